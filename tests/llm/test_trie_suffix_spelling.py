"""Prefix trie, suffix dedup and spelling variants against plain restatements, on the registered queries and on small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import prefix_trie, spelling, suffix_dedup
from tapewright.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import frame, odd_rows, words

TURNS = "conv_id long, turn long, role string, text string"


def plain_nodes(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((-(10**18) if turn is None else turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, below = collections.defaultdict(list), collections.defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            below[p[:-1]].add(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        size = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * size + sum(saved[k] for k in below[p])
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(below[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def found_nodes(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_nodes(QUERIES["op11_prefix_trie"](spark, DATA)) == plain_nodes(rows)


@pytest.mark.parametrize("batches", [(1.0,), (0.3, 1.0), (0.1, 0.3, 0.6, 1.0)])
def test_prefix_trie_of_shared_prefixes(spark, rng, batches):
    # Long common prefixes, ends inside edges, several cuts of one edge, equal conversations, and one hot first turn.
    trunk = [("user", f"turn {i} of the trunk") for i in range(70)]
    rows = []
    for c in range(260):
        kind = c % 4
        turns = trunk[: rng.choice([1, 2, 3, 5, 8, 30, 33, 64, 70])] if kind else [("user", f"own {rng.randrange(9)}")]
        turns = turns + [("bot", f"word {rng.randrange(3)} a b")] * rng.randrange(3)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    assert found_nodes(prefix_trie.trie(table, batches)) == plain_nodes(rows)


def test_prefix_trie_of_odd_rows(spark, rng):
    long = words(rng, 30_000)
    rows = [(1, None, None, None), (1, 0, "user", long), (1, 0, "user", long), (2, 1, "", ""), (3, 5, "user", long), (20, 1, "user", None), (21, 1, "user", ""),
            (-7, 2, "bot", "a"), (-7, 1, None, "b c"), (5000, 0, "x", "y"), (5000, 0, "x", "y"), (5020, 0, "x", "y"), (5020, 1, "x", "y")]
    table = spark.createDataFrame(rows + [(None, 1, "user", "lost")], TURNS)
    for c in ("key", "path", "sid", "ups", "depth", "turns", "a", "b", "r", "n"):
        table = table.withColumn(c, F.lit("x"))
    # Spark's remainder keeps the sign.
    assert [r[0] for r in found_nodes(prefix_trie.trie(table)) if r[1] == 0] == [-7]
    assert found_nodes(prefix_trie.trie(table.filter("conv_id > 0"))) == plain_nodes([r for r in rows if r[0] > 0])
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_long_list_of_ends(spark):
    ids = [*range(9000), 10**12, 10**12 + 1]
    got = {(r.key.a, r.ends_sha256) for r in prefix_trie.ends_digests(spark.createDataFrame([((1, 2), i) for i in ids] + [((3, 4), 5)], "key struct<a:long,b:long>, conv_id long").repartition(7)).collect()}
    assert got == {(1, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), (3, hashlib.sha256(b"5").hexdigest())}


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(-1, 40) for b in range(max(a + 1, 1), 41) if a >= 0]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def plain_removal(rows):
    order = {r: (1, zlib.crc32((r[1] or "").encode())) if r[0] is None else (0, r[0]) for r in rows}
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, (2, 0)), order[r])
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order[d, t]:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(df):
    got = df.select("doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0]), F.size("removed").cast("long"), F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=str)


def test_suffix_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = plain_removal(rows)
    assert sorted(map(tuple, QUERIES["op12_suffix_dedup"](spark, DATA).collect()), key=str) == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("frequent", [4096, 3])
def test_suffix_dedup_of_passages(spark, rng, frequent):
    # Overlapping passages, passages of 49 to 52 bytes, one in a third of the documents, loops, cut characters.
    common, other = words(rng, 40), words(rng, 60)
    rows = [(i, f"{words(rng, 12)} {common[rng.randrange(9) :] if i % 3 else words(rng, 4)} {words(rng, 6)}") for i in range(90)]
    rows += [(100 + i, f"{words(rng, 5)}|{other[i : 49 + 2 * i]}|{words(rng, 5)}") for i in range(60)]
    rows += [(200, "ab" * 900), (201, "ab" * 700), (202, "x" * 3000), (203, "x" * 50), (204, "x" * 49), (205, "é中" * 40), (206, "中é" * 30), (207, "é中" * 40)]
    assert removal(suffix_dedup.dedup(frame(spark, rows).repartition(3), frequent=frequent, piece=3000)) == plain_removal(rows)


def test_suffix_dedup_of_odd_rows(spark, rng):
    rows = odd_rows(rng)
    docs = frame(spark, rows)
    for c in ("piece", "part", "at", "keys", "block", "kept", "removed", "n_bytes", "_llm_id", "_llm_th"):
        docs = docs.withColumn(c, F.lit("x"))
    got = suffix_dedup.dedup(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_bytes, sum(b - a for a, b in r.removed)))
    assert by[5][0][0] == by[5][0][1] > 100_000 and by[4][0][1] == 0 and by[8] == [by[8][0]] * 2 or len({n for n, _ in by[8]}) == 2
    assert all(m == 0 for d in (None, 1, 2, 3, 6, 7, 8, 9, -5) for _, m in by[d])
    # Null ids follow all others; of two equal texts without an id neither is first.
    passage = words(rng, 30)
    lost = suffix_dedup.dedup(frame(spark, [(None, passage), (None, passage), (7, passage), (None, passage + " " + words(rng, 3))])).collect()
    assert sorted((r.doc_id is None, bool(r.removed)) for r in lost) == [(False, False), (True, True), (True, True), (True, True)]
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=12), st.integers(1, 20))
def test_backward_extension_finds_the_classes(texts, least):
    flat = np.frombuffer(b"\xff".join(t.encode() for t in texts) + b"\xff", np.uint8)
    sa, new = suffix_dedup.equal_windows(flat, least)
    round_ = bytes(flat) * (least // len(flat) + 2)
    sorted_ = [round_[i : i + least] for i in sa.tolist()]
    assert sorted(sa.tolist()) == list(range(len(flat))) and sorted_ == sorted(sorted_)
    assert new.tolist() == [i == 0 or sorted_[i] != sorted_[i - 1] for i in range(len(sa))]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400).map(lambda b: bytes(x % 3 + 97 for x in b)), st.lists(st.integers(0, 400), max_size=4))
def test_equal_windows_have_equal_anchors(data, cuts):
    edges = np.array(sorted({0, len(data), *(c for c in cuts if c < len(data))}), np.int64)
    doc, start, n, key = suffix_dedup.stretches(np.frombuffer(data, np.uint8), edges)
    seen, windows = {}, []
    for d, s, m, k in zip(doc, start, n, key):
        for w in range(s, s + m):
            windows.append(w)
            assert edges[d] <= w and w + 50 <= edges[d + 1] and seen.setdefault(data[w : w + 50], k) == k
    assert windows == [w for a, b in zip(edges, edges[1:]) for w in range(a, b - 49)]


def plain_variants(rows, least=5, times=5, slip=199):
    count = collections.Counter()
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % slip == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            count[w] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 6 and n >= least}
    by_gap = collections.defaultdict(set)
    for w in vocab:
        by_gap[w].add(w)
        for i in range(len(w)):
            by_gap[w[:i], w[i + 1 :]].add(w)
    letters = {c for w in vocab for c in w}
    form, out = {}, []
    for w, n in vocab.items():
        near = {x for i in range(len(w)) for x in by_gap.get((w[:i], w[i + 1 :]), ())} | {w[:i] + w[i + 1 :] for i in range(len(w))} & vocab.keys()
        near |= {x for i in range(len(w) + 1) for c in letters if (x := w[:i] + c + w[i:]) in vocab}
        near.discard(w)
        best = min(near, key=lambda x: (-vocab[x], x)) if near else None
        form[w] = best if best and vocab[best] >= times * n else None
        out.append([w, form[w], w, n, len(near), vocab[best] if form[w] else None])
    for r in out:
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, out))


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = plain_variants(rows)
    assert sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, DATA).collect())) == want
    assert any(r[1] for r in want)


def test_spelling_chains_ties_and_passes(spark, rng):
    times = {"aaaaaaaa": 700, "aaaaaaab": 130, "aaaaaabb": 25, "aaaaabb": 5, "aaaaabbb": 5, "zzzzzz": 300, "zzzzzzz": 300, "zzyzzzz": 40, "éèêëàâ": 60, "éèêëàa": 9, "x" * 300: 30, "x" * 301: 5,
             "Zzzzzzq": 7, "A" * 8: 10, "ÀÀÀÀÀÀ": 30, "àÀÀÀÀÀ": 5, "seldom": 4, "short": 50}
    pool = [w for w, n in times.items() for _ in range(n)]
    rng.shuffle(pool)
    rows = [(i, " ".join(pool[i::40]) + ".") for i in range(40)] + [(None, "seldom,seldom"), (None, None), (50, ""), (50, "zzzzzz"), (50, "zzzzzz")]
    docs = frame(spark, rows).withColumn("word", F.lit("x")).withColumn("n", F.lit("x")).withColumn("d", F.lit("x"))
    want = plain_variants(rows)
    assert {r[0]: r[2] for r in want}["aaaaabb"] == "aaaaaaaa"
    assert sorted(map(tuple, spelling.variants(docs).collect())) == want
    assert sorted(map(tuple, spelling.variants(docs, pass_words=4).collect())) == want
    assert spelling.variants(frame(spark, [])).count() == 0
    odd = odd_rows(rng)
    assert sorted(map(tuple, spelling.variants(frame(spark, odd), least=2).collect())) == plain_variants(odd, least=2)


def test_filters_miss_nothing_and_pass_little(spark, rng):
    vocab = list({words(rng, 1) for _ in range(4000)})
    found = spelling.filters(spark.createDataFrame([(w,) for w in vocab], "word string"))
    other = [w for w in {words(rng, 1) for _ in range(20_000)} if w not in set(vocab)]
    share = []
    for group in (vocab, other):
        hits = n = 0
        for k, at in spelling.by_length(group):
            h = np.bitwise_xor.reduce(spelling.at_places(spelling.letters_of([group[i] for i in at]), np.arange(k)), 1)
            hits, n = hits + int(found.holds(k, h).sum()), n + len(at)
        share.append(hits / n)
    assert share[0] == 1 and share[1] < 0.01
