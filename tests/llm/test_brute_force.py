"""Operators against plain restatements of what they compute, on small tables."""

import collections
import glob
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import decontaminate, fingerprints, jaccard_join, lang_id, license_scan, line_templates, lm_score, mixing, substring_dedup, token_store
from tapewright.llm.common import components
from tapewright.llm.queries import QUERIES, vocabulary
from tests.conftest import DATA
from tests.llm.conftest import frame, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_substring_dedup(spark, docs, rows):
    parts = {d: substring_dedup.sentences(t) for d, t in rows}

    def runs(p):
        """(first sentence, end, words) of each run: three sentences, and more until there are ten words."""
        size = [len(x[2].split()) for x in p]
        for i in range(len(p) - 2):
            if end := next((j for j in range(i + 3, len(p) + 1) if sum(size[i:j]) >= substring_dedup.MIN_WORDS), None):
                yield i, end, tuple(x[2] for x in p[i:end])

    first = {}
    for d, p in parts.items():
        for i, _, run in runs(p):
            first.setdefault(run, (d, i))
    want = {}
    for d, p in parts.items():
        gone = {k for i, end, run in runs(p) if first[run] != (d, i) for k in range(i, end)}
        want[d] = (len(p), len(gone))
    got = {r.doc_id: r for r in QUERIES["op1_substring_dedup"](spark, DATA).collect()}
    assert {d: (r.n_sentences, r.n_removed) for d, r in got.items()} == want
    assert sum(n for _, n in want.values()) > 0
    for d, t in rows:
        left = "".join(t[a:b] for a, b in zip([0, *(e for _, e in got[d].removed)], [*(s for s, _ in got[d].removed), len(t)]))
        assert left == got[d].clean_text


def test_planted_passage_is_cut_once(spark, rng):
    passage = ". ".join(words(rng, 9).capitalize() for _ in range(7)) + "."
    docs = [(i, f"{words(rng, 30)}.\n{passage}\n{words(rng, 20)}.") for i in range(6)] + [(10, words(rng, 80) + ".")]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, docs)).collect()}
    assert got[0].n_removed == got[10].n_removed == 0
    assert all(passage not in got[i].clean_text and got[i].n_removed == 7 for i in range(1, 6))


def test_repeated_short_sentences_and_long_ones_at_any_offset(spark, rng):
    listed = "\n".join(words(rng, 1) for _ in range(40))
    flat = words(rng, 200)
    docs = [(i, f"{words(rng, 12)}.\n{listed}\n{words(rng, 15)}.") for i in range(2)]
    docs += [(10 + i, f"{words(rng, 30 + 5 * i)} {flat} {words(rng, 20)}") for i in range(4)]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, docs)).collect()}
    assert got[0].n_removed == got[10].n_removed == 0
    assert got[1].n_removed == 40 and listed not in got[1].clean_text
    assert all(sum(w in got[i].clean_text.split() for w in set(flat.split())) < 40 for i in (11, 12, 13))


def test_passages_among_rows_without_an_id(spark, rng):
    passage = ". ".join(words(rng, 9) for _ in range(6)) + "."
    docs = [(None, f"{words(rng, 20)}.\n{passage}") for _ in range(4)] + [(None, passage)] * 2
    got = substring_dedup.dedup(frame(spark, docs)).collect()
    # One text keeps the passage, whichever hashes least; equal rows fare alike.
    assert sum(passage in r.clean_text for r in got) in (1, 2) and len(got) == 6
    assert sorted(substring_dedup.dedup(frame(spark, docs)).collect()) == sorted(got)


def test_runs_take_in_what_they_need(rng):
    parts = [(0, 0, words(rng, rng.choice([1, 2, 9]))) for _ in range(60)]
    at, h, n = substring_dedup.run_hashes(parts)
    size = [len(p[2].split()) for p in parts]
    want = {a: next((j - a for j in range(a + 3, 61) if sum(size[a:j]) >= 10), 0) for a in range(58)}
    assert dict(zip(at.tolist(), n.tolist())) == {a: k for a, k in want.items() if k}
    again, g, k = substring_dedup.run_hashes(parts[7:])
    assert dict(zip((again + 7).tolist(), g.tolist())) == {a: x for a, x in zip(at.tolist(), h.tolist()) if a >= 7}


def test_language_accuracy(spark, docs):
    found = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_ignores_labels_of_held_out(spark, docs):
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")))
    assert sorted(lang_id.identify(blind).collect()) == sorted(lang_id.identify(docs).collect())


def test_hypervectors_match_plain_binding():
    text = "Ab, éé x"
    symbols = "ab éé x"
    want = np.zeros(lang_id.DIM)
    for i in range(len(symbols) - 2):
        v = np.ones(lang_id.DIM)
        for k, c in enumerate(symbols[i : i + 3]):
            v = v * np.roll(lang_id.letter_vector(ord(c)), 2 - k)
        want += v
    assert (lang_id.bundle([text], np.array([0]), 1)[0] == want).all()
    long = ("abc d" * 40_000 + "x,.! " * 7 + "." * 300_000 + "yz ") * 5
    pieces = lang_id.bundle([long], np.array([0]), 1)[0]
    counts, vectors = lang_id.gram_counts([long], np.array([0]), 1)
    assert np.abs(pieces - (counts @ vectors)[0]).max() < 1e-2


def test_decontamination(spark, rng):
    items = [(i, words(rng, 40)) for i in range(20)] + [(90, words(rng, 7))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, want = [], set()
    for i, (item, text) in enumerate(items):
        w = text.split()
        for k in range(len(w) // 12):
            w[rng.randrange(12 * k, 12 * k + 12)] = "other"  # a substitution in every dozen
        docs.append((i, f"{words(rng, 50)} {' '.join(w)} {words(rng, 30)}"))
        want.add((i, item))
    items += [(91, "yes"), (92, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs += [(300, "Yes!"), (301, "yes yes"), (302, "A, b c"), (303, "a b")]
    want |= {(300, 91), (302, 92)}
    docs += [(100 + i, words(rng, 200)) for i in range(20)] + [(200, "see: " + items[3][1].upper().replace(" ", ", "))]
    want.add((200, 3))
    table = frame(spark, docs)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table, bench).collect()}
    assert set(got) == want
    assert got[200, 3].n_same == got[200, 3].n_overlap == 40 and got[200, 3].first_token == 1
    split = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench, pass_tokens=100).collect()}
    assert split == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(table, bench, pass_tokens=100).collect()} == {*range(100, 120), 301, 303}


def test_every_overlap_with_enough_agreement_is_found(rng):
    share, least = decontaminate.IDENTITY, decontaminate.MIN_TOKENS

    def plain(x, y):
        for shift in range(1 - len(y), len(x)):
            same = [x[i + shift] == w if 0 <= i + shift < len(x) else None for i, w in enumerate(y)]
            for a in range(len(y)):
                for b in range(a + 1, len(y) + 1):
                    part = same[a:b]
                    if None not in part and sum(part) >= share * (b - a) - 1e-9 and sum(part) >= min(least, share * len(y)) - 1e-9:
                        return True
        return False

    def hit(x, y):
        return bool(decontaminate.Index([(1, " ".join(y))]).overlaps(" ".join(x)))

    for n in (5, 7, 10, 15, 16, 20, 40):
        y = words(rng, n).split()
        for subs in range(n // 3 + 1):
            for _ in range(12):
                gone = rng.sample(range(n), subs)
                x = [*words(rng, 8).split(), *(f"other{i}" if i in gone else w for i, w in enumerate(y)), *words(rng, 8).split()]
                assert hit(x, y) == plain(x, y), (n, gone)
                if subs <= n * (1 - share) + 1e-9:
                    assert hit(x, y), (n, gone)
    for n in (15, 16):
        y = words(rng, n).split()
        assert all(hit([*y[:k], "other", *y[k + 1 :]], y) for k in range(n))
    y = words(rng, 40).split()
    assert hit([f"other{i}" if i % 5 == 4 else w for i, w in enumerate(y)], y)


def test_masks_hit_every_pattern_of_substitutions():
    for n in (5, 6, 8, 10, 13, 15, 16, 17):
        some = decontaminate.masks(decontaminate.weight(n))
        for gone in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(4)):
            agree = [i not in gone for i in range(n)]
            best = max((sum(agree[a:b]) for a in range(n) for b in range(a + 1, n + 1) if sum(agree[a:b]) >= 0.8 * (b - a) - 1e-9), default=0)
            if best >= decontaminate.bar(n):
                assert any(all(agree[a + o] for o in m) for m in some for a in range(n - m[-1])), (n, gone)
    assert any(len(m) <= m[-1] for m in decontaminate.masks(decontaminate.weight(20)))


def test_many_short_items_that_begin_alike(rng):
    lead = "what is the"
    index = decontaminate.Index([(i, f"{lead} {words(rng, 3)}") for i in range(20_000)])
    text = " ".join(f"{lead} {words(rng, 2)}" for _ in range(400))
    start = time.time()
    assert index.overlaps(text) == []
    assert time.time() - start < 0.5


def test_decontamination_query(spark, rows):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.n_same for r in QUERIES["op3_decontamination"](spark, DATA).collect()}
    items = {i: jaccard_join.words_of(t) for i, t in bench}
    want = {}
    for d, t in rows:
        x = jaccard_join.words_of(t)
        where = collections.defaultdict(list)
        for k, w in enumerate(x):
            where[w].append(k)
        for i, y in items.items():
            for shift, n in collections.Counter(k - j for j, w in enumerate(y) for k in where.get(w, ())).items():
                if n < decontaminate.bar(len(y)):
                    continue
                same = [0 <= j + shift < len(x) and x[j + shift] == w for j, w in enumerate(y)]
                inside = [j for j in range(len(y)) if 0 <= j + shift < len(x)]
                upto = [0, *itertools.accumulate(same)]
                best = max(upto[b + 1] - upto[a] for a in inside for b in inside if b >= a and upto[b + 1] - upto[a] >= 0.8 * (b + 1 - a) - 1e-9)
                if best >= decontaminate.bar(len(y)):
                    want[d, i] = max(want.get((d, i), 0), best)
    assert got == want and want


def grams(text):
    w = jaccard_join.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check_join(found, rows):
    sets = {d: frozenset(grams(t or "")) for d, t in rows}
    classes = collections.defaultdict(list)
    for d, s in sets.items():
        if s:
            classes[s].append(d)
    links = {s: {o for o in classes if o != s and len(s & o) / len(s | o) >= 0.8} for s in classes}
    group = {}
    for s in classes:
        todo, seen = [s], {s}
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        group[s] = min(d for o in seen for d in classes[o])
    for r in found:
        s = sets[r._llm_id]
        assert (r.class_id, r.copies, r.n_links) == ((group[s], len(classes[s]), len(links[s])) if s else (r._llm_id, 1, 0)), r


def test_jaccard_join(spark, docs, rows):
    check_join(jaccard_join.join(docs).collect(), rows)


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join_large_groups(spark, rng, block):
    base = [words(rng, 120).split() for _ in range(3)]
    docs = [(i, " ".join(base[0])) for i in range(30)]
    for i in range(60):
        w = list(base[i % 2])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        docs.append((100 + i, " ".join(w)))
    docs += [(500 + i, words(rng, 100)) for i in range(20)] + [(600, ""), (601, "a b"), (602, "a b"), (603, None)]
    check_join(jaccard_join.join(frame(spark, docs), block=block).collect(), docs)


def test_bands_reach_the_recall():
    b = jaccard_join.bands_for(0.8, 0.9999, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.9999 > 1 - (1 - 0.8**6) ** (b - 1)


def test_line_templates(spark, rng):
    docs = [(i, f"{words(rng, 12)}\nlogin of user u{i} from host{rng.randrange(99)} ok\n{words(rng, 9)}\nplease call {words(rng, 1)} about this notice") for i in range(12)]
    docs += [(50, "login of user bob from here ok"), (51, "Only one line"), (52, "Only one line")]
    got = {r.doc_id: r for r in line_templates.dedup(frame(spark, docs)).collect()}
    assert all(got[i].n_dropped == 2 and got[i].n_lines == 4 for i in range(12))
    assert all("login" not in got[i].clean_text and "notice" not in got[i].clean_text for i in range(12))
    assert [got[i].n_dropped for i in (50, 51, 52)] == [1, 0, 0]


def test_short_lines_that_recur(spark, rng):
    docs = [(i, f"{words(rng, 8)}\nRead more\nPage {i} of 9\n{i}\nLes.\n{words(rng, 5)}") for i in range(4)] + [(9, "Read more\nonce"), (10, "7\n\nonce upon")]
    got = {r.doc_id: r for r in line_templates.dedup(frame(spark, docs)).collect()}
    assert [got[i].n_dropped for i in (0, 1, 2, 3, 9, 10)] == [3, 3, 3, 3, 1, 0]
    assert got[2].clean_text.split("\n")[1] == "2" and got[9].clean_text == "once"


def test_line_templates_match_plain_tree(spark, docs, rows):
    lines = {(d, i): tuple(line_templates.masked(x)) for d, t in rows for i, x in enumerate(t.split("\n"))}
    lines = {k: w for k, w in lines.items() if len(w) >= 3}
    leaf = lambda w: (len(w), w[: line_templates.LEAD])
    at = collections.defaultdict(set)
    reach = collections.defaultdict(set)
    for (d, _), w in lines.items():
        reach[leaf(w)].add(d)
        for p, x in enumerate(w):
            at[leaf(w), p, x].add(d)

    def template(w):
        out = tuple(x if x != "<*>" and len(at[leaf(w), p, x]) >= 3 else "<*>" for p, x in enumerate(w))
        fixed = sum(x != "<*>" for x in out)
        return out if fixed >= len(w) / 2 and fixed >= 3 and len(reach[leaf(w)]) >= 3 else None

    docs_of = collections.defaultdict(set)
    for (d, _), w in lines.items():
        if template(w):
            docs_of[template(w)].add(d)
    every = {(d, i): tuple(line_templates.masked(x)) for d, t in rows for i, x in enumerate(t.split("\n"))}
    equal = collections.defaultdict(set)
    for (d, _), w in every.items():
        equal[w].add(d)
    recurs = lambda w: any(x != "<*>" for x in w) and len(equal[w]) >= 3
    want = collections.Counter(d for (d, _), w in every.items() if recurs(w) or len(w) >= 3 and template(w) and len(docs_of[template(w)]) >= 3)
    got = {r.doc_id: r.n_dropped for r in QUERIES["op5_line_templates"](spark, DATA).collect()}
    assert got == {d: want[d] for d, _ in rows} and sum(want.values()) > 0


@pytest.mark.parametrize("n, values", [(100, 100), (1000, 100), (3000, 100), (2000, 2)])
def test_line_templates_hold_in_larger_corpora(spark, rng, n, values):
    fields = 2 if values > 2 else 10
    field = lambda: " ".join("v" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10] for k in (rng.randrange(values) for _ in range(fields)))
    fixed = "every name of the users is here now and then gone"
    docs = [(i, f"{fixed} {field()}\n{words(rng, 9)}") for i in range(n)]
    got = line_templates.dedup(frame(spark, docs)).groupBy("n_dropped").count().collect()
    assert [(r.n_dropped, r["count"]) for r in got] == [(1, n)]


def test_line_templates_of_leaves_in_parts(spark, docs, rng):
    """Leaves counted in parts of any size, over several tasks, drop what whole leaves drop."""
    field = lambda k: " ".join("v" + "abcdefghij"[rng.randrange(k)] for _ in range(3))
    more = frame(spark, [(10**6 + i, f"every name of the users is here {field(9)}\nall of it goes {field(3)} and so on\n{words(rng, 9)}") for i in range(300)])
    both = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text")).repartition(7)
    want = line_templates.dedup(both).orderBy("doc_id").collect()
    assert sum(r.n_dropped for r in want) > 600
    for leaf_words in (0, 50):
        assert line_templates.dedup(both, leaf_words=leaf_words).orderBy("doc_id").collect() == want


def test_line_templates_leave_no_shuffle_files(spark, rng):
    """The disk of one step is free before the next, whenever the driver collects its garbage."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in folders for p in glob.glob(f"{d}/*/shuffle_*.data")}
    docs = frame(spark, [(i, f"every name of the users is here {words(rng, 2)} now\n{words(rng, 9)}") for i in range(200)]).repartition(3).select("doc_id", "text")
    docs.count()
    before = files()
    _, drops = line_templates.recurring(line_templates.identified(docs))
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.5)
    assert not files() - before
    assert drops.count() == 200


def test_language_model(spark, docs, rows):
    tok = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for d, t in rows}
    one, two = collections.Counter(), collections.Counter()
    for d, w in tok.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    got = {r.doc_id: r for r in QUERIES["op6_lm_score"](spark, DATA).collect()}
    assert len(got) == len(rows)
    # The learned weights, found again by plain expectation maximisation on deleted counts.
    held = collections.defaultdict(list)
    for d, w in tok.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for a, b in zip([None, *w], w):
                c1 = one[a] - 1
                held[lm_score.bucket(np.array([c1]))[0]].append((1.0, (one[b] - 1) / (n - 1) * (v + 1), (two[a, b] - 1) / c1 * (v + 1) if c1 else 0.0))
    weights = {}
    for k, p in held.items():
        p, lam = np.array(p), np.array([0.2, 0.4, 0.4] if k else [0.5, 0.5, 0])
        for _ in range(200):
            each = p * lam
            lam = (each / each.sum(1, keepdims=True)).mean(0)
        weights[k] = lam
    model_gap = []
    for d, w in tok.items():
        assert abs(got[d].base_score - sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(w), sum(one[x] > 0 for x in w), n)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
        score = 0.0
        for a, b in zip([None, *w], w):
            lam = weights.get(lm_score.bucket(np.array([one[a]]))[0])
            if lam is None:
                break
            score += math.log10(lam @ [1 / (v + 1), one[b] / n, two[a, b] / one[a] if one[a] else 0])
        else:
            model_gap.append(abs(score - got[d].score) / len(w))
    assert len(model_gap) > 100 and max(model_gap) < 0.02
    held_rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_language_model_of_unstored_rows(spark, docs):
    a = lm_score.score(docs)
    b = lm_score.score(docs.repartition(3).withColumn("text", F.concat("text", F.lit(""))).unionByName(docs.limit(0)))
    left, right = ({r.doc_id: r for r in x.collect()} for x in (a, b))
    assert all(abs(left[d].score - right[d].score) < 1e-6 for d in left) and left.keys() == right.keys()


def test_token_file(spark, docs, rows):
    from tokenizers import Tokenizer

    tk, start = Tokenizer.from_file(vocabulary()), 0
    got = {r.doc_id: tuple(r) for r in QUERIES["op7_token_store"](spark, DATA).collect()}
    for d, t in rows:
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        assert got[d] == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


PIECES = ["a", "word", " ", "  ", "\n", "\t", ".", ",", "..", "'s", "12", "été", "中", "!", " .", "\r", "\x1c", "<|endoftext|>", " ", "…", "###", "\0", "I'll"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=5))
def test_pieces_encode_as_whole_texts(texts):
    got = token_store.encoder(vocabulary()).encode([t.encode() for t in texts])
    tk = token_store.encoder(vocabulary()).tokenizer
    assert [list(map(int, x)) for x in got] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 300_000), st.integers(1, 500), st.integers(0, 9))
def test_coder_round_trip(n, vocab, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % vocab).astype(np.uint32)
    token, count = np.unique(ids, return_counts=True)
    table = token_store.scaled(token.astype(np.int64), count)
    assert len(token) == 0 or table.freq.sum() == 1 << token_store.PRECISION
    payload = token_store.encode_segment(ids, table)
    assert (token_store.decode_segment(payload, table) == ids).all()
    if n > 5000 and vocab > 50:
        broken = bytearray(payload)
        broken[4 + 16 * -(-n // token_store.BLOCK) + 1] ^= 255  # in the first lane's state
        with pytest.raises((ValueError, IndexError)):
            token_store.decode_segment(bytes(broken), table)


def test_coder_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 1 << 18) % 5000).astype(np.uint32)
    token, count = np.unique(ids, return_counts=True)
    bits = -(count * np.log2(count / count.sum())).sum()
    size = len(token_store.encode_segment(ids, token_store.scaled(token.astype(np.int64), count)))
    assert size * 8 < bits * 1.01 + 2 * token_store.LANES * 64 + 1000


def test_mixing(spark, rng):
    docs = [(i, words(rng, rng.randint(1, 60)), None, s) for i, s in enumerate(["a"] * 300 + ["b"] * 150 + ["c"] * 40 + [None] * 120)]
    rows = mixing.per_row(mixing.mixed(frame(spark, docs))).collect()
    assert sorted(rows) == sorted(mixing.per_row(mixing.mixed(frame(spark, docs).repartition(5))).collect())
    size = collections.Counter()
    for _, t, _, s in docs:
        size[s] += len(t.split())
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    target = dict.fromkeys(size, 0.0)
    free, rest = set(size), float(sum(size.values()))
    while free:
        share = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > 3 * size[s]}
        for s in full or free:
            target[s] = 3.0 * size[s] if full else weight[s] * share
        if not full:
            break
        rest -= sum(3.0 * size[s] for s in full)
        free -= full
    taken = collections.Counter()
    for r in rows:
        s = docs[r.doc_id][3]
        assert r.size == len(docs[r.doc_id][1].split()) and r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 5 for s in size)


def test_pareto_sampling_keeps_inclusion_odds(spark, rng):
    sizes = [4, 16, 64, 256]
    docs = [(i, " ".join(["w"] * sizes[i // 2 % 4]), None, "ab"[i % 2]) for i in range(1600)]
    table = frame(spark, docs)
    hits = collections.Counter()
    for seed in range(5):
        for r in mixing.per_row(mixing.mixed(table, seed=seed, weights=(3.0, 5.0))).collect():
            hits[r.doc_id] += r.taken // r.size
    total = sum(sizes[i // 2 % 4] for i in range(1600))
    for source, weight in (("a", 3.0), ("b", 5.0)):
        mean = weight / 8 * total / (total / 2)
        sure, p = math.floor(mean), mean - math.floor(mean)
        score = {n: math.floor(1024 * n / (n + 64)) / 1024 for n in sizes}
        middle = sum(n * score[n] for n in sizes) / sum(sizes)
        for n in sizes:
            want = sure + p + min(p, 1 - p) * (score[n] - middle)
            seen = np.mean([hits[i] for i, t, _, s in docs if s == source and len(t.split()) == n]) / 5
            assert abs(seen - want) < 0.06, (source, n, seen, want)
    # Odds differ: long documents come more often.
    assert hits[6] + hits[14] + hits[22] + hits[30] > hits[0] + hits[8] + hits[16] + hits[24]


def test_license_scan(spark, rng):
    texts = dict(license_scan.TEMPLATES)
    docs = [(i, f"{words(rng, 40)}\n{t}\n{words(rng, 25)}") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    w = texts["mit"].split()
    w[10] = "other"
    docs += [(50, " ".join(w)), (51, texts["gpl"] + " and " + texts["bsd"]), (60, words(rng, 300)), (61, "the License and this work is free")]
    got = {(r.doc_id, r.license_id) for r in license_scan.scan(frame(spark, docs), license_scan.templates(spark)).collect()}

    def toks(t):
        return re.findall(r"[^\W_]+", t.lower())

    want = set()
    for d, t in docs:
        for name, template in license_scan.TEMPLATES:
            n = min(5, len(toks(template)))
            a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (toks(t), toks(template)))
            if len(set(a) & set(b)) >= 0.8 * len(set(b)):
                want.add((d, name))
    assert got == want and {(i, name) for i, (name, _) in enumerate(license_scan.TEMPLATES)} <= got and (50, "mit") in got


def test_license_scan_of_documents(spark, docs, rows):
    got = {(r.doc_id, r.license_id) for r in QUERIES["op9_license_scan"](spark, DATA).collect()}
    want = {(d, name) for d, t in rows for name, template in license_scan.TEMPLATES if re.search(r"\W+".join(re.findall(r"\w+", template)), t, re.I)}
    assert got == want


def plain_prints(texts):
    """Fingerprint of any text and likeness, in plain Python, by the terms of these texts."""
    n = len(texts)
    df = collections.Counter(w for t in texts for w in set(jaccard_join.words_of(t)))
    band = {w for w, k in df.items() if max(2, fingerprints.RARE * n) <= k <= fingerprints.COMMON * n}
    h = lambda w: xxhash.xxh3_64_intdigest(w)
    above = sorted((w for w, k in df.items() if k > fingerprints.COMMON * n and k >= max(2, fingerprints.RARE * n)), key=lambda w: (df[w], h(w)))
    place = {w: i for i, w in enumerate(above)}
    odds = [1 << (k + 1) for k, m in enumerate(fingerprints.SUBSETS) for _ in range(m)]

    def fp(text):
        words = set(jaccard_join.words_of(text))
        mine = words & band
        if len(mine) < 64:
            mine |= set(sorted(words & place.keys(), key=place.get)[:64])
        if len(mine) < 16:
            mine = words
        hashes = sorted(map(h, mine))
        out = []
        for mul, odd in zip(fingerprints._MUL.tolist(), odds):
            some = [x for x in hashes if (x * mul) % 2**64 < 2**64 // odd]
            out.append(xxhash.xxh3_64_hexdigest(b"".join(x.to_bytes(8, "little") for x in some))[:8] if some else "0" * 8)
        return out

    def like(a, b):
        used = [(x, y) for x, y in zip(a, b) if (x, y) != ("0" * 8, "0" * 8)]
        return 1.0 if a == b else sum(x == y for x, y in used) / len(used) if used else 0.0

    return fp, like


def test_fingerprints(spark, docs, rows):
    fp, like = plain_prints([t for _, t in rows])
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(fp, (t, edited, after))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(a), "".join(b))
        assert (r.near_edited, r.near_next) == (like(a, b), like(a, c))
    assert np.mean([r.near_edited for r in got.values()]) > 20 * np.mean([r.near_next for r in got.values()])


def test_fingerprints_of_copies_and_edits(spark, rng):
    base = words(rng, 300).split()
    pool = base + words(rng, 2000).split()
    docs = [(i, " ".join(rng.choices(pool, k=200))) for i in range(60)] + [(100, " ".join(base)), (101, " ".join(base)), (102, " ".join([*base[:-2], "xx", "yy"]))]
    got = {r.doc_id: bytes.fromhex(r.fingerprint) for r in fingerprints.compare(frame(spark, docs)).collect()}
    assert got[100] == got[101]
    assert fingerprints.likeness(got[100], got[102]) > 0.6 > fingerprints.likeness(got[100], got[0])


@pytest.mark.parametrize("copies", [5, 100])
def test_fingerprints_of_a_large_group_of_near_copies(spark, rng, copies):
    vocab = words(rng, 4000).split()
    base = rng.choices(vocab, k=200)
    docs = [(i, " ".join(rng.choices(vocab, k=200))) for i in range(200)]
    for i in range(copies):
        w = list(base)
        for k in rng.sample(range(200), 4):
            w[k] = rng.choice(vocab)
        docs.append((1000 + i, " ".join(w)))
    got = {r.doc_id: bytes.fromhex(r.fingerprint) for r in fingerprints.compare(frame(spark, docs)).collect()}
    group = [v for d, v in got.items() if d >= 1000]
    pairs = [(group[i], group[i + 1]) for i in range(len(group) - 1)]
    assert np.mean([fingerprints.likeness(a, b) for a, b in pairs]) > 0.5
    assert np.mean([fingerprints.likeness(group[0], got[d]) for d in range(60)]) < 0.05
