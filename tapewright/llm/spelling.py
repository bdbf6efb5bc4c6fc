"""Spelling variants: the vocabulary's words one edit apart, found through Bloom filters.

1. Words are counted over all documents; frequent enough ones are the vocabulary.
2. Its words go to Bloom filters, one per word length, whose blocks are single
   64-bit numbers. Each filter is built in ranges of blocks by separate tasks.
   A pass holds the filters of a bounded share of the vocabulary.
3. Every deletion and replacement of a word's letters is hashed without being
   spelled out, and probed. Only what the filters let through is spelled,
   shuffled and joined with the vocabulary, which removes false positives.
   Insertions are deletions seen from the other word.
4. A word's form is its most frequent neighbour, if that is much more frequent.
   Forms grow in frequency, so chains are short; their ends are found by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, slices, stored

#: A word counts from so many letters and occurrences; a form has so many times the word's occurrences.
LETTERS, LEAST, TIMES = 6, 5, 5
#: One in SLIP occurrences by document and word loses a letter.
SLIP = 199
#: Words in one pass's filters, bits per word, bits set per word, blocks (of 64 bits) built by one task.
PASS_WORDS, WORD_BITS, HASHES, RANGE = 16_000_000, 24, 6, 1 << 17
#: Words counted before a task hands them on; edits hashed together.
ENTRIES, TOGETHER = 1 << 18, 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, slip: int = SLIP) -> DataFrame:
    """Rows word, n: partial counts of the words with enough letters; A-Z in lower case, with the slips of the contract of `variants`."""
    run = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for d, text in zip(batch.column("d").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if d is None else d}:".encode())
                # Lower-casing bytes changes A-Z only.
                for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % slip:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < letters:
                            continue
                    total[word] += n
                if len(total) >= ENTRIES:
                    yield out()
                    total.clear()
        if total:
            yield out()

    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(work, "word string, n bigint")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, slip: int = SLIP) -> DataFrame:
    """Rows word, n of the words that occur often enough in all documents together."""
    return counted(docs, id_col, text_col, slip=slip).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MULTIPLY
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def at_places(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of a letter at a place; a word's hash is the exclusive or over its places."""
    return _mix(codes.astype(np.uint64) * np.uint64(0x100000001B3) + places.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def letters_of(words: list[str]) -> np.ndarray:
    """Code points, a row for each of the words, which are of one length."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places in the list) of the words of each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for k in np.unique(size).tolist():
        yield k, np.flatnonzero(size == k)


def _bits(h: np.ndarray) -> np.ndarray:
    """The bits that a hash sets in its block."""
    out = np.zeros(len(h), np.uint64)
    for j in range(HASHES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return out


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    """Place of a hash's block; remixed, so that it doesn't depend on the bits."""
    return (_mix(h) % np.uint64(blocks)).astype(np.int64)


class Filters:
    """Bloom filters by word length, and the letters of their words."""

    def __init__(self, rows: list[tuple[int, int, bytes, str]], blocks: dict[int, int]):
        self.bits = {k: np.zeros(n, np.uint64) for k, n in blocks.items()}
        for k, part, bits, _ in rows:
            found = np.frombuffer(bits, np.uint64)
            self.bits[k][part * RANGE : part * RANGE + len(found)] = found
        self.letters = np.array(sorted({ord(c) for r in rows for c in r[3]}), np.uint32)

    def holds(self, k: int, h: np.ndarray) -> np.ndarray:
        """True where a word of k letters with this hash may be in the filter."""
        if k not in self.bits:
            return np.zeros(len(h), bool)
        need = _bits(h)
        return self.bits[k][_block(h, len(self.bits[k]))] & need == need

    def edits(self, words: list[str]) -> Iterator[tuple[str, int, bool]]:
        """(edited word, place of the word, a letter is deleted) of the deletions and replacements that pass."""
        for k, at in by_length(words):
            step = max(1, TOGETHER // (k * max(1, len(self.letters))))
            for i in range(0, len(at), step):
                yield from self._edits([words[j] for j in at[i : i + step]], at[i : i + step])

    def _edits(self, words: list[str], at: np.ndarray) -> Iterator[tuple[str, int, bool]]:
        codes = letters_of(words)
        n, k = codes.shape
        places = np.arange(k)
        own = at_places(codes, places)
        total = np.bitwise_xor.reduce(own, 1)
        # Without letter i: places before i as they are, those after it one to the left.
        shifted = at_places(codes[:, 1:], places[:-1])
        head = np.concatenate([np.zeros((n, 1), np.uint64), np.bitwise_xor.accumulate(own, 1)[:, :-1]], 1)
        tail = np.concatenate([np.bitwise_xor.accumulate(shifted[:, ::-1], 1)[:, ::-1], np.zeros((n, 1), np.uint64)], 1)
        # Of equal letters in a row only the last is deleted: the others give the same word.
        last = np.concatenate([codes[:, 1:] != codes[:, :-1], np.ones((n, 1), bool)], 1)
        w, i = np.nonzero(last)
        some = self.holds(k - 1, (head ^ tail)[w, i])
        for x, p in zip(w[some].tolist(), i[some].tolist()):
            yield words[x][:p] + words[x][p + 1 :], int(at[x]), True
        if not len(self.letters):
            return
        put = at_places(self.letters[None, :], places[:, None])
        h = (total[:, None] ^ own)[:, :, None] ^ put
        w, i, c = np.nonzero(self.holds(k, h.ravel()).reshape(h.shape) & (codes[:, :, None] != self.letters))
        for x, p, y in zip(w.tolist(), i.tolist(), c.tolist()):
            yield words[x][:p] + chr(self.letters[y]) + words[x][p + 1 :], int(at[x]), False


def filters(words: DataFrame) -> Filters:
    """The filters of a bounded table (word), built in ranges of blocks."""
    sizes = {r.k: r.n for r in words.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {k: -(-n * WORD_BITS // 64) for k, n in sizes.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for k, at in by_length(words):
                some = [words[i] for i in at]
                h = np.bitwise_xor.reduce(at_places(letters_of(some), np.arange(k)), 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(h), k), pa.int32()), pa.array(_block(h, blocks[k]) // RANGE).cast(pa.int32()), pa.array(h.view(np.int64)), pa.array(some, pa.string())],
                    ["k", "part", "h", "word"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        k, part = (x.as_py() for x in key)
        h = table.column("h").to_numpy().view(np.uint64)
        bits = np.zeros(min(RANGE, blocks[k] - part * RANGE), np.uint64)
        np.bitwise_or.at(bits, _block(h, blocks[k]) - part * RANGE, _bits(h))
        letters = "".join(sorted(set().union(*table.column("word").to_pylist())))
        return pa.table({"k": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary()), "letters": [letters]})

    parts = words.mapInArrow(deal, "k int, part int, h bigint, word string").groupBy("k", "part").applyInArrow(build, "k int, part int, bits binary, letters string")
    return Filters([tuple(r) for r in parts.collect()], blocks)


def neighbours(vocab: DataFrame, pass_words: int = PASS_WORDS) -> DataFrame:
    """Rows word, n, near, near_n: the words of a table (word, n) one edit apart, both ways round.

    A word has at most its letters times the alphabet's neighbours, so no group is large.
    """
    spark = vocab.sparkSession
    size = vocab.count()
    passes = max(1, -(-size // pass_words))
    found = None
    for k in range(passes):
        part = vocab if passes == 1 else vocab.filter(F.pmod(F.xxhash64("word"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast(filters(part.select("word")))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column("word").to_pylist()
                rows = list(shared.value.edits(words))
                edited, at, less = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([
                    pa.array(edited, pa.string()), pa.array(less, pa.bool_()), *(batch.column(c).take(pa.array(at, pa.int64())) for c in ("word", "n"))],
                    ["edited", "less", "word", "n"])

        hits = vocab.repartition(partitions(spark)).mapInArrow(probe, "edited string, less boolean, word string, n bigint")
        met = hits.join(part.select(F.col("word").alias("edited"), F.col("n").alias("near_n")), "edited").select("word", "n", F.col("edited").alias("near"), "near_n", "less")
        found = met if found is None else found.unionByName(met)
    found = stored(found, "neighbours")
    turned = found.filter("less").select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.drop("less").unionByName(turned)


def roots(forms: DataFrame) -> DataFrame:
    """Rows word, root of a table (word, form): where a word's chain of forms ends.

    Each round doubles the steps taken. A form is TIMES as frequent as its
    word, so a chain has at most log_TIMES(occurrences) steps.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = stored(steps.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("at").isNotNull().alias("moved")), "roots")
        if not moved.filter("moved").take(1):
            return moved.drop("moved")
        steps = moved.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, slip: int = SLIP, pass_words: int = PASS_WORDS) -> DataFrame:
    """Rows word, form, root, n, n_near, form_n for every word of the vocabulary.

    Words are maximal runs of letters (A-Z in lower case, a-z, U+00C0-U+00FF)
    with LETTERS code points or more and `least` occurrences. The crc32 of
    '<id>:<run>' drops a letter from one in `slip` of them, before they are
    counted. Null and empty texts have no words; a null id counts as empty
    text; repeated rows count again; of equally frequent neighbours the first
    by code point is the form. Words of any length take part. An empty table
    gives no rows.
    """
    vocab = stored(vocabulary(docs, id_col, text_col, least, slip), "vocabulary")
    best = neighbours(vocab, pass_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = stored(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")), "words")
    ends = roots(known.filter("f is not null").select("word", F.col("f.form").alias("form")))
    return known.join(ends, "word", "left").select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.form_n").alias("form_n"))
