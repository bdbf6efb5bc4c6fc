"""I-Match document fingerprints.

The lexicon holds the terms whose document frequency lies in a band. A text's
distinct lexicon terms are sorted and hashed once per randomised subset of the
lexicon. Subsets come in several sizes, so that short texts have terms in the
large ones and long, slightly edited texts agree in the small ones.

A large group of near copies lifts its own terms above the band. A text with
few terms in the band therefore takes in its least common ones from above it;
these are the same for all of the group, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import ID, TH, identified, partitions, slices, stored
from tapewright.llm.jaccard_join import words_of
from tapewright.llm.lm_score import _counts, _parts, _planes, _squeeze

#: Band of the document frequency: at least 2 and this share of all documents, at most that share.
RARE, COMMON = 0.0005, 0.1
#: A text with fewer terms in the band takes in so many from above it; one with still fewer than FEW takes all its terms.
LEAST, FEW = 64, 16
#: Subsets that take each term with probability 1/2, 1/4, ... 1/256: so many of each.
SUBSETS = (2, 2, 4, 4, 8, 12, 16, 16)
KNOWN, ENTRIES = 200_000, 1 << 20
_MUL = np.random.Generator(np.random.Philox(key=10)).integers(0, 2**63, sum(SUBSETS), dtype=np.uint64) | np.uint64(1)
_SHIFT = np.repeat(63 - np.arange(len(SUBSETS)), SUBSETS).astype(np.uint64)
#: Bytes of a subset's hash.
BYTES = 4
EMPTY = bytes(BYTES)


class _Terms(dict):
    """Word -> hash; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) or 1
        return h


def document_frequencies(texts: DataFrame, n_parts: int) -> DataFrame:
    """Rows part, terms, counts: sorted distinct term hashes of some documents with the number of those documents."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Terms()
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = _parts(keys, n_parts)
            some = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([_squeeze(keys[edges[p] : edges[p + 1]]) for p in some], pa.binary()),
                pa.array([_planes(counts[edges[p] : edges[p + 1]]) for p in some], pa.binary())], ["part", "terms", "counts"])

        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                held.append(np.unique(np.fromiter(map(hashes.__getitem__, words_of(t)), np.uint64)))
                size += len(held[-1])
            if size >= 4 * ENTRIES:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return texts.mapInArrow(work, "part int, terms binary, counts binary")


class Lexicon:
    """Sorted hashes of the terms in the band, and of those above it with their place by document frequency."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, high: float):
        above = counts > high
        self.band = np.sort(terms[~above])
        common = terms[above]
        order = np.lexsort((common, counts[above]))
        place = np.empty(len(common), np.int64)
        place[order] = np.arange(len(common))
        by = np.argsort(common)
        self.common, self.place = common[by], place[by]

    def pick(self, h: np.ndarray) -> np.ndarray:
        """Those of a text's sorted distinct term hashes that its fingerprint is made of."""
        inside = _within(self.band, h)
        n = int(inside.sum())
        if n < LEAST and len(self.common):
            at = np.flatnonzero(_within(self.common, h))
            place = self.place[np.searchsorted(self.common, h[at])]
            inside[at[np.argsort(place)[:LEAST]]] = True
            n = int(inside.sum())
        return h if n < FEW else h[inside]


def _within(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, h)
    at[at == len(sorted_)] = 0
    return sorted_[at] == h if len(sorted_) else np.zeros(len(h), bool)


def lexicon(texts: DataFrame, rare: float = RARE, common: float = COMMON) -> Lexicon:
    """The terms in the band and above it.

    Frequencies are of all documents. The result is bounded whatever the
    input's size: at most (mean number of distinct terms per document) / rare.
    """
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n_docs, n_parts = size["n"], max(partitions(texts.sparkSession), -(-(size["chars"] or 0) // (16 * ENTRIES)))
    low = max(2, rare * n_docs)

    def counted(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_counts(x.as_py()), dtype=np.uint64) for x in table.column("terms")])
        each, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_counts(x.as_py()) for x in table.column("counts")])).astype(np.int64)
        return pa.table({"term": each[total >= low].view(np.int64), "n": total[total >= low]})

    terms = document_frequencies(texts, n_parts).groupBy("part").applyInArrow(counted, "term bigint, n bigint").toArrow()
    return Lexicon(terms.column("term").to_numpy().view(np.uint64), terms.column("n").to_numpy(), common * n_docs)


def fingerprint(text: str, terms: _Terms, lex: Lexicon) -> bytes:
    """BYTES per subset, zeros for one without a term."""
    words = words_of(text)
    h = lex.pick(np.unique(np.fromiter(map(terms.__getitem__, words), np.uint64, len(words))))
    taken = (h[:, None] * _MUL >> _SHIFT) == 0
    digest = xxhash.xxh3_64_digest
    return b"".join(digest(h[taken[:, k]].tobytes())[:BYTES] if some else EMPTY for k, some in enumerate(taken.any(0).tolist()))


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal subset hashes among the subsets in which either text has a term; 1 if the fingerprints are equal."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v, f"<u{BYTES}") for v in (a, b))
    used = (x != 0) | (y != 0)
    return float((x == y)[used].sum() / used.sum()) if used.any() else 0.0


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class _Judge:
    def __init__(self, lex: Lexicon):
        self.terms, self.lex = _Terms(), lex

    def print(self, text: str) -> bytes:
        return fingerprint(text, self.terms, self.lex)

    def row(self, d: int | None, text: str, own: bytes, after: str, next_print: bytes) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        other = self.print(edited)
        return d, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, next_print)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Documents follow each other by id, null ids
    first, then by text hash; after the last comes the first, and a single
    document follows itself. Rows equal in both are next to each other. An
    empty table gives no rows. Fingerprints are hex, 2 * BYTES digits a subset.
    Texts are sorted in ranges; the last of a range meets the first of the
    next range afterwards.
    """
    spark = docs.sparkSession
    texts = identified(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(lexicon(texts, rare, common))
    order = [F.asc_nulls_first(ID), F.asc(TH)]
    # Rows equal in id and text may be many; their place in the input splits them over ranges.
    placed = texts.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(partitions(spark), *order, "place").sortWithinPartitions(*order).select(ID, "text", F.spark_partition_id().alias("part"))
    names = [f.split()[0] for f in _RESULT.split(", ")]
    schema = f"{_RESULT}, part int, first boolean, text string"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*names, "part", "first", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, last = _Judge(shared.value), None
        none = (None,) * 3
        for batch in slices(batches):
            rows = []
            for d, text, part in zip(*(batch.column(c).to_pylist() for c in (ID, "text", "part"))):
                own = judge.print(text)
                if last is None:
                    rows.append((d, None, None, own, None, None, None, part, True, text))
                else:
                    rows.append((*judge.row(*last[:3], text, own), *none))
                last = (d, text, own, part)
            yield batch_of(rows)
        if last:
            yield batch_of([(last[0], None, None, last[2], None, None, None, last[3], False, last[1])])

    found = stored(ranged.mapInArrow(walk, schema), "fingerprints")
    heads = found.filter("first").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("next_print"))
    parts = heads.select("part")
    every = Window.orderBy("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(every)).alias("follows"))
    ends = found.filter("not first").select("doc_id", "text", "fingerprint", "part").join(follow, "part").join(
        heads.withColumnRenamed("part", "h_part"), F.col("follows") == F.col("h_part")).select("doc_id", "text", "fingerprint", "after", "next_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in slices(batches):
            rows = [(*judge.row(*x), None, None, None) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield batch_of(rows).select(names)

    every = found.filter("part is null").select(*names).unionByName(ends.mapInArrow(close, _RESULT))
    return every.withColumns({n: F.lower(F.hex(n)) for n in ("fingerprint", "edited_fingerprint")})
