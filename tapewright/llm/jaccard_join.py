"""Similarity join on word n-gram sets: MinHash bands find candidates, full sets decide.

1. Every text becomes the set of its word n-grams (64-bit hashes); texts with
   equal sets form a class, and copies never meet as pairs.
2. A class has bands x rows MinHash values. Equal band hashes link classes to
   the smallest class of their bucket (one row per member, not per pair), and
   connected components of these links gather all candidates of a class.
3. The sets of each component are compared exactly, in blocks of a bounded
   number of classes. A component beyond that goes to pairs of blocks. Only
   link counts and a spanning forest leave a task, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import ID, TH, components, identified, partitions, slices, stored

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 6
#: Classes compared together in one task, and words' hashes kept by a worker.
BLOCK, KNOWN_WORDS = 512, 100_000
#: n-grams of the classes of a block, about.
BLOCK_GRAMS = 2_000_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed for a pair at the threshold to meet in one of them with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _Hashes(dict):
    """Word -> 64-bit hash; emptied when full, so memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and other word characters; punctuation is dropped."""
    return text.lower().translate(_PUNCTUATION).split() if text.isascii() else _WORD.findall(text.lower())


import re  # noqa: E402

_WORD = re.compile(r"\w+")
_PUNCTUATION = {c: " " for c in range(128) if not (chr(c).isalnum() or chr(c) == "_")}


def gram_set(text: str, hashes: dict, n: int = WORDS) -> np.ndarray:
    """Sorted distinct n-gram hashes; a shorter text is one gram, a text without words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (sets x bands) of sets that are not empty."""
    rng = np.random.Generator(np.random.Philox(key=7))
    mul = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        for r in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat((low * mul[r] + add[r]) ^ high, starts)
            out[:, b] = (out[:, b] ^ least) * np.uint64(0xC2B2AE3D27D4EB4F)
            out[:, b] ^= out[:, b] >> np.uint64(31)
    return out.view(np.int64)


def _class_key(s: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def sign(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Per row: identity, class key (k1, k2), number of grams, band hashes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, chars=1 << 19, rows=256):
            sets = [gram_set(t, hashes, n) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            got = _signatures(full, bands, rows).ravel() if full else np.zeros(0, np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            keys = np.array([_class_key(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column(ID), batch.column(TH), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes),
                pa.ListArray.from_arrays(offsets, got)], [ID, TH, "k1", "k2", "n", "bands"])

    return texts.mapInArrow(work, f"{ID} bigint, {TH} bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>")


def _verify(threshold: float):
    """Exact comparison of the classes of a task, component by component."""
    def work(table: pa.Table) -> pa.Table:
        comp, i, j, block = (table.column(c).to_numpy() for c in ("root", "i", "j", "block"))
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        sets = table.column("grams")
        order = np.lexsort((k2, k1, comp))
        out: list[tuple] = []
        edges = np.flatnonzero(np.diff(comp[order])) + 1
        for group in np.split(order, edges):
            _, first = np.unique(np.stack([k1[group], k2[group]]), axis=1, return_index=True)
            group = group[np.sort(first)]
            own = [np.frombuffer(sets[int(g)].as_py(), np.uint64) for g in group]
            near = _near(own, threshold)
            if i[group[0]] >= 0:
                # Two blocks of a large component: pairs inside a block belong to the task of (block, block).
                side = block[group]
                near &= (side[:, None] != side[None, :]) | (i[group[0]] == j[group[0]])
            root = np.arange(len(group))
            while True:
                low = np.minimum(root, np.where(near, root[None, :], len(group)).min(1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            out += zip(comp[group], i[group], k1[group], k2[group], near.sum(1), k1[group[root]], k2[group[root]])
        cols = [pa.array(np.array(c, np.int64)) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7
        return pa.table(dict(zip(("root", "i", "k1", "k2", "links", "r1", "r2"), cols)))

    return work


def _near(sets: list[np.ndarray], threshold: float, width: int = 4096) -> np.ndarray:
    """Square matrix: Jaccard of the two sets is at least the threshold. Grams are counted in column blocks."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[at] > 1
    at, owner = at[shared], owner[shared]
    by = np.argsort(at, kind="stable")
    at, owner = at[by], owner[by]
    if len(at):
        at = np.cumsum(np.concatenate([[0], np.diff(at) != 0]))
    common = np.zeros((m, m), np.float32)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, [a, a + width])
        x = np.zeros((m, min(width, int(at[-1]) + 1 - a)), np.float32)
        x[owner[lo:hi], at[lo:hi] - a] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    near = common >= threshold * union - 1e-6
    np.fill_diagonal(near, False)
    return near


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD,
         recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per input row: identity, class (c1, c2), group (g1, g2), class_id, copies, n_links.

    class: rows with equal n-gram sets, `copies` of them. n_links: other classes
    with a Jaccard similarity of `threshold` or more. group: the connected
    classes; class_id its smallest id (null only if all ids are null). Rows
    without a word, null texts among them, have no n-grams: no links, one class
    each by identity. Repeated rows are copies of one class. An empty table
    gives no rows.
    """
    spark, bands = docs.sparkSession, bands_for(threshold, recall, rows)
    texts = identified(docs, id_col, text_col)
    signed = stored(sign(texts, n, bands, rows), "signatures")
    members = signed.select(ID, TH, "k1", "k2", "n")
    worded = members.filter("n > 0")
    classes = worded.groupBy("k1", "k2").agg(
        F.min(F.struct(F.col(ID).isNull().alias("none"), ID, TH)).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))

    # Buckets of two or more classes link to their smallest class.
    rows_ = signed.filter("n > 0").select("k1", "k2", F.posexplode("bands").alias("band", "h")).distinct()
    buckets = rows_.groupBy("band", "h").agg(F.min("k1").alias("v"), F.max("k1").alias("top")).filter("v < top")
    links = rows_.join(buckets, ["band", "h"]).select(F.col("k1").alias("u"), "v").filter("u <> v").distinct()
    comp = stored(components(links), "components")

    # Blocks: small components share tasks, large ones are split, by classes and by n-grams.
    placed = classes.join(comp, classes["k1"] == comp["node"])
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams"))
    shape = sizes.select("root", F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("blocks"))
    candidates = placed.join(shape, "root").select(
        F.col(f"rep.{ID}").alias(ID), F.col(f"rep.{TH}").alias(TH), "k1", "k2", "root", "blocks",
        F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("k2"), F.col("blocks"))).otherwise(0).alias("block"))
    named = candidates.withColumnsRenamed({ID: "c_id", TH: "c_th"})
    wanted = texts.join(named, texts[TH].eqNullSafe(named["c_th"]) & texts[ID].eqNullSafe(named["c_id"])).select(
        "text", "k1", "k2", "root", "blocks", "block")
    schema = "k1 bigint, k2 bigint, root bigint, blocks bigint, block bigint, grams binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in slices(batches):
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            new = []
            if len(seen) > KNOWN_WORDS:
                seen.clear()
            for key in keys:  # repeated rows of one document: few are passed on, the comparison takes one
                new.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(new))
            grams = [gram_set(t, hashes, n).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "root", "blocks", "block")), pa.array(grams, pa.binary())],
                                             ["k1", "k2", "root", "blocks", "block", "grams"])

    filled = wanted.mapInArrow(sets, schema)
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1).cast("long"))))
    dealt = filled.withColumn("other", other).select(
        "k1", "k2", "root", "block", "grams",
        F.when(F.col("other") < 0, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(F.col("other") < 0, -1).otherwise(F.greatest("block", "other")).alias("j"))
    bins = 8 * partitions(spark)
    task = F.when(F.col("i") < 0, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "i", "j"))
    checked = stored(dealt.groupBy(task.alias("task"), "i", "j").applyInArrow(
        _verify(threshold), "root bigint, i bigint, k1 bigint, k2 bigint, links bigint, r1 bigint, r2 bigint"), "links")

    # Groups: final in small components; forests of split ones are joined.
    whole = checked.filter("i < 0").select("k1", "k2", "links", F.col("r1").alias("g1"), F.col("r2").alias("g2"))
    split = checked.filter("i >= 0")
    forest = components(split.select(F.col("k1").alias("u"), F.col("r1").alias("v")))
    rest = split.groupBy("k1", "k2").agg(F.sum("links").alias("links")).join(forest, F.col("k1") == forest["node"], "left").select(
        "k1", "k2", "links", F.coalesce("root", "k1").alias("g1"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(0).alias("g2"))
    grouped = classes.join(whole.unionByName(rest), ["k1", "k2"], "left").select(
        "k1", "k2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("g1", "k1").alias("g1"), F.coalesce("g2", "k2").alias("g2"))
    least = grouped.groupBy("g1", "g2").agg(F.min(F.col(f"rep.{ID}")).alias("class_id"), F.min("rep").alias("keep"))
    labelled = stored(grouped.join(least, ["g1", "g2"]), "classes")
    wordy = worded.drop("n").join(labelled, ["k1", "k2"]).select(
        ID, TH, F.col("k1").alias("c1"), F.col("k2").alias("c2"), "g1", "g2", "class_id", "copies", "n_links",
        (F.col(ID).eqNullSafe(F.col(f"keep.{ID}")) & (F.col(TH) == F.col(f"keep.{TH}"))).alias("first"))
    empty = members.filter("n = 0").select(
        ID, TH, F.col(TH).alias("c1"), F.xxhash64(ID).alias("c2"), F.col(TH).alias("g1"), F.xxhash64(ID).alias("g2"),
        F.col(ID).alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return wordy.unionByName(empty)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with one row of each group: its smallest id, then text hash.

    Rows without a word stay. Of equal rows one stays; if such rows differ only
    in other columns, either may.
    """
    firsts = join(docs, **options).filter("first").select(F.col(ID).alias("f_id"), F.col(TH).alias("f_th")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias(ID), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(TH))
    kept = row.join(firsts, row[ID].eqNullSafe(firsts["f_id"]) & (row[TH] == firsts["f_th"]), "left_semi")
    return kept.dropDuplicates([ID, TH]).select("row.*")
