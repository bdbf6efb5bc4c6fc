"""Benchmark decontamination with spaced seeds.

A seed is a mask over neighbouring tokens: those under ones are hashed, those
under zeros ignored. Substitutions split an overlap into runs of agreeing
tokens. The share of agreeing tokens that an overlap needs bounds the number of
runs, so two neighbouring runs (or a single one) together have some least
number w of tokens. The masks of w ones, alone or with one zero at each place
between them, therefore hit every overlap that counts. Around each hit the
document and the item are compared along the hit's diagonal, and the stretch
with the most agreeing tokens is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import slices
from tapewright.llm.jaccard_join import words_of

#: An overlap counts if so many tokens agree, or all of a shorter item, ...
MIN_TOKENS = 13
#: ... and so large a share of the overlap's tokens.
IDENTITY = 0.8
#: Benchmark tokens looked up in one pass; a larger benchmark takes more passes.
PASS_TOKENS = 2_000_000
#: Items shorter than this many tokens occur in ordinary text; they are found where they are the whole document.
LEAST_ITEM = 5
#: (document, item) diagonals compared together, in tokens.
TOGETHER = 1 << 18


def bar(n: int) -> int:
    """Tokens that must agree in an overlap with an item of n tokens."""
    return min(MIN_TOKENS, math.ceil(n * IDENTITY - 1e-9))


def weight(n: int) -> int:
    """Tokens that a run, or two neighbouring runs, have in every overlap with an item of n tokens.

    a agreeing tokens and s substitutions make s + 1 runs, which go into
    ceil((s + 1) / 2) pairs of neighbours (one may be single).
    """
    def least(a: int) -> int:
        s = min(n - a, int(a * (1 - IDENTITY) / IDENTITY + 1e-9))
        return -(-a // -(-(s + 1) // 2))

    return min(map(least, range(bar(n), n + 1)))


def masks(w: int) -> list[tuple[int, ...]]:
    """Places of the ones: w in a row, and with one ignored place after the first, second, ..."""
    return [tuple(range(w)), *((*range(i), *range(i + 1, w + 1)) for i in range(1, w))]


class Index:
    """Seeds of a bounded part of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.items, self.vocab = [], [], {}
        self.short: dict[tuple[str, ...], list[int]] = {}
        for item, text in rows:
            words = words_of(text or "")
            if not words:
                continue
            if len(words) < LEAST_ITEM:
                self.short.setdefault(tuple(words), []).append(len(self.ids))
            self.ids.append(item)
            self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64))
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.starts = np.cumsum([0, *self.sizes])[:-1]
        self.flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)
        self.bars = np.array([bar(n) for n in self.sizes], np.int64)
        by_size = {int(n): weight(int(n)) for n in np.unique(self.sizes) if n >= LEAST_ITEM}
        weights = np.array([by_size.get(int(n), 0) for n in self.sizes], np.int64)
        self.seeds = []
        for w in sorted(set(by_size.values())):
            for mask in masks(w):
                found = []
                for i in np.flatnonzero((weights == w) & (self.sizes > mask[-1])):
                    at = np.arange(len(self.items[i]) - mask[-1])
                    found.append(np.stack([self.hash(self.items[i], at, mask).view(np.int64), np.full(len(at), i), at]))
                if found:
                    table = np.concatenate(found, 1)
                    by = np.argsort(table[0].view(np.uint64), kind="stable")
                    self.seeds.append((mask, table[0][by].view(np.uint64), table[1][by], table[2][by]))

    @staticmethod
    def hash(x: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for o in mask:
            out = (out ^ x[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item index, first token, end token, tokens that agree, tokens) of the best overlap with each item."""
        return self.overlaps_of([text])[0]

    def overlaps_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """`overlaps` of each text. Texts are looked up in one row of tokens, two unknown ones between them."""
        get = self.vocab.get
        words = [words_of(t) if t else [] for t in texts]
        best: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        for d, w in enumerate(words):
            if 0 < len(w) < LEAST_ITEM:
                best[d].update((i, (0, len(w), len(w), len(w))) for i in self.short.get(tuple(w), ()))
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        ends = np.cumsum(sizes) - 2
        starts = ends - sizes + 2
        x = np.fromiter((get(w, 0) for ws in words for w in (*ws, "", "")), np.int64, int(sizes.sum()))
        known = x > 0
        for mask, hashes, item, pos in self.seeds:
            m = len(x) - mask[-1]
            if m < 1:
                continue
            ok = known[:m].copy()
            for o in mask[1:]:
                ok &= known[o : o + m]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h = self.hash(x, at, mask)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = hi > lo
            at, lo, hi = at[hit], lo[hit], hi[hit]
            total = np.cumsum(hi - lo)
            for a, b in _chunks(total, max(1, TOGETHER // int(self.sizes.max()))):
                n = (hi - lo)[a:b]
                s = np.repeat(lo[a:b] - (total[a:b] - n - (total[a] - n[0])), n) + np.arange(n.sum())
                place = np.repeat(at[a:b], n)
                doc = np.searchsorted(ends, place, "right")
                for d, i, shift in self.agreeing(x, starts, ends, doc, item[s], place - pos[s]):
                    self.judge(x[starts[d] : ends[d]], i, shift - int(starts[d]), best[d])
        return [[(i, *v) for i, v in sorted(found.items())] for found in best]

    def agreeing(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> list[tuple[int, int, int]]:
        """The distinct (document, item, shift) whose diagonals have enough agreeing tokens in all."""
        if not len(item):
            return []
        doc, item, shift = np.unique(np.stack([doc, item, shift]), axis=1)
        n = self.sizes[item]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        there = place + np.repeat(shift, n)
        same = (there >= np.repeat(starts[doc], n)) & (there < np.repeat(ends[doc], n)) & (x[there.clip(0, len(x) - 1)] == self.flat[place + np.repeat(self.starts[item], n)])
        some = np.add.reduceat(same, first, dtype=np.int64) >= self.bars[item]
        return list(zip(doc[some].tolist(), item[some].tolist(), shift[some].tolist()))

    def judge(self, x: np.ndarray, i: int, shift: int, best: dict[int, tuple[int, int, int, int]]) -> None:
        """Keeps the diagonal's stretch with the most agreeing tokens, the shortest and first of these, if it is better than the item's best."""
        y = self.items[i]
        a, b = max(0, -shift), min(len(y), len(x) - shift)
        same = y[a:b] == x[a + shift : b + shift]
        # A stretch from s to e has the share if the total at e is not below that at s; the farthest such e agrees most.
        total = np.concatenate([[0], np.cumsum(np.where(same, round(100 - 100 * IDENTITY), -round(100 * IDENTITY)))])
        upto = np.concatenate([[0], np.cumsum(same)])
        last = np.maximum.accumulate(np.concatenate([[0], np.where(same, np.arange(1, len(same) + 1), 0)]))
        rest = np.maximum.accumulate(total[::-1])
        start = np.flatnonzero(same)
        end = last[len(total) - 1 - np.searchsorted(rest, total[start])]
        agree = upto[end] - upto[start]
        k = np.lexsort((start, end - start, -agree))[0]
        start, end, agree = int(start[k]), int(end[k]), int(agree[k])
        if agree >= self.bars[i] and (i not in best or (agree, -(a + start + shift)) > (best[i][2], -best[i][0])):
            best[i] = (a + start + shift, a + end + shift, agree, end - start)


def _chunks(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose counts, by their running sums, are about `size` together."""
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + size, "right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", pass_tokens: int = PASS_TOKENS) -> Iterator[Index]:
    """The benchmark in parts of about `pass_tokens` tokens; only one part is held at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    parts = -(-total // pass_tokens)
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).orderBy("item", "text").collect()
        yield Index([tuple(r) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_tokens: int = PASS_TOKENS) -> DataFrame:
    """Rows doc_id, item_id, first_token, end_token, n_same, n_overlap: the best overlap of a document and an item.

    Null or empty texts overlap nothing; repeated rows give repeated results;
    of equally good overlaps the first counts. An item of fewer than LEAST_ITEM
    tokens overlaps a document that is this item and nothing else. Empty
    tables give no rows. Neither table is shuffled.
    """
    out = None
    schema = "doc_id bigint, item_id bigint, first_token bigint, end_token bigint, n_same bigint, n_overlap bigint"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for index in indexes(benchmark, text_col="text", pass_tokens=pass_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                rows = [(d, index.ids[i], *more) for d, found in zip(batch.column("doc_id").to_pylist(), index.overlaps_of(batch.column("text").to_pylist())) for i, *more in found]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "first_token", "end_token", "n_same", "n_overlap"])

        part = texts.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", pass_tokens: int = PASS_TOKENS) -> DataFrame:
    """The rows of docs whose text overlaps no item; all columns pass unchanged, without a shuffle."""
    for index in indexes(benchmark, pass_tokens=pass_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                yield batch.filter(pa.array([not found for found in shared.value.overlaps_of(batch.column(text_col).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
