"""Substring dedup by sliding spans of sentences.

Every run of SENTENCES consecutive sentences is hashed, or of as many more as
make MIN_WORDS words; runs are joined over all documents, and a sentence covered by a repeated run that is not the run's
first occurrence is removed. First is the smallest id, then the earliest place.

A long sentence is cut where the words around say so, wherever it starts: at
words whose hash is the least of the RADIUS words to either side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import ID, TH, identified, slices, stored
from tapewright.llm.jaccard_join import _PUNCTUATION, words_of

SENTENCES, MIN_WORDS = 3, 10
#: A longer sentence is taken in pieces; those without a cut of their own for LONG words are of PIECE words.
LONG, PIECE, RADIUS = 24, 16, 4
_BREAK = re.compile(r"((?<=[.!?])\s+|\n+)")
#: Punctuation to spaces, but for the mark between sentences.
_APART = {c: x for c, x in _PUNCTUATION.items() if c}
_TOKEN = re.compile(r"\S+")


@lru_cache(1 << 17)
def _word(token: str) -> tuple[int, str, int]:
    """Hash of a token's words, the words joined by spaces, and their number."""
    words = words_of(token)
    joined = " ".join(words)
    return xxhash.xxh3_64_intdigest(joined), joined, len(words)


def _worded(bodies: list[str]) -> list[list[str]]:
    """`words_of` each; plain texts are translated together."""
    text = "\0".join(bodies)
    if text.isascii() and text.count("\0") == len(bodies) - 1:
        return [x.split() for x in text.lower().translate(_APART).split("\0")]
    return [words_of(x) for x in bodies]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words joined by spaces) of each sentence with a word; they end at . ! ? before white space, or a line's end."""
    # Sentences and the gaps between them in turn.
    parts = _BREAK.split(text)
    ends = list(accumulate(map(len, parts)))
    out, long = [], []
    for k, words in enumerate(_worded(parts[::2])):
        if len(words) > LONG:
            long.append((ends[2 * k] - len(parts[2 * k]), parts[2 * k]))
            out.append(None)
        elif words:
            out.append((ends[2 * k] - len(parts[2 * k]), ends[2 * k], " ".join(words)))
    if not long:
        return out
    cut = iter(_pieces(long))
    return [x for part in out for x in ([part] if part else next(cut))]


def _pieces(long: list[tuple[int, str]]) -> list[list[tuple[int, int, str]]]:
    """Long sentences (start, text) in pieces, as `sentences` returns them.

    The pair of words at a cut hashes to less than the pairs at the RADIUS
    words before and no more than those after it, so equal words far enough
    from an end are cut equally.
    """
    spans = [m.span() for _, body in long for m in _TOKEN.finditer(body)]
    tokens = [body.split() for _, body in long]
    said = [_word(t) for mine in tokens for t in mine]
    stops = [0, *accumulate(map(len, tokens))]
    # Tokens without a word stay with the one before.
    worded = [[k for k in range(a, b) if said[k][2]] for a, b in zip(stops, stops[1:])]
    one = np.fromiter((said[k][0] for mine in worded for k in mine), np.uint64)
    first = np.cumsum([0, *map(len, worded)]).tolist()
    places = np.zeros(0, np.int64)
    if len(one) > 2 * RADIUS + 1:
        pair = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]
        pair = (pair ^ pair >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        least = np.lib.stride_tricks.sliding_window_view(pair, RADIUS).min(1)
        k = np.arange(RADIUS, len(pair) - RADIUS)
        places = k[(pair[k] < least[k - RADIUS]) & (pair[k] <= least[k + 1])]
    out = []
    for (at, _), start, stop, mine, a, b in zip(long, stops, stops[1:], worded, first, first[1:]):
        n, cuts, last = b - a, [], 0
        # Windows of a place reach RADIUS words to both sides and stay in the sentence.
        inside = (places[np.searchsorted(places, a + RADIUS) : np.searchsorted(places, b - 1 - RADIUS)] - a).tolist() if n > LONG else range(PIECE, n, PIECE)
        for c in (*inside, n):
            if c - last > LONG:
                cuts += range(last + PIECE, c, PIECE)
            if c < n:
                cuts.append(c)
            last = c
        edges = [start, *(mine[c] for c in cuts), stop]
        out.append([(at + spans[x][0], at + spans[y - 1][1], " ".join([w for _, w, _ in said[x:y] if w])) for x, y in zip(edges, edges[1:])])
    return out


def run_hashes(parts: list[tuple[int, int, str]], k: int = SENTENCES, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, sentences) of the run at each sentence: the first k, and as many more as make `least` words."""
    m = len(parts) - k + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.fromiter((xxhash.xxh3_64_intdigest(p[2]) for p in parts), np.uint64, len(parts))
    sizes = np.cumsum([0, *(p[2].count(" ") + 1 for p in parts)])
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = (h ^ one[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    n = np.full(m, k)
    at = np.arange(m)
    # A sentence has a word or more, so the loop ends after `least` steps.
    while len(at := at[sizes[at + n[at]] - sizes[at] < least]):
        short = at
        at = at[at + n[at] < len(parts)]
        n[np.setdiff1d(short, at)] = 0
        h[at] = (h[at] ^ one[at + n[at]]) * np.uint64(0x9E3779B97F4A7C15)
        h[at] ^= h[at] >> np.uint64(32)
        n[at] += 1
    at = np.flatnonzero(n)
    return at, h[at].view(np.int64), n[at]


def spans(texts: DataFrame, k: int, least: int) -> DataFrame:
    """Rows: identity, place, hash of the runs, the first of each text only; and one row per text (place -1) with `shape`.

    shape: starts of the sentences, sentences of the run at each (0: none), and
    whether that run is a repeat inside the text.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places, hashes, shapes = [], [], []
            for t in batch.column("text").to_pylist():
                parts = sentences(t)
                at, h, n = run_hashes(parts, k, least)
                first = np.zeros(len(h), bool)
                first[np.unique(h, return_index=True)[1]] = True
                size, again = np.zeros(len(parts), np.uint16), np.zeros(len(parts), bool)
                size[at], again[at[~first]] = n, True
                places.append(at[first])
                hashes.append(h[first])
                shapes.append(np.fromiter((p[0] for p in parts), np.int32, len(parts)).tobytes() + size.tobytes() + again.tobytes())
            n = [len(h) for h in hashes]
            row = pa.array(np.repeat(np.arange(len(n)), n))
            some = [batch.column(c).take(row) for c in (ID, TH)]
            yield pa.RecordBatch.from_arrays([
                *some, pa.array(np.concatenate(places)).cast(pa.int32()), pa.array(np.concatenate(hashes)), pa.nulls(len(row), pa.binary())], [ID, TH, "at", "h", "shape"])
            every = len(shapes)
            yield pa.RecordBatch.from_arrays([
                batch.column(ID), batch.column(TH), pa.array(np.full(every, -1), pa.int32()), pa.nulls(every, pa.int64()), pa.array(shapes, pa.binary())], [ID, TH, "at", "h", "shape"])

    return texts.mapInArrow(work, f"{ID} bigint, {TH} bigint, at int, h bigint, shape binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SENTENCES, least: int = MIN_WORDS) -> DataFrame:
    """Rows doc_id, n_sentences, n_removed, removed (list of character ranges), clean_text; one for each row of docs.

    Null texts count as empty. Rows with one id count as one document, which
    doesn't repeat itself; rows with a null id come last and are told apart by
    their texts (ids are below 2**62). Texts of fewer than k sentences, or of
    fewer than `least` words, are left alone. A repeat inside a text goes, too.
    Repeated rows give equal results. An empty table gives no rows.
    """
    texts = identified(docs, id_col, text_col)
    order = F.coalesce(F.col(ID), F.lit(1 << 62) + F.shiftrightunsigned(F.col(TH), 2))
    found = stored(spans(texts, k, least), "spans")
    runs = found.filter("at >= 0")
    repeated = runs.groupBy("h").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first < last").select("h", "first")
    later = runs.join(repeated, "h").filter(order > F.col("first")).select(ID, TH, "at", F.lit(None).cast("binary").alias("shape"))
    told = later.unionByName(found.filter("at < 0").select(ID, TH, F.lit(None).cast("int").alias("at"), "shape")).groupBy(F.col(ID).alias("s_id"), F.col(TH).alias("s_th")).agg(
        F.collect_set("at").alias("at"), F.first("shape", ignorenulls=True).alias("shape"))
    marked = texts.join(told, texts[ID].eqNullSafe(told["s_id"]) & (texts[TH] == told["s_th"])).select(ID, "text", "at", "shape")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t, at, shape in zip(*(batch.column(c).to_pylist() for c in ("text", "at", "shape"))):
                n = len(shape) // 7
                starts = np.append(np.frombuffer(shape, np.int32, n), len(t))
                size, again = np.frombuffer(shape, np.uint16, n, 4 * n), np.frombuffer(shape, bool, n, 6 * n)
                edges = np.zeros(n + 1, np.int64)
                for a in (*at, *np.flatnonzero(again).tolist()):
                    edges[a] += 1
                    edges[a + size[a]] -= 1
                gone = np.cumsum(edges)[:n] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                ranges = starts[turn].reshape(-1, 2).tolist()
                clean, done = [], 0
                for start, end in ranges:
                    clean.append(t[done:start])
                    done = end
                rows.append((n, int(gone.sum()), ranges, "".join(clean) + t[done:]))
            n, m, ranges, clean = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(ID), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(clean, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed", "clean_text"])

    return marked.mapInArrow(cut, "doc_id bigint, n_sentences bigint, n_removed bigint, removed array<array<bigint>>, clean_text string")
