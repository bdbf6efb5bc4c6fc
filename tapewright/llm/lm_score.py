"""Language-model scoring by deleted interpolation of bigrams.

p(w | v) = l2 c(vw)/c(v) + l1 c(w)/N + l0 1/(V+1), with weights l by how often
the context v was seen (powers of two). The weights are learned by expectation
maximisation on deleted counts: each training token is scored as if it had not
been counted.

How the counts reach the texts: runs of rows of the stored table (pieces) list
the distinct word and pair hashes of their texts once, with local counts; the
lists are dealt by hash, summed, and each list is answered in its own order.
Texts then meet the answers of their own run of rows. So what is shuffled grows
with the distinct pairs of a piece, a few bytes each, and no word or pair,
however frequent, is more than one entry per piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import held_out, partitions, stored

#: Rows of a file in one run; tokens of one piece; words' hashes a worker keeps.
RUN_ROWS, PIECE_TOKENS, KNOWN = 2048, 1 << 20, 400_000
#: Entries of a dealt part of the hashes, about.
PART_ENTRIES = 1 << 20
#: Weight buckets by context count: 0 unseen, k for 2^(k-1) and more.
BUCKETS = 64
#: Expectation-maximisation: most rounds, least gain in log10 probability per token.
ROUNDS, GAIN = 200, 1e-7
END = np.uint64(0x9AE16A3B2F90404F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(text: str, hashes: dict) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and of one end. Words are runs of other bytes than \\x20 and \\x09-\\x0D."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pairs(t: np.ndarray) -> np.ndarray:
    """Hash of each token and the one before it; the first follows an end."""
    before = np.concatenate([[END], t[:-1]])
    h = before * np.uint64(0x9E3779B97F4A7C15) + t
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


def _squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps, byte planes apart: the shuffle's compression removes the empty planes."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _planes(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _listed(docs: list[np.ndarray], train: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a piece, sorted, and their training counts."""
    flat = np.concatenate([d if kind == 0 else pairs(d) for d in docs])
    mine = np.repeat(train, [len(d) for d in docs])
    keys, at = np.unique(flat, return_inverse=True)
    return keys, np.bincount(at, weights=mine, minlength=len(keys)).astype(np.int64)


def _parts(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """Borders of the parts: equal ranges of hashes."""
    edges = (np.arange(1, n_parts, dtype=object) * (1 << 64) // n_parts).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def requests(rows: DataFrame, n_parts: int) -> DataFrame:
    """Rows file, run, first (row of the piece), kind (0 words, 1 pairs), part, keys, counts."""
    schema = "file string, run bigint, first bigint, kind int, part int, keys binary, counts binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        held: list[np.ndarray] = []
        train: list[bool] = []
        at, size = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                keys, counts = _listed(held, np.array(train), kind)
                edges = _parts(keys, n_parts)
                some = np.flatnonzero(np.diff(edges))
                n = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array([at[2]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
                    pa.array(some, pa.int32()), pa.array([_squeeze(keys[edges[p] : edges[p + 1]]) for p in some], pa.binary()),
                    pa.array([_planes(counts[edges[p] : edges[p + 1]]) for p in some], pa.binary())], ["file", "run", "first", "kind", "part", "keys", "counts"])

        for batch in batches:
            for file, row, text, held_ in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "text", "held"))):
                run = row // RUN_ROWS
                if at and (at[:2] != (file, run) or size >= PIECE_TOKENS):
                    yield from out()
                    held, train, at, size = [], [], None, 0
                at = at or (file, run, row)
                held.append(tokens(text, hashes))
                train.append(not held_)
                size += len(held[-1])
        if at:
            yield from out()

    return rows.select("file", "row", "text", "held").mapInArrow(work, schema)


def answers(asked: DataFrame) -> DataFrame:
    """The request rows with the training counts of all pieces in place of the keys; per part a row (file null) with its sums."""
    schema = "file string, run bigint, first bigint, kind int, part int, counts binary, n_tokens bigint, n_types bigint"

    def work(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_counts(x.as_py()), dtype=np.uint64) for x in table.column("keys")]
        counts = [_counts(x.as_py()) for x in table.column("counts")]
        each, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(each), np.int64)
        np.add.at(total, at, np.concatenate(counts).astype(np.int64))
        cut = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        n = len(keys)
        zero = [0] * n
        first = pa.table({c: table.column(c) for c in ("file", "run", "first", "kind", "part")}
                         | {"counts": pa.array([_planes(c) for c in cut], pa.binary()), "n_tokens": pa.array(zero, pa.int64()), "n_types": pa.array(zero, pa.int64())})
        sums = pa.table({"file": pa.array([None], pa.string()), "run": pa.array([None], pa.int64()), "first": pa.array([None], pa.int64()),
                         "kind": table.column("kind").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([None], pa.binary()),
                         "n_tokens": pa.array([int(total.sum())]), "n_types": pa.array([int((total > 0).sum())])})
        return pa.concat_tables([first, sums])

    return asked.groupBy("kind", "part").applyInArrow(work, schema)


def _grid(c12: np.ndarray, c1: np.ndarray, c2: np.ndarray, n: int, v: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums over training tokens with their own occurrence deleted: by bucket and by powers of two of the two ratios to 1/(V+1)."""
    a1, a12 = c1.astype(float) - 1, c12.astype(float) - 1
    unigram = (c2.astype(float) - 1) / max(n - 1, 1) * (v + 1)
    bigram = np.where(a1 > 0, a12 / np.maximum(a1, 1), 0.0) * (v + 1)
    cell1 = np.where(unigram > 0, np.floor(np.log2(np.maximum(unigram, 1e-300))), -99)
    cell2 = np.where(bigram > 0, np.floor(np.log2(np.maximum(bigram, 1e-300))), -99)
    keys = np.stack([bucket(a1), cell1, cell2]).astype(np.int64)
    each, at = np.unique((keys[0] * 512 + keys[1] + 128) * 512 + keys[2] + 128, return_inverse=True)
    sums = np.stack([np.bincount(at), np.bincount(at, weights=unigram), np.bincount(at, weights=bigram)])
    return {(int(k) // 512 // 512, int(k) // 512 % 512 - 128, int(k) % 512 - 128): sums[:, i] for i, k in enumerate(each)}


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def counted(rows: DataFrame, answered: DataFrame, n: int, v: int) -> DataFrame:
    """Texts with the counts of their tokens and pairs (packed), and the cells of the grid that the weights are learned from."""
    schema = "doc_id bigint, held boolean, n_tokens bigint, c2 binary, c12 binary, b int, x int, y int, cell_n double, cell_1 double, cell_2 double"

    def work(texts: pa.Table, replies: pa.Table) -> pa.Table:
        hashes = _Hashes()
        by = np.argsort(texts.column("row").to_numpy(), kind="stable")
        texts = texts.take(pa.array(by))
        row = texts.column("row").to_numpy()
        if not len(row):
            return pa.table({f: pa.array([], t) for f, t in types})
        replies = replies.sort_by([("first", "ascending"), ("kind", "ascending"), ("part", "ascending")])
        first, kind = replies.column("first").to_numpy(), replies.column("kind").to_numpy()
        starts = np.unique(first)
        held = texts.column("held").to_numpy(zero_copy_only=False)
        seen, packed = {}, []
        edges = [*np.searchsorted(row, starts), len(row)]
        for s, lo, hi in zip(starts, edges, edges[1:]):
            docs = [tokens(t, hashes) for t in texts.column("text").slice(lo, hi - lo).to_pylist()]
            got = []
            for k in (0, 1):
                data = [replies.column("counts")[int(i)].as_py() for i in np.flatnonzero((first == s) & (kind == k))]
                keys = _listed(docs, np.zeros(len(docs)), k)[0]
                flat = np.concatenate([d if k == 0 else pairs(d) for d in docs])
                got.append(np.concatenate([_counts(x) for x in data])[np.searchsorted(keys, flat)])
                if k == 0:
                    end = int(got[0][np.flatnonzero(flat == END)[0]])
            sizes = [len(d) for d in docs]
            ends = np.cumsum(sizes)
            c2, c12 = got
            c1 = np.concatenate([[end], c2[:-1]])
            c1[ends[:-1]] = end
            train = np.repeat(~held[lo:hi], sizes)
            if train.any():
                for key, sums in _grid(c12[train], c1[train], c2[train], n, v).items():
                    seen[key] = seen.get(key, 0) + sums
            packed += [(z, _planes(c2[e - z : e]), _planes(c12[e - z : e])) for e, z in zip(ends, sizes)]
        m, z, a, b = len(row), *zip(*packed)
        none = lambda k, t: pa.array([None] * k, t)
        docs_ = pa.table({"doc_id": texts.column("doc_id"), "held": texts.column("held"), "n_tokens": pa.array(z, pa.int64()), "c2": pa.array(a, pa.binary()), "c12": pa.array(b, pa.binary()),
                          "b": none(m, pa.int32()), "x": none(m, pa.int32()), "y": none(m, pa.int32()), "cell_n": none(m, pa.float64()), "cell_1": none(m, pa.float64()), "cell_2": none(m, pa.float64())})
        k = len(seen)
        keys, sums = np.array(list(seen), np.int64).reshape(-1, 3), np.array(list(seen.values()), float).reshape(-1, 3)
        cells = pa.table({"doc_id": none(k, pa.int64()), "held": none(k, pa.bool_()), "n_tokens": none(k, pa.int64()), "c2": none(k, pa.binary()), "c12": none(k, pa.binary()),
                          "b": pa.array(keys[:, 0], pa.int32()), "x": pa.array(keys[:, 1], pa.int32()), "y": pa.array(keys[:, 2], pa.int32()),
                          "cell_n": pa.array(sums[:, 0]), "cell_1": pa.array(sums[:, 1]), "cell_2": pa.array(sums[:, 2])})
        return pa.concat_tables([docs_, cells])

    types = [("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("c2", pa.binary()), ("c12", pa.binary()), ("b", pa.int32()), ("x", pa.int32()),
             ("y", pa.int32()), ("cell_n", pa.float64()), ("cell_1", pa.float64()), ("cell_2", pa.float64())]
    return rows.groupBy("file", "run").cogroup(answered.filter("file is not null").groupBy("file", "run")).applyInArrow(work, schema)


def learn(cells: DataFrame) -> np.ndarray:
    """Weights (bucket x 3: uniform, unigram, bigram) by expectation maximisation.

    The cells are sums over all training tokens, at most one per bucket and
    pair of powers of two; a bucket without tokens takes the weights of all.
    """
    rows = cells.filter("b is not null").groupBy("b", "x", "y").agg(F.sum("cell_n"), F.sum("cell_1"), F.sum("cell_2")).orderBy("b", "x", "y").toArrow()
    b, _, _, n, s1, s2 = (c.to_numpy() for c in rows.columns)
    out = np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    if not len(b):
        return out
    p = np.stack([np.ones(len(n)), s1 / n, s2 / n])

    def fit(some: np.ndarray, with_bigram: bool) -> np.ndarray:
        weights, last = (np.array([0.2, 0.4, 0.4]) if with_bigram else np.array([0.5, 0.5, 0.0])), -np.inf
        for _ in range(ROUNDS):
            each = weights[:, None] * p[:, some]
            whole = each.sum(0)
            weights = (each / whole * n[some]).sum(1) / n[some].sum()
            gain = (n[some] * np.log10(whole)).sum() / n[some].sum()
            if gain - last < GAIN:
                break
            last = gain
        # No part is given up: unseen words and pairs of other texts must keep a probability.
        weights = np.maximum(weights, [1e-6, 1e-6, 1e-6 if with_bigram else 0.0])
        return weights / weights.sum()

    every = np.ones(len(b), bool)
    out[:] = fit(every, True)
    for k in np.unique(b):
        out[k] = fit(b == k, k > 0)
    out[0] = fit(b == 0, False) if (b == 0).any() else fit(every, False)
    return out


def located(docs: DataFrame, id_col: str, text_col: str, modulus: int, remainder: int) -> DataFrame:
    """Rows file, row, doc_id, text, held: each row by its place in stored files; other tables are stored first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(F.col(id_col), modulus, remainder).alias("held")]
    if _is_scan(docs):
        return docs.select(*columns, *place)
    return stored(docs.select(*columns), "texts").select("*", *place)


def _is_scan(docs: DataFrame) -> bool:
    """True if rows still know their place in a Parquet file."""
    try:
        docs.select(F.col("_metadata.row_index")).schema  # noqa: B018
        return True
    except Exception as e:
        if "UNRESOLVED_COLUMN" in str(e) or "FIELD_NOT_FOUND" in str(e):
            return False
        raise


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Rows doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one for each row of docs.

    Null texts count as empty, that is one end. Repeated rows count and score
    as often as they come. Without training rows every token is unseen, and
    both scores give it probability 1. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = located(docs, id_col, text_col, modulus, remainder)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = max(partitions(spark), -(-size // (8 * PART_ENTRIES)))
    answered = stored(answers(requests(rows, n_parts)), "answers")
    n, v = answered.filter("file is null and kind = 0").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    held = rows.select("doc_id", "text", "held", "row", "file", F.floor(F.col("row") / RUN_ROWS).alias("run"))
    texts = stored(counted(held, answered, n, v), "counts")
    weights = learn(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                c2s = [_counts(x.as_py()) for x in some.column("c2")]
                sizes = np.array([len(x) for x in c2s])
                ends = np.cumsum(sizes)
                c2 = np.concatenate(c2s).astype(float)
                c12 = np.concatenate([_counts(x.as_py()) for x in some.column("c12")]).astype(float)
                c1 = np.concatenate([[0], c2[:-1]])
                c1[np.concatenate([[0], ends[:-1]])] = c2[ends - 1]  # a text starts after an end
                w = weights[bucket(c1)]
                p = w[:, 0] / (v + 1) + w[:, 1] * c2 / max(n, 1) + w[:, 2] * np.where(c1 > 0, c12 / np.maximum(c1, 1), 0)
                starts = np.concatenate([[0], ends[:-1]])
                model = np.add.reduceat(np.log10(p), starts)
                base = np.add.reduceat(np.log10((c2 + 1) / (n + v + 1)), starts)
                known = np.add.reduceat((c2 > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held"), some.column("n_tokens"), pa.array(known), pa.array(np.full(len(sizes), n)),
                                                  pa.array(base), pa.array(model)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.filter("n_tokens is not null").select("doc_id", "held", "n_tokens", "c2", "c12").mapInArrow(
        work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
