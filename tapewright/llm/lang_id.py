"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its
letters' vectors, each permuted (rotated) by its distance from the end, by
multiplication; a text's vector bundles (adds) its n-grams' vectors. A
language's prototype bundles its labelled texts; a text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import held_out, slices

DIM, GRAM, SEED = 1024, 3, 20
UNKNOWN = "und"
#: Stands for a space that must be kept at a piece's start; not a character of texts.
SPACE = "\U0010ffff"
#: Prototypes compared in one pass over the texts; more languages take more passes.
LANGS_PER_PASS = 1024
#: Texts bundled together; their n-gram counts are a table of texts by n-grams.
TOGETHER = 256


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    """The random vector of a code point, the same in every task."""
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIM, dtype=np.int8)
    return bits * 2 - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(texts: list[str], owner: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by owner of the letter n-grams of lower-cased texts, and the n-grams' vectors.

    Runs of other characters count as one space; n-grams don't cross texts.
    Texts of any length are counted in pieces.
    """
    low = [t.lower() for t in texts]
    code = np.frombuffer(" ".join(low).encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= code == ord(SPACE)
    ends = np.cumsum([len(t) + 1 for t in low])
    keep[ends[:-1] - 1] = False  # what joins the texts is in none of them
    at = np.flatnonzero(keep)
    symbol = np.where(letter[at], code[at], 32)
    if len(symbol) < GRAM:
        return np.zeros((n_owners, 0), np.float32), np.zeros((0, DIM), np.float32)
    text_of = np.repeat(np.arange(len(low)), np.diff(np.searchsorted(at, ends, "left"), prepend=0))
    seen = np.zeros(0x110000, bool)
    seen[symbol] = True
    codes = np.flatnonzero(seen)
    table = np.zeros(0x110000, np.int64)
    table[codes] = np.arange(len(codes))
    dense, base = table[symbol], len(codes)
    gram = np.zeros(len(dense) - GRAM + 1, np.int64)
    for k in range(GRAM):
        gram = gram * base + dense[k : len(dense) - GRAM + 1 + k]
    inside = text_of[: len(gram)] == text_of[GRAM - 1 :]
    gram, who = gram[inside], owner[text_of[: len(inside)][inside]]
    if base**GRAM <= 1 << 21:
        present = np.flatnonzero(np.bincount(gram, minlength=1))
        place = np.zeros(base**GRAM, np.int64)
        place[present] = np.arange(len(present))
        gram = place[gram]
    else:
        present, gram = np.unique(gram, return_inverse=True)
    counts = np.bincount(who * len(present) + gram, minlength=n_owners * len(present)).reshape(n_owners, -1).astype(np.float32)
    vectors = np.ones((len(present), DIM), np.int8)
    rest = present
    for shift in range(GRAM):
        rolled = np.stack([np.roll(letter_vector(int(c)), shift) for c in codes])
        vectors *= rolled[rest % base]
        rest = rest // base
    return counts, vectors.astype(np.float32)


def _pieces(texts: list[str], size: int = 1 << 20) -> list[tuple[int, str]]:
    """(index, piece); each piece of a long text starts with the last symbols before it."""
    out = []
    for i, t in enumerate(texts):
        if len(t) <= size:
            out.append((i, t))
            continue
        tail = ""
        for a in range(0, len(t), size):
            piece = tail + t[a : a + size]
            out.append((i, piece))
            symbols = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in piece.lower()))
            tail = symbols[-(GRAM - 1) :].replace(" ", SPACE)
            if len(symbols) < GRAM and not tail.strip(SPACE):
                tail = ""
    return out


def bundle(texts: list[str], owner: np.ndarray, n_owners: int) -> np.ndarray:
    """Sum of the n-gram vectors of each owner's texts."""
    parts = _pieces(texts)
    total = np.zeros((n_owners, DIM))
    for a in range(0, len(parts), TOGETHER):
        some = parts[a : a + TOGETHER]
        mine, place = np.unique(owner[[i for i, _ in some]], return_inverse=True)
        counts, vectors = gram_counts([t for _, t in some], place, len(mine))
        total[mine] += counts @ vectors
    return total


def prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, vector array<long>) bundled from all texts with a language; integer sums, so order is without effect."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            flat = np.concatenate(list(sums.values())).astype(np.int64)
            offsets = np.arange(0, len(flat) + 1, DIM, dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.ListArray.from_arrays(offsets, flat)], ["lang", "vector"])

        for batch in slices(batches):
            names = batch.column("lang").to_pylist()
            index = {x: i for i, x in enumerate(sorted(set(names)))}
            got = bundle(batch.column("text").to_pylist(), np.array([index[x] for x in names]), len(index))
            for x, i in index.items():
                sums[x] = sums.get(x, 0) + got[i]
            if len(sums) > 512:
                yield out()
                sums.clear()
        if sums:
            yield out()

    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.mapInArrow(learn, "lang string, vector array<bigint>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def _passes(protos: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Prototypes in blocks of a bounded number of languages, as unit vectors."""
    names: list[str] = []
    vectors: list[np.ndarray] = []
    for row in protos.orderBy("lang").toLocalIterator():
        v = np.array(row["vector"], float)
        if not v.any():
            continue
        names.append(row["lang"])
        vectors.append(v / np.linalg.norm(v))
        if len(names) == LANGS_PER_PASS:
            yield names, np.stack(vectors)
            names, vectors = [], []
    if names:
        yield names, np.stack(vectors)


def _judge(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    sums = bundle([t or "" for t in texts], np.arange(len(texts)), len(texts))
    norm = np.sqrt((sums * sums).sum(1))
    cos = np.round(sums @ matrix.T / np.maximum(norm, 1e-300)[:, None], 9)
    best = cos.argmax(1)
    none = np.array([not any(map(str.isalpha, t or "")) for t in texts], bool)
    # Letters, but too few for an n-gram: every prototype is equally near, the first by name is taken.
    score = np.where(none, 0.0, np.clip(cos[np.arange(len(texts)), best], 0, 1))
    return [UNKNOWN if e else names[b] for e, b in zip(none, best)], score


def predict(docs: DataFrame, protos: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs, then lang_pred and score (cosine, 0 to 1).

    Texts that are null or have no letter get `und` and 0, and so do all texts
    if no prototype was learned. Equal cosines go to the first language by name.
    A text with one or two letters has no n-gram: first language, score 0.
    """
    schema = docs.schema
    blocks = list(_passes(protos)) or [([], np.zeros((0, DIM)))]
    out = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(-1.0)})
    names_of = [f.name for f in schema.fields]
    for names, matrix in blocks:
        def judge(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                cols = [batch.column(c) for c in range(batch.num_columns)]
                if names:
                    lang, score = _judge(batch.column(text_col).to_pylist(), names, matrix)
                    was = cols[-1].to_numpy(zero_copy_only=False)
                    better = score > was
                    lang = [a if b else c for a, b, c in zip(lang, better, cols[-2].to_pylist())]
                    score = np.where(better, score, was)
                else:
                    lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*cols[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names_of, "lang_pred", "score"])

        out = out.mapInArrow(judge, out.schema)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Rows doc_id, held_out, lang_pred, score; learned from the labelled texts outside the held-out rows.

    Rows without a text or a language teach nothing; a null id counts as empty
    text for `held_out`. Repeated rows teach and are judged again each time. An
    empty table gives no rows. For null texts see `predict`.
    """
    held = held_out(F.col(id_col), modulus, remainder)
    protos = prototypes(docs.filter(~held), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, protos).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The rows whose text is in a learned language: not `und`, and cosine `least` or more.

    All columns pass unchanged; rows are judged in place, without a shuffle.
    """
    protos = prototypes(docs.filter(~held_out(F.col("doc_id"), modulus, remainder)))
    blocks = list(_passes(protos))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best = np.zeros(batch.num_rows)
            for names, matrix in blocks:
                best = np.maximum(best, _judge(batch.column("text").to_pylist(), names, matrix)[1])
            yield batch.filter(pa.array(best >= least))

    return docs.mapInArrow(keep, docs.schema)
