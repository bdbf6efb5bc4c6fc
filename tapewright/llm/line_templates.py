"""Line dedup with a log-template tree of fixed depth.

A line's masked words (words with a digit become a wildcard) lead it down the
tree: number of words, then its first LEAD words; that is its leaf. In a leaf,
a word that stands at its place in lines of MIN_DOCS documents or more is
constant, other words become wildcards. The lines that agree then share a
template; templates that recur in MIN_DOCS documents are dropped.

The values of a variable field are frequent words, too, once the corpus is
large. So templates are formed again at each of a ladder of bars, twice as high
as the one before, by which fewer and fewer words are constant; a line is
dropped if its template at any bar recurs. Lines too short for a template, or with too few
constant words, are dropped if the masked line itself recurs. There is a bar between a field's
values and the template's own words if each value stands in less than half of
the template's lines. Bars above the first count (line, document) pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import ID, TH, identified, slices, stored, trim

LEAD, MIN_DOCS, MIN_WORDS, CONSTANT, WILD = 2, 3, 3, 0.5, "<*>"
#: Words of a leaf, or of a part of one, that a task holds at a time.
LEAF_WORDS = 1 << 18
_VARIABLE = re.compile(r"\S*\d\S*")


def masked(line: str) -> list[str]:
    return (_VARIABLE.sub(WILD, line) if any(map(str.isdigit, line)) else line).split()


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def leaves(texts: DataFrame, lead: int) -> DataFrame:
    """Rows: identity, place of the line, hash of its masked words, leaf, words that are fixed, words; lines with a word."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, out = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for at, line in enumerate(t.split("\n")):
                    words = masked(line)
                    if words:
                        row.append(i)
                        out.append((at, _signed(" ".join(words)), _signed(f"{len(words)} {' '.join(words[:lead])}"),
                                    len(words) - words.count(WILD), len(words)))
            take = pa.array(row, pa.int64())
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column(ID).take(take), batch.column(TH).take(take), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], [ID, TH, "at", "line", "leaf", "fixed", "n"])

    return texts.mapInArrow(work, f"{ID} bigint, {TH} bigint, at int, line bigint, leaf bigint, fixed int, n int")


def _counted(t: pa.Table, lead: int, min_docs: int, whole: bool) -> tuple[np.ndarray, ...]:
    """Of lines: numbers of words and of fixed leading words. Of other fixed words: line and (leaf, place, word). Of each (leaf, place, word): place,
    word, sum of its lines' documents, whether min_docs documents have it. Then pairs of (leaf, place, word) and document where it is not so; if the
    leaves are whole, not all of them."""
    words, docs, wild = t["words"].combine_chunks(), t["docs"].combine_chunks(), _signed(WILD)
    n, word = pc.list_value_length(words).to_numpy(), words.flatten().to_numpy()
    line = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    head = np.bincount(line[(pos < lead) & (word != wild)], minlength=len(n))
    at = np.flatnonzero((pos >= lead) & (word != wild))
    line, pos, word = line[at], pos[at], word[at]
    leaf, line_docs = t["leaf"].to_numpy()[line], t["line_docs"].to_numpy()[line]
    order = np.lexsort((word, pos, leaf))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (leaf, pos, word)])
    starts, group = np.flatnonzero(new), np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    some, most = (f.reduceat(line_docs[order], starts) if len(starts) else np.zeros(0, np.int64) for f in (np.add, np.maximum))
    # If a line alone has enough documents, the count is plain; else documents are counted once over the lines.
    open_ = np.flatnonzero(((most < min_docs) & (some >= (min_docs if whole else 0)))[group])
    sizes, doc = pc.list_value_length(docs).to_numpy(), docs.flatten().to_numpy()
    size = sizes[line[open_]]
    in_group = np.repeat(group[open_], size)
    doc = doc[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat((np.cumsum(sizes) - sizes)[line[open_]], size)]
    by = np.lexsort((doc, in_group))
    in_group, doc = in_group[by], doc[by]
    first = np.ones(len(by), bool)
    first[1:] = (in_group[1:] != in_group[:-1]) | (doc[1:] != doc[:-1])
    in_group, doc = in_group[first], doc[first]
    found = (most >= min_docs) | (np.bincount(in_group, minlength=len(starts)) >= min_docs)
    left = ~found[in_group]
    return n, head, line, group, pos[order][starts], word[order][starts], some, found, in_group[left], doc[left]


def _lists(of: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Values by row; `of`, the rows of the values, ascends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]), pa.int32()), values)


def _structs(kind: pa.StructType, *columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, kind)], fields=list(kind))


_WORD = pa.struct([("pos", pa.int32()), ("word", pa.int64()), ("level", pa.int8())])
_COUNT = pa.struct([("pos", pa.int32()), ("word", pa.int64()), ("some", pa.int64()), ("found", pa.bool_()), ("docs", pa.list_(pa.int64()))])
_LINE = pa.struct([("line", pa.int64()), ("n", pa.int32()), ("head", pa.int32())])
_PLACE = pa.struct([("at", pa.int32()), ("k", pa.int32())])
_REST = "array<struct<pos:int,word:bigint,level:tinyint>>"


def constants(words: DataFrame, lead: int, min_docs: int, leaf_words: int) -> DataFrame:
    """Rows home, line, n, head, rest of rows (leaf, line, line_docs, docs, words); one for each line.

    `n` is the number of words, `head` that of fixed leading words; `rest` has
    the line's other constants with their places and levels, the numbers of the
    highest bars that they reach.

    Rows are dealt by ranges of (leaf, line), so words are counted where they
    lie: all leaves of a task but its first and its last are whole. Those two,
    and leaves with more than `leaf_words` words in a task, are kept in parts of
    about so many words, one row each with its lines and counts. Counts of parts
    are summed over the tasks and come back to each part.
    """
    def lines(t: pa.Table) -> pa.RecordBatch:
        n, head, line, group, pos, word, some, found, *_ = _counted(t, lead, min_docs, True)
        own = np.flatnonzero(found[group])
        # Number of the highest bar: bits of some // min_docs, less one.
        level = np.frexp((some // min_docs).astype(float))[1] - 1
        rest = _lists(line[own], len(n), _structs(_WORD, *(x[group[own]] for x in (pos, word, level))))
        no = [pa.nulls(len(n), x) for x in (pa.int64(), pa.list_(_LINE), pa.list_(_PLACE), pa.list_(_COUNT))]
        return row(t["leaf"].combine_chunks(), t["line"].combine_chunks(), pa.array(n, pa.int32()), pa.array(head, pa.int32()), rest, *no)

    def part(t: pa.Table) -> pa.RecordBatch:
        n, head, line, group, pos, word, some, found, of, docs = _counted(t, lead, min_docs, False)
        counts = _structs(_COUNT, pos, word, some, found, _lists(of, len(pos), pa.array(docs, pa.int64())))
        no = [pa.nulls(1, x) for x in (pa.int64(), pa.int32(), pa.int32(), pa.list_(_WORD))]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return row(t["leaf"].combine_chunks()[:1], *no, t["line"].combine_chunks()[:1], one(_structs(_LINE, t["line"].combine_chunks(), n, head)), one(_structs(_PLACE, line, group)), one(counts))

    def row(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), ["leaf", "line", "n", "head", "rest", "part", "lines", "places", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last leaf so far, the leaf that goes out in parts, the last line.
        rest, split, seen = None, None, None
        for b in batches:
            line = b.column("line").to_numpy()
            if not len(line):
                continue
            # Repeated rows of one document give a line more than once.
            b = b.filter(pa.array(np.concatenate([[seen is None or line[0] != seen], line[1:] != line[:-1]])))
            seen = line[-1]
            t = pa.concat_tables([*([rest] if rest else []), pa.Table.from_batches([b])])
            if not len(t):
                continue
            leaf = t["leaf"].to_numpy()
            split = leaf[0] if split is None else split
            start, last = int(np.searchsorted(leaf, split, "right")), int(np.searchsorted(leaf, leaf[-1], "left"))
            if start < last:
                yield lines(t.slice(start, last - start))
            if 0 < start < len(t):
                yield part(t.slice(0, start))
            rest = t.slice(0 if start == len(t) else max(start, last))
            if full(rest):
                yield part(rest)
                rest, split = None, leaf[-1]
        if rest:
            yield part(rest)
        trim()

    def full(t: pa.Table) -> bool:
        return pc.sum(pc.list_value_length(t["words"])).as_py() > leaf_words

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of parts, with the levels found for their counts."""
        for batch in batches:
            for i in range(batch.num_rows):
                line, place, count, known = (batch.column(x)[i].values for x in ("lines", "places", "counts", "levels"))
                level = np.full(len(count), -1)
                level[known.field("k").to_numpy()] = known.field("level").to_numpy()
                at, k = place.field("at").to_numpy(), place.field("k").to_numpy()
                own = np.flatnonzero(level[k] >= 0)
                k, at = k[own], at[own]
                rest = _lists(at, len(line), _structs(_WORD, count.field("pos").to_numpy()[k], count.field("word").to_numpy()[k], level[k]))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("leaf")[i].as_py()] * len(line), pa.int64()), line.field("line"), line.field("n"), line.field("head"), rest],
                                                 ["home", "line", "n", "head", "rest"])

    found = stored(words.repartitionByRange("leaf", "line").sortWithinPartitions("leaf", "line").mapInArrow(
        work, f"leaf bigint, line bigint, n int, head int, rest {_REST}, part bigint, lines array<struct<line:bigint,n:int,head:int>>, places array<struct<at:int,k:int>>, "
        "counts array<struct<pos:int,word:bigint,some:bigint,found:boolean,docs:array<bigint>>>"), "constants", release=True)
    parts = found.filter(F.col("part").isNotNull())
    counts = parts.select("part", "leaf", F.posexplode("counts").alias("k", "c")).select("part", "leaf", "k", "c.*")
    total = counts.groupBy("leaf", "pos", "word").agg(F.sum("some").alias("some"), F.max("found").alias("found"), F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"))
    level = (F.length(F.bin(F.floor(F.col("some") / min_docs))) - 1).cast("tinyint").alias("level")
    total = total.filter(F.col("found") | (F.col("docs") >= min_docs)).select("leaf", "pos", "word", level)
    levels = counts.join(total, ["leaf", "pos", "word"]).groupBy("part").agg(F.collect_list(F.struct("k", "level")).alias("levels"))
    filled = parts.join(levels, "part", "left").select("leaf", "lines", "places", "counts", F.coalesce("levels", F.array().cast("array<struct<k:int,level:tinyint>>")).alias("levels"))
    filled = filled.mapInArrow(fill, f"home bigint, line bigint, n int, head int, rest {_REST}")
    return found.filter(F.col("part").isNull()).select(F.col("leaf").alias("home"), "line", "n", "head", "rest").unionByName(filled)


def recurring(texts: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS, least: int = MIN_WORDS, constant: float = CONSTANT,
              leaf_words: int = LEAF_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines of all texts, rows (line, template) of the masked lines to drop); both by hash.

    A leaf with one line needs no look at its words: the line is its template,
    and it recurs if the line does.
    """
    lines = stored(leaves(texts, lead), "lines")
    pairs = lines.select("leaf", "line", "fixed", "n", ID, TH).distinct()
    per_line = stored(pairs.groupBy("leaf", "line", "fixed", "n").agg(F.count(F.lit(1)).alias("line_docs")), "per_line", release=True)
    # Equal masked lines, however short, with a word that is not masked.
    equal = per_line.filter((F.col("line_docs") >= min_docs) & (F.col("fixed") > 0)).select("line", F.col("line").alias("template"))
    # Leaves that enough documents reach: surely if they reach a line of it, never if all its lines together have too few; else documents are counted.
    stats = stored(per_line.filter(F.col("n") >= least).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("sorts"), F.sum("line_docs").alias("some"), F.max("line_docs").alias("most")).filter((F.col("some") >= min_docs) & (F.col("sorts") > 1)), "leaves", release=True)
    open_ = stats.filter(F.col("most") < min_docs).select("leaf")
    docs = lines.join(open_, "leaf", "left_semi").select("leaf", ID, TH).distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    enough = lambda fixed, n: (fixed >= n * constant) & (fixed >= least)

    shared = stored(stats.filter(F.col("most") >= min_docs).select("leaf").unionByName(docs.select("leaf")), "shared", release=True)
    pairs = stored(lines.join(shared, "leaf", "left_semi").groupBy("leaf", "line", ID, TH).agg(F.min("at").alias("at")), "pairs", release=True)
    # One place to read each distinct masked line from; the documents of a line, if they may have to be counted with those of others.
    place = stored(pairs.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("line_docs"), F.min(F.struct(F.col(ID).alias("p_id"), F.col(TH).alias("p_th"), "at")).alias("p")), "places", release=True)
    few = pairs.join(place.filter(F.col("line_docs") < min_docs).select("line"), "line").groupBy("line").agg(F.collect_list(F.xxhash64(ID, TH)).alias("docs"))
    place = place.join(few, "line", "left").select("p", F.struct("p.at", "leaf", "line", "line_docs", F.coalesce("docs", F.array().cast("array<bigint>")).alias("docs")).alias("at"))
    wanted = place.groupBy("p.p_id", "p.p_th").agg(F.collect_list("at").alias("ats"))
    sources = texts.join(wanted, texts[ID].eqNullSafe(wanted["p_id"]) & (texts[TH] == wanted["p_th"])).select("text", "ats")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of = batch.column("ats").flatten()
            places, words = iter(pc.struct_field(of, "at").to_pylist()), []
            for t, k in zip(batch.column("text").to_pylist(), pc.list_value_length(batch.column("ats")).to_pylist()):
                split = t.split("\n")
                words += [list(map(_signed, masked(split[at]))) for at in islice(places, k)]
            yield pa.RecordBatch.from_arrays([*(pc.struct_field(of, x) for x in ("leaf", "line", "line_docs", "docs")), pa.array(words, pa.list_(pa.int64()))],
                                             ["leaf", "line", "line_docs", "docs", "words"])

    words = stored(sources.mapInArrow(read, "leaf bigint, line bigint, line_docs bigint, docs array<bigint>, words array<bigint>"), "words", release=True)
    # A line's constants with their places are its template; the other places are wildcards. Its first words are those of its leaf.
    formed = constants(words, lead, min_docs, leaf_words)
    # Bars between two levels of a line's words give the template of the upper one.
    bars = F.array_distinct(F.concat(F.array(F.lit(0).cast("tinyint")), F.transform("rest", lambda x: x["level"])))
    formed = formed.withColumn("bar", F.explode(bars)).withColumn("rest", F.filter("rest", lambda x: x["level"] >= F.col("bar"))).withColumn("fixed", F.col("head") + F.size("rest"))
    rest = F.transform("rest", lambda x: F.struct(x["pos"], x["word"]))
    formed = stored(formed.filter(enough(F.col("fixed"), F.col("n"))).select("line", F.xxhash64("home", rest).alias("template")).distinct(), "formed", release=True)
    kept = pairs.join(formed, "line").select("template", ID, TH).distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    return lines, stored(equal.unionByName(formed.join(kept.select("template"), "template", "left_semi").select("line", "template")), "templates", release=True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows doc_id, n_lines, n_dropped, clean_text; one for each row of docs.

    Lines end at a newline; a word is a run of other characters than white
    space. Null texts count as empty. Documents are told apart by id and text,
    so a repeated row counts once. All occurrences of a recurring template are
    dropped, and of masked lines that recur as they are; the latter may be of
    any length, a template has MIN_WORDS constant words or more, and half of
    all. An empty table gives no rows.
    """
    texts = identified(docs, id_col, text_col)
    lines, drops = recurring(texts, **options)
    gone = lines.join(drops.select("line"), "line", "left_semi").groupBy(F.col(ID).alias("g_id"), F.col(TH).alias("g_th")).agg(F.collect_set("at").alias("ats"))
    marked = texts.join(gone, texts[ID].eqNullSafe(gone["g_id"]) & (texts[TH] == gone["g_th"]), "left").select(ID, "text", "ats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m, clean = [], [], []
            for t, ats in zip(batch.column("text").to_pylist(), batch.column("ats").to_pylist()):
                split, out = t.split("\n"), set(ats or [])
                n.append(len(split) if t else 0)
                m.append(len(out))
                clean.append("\n".join(x for i, x in enumerate(split) if i not in out) if out else t)
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(clean, pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", "clean_text"])

    return marked.mapInArrow(cut, "doc_id bigint, n_lines bigint, n_dropped bigint, clean_text string")
