"""Helpers shared by the corpus operators: identities, stored tables, components, seeded draws."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.session import cut_lineage, shared_dir

#: Characters of text handled together inside a task.
SLICE_CHARS = 1 << 20
#: Names of the identity columns inside the operators.
ID, TH = "_llm_id", "_llm_th"


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identity of each row, (id, hash of the text), and its text (null: empty).

    Rows with equal id and text are the same document and get equal results;
    rows that share only the id are told apart by their text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias(ID), F.xxhash64(text).alias(TH), text.alias("text"))


def same_row(left: DataFrame, right: DataFrame):
    """Null-safe equality of the identity columns."""
    return left[ID].eqNullSafe(right[ID]) & (left[TH] == right[TH])


def held_out(id_column, modulus: int, remainder: int):
    """True where crc32 of the id as text has this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


#: Spark deletes the shuffle files of an execution when it ends.
RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor re-reads the files. With `release` the
    shuffle files of the write go at its end, not at some later garbage
    collection of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE_CONF, None)
    if release:
        spark.conf.set(RELEASE_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE_CONF) if before is None else spark.conf.set(RELEASE_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a Python worker keeps from task to task, by name.
_STORES: dict[str, object] = {}


def worker_store(name: str, make: Callable[[], object]):
    """What this Python worker keeps under a name; workers live on over many tasks and stages."""
    if name not in _STORES:
        _STORES[name] = make()
    return _STORES[name]


def trim() -> None:
    """Gives freed memory back to the system, so that a worker that waits holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS, rows: int = 1024, store: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `chars` bytes of text, or one long row.

    A task keeps the worker's store of that name; what other operators left
    there goes at its start, and freed memory at its end.
    """
    for name in [n for n in _STORES if n != store]:
        del _STORES[name]
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    trim()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps; each is a minimum per node
    with map-side combining and a join back, so a hub never meets in one task
    with all its neighbours' pairs. Every round is checkpointed.
    """
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.filter("u <> v").distinct())
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
