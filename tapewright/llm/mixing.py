"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the mean number of copies of its words. The
whole part is certain. The fraction p that is left is dealt unevenly: long
documents are included with a higher probability p_i than short ones, such that
the words expected are p of the source's. Documents are ranked by
U/(1-U) / (p_i/(1-p_i)), U a hash-drawn number, and the first are taken as long
as their words fit the target; one more, that comes nearest to what is left,
fills it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, stored

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0
WORD = r"[^\x20\x09-\x0D]+"
#: Rank buckets of a source hold about this many documents each.
PER_BUCKET = 512
#: A document of this many words has half the length score, which counts in so many steps.
HALF, STEPS = 64, 1024


def length_score() -> Column:
    """Whole number from 0 to STEPS that rises with a document's words; sums of it are exact."""
    return F.floor(F.col("size") * STEPS / (F.col("size") + HALF)).cast("long")


def inclusion(p: Column) -> Column:
    """Probability of one copy beyond the certain ones, where p is the source's fraction.

    The words of a source keep the mean p: scores count from their mean, and
    are stretched as far as 0 and 1 allow.
    """
    mean = F.col("score_words") / (STEPS * F.col("source_size"))
    return p + F.least(p, 1 - p) * (length_score() / F.lit(STEPS) - mean)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Rows source, source_size, n_docs, score_words, target of a table (source, size).

    Sources take the weights in turn, by code point, null last. Targets share
    all words by weight, stop at cap x size, and the excess is shared again
    by weight until no target is above. If every source stops, words are left
    over.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("size") * length_score()).alias("score_words"))
    # A global rank in two steps: ranges of sources, then the place inside a range.
    ranges = stored(per.repartitionByRange(partitions(spark), F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    held = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("before")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranges.join(before, "part").withColumn("weight", turn).drop("part", "before"), "weights")
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        full = F.col("weight") * F.lit(share) >= F.lit(cap) * F.col("source_size")
        used, open_ = ranked.agg(F.sum(F.when(full, F.lit(cap) * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            break
        higher = (whole - (used or 0.0)) / open_
        if higher <= share:
            break
        share = higher
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(share), F.lit(cap) * F.col("source_size")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
          cap: float = CAP, seed: int = 8) -> DataFrame:
    """Rows doc_id, th (text hash), size, source, source_size, target, n, sure, extra.

    One row for the n input rows equal in id, text and source: each is taken
    `sure` times, whole, and `extra` of them once more. Null texts have size 0;
    a document without words ranks like others of its source, with the least
    odds. Draws are hashes of seed, id and text, so reruns agree; equal ranks go
    by id and text hash. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(text.cast("binary")))
    draw = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(source_col).cast("string").alias("source"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"), draw.alias("u")), "sizes")
    targets = stored(source_targets(rows.select("source", "size"), weights, cap), "targets")
    alike = rows.groupBy("doc_id", "th", "source", "size", "u").agg(F.count(F.lit(1)).alias("n"))
    wide = alike.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.floor(expected + 1e-12)
    p = F.greatest(expected - sure, F.lit(0.0))
    # Odds of the draw over odds of inclusion. The source's own odds bring the ranks back to an even spread over (0, 1).
    ratio = (F.col("u") / (1 - F.col("u"))) / (F.col("p_i") / (1 - F.col("p_i"))) * (F.col("p") / (1 - F.col("p")))
    ranked = wide.withColumns({"sure": sure.cast("long"), "p": p}).withColumn("p_i", F.when(F.col("p") > 0, inclusion(F.col("p"))))
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 0, ratio / (1 + ratio))).drop("p_i", "score_words")
    # Words wanted beyond the certain copies are filled in rank order: first by bucket, then inside the bucket where they end.
    ranked = ranked.withColumn("bucket", F.when(F.col("p") > 0, F.floor(F.col("rank") * F.ceil(F.col("n_docs") / PER_BUCKET))))
    words = F.col("n") * F.col("size")
    sums = ranked.filter("p > 0").groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    # A source's running sums go over runs of buckets first.
    runs = sums.withColumn("run", F.floor(F.col("bucket") / PER_BUCKET))
    per_run = runs.groupBy("source", "run").agg(F.sum("words").alias("in_run"))
    ahead = per_run.select(F.col("source").alias("rs"), F.col("run").alias("rr"),
                           (F.sum("in_run").over(Window.partitionBy("source").orderBy("run")) - F.col("in_run")).alias("ahead"))
    starts = runs.join(ahead, F.col("source").eqNullSafe(F.col("rs")) & (F.col("run") == F.col("rr"))).select(
        F.col("source").alias("bs"), F.col("bucket").alias("bb"),
        (F.sum("words").over(Window.partitionBy("source", "run").orderBy("bucket")) - F.col("words") + F.col("ahead")).alias("start"), "words")
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")), "left").drop("bs", "bb")
    left = F.col("target") - F.col("sure") * F.col("source_size")
    inside = F.coalesce((F.col("start") < left) & (F.col("start") + F.col("words") > left), F.lit(False))
    order = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.filter(inside).withColumn("upto", F.col("start") + F.sum(words).over(order))
    fits = F.col("upto") <= left
    whole_bucket = Window.partitionBy("source", "bucket")
    edge = edge.withColumn("rest", left - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(whole_bucket), F.col("start")))
    # The rest goes to the document whose words come nearest to it, if that is nearer than none; equal rows may share it.
    some = F.when(F.col("size") > 0, F.least(F.col("n").cast("double"), F.floor(F.col("rest") / F.col("size") + 0.5))).otherwise(0.0)
    miss = F.when(~fits & (some > 0), F.abs(F.col("rest") - some * F.col("size")))
    edge = edge.withColumns({"some": some, "miss": miss})
    nearest = F.row_number().over(whole_bucket.orderBy(F.asc_nulls_last("miss"), "rank", "doc_id", "th")) == 1
    edge = edge.withColumn("extra", F.when(fits, F.col("n")).when(nearest & (F.col("miss") < F.col("rest")), F.col("some")).otherwise(0).cast("long"))
    edge = edge.drop("upto", "rest", "some", "miss")
    taken = F.coalesce(F.col("start") + F.col("words") <= left, F.lit(False))
    flat = joined.filter(~inside).withColumn("extra", F.when(taken, F.col("n")).otherwise(F.lit(0)).cast("long"))
    return edge.unionByName(flat).select("doc_id", "th", "size", "source", "source_size", "target", "n", "sure", "extra")


def per_row(mixture: DataFrame) -> DataFrame:
    """Rows doc_id, size, source_size, target, taken for every input row; of equal rows the first `extra` are taken once more."""
    rows = mixture.select("*", F.explode(F.expr("sequence(1L, n)")).alias("i"))
    copies = F.col("sure") + (F.col("i") <= F.col("extra")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows equal in id, text and source are taken alike."""
    found = mixed(docs, **options).select(
        F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), F.col("source").alias("m_source"),
        (F.col("sure") + (2 * F.col("extra") >= F.col("n")).cast("long") * (F.col("extra") > 0).cast("long")).cast("int").alias("m_copies")).filter("m_copies > 0")
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("r_id"),
                      F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("r_th"), F.col("source").cast("string").alias("r_source"))
    joined = row.join(found, row["r_id"].eqNullSafe(found["m_id"]) & (row["r_th"] == found["m_th"]) & row["r_source"].eqNullSafe(found["m_source"]))
    return joined.select("row", F.explode(F.expr("sequence(1, m_copies)")).alias("copy")).select("row.*")
