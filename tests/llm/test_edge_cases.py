"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapewright.llm import decontaminate, fingerprints, jaccard_join, lang_id, license_scan, line_templates, lm_score, mixing, substring_dedup, token_store
from tapewright.llm.queries import vocabulary
from tests.llm.conftest import frame, odd_rows, words

CLASHES = ["row", "th", "_llm_id", "_llm_th", "held", "words", "h", "at", "first", "part", "size", "copy", "score", "lang_pred", "file", "r_id", "m_id"]


def bench(spark, rng, rows=None):
    return spark.createDataFrame(rows if rows is not None else [(1, words(rng, 30)), (2, None), (None, "")], "item_id long, text string")


def operators(spark, rng):
    b = bench(spark, rng)
    return {
        "substring": substring_dedup.dedup, "language": lang_id.identify, "decontaminate": lambda d: decontaminate.contaminated(d, b),
        "jaccard": jaccard_join.join, "lines": line_templates.dedup, "lm": lm_score.score, "tokens": lambda d: token_store.round_trip(d, vocabulary()),
        "mixing": lambda d: mixing.per_row(mixing.mixed(d)), "licenses": lambda d: license_scan.scan(d, license_scan.templates(spark)),
        "fingerprints": fingerprints.compare}


NAMES = ["substring", "language", "decontaminate", "jaccard", "lines", "lm", "tokens", "mixing", "licenses", "fingerprints"]
PER_ROW = {"substring", "language", "jaccard", "lines", "lm", "tokens", "mixing", "fingerprints"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, rng, name):
    rows = odd_rows(rng)
    docs = frame(spark, rows)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("x"))
    found = operators(spark, rng)[name](docs).collect()
    if name in PER_ROW:
        assert len(found) == len(rows)
        assert sorted(str(r["doc_id"] if name != "jaccard" else r["_llm_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    else:
        assert not found


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, rng, name):
    assert operators(spark, rng)[name](frame(spark, [])).count() == 0


def test_empty_benchmark_and_templates(spark, rng):
    docs = frame(spark, [(1, words(rng, 20))])
    assert decontaminate.contaminated(docs, bench(spark, rng, [])).count() == 0
    assert decontaminate.drop_contaminated(docs, bench(spark, rng, [])).count() == 1
    assert license_scan.scan(docs, spark.createDataFrame([("a", None), ("b", " ")], "license_id string, text string")).count() == 0


def test_stages_keep_columns(spark, rng, tmp_path):
    bench(spark, rng).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, words(rng, 20), "en", "s") for i in range(30)] + [(i, t, None, None) for i, t in odd_rows(rng)]
    docs = frame(spark, rows)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("x"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
        else:
            assert out.count() == docs.count() > 0
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0


def test_pipeline_effects(spark, rng, tmp_path):
    passage = words(rng, 25)
    bench(spark, rng, [(1, passage)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    one, two = words(rng, 60), words(rng, 60)
    near = two.rsplit(" ", 1)[0] + " changed"
    clean = [(i, words(rng, 50), "en", "s") for i in range(10, 40)]
    rows = [(1, "12 34 !", None, "s"), (2, one, "en", "s"), (3, one, "en", "s"), (4, two, "en", "s"), (5, near, "en", "s"), (6, words(rng, 30) + " " + passage, "en", "s"), *clean]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(ids) == {2, 4, *range(10, 40)}
