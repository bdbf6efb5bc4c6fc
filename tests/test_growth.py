"""The panel's series: how often they read the panel, and the names they draw."""

import pytest
from pyspark.sql import functions as F

from tapewright.operators import panel as pn
from tapewright.plans import views

c = F.col


def plan(df, name="executedPlan"):
    return getattr(df._jdf.queryExecution(), name)().toString()


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    months = spark.range(20).select((F.col("id") + 202001 + F.floor(c("id") / 12) * 88).cast("string").alias("m"))
    rows = spark.range(45).select(F.format_string("S%03d", "id").alias("symbol")).crossJoin(months.select(F.concat(F.substring("m", 1, 4), F.lit("-"), F.substring("m", 5, 2)).alias("month")))
    rows.withColumn("close", 10.0 + F.pmod(F.crc32(F.concat("symbol", "month").cast("binary")), F.lit(1000)) / 7.0).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("series", [pn.momentum_portfolio, lambda p, **k: pn.random_portfolio(p, seeds=4, **k)])
def test_series_read_the_panel_once(prices, series):
    """Returns and turnover go by the picks; the panel isn't read again for each."""
    out = series(prices, formations=((3, 1),))
    assert out.count() > 0
    assert "parquet" not in plan(out, "optimizedPlan")


def test_given_sizes_draw_the_same_names(prices):
    elig, sizes = pn.eligible_sizes(prices, ((3, 1),), 10)
    key = lambda df: sorted(map(tuple, df.select("seed", "month", "pick", "symbol").collect()))
    assert key(pn.random_picks(elig, 4, 10)) == key(pn.random_picks(elig, 4, 10, sizes=sizes))


def test_long_supplier_keys_share_a_symbol(spark, tmp_path):
    """lpad keeps six characters, so the keys 1234567 and 123456 are one symbol, as in the SQL."""
    spark.sql("""SELECT * FROM VALUES (1234567L, 2.0D, 20.0D, TIMESTAMP_NTZ '2020-01-05'), (123456L, 1.0D, 30.0D, TIMESTAMP_NTZ '2020-01-31'), (7L, 1.0D, 5.0D, TIMESTAMP_NTZ '2020-02-01'),
        (NULL, 1.0D, 5.0D, TIMESTAMP_NTZ '2020-02-01') AS t(l_suppkey, l_quantity, l_extendedprice, l_shipdate)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in views.panel(spark, str(tmp_path)).collect()}
    assert got == {("S123456", "2020-01", 20.0), ("S000007", "2020-02", 5.0), (None, "2020-02", 5.0)}
