"""What a task of the block stages may hold: no whole symbol, and the tables of one search."""

import re

from tapewright.operators import levels as lv
from tapewright.operators import lifecycle as lc
from tapewright.operators import order
from tapewright.plans import q_engine as qe
from tests.conftest import BAR_SCHEMA, DATA, make_bars


def plan(df, name="executedPlan"):
    return getattr(df._jdf.queryExecution(), name)().toString()


def test_bars_are_not_dealt_by_symbol(spark):
    """A join by symbol before the pivots would put all bars of a symbol in one task."""
    bars = order.with_index(spark.createDataFrame(make_bars(symbols=("A", "B")), BAR_SCHEMA))
    peer = bars.select("symbol", "ts", "high", "low")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(lv.smt_divergence(lv.peer_join(bars, peer), 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert not re.search(r"SortMergeJoin \[symbol#\d+\], \[symbol#\d+\], Inner", text)


def test_stages_are_searched_one_at_a_time(spark):
    """Before, the sixteen joins of three searches met in one stage, and a task held the tables of all."""
    blocks = qe.candidates(spark, DATA)
    names = [f"{n}{x}" for n in (*lc.STAGES, "gone") for x in ("", "_session")]
    again = lc.block_events(blocks.drop(*names), qe.context(spark, DATA), qe.LOOSE, qe.TF)
    assert plan(again, "optimizedPlan").count("Join ") == 1
    rows = lambda df: sorted(map(str, df.select(*lc.BLOCK, *names).collect()))
    assert rows(again) == rows(blocks)
