"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tapewright.functions import stats as st
from tapewright.functions import timecols as tc
from tapewright.operators import bars as ob
from tapewright.operators import calendar as cal
from tapewright.operators import detect as dt
from tapewright.operators import indicators as ind
from tapewright.operators import order
from tapewright.operators import panel as pn
from tapewright.operators import resolve as rs
from tapewright.operators import score as sc
from tapewright.operators import studies as sd
from tapewright.operators.config import ModelConfig
from tests.conftest import BAR_SCHEMA

c = F.col


def flat(spark, ohlc, minute0=570):
    rows = [("A", 1_709_562_600 + 60 * i, *map(float, x), 10.0, "2024-03-04", minute0 + i) for i, x in enumerate(ohlc)]
    return order.with_index(spark.createDataFrame(rows, BAR_SCHEMA))


def test_parse_session():
    assert tc.parse_session("0930-1600") == (570, 960)
    assert tc.parse_session("1800-0000") == (1080, 1440)
    for bad in ("9:30-16", "0930", "abcd-efgh"):
        with pytest.raises(ValueError):
            tc.parse_session(bad)


def test_resample_conserves_and_composes(bars):
    df, rows = bars
    w15 = ob.resample_bars(df, 15)
    direct, twice = ob.resample_bars(df, 45), ob.resample_bars(w15, 45)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, twice.collect()))
    assert direct.agg(F.sum("volume")).first()[0] == sum(r[6] for r in rows)


def test_bucket_start_over_clock_change(spark):
    """The left edge follows the wall clock across the spring switch."""
    df = spark.createDataFrame([("2024-03-08", 0), ("2024-03-11", 0), ("2024-03-11", -2)], "session string, bucket int")
    got = [r[0] for r in df.select(tc.bucket_start(c("session"), c("bucket"), 60)).collect()]
    assert got == [1_709_908_200, 1_710_163_800, 1_710_163_800 - 7200]


def test_pivot_ties_confirm_the_earlier_top(spark):
    highs = [1.0, 2.0, 5.0, 5.0, 2.0, 1.0, 1.0]
    df = flat(spark, [(h, h, 0.5, h) for h in highs])
    got = [r[0] for r in ind.pivot_high(df, 2, 2).orderBy("idx").select("pivot_high").collect()]
    assert got == [None, None, None, None, 5.0, None, None]


def test_opposing_run_skips_leading_bars(spark):
    # up, down, down, up, then the bar that looks back
    df = flat(spark, [(1, 3, 1, 2), (9, 9, 6, 7), (7, 7, 4, 5), (5, 7, 5, 6), (6, 12, 6, 11)])
    got = dt.opposing_run(df, 4, True, "r").filter("idx = 4").select("r_level", "r_len", "r_start").first()
    assert tuple(got) == (9.0, 2, 1)
    fired = dt.change_of_state(df, True, 4, ModelConfig(), "f").filter("idx = 4").first()["f"]
    assert fired


def test_stop_wins_inside_one_bar(spark):
    df = flat(spark, [(10, 10, 10, 10), (10, 14, 8, 12), (12, 13, 11, 12)])
    entry = spark.createDataFrame([("A", "2024-03-04", 1, 1, 10.0, 1.0, 1.0, 2.0)],
                                  "symbol string, session string, day_pos int, direction int, entry double, atr double, stop_atr double, target_atr double")
    got = rs.resolve_entry(entry, rs.session_paths(df), cost_atr=0.02).first()
    assert (got.outcome, got.bars_held) == ("stop", 1)
    assert got.r == pytest.approx(-1.02)
    last = spark.createDataFrame([("A", "2024-03-04", 3, 1, 12.0, 1.0, 1.0, 2.0)], entry.schema)
    assert rs.resolve_entry(last, rs.session_paths(df)).count() == 0


def test_blackout_ends_count(spark):
    probe = spark.createDataFrame([(i, 10_000 + d) for i, d in enumerate((-901, -900, 0, 900, 901))], "id int, ts long")
    events = spark.createDataFrame([(10_000, "cpi"), (10_000, "b")], "event_ts long, name string")
    got = {r.id: r.blocked_by for r in cal.event_blackout(probe, events).collect()}
    assert got == {0: None, 1: "b", 2: "b", 3: "b", 4: None}


def test_drop_best_rules(spark):
    n = spark.createDataFrame([(k,) for k in (10, 150, 250, 350)], "n long")
    assert [r[0] for r in n.select(pn.drop_best_count(c("n"))).collect()] == [1, 2, 2, 4]


def test_deciles_are_not_ntile(spark):
    df = spark.createDataFrame([("A", float(i), 1.0, i) for i in range(203)], "symbol string, v double, pnl double, day int")
    got = {r.decile: r.n for r in sd.deciles(df, ["symbol"], "v", "pnl", "day").collect()}
    assert got == {q + 1: (q + 1) * 203 // 10 - q * 203 // 10 for q in range(10)}


def test_targets_behind_the_entry_drop_out(spark):
    df = spark.createDataFrame([(True, 10.0, 12.0, 14.5, 10.0)], "bull boolean, ext double, disp_extreme double, entry double, stop double")
    got = df.select(sc.build_targets(ModelConfig()).alias("t")).first().t
    assert [(t.leg_multiple, t.price) for t in got] == [(2.5, 15.0), (4.0, 18.0)]
    assert got[0].r_multiple == pytest.approx(0.5 / 4.5)


def test_small_samples_give_null(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    row = one.agg(st.std_error(c("x")).alias("se"), st.t_stat(c("x")).alias("t"), st.sharpe(c("x")).alias("s")).first()
    assert tuple(row) == (None, None, None)


def test_random_picks_are_distinct_and_eligible(spark):
    rows = [(f"N{i:03d}", f"2020-{m:02d}", 10.0 + i + m) for i in range(40) for m in range(1, 12)]
    panel = spark.createDataFrame(rows, "symbol string, month string, close double")
    elig = pn.eligible(panel, ((3, 1),), 10)
    picks = pn.random_picks(elig, 6, 10)
    per = picks.groupBy("seed", "month").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("d")).collect()
    months = elig.select("month").distinct().count()
    assert len(per) == 6 * months and all(r.n == 10 and r.d == 10 for r in per)
