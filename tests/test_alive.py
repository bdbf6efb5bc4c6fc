"""Sweeps by price, extremes between bars, and properties of blocks and their signals."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tapewright.operators import alive
from tapewright.operators import lifecycle as lc
from tapewright.operators import search
from tapewright.operators.config import ModelConfig
from tests.conftest import BAR_SCHEMA, make_bars

c = F.col
LOOSE = replace(
    ModelConfig(rb_timeframes=(5, 15), base_timeframe=5, use_smt=False, bias_timeframe=15, htf_fvg_timeframe=15), swing_lookback=3, require_min_sweep=False, require_strong_close=False,
    min_body_fraction=0.1, min_grade_to_track="C", min_grade_to_signal="C", disp_atr_mult=0.3, traded_window="0930-1600", use_stack_gate=False, require_bias=False, dol_mode="Tag only (no gate)")


def lives(rng, n, sessions, per):
    """Random lives over sessions of `per` bars: (born_idx, born_session, dead_idx, dead_session)."""
    out = []
    for _ in range(n):
        born = rng.randrange(sessions * per)
        dead = None if rng.random() < 0.2 else born + rng.choice([0, 1, 3, per, 5 * per, 40 * per, 300 * per])
        if dead is not None and dead >= sessions * per:
            dead = None
        out.append((born, born // per + 1, dead, dead // per + 1 if dead is not None else None))
    return out


@pytest.fixture
def world(spark):
    rng, sessions, per = random.Random(4), 700, 3
    bars = spark.createDataFrame([("A", i // per + 1, i) for i in range(sessions * per)], "symbol string, session_no int, idx long")
    rows = [("A", rng.choice([1, -1]), rng.randrange(sessions * per), k) for k in range(400)]
    rows = [(s, d, i, i // per + 1, k, round(rng.uniform(0, 30)) / 2) for s, d, i, k in rows]
    return rng, alive.last_sessions(bars), rows, lives(rng, 300, sessions, per)


def test_price_lies_in_a_living_interval(spark, world):
    rng, last, rows, spans = world
    zones = [("A", rng.choice([1, -1]), (lo := round(rng.uniform(0, 30)) / 2), lo + rng.choice([0.0, 0.5, 4.0]), *x) for x in spans]
    got = alive.in_interval(spark.createDataFrame(rows, "symbol string, side int, idx long, session_no int, k int, p double"), ["k"],
                            spark.createDataFrame(zones, "symbol string, side int, lo double, hi double, born_idx long, born_session int, dead_idx long, dead_session int"), last, "p")
    want = {(k, d) for _, d, i, _, k, p in rows if any(z[1] == d and z[2] <= p <= z[3] and z[4] <= i and (z[6] is None or z[6] > i) for z in zones)}
    assert {tuple(r) for r in got.collect()} == want and 0 < len(want) < len(rows)


def test_kinds_of_living_levels(spark, world):
    rng, last, rows, spans = world
    points = [("A", rng.choice([1, -1]), rng.choice([5, 15, 60]), round(rng.uniform(0, 30)) / 2, *x) for x in spans]
    asked = [(*r, r[5] - 1.0, r[5] + 1.0) for r in rows]
    got = alive.kinds_near(spark.createDataFrame(asked, "symbol string, side int, idx long, session_no int, k int, p double, lo double, hi double"), ["k"],
                           spark.createDataFrame(points, "symbol string, side int, kind long, level double, born_idx long, born_session int, dead_idx long, dead_session int"), last, "lo", "hi", [5, 15, 60])
    found = {r.k: set(r.kinds) for r in got.collect() if r.kinds}
    want = {k: {z[2] for z in points if z[1] == d and lo <= z[3] <= hi and z[4] <= i and (z[6] is None or z[6] > i)} for _, d, i, _, k, _, lo, hi in asked}
    assert found == {k: v for k, v in want.items() if v} and {len(v) for v in want.values()} == {0, 1, 2, 3}


def test_extremes_between_bars(spark):
    rng = random.Random(8)
    n, per = 900, 3
    bars = [("A", i // per + 1, i, float(rng.randrange(1000)), float(rng.randrange(1000)), 1.0, 1.0) for i in range(n)]
    index = search.search_index(spark.createDataFrame(bars, "symbol string, session_no int, idx long, high double, low double, close double, atr double"))
    ends = [(a, min(n - 1, a + rng.choice([0, 1, 2, 5, 100, 400, 800]))) for a in (rng.randrange(n) for _ in range(120))]
    rows = spark.createDataFrame([("A", a, a // per + 1, b, b // per + 1) for a, b in ends], "symbol string, a long, sa int, b long, sb int")
    for r in search.range_extremes(rows, index, "a", "sa", "b", "sb").collect():
        assert (r.high_between, r.low_between) == (max(x[3] for x in bars[r.a : r.b + 1]), min(x[4] for x in bars[r.a : r.b + 1]))


def model(spark, rows, cfg=LOOSE):
    df = spark.createDataFrame(rows, BAR_SCHEMA)
    ctx, zones, blocks = lc.build_context(df, cfg, 5)
    return ctx, zones, blocks


@pytest.fixture(scope="module")
def built(spark):
    rows = make_bars(days=25, per_day=30, seed=11)
    return rows, *model(spark, rows)


def test_stages_follow_each_other(built):
    """Formed, confirmed, left, armed, triggered: each at or after the one before, none after the end, so a funnel only narrows."""
    _, _, _, blocks = built
    rows = blocks.collect()
    assert len({r.timeframe for r in rows}) == 2 and sum(r.triggered is not None for r in rows) > 5
    for r in rows:
        seen = [r[s] for s in lc.STAGES]
        reached = [x for x in seen if x is not None]
        assert seen[: len(reached)] == reached == sorted(reached) and (r.gone is None or all(x < r.gone for x in reached[1:]))
        assert r.timeframe == 5 or r.confirmed == r.formed
        assert 1 <= r.agreement <= 2


def test_agreement_by_pairs(built):
    _, _, _, blocks = built
    rows = blocks.collect()
    for r in rows:
        near = {z.timeframe for z in rows if z.gate is None and z.bull == r.bull and r.ce - r.atr <= z.ce <= r.ce + r.atr and z.formed <= r.idx and (z.gone is None or z.gone > r.idx)}
        assert r.agreement == len(near | {r.timeframe})


def test_gates_only_refuse_more(built):
    _, ctx, zones, blocks = built
    loose = lc.model_signals(blocks, ctx, zones, replace(LOOSE, max_signals_per_session=99), 5)
    taken = {(r.timeframe, r.htf_idx) for r in loose.filter("rejection IS NULL").collect()}
    assert taken
    refused = lambda cfg: {(r.timeframe, r.htf_idx): r.rejection for r in lc.model_signals(blocks, ctx, zones, cfg, 5).collect()}
    tight = replace(LOOSE, max_signals_per_session=1, min_grade_to_signal="A", use_stack_gate=True, require_bias=True, dol_mode="Both", traded_window="0930-1100")
    late = refused(tight)
    assert {k for k, v in late.items() if v is None} < taken | {k for k, v in refused(replace(LOOSE, max_signals_per_session=99)).items() if v == "not_best_of_bar"}
    assert {v for v in late.values()} - {None} and set(late) == {(r.timeframe, r.htf_idx) for r in loose.collect()}
    dated = loose.filter("rejection IS NULL").count()
    quota = lc.model_signals(blocks, ctx, zones, replace(LOOSE, max_signals_per_session=1), 5).filter("rejection IS NULL").groupBy("session").count().collect()
    assert all(r["count"] == 1 for r in quota) and len(quota) <= dated


def test_mirrored_prices_mirror_the_blocks(spark, built):
    """Prices turned upside down turn bull into bear, with the same bars at every stage."""
    rows, ctx, zones, blocks = built
    top = 200.0
    flipped = [(s, ts, top - o, top - low, top - h, top - cl, v, d, m) for s, ts, o, h, low, cl, v, d, m in rows]
    _, _, other = model(spark, flipped)
    key = lambda r, bull: (r.timeframe, r.htf_idx, bull, r.formed, r.confirmed, r.left, r.armed, r.triggered, r.gone, r.agreement)
    a, b = sorted(key(r, r.bull) for r in blocks.collect()), sorted(key(r, not r.bull) for r in other.collect())
    # Rounding of mirrored prices may move single comparisons.
    assert len(set(a) & set(b)) >= 0.95 * len(a) and abs(len(a) - len(b)) <= 0.05 * len(a)
