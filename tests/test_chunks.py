"""Chunked windows must equal the plain series, wherever chunks break."""

import math
import random

from pyspark.sql import functions as F

from tapewright.functions import shape as sh
from tapewright.operators import indicators as ind
from tapewright.operators import levels as lv
from tapewright.operators import order
from tapewright.operators import signals as sg
from tests.conftest import BAR_SCHEMA, make_bars

c = F.col


def series(rows, sym):
    return [r for r in rows if r[0] == sym]


def by_symbol(df, *cols):
    out = {}
    for r in df.select("symbol", "idx", *cols).orderBy("symbol", "idx").collect():
        out.setdefault(r[0], []).append(tuple(r)[2:])
    return out


def test_index_is_dense(bars):
    df, rows = bars
    got = by_symbol(order.with_index(df), "ts")
    for sym in "AB":
        assert [x[0] for x in got[sym]] == [r[1] for r in series(rows, sym)]


def test_over_history_equals_plain_window(bars):
    df, rows = bars
    for chunk in (5, 7, 64):
        out = order.over_history(order.with_index(df), 4, lambda d, w: d.withColumn("m", F.min("low").over(order.back(w, 3))), chunk=chunk)
        got = by_symbol(out, "m")
        for sym in "AB":
            s = series(rows, sym)
            assert [x[0] for x in got[sym]] == [min(r[4] for r in s[max(0, i - 3): i + 1]) for i in range(len(s))]


def test_carry_last_reaches_over_many_chunks(bars):
    df, rows = bars
    flagged = order.with_index(df).withColumn("v", F.when(c("close") > c("open") + 0.9, c("idx")))
    got = by_symbol(order.carry_last(flagged, {"last": c("v")}, chunk=3), "last")
    for sym in "AB":
        want, held = [], None
        for i, r in enumerate(series(rows, sym)):
            held = i if r[5] > r[2] + 0.9 else held
            want.append(held)
        assert [x[0] for x in got[sym]] == want


def test_rma_equals_recursion(spark):
    rows = make_bars(days=12, per_day=60, seed=9)
    df = order.with_index(spark.createDataFrame(rows, BAR_SCHEMA))
    for n in (2, 5, 14, 50):
        got = [x[0] for x in by_symbol(ind.rma(df, "close", n, "y"), "y")["A"]]
        closes = [r[5] for r in rows]
        y = sum(closes[:n]) / n
        assert got[: n - 1] == [None] * (n - 1)
        for i in range(n - 1, len(closes)):
            if i >= n:
                y = closes[i] / n + (1 - 1 / n) * y
            assert math.isclose(got[i], y, rel_tol=1e-12)


def test_session_ranges_over_chunks(bars):
    df, rows = bars
    specs = {"am": "0940-1015", "all": "0930-1600", "late": "1030-1100"}
    for chunk in (4, 9, 4096):
        out = lv.session_ranges(order.with_index(df), specs, chunk=chunk)
        for p, spec in specs.items():
            lo, hi = (int(spec[:2]) * 60 + int(spec[2:4]), int(spec[5:7]) * 60 + int(spec[7:]))
            got = by_symbol(out, f"{p}_high", f"{p}_low", f"{p}_exit")
            for sym in "AB":
                want, was, h, low = [], False, None, None
                for r in series(rows, sym):
                    inside = lo <= r[8] < hi
                    if inside and not was:
                        h, low = r[3], r[4]
                    elif inside:
                        h, low = max(h, r[3]), min(low, r[4])
                    want.append((h, low, was and not inside))
                    was = inside
                assert got[sym] == want, (p, chunk)


def test_asof_join_any_span(spark):
    import random

    rng = random.Random(5)
    refs = sorted((rng.randrange(0, 500), k) for k in range(40))
    probes = [(t, k) for k, t in enumerate(rng.randrange(0, 520) for _ in range(120))]
    ref = spark.createDataFrame([("A", t, k) for t, k in refs], "symbol string, rt long, k long").withColumn("v", F.struct("k"))
    probe = spark.createDataFrame([("A", t, k) for t, k in probes], "symbol string, t long, p long")
    for strict in (False, True):
        for span in (7, 60, 10_000):
            out = order.asof_join(probe, ref, "symbol", "t", "rt", "v", span, strict=strict, seq="k")
            got = {r.p: (r.v.k if r.v else None) for r in out.collect()}
            for t, p in probes:
                held = [k for rt, k in sorted(refs) if (rt < t if strict else rt <= t)]
                assert got[p] == (held[-1] if held else None)


def test_python_signal_is_chunk_free(bars):
    df, rows = bars

    def rule(frame):
        return (frame["close"] > frame["close"].shift(3)).astype("int32")

    a = by_symbol(sg.python_signal(order.with_index(df), rule, 3, ["close"], chunk=8), "signal")
    b = by_symbol(sg.python_signal(order.with_index(df), rule, 3, ["close"], chunk=4096), "signal")
    assert a == b


def test_signals_are_causal(spark):
    """Cutting the future off never changes a past signal."""
    rows = make_bars(days=5, per_day=30, seed=11)
    full, names = sg.candidate_signals(ind.atr(order.with_index(spark.createDataFrame(rows, BAR_SCHEMA))))
    cut, _ = sg.candidate_signals(ind.atr(order.with_index(spark.createDataFrame(rows[:97], BAR_SCHEMA))))
    a, b = by_symbol(full, *names)["A"][:97], by_symbol(cut, *names)["A"]
    assert a == b
    assert all(v in (-1, 0, 1) for row in b for v in row)


def test_depth_shape(spark):
    df = spark.createDataFrame([(110.0, 100.0, 120.0, 90.0)], "pdh double, pdl double, pwh double, pwl double")
    got = df.select(sh.dealing_depth(F.lit(105.0), F.lit(True)).alias("mid"), sh.dealing_depth(F.lit(90.0), F.lit(True)).alias("deep"),
                    sh.dealing_depth(F.lit(100.0), F.lit(True)).alias("half")).first()
    assert got.mid == 0.0 and got.deep == 1.0
    assert math.isclose(got.half, (0.65 + 0.35 / 3) ** 1.5)


def test_exact_ranks(spark):
    from tapewright.operators.ranks import with_rank

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 0.0, rng.gauss(0, 1), rng.gauss(0, 1e6), 7.0, -7.0]), i) for i in range(700)]
    got = with_rank(spark.createDataFrame(rows, "g string, v double, i int").repartition(4), ["g"], "v", "i").collect()
    for g in ("a", "b", None):
        mine = [r for r in rows if r[0] == g]
        order = sorted(mine, key=lambda r: (0, 0.0, r[2]) if r[1] is None else (2, 0.0, r[2]) if r[1] != r[1] else (1, r[1], r[2]))
        assert {r.i: (r._rn, r._n) for r in got if r.g == g} == {r[2]: (k + 1, len(mine)) for k, r in enumerate(order)}
