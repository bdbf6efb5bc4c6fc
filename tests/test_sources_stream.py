"""File readers, and streams against the same work in batch."""

import json

import pytest
from pyspark.sql import functions as F

from tapewright.operators import bars as ob
from tapewright.operators import portfolio as pf
from tapewright.operators import quality as qa
from tapewright.operators.medians import exact_medians
from tapewright.session import shared_dir
from tapewright.sources import intraday as si
from tapewright.sources import tables as tb
from tapewright.streaming import bars as sb
from tests.conftest import BAR_SCHEMA, DATA, make_bars

c = F.col


def test_intraday_files(spark, tmp_path):
    def row(minute, kind, close):
        return dict(start_time=f"2024-07-01T{13 + (30 + minute) // 60:02d}:{(30 + minute) % 60:02d}:00Z", market_time=kind, open="1.0",
                    high="2.5", low="0.5", close=close, volume="7" if minute else None)

    rows = [row(2, "r", "2.0"), row(1, "r", "bad"), row(0, "r", "1.5"), row(3, "po", "1.8")]
    (tmp_path / "2024-07-01.json").write_text(json.dumps(rows))
    got = si.read_intraday_json(spark, str(tmp_path), "SPY").orderBy("ts").collect()
    assert [(r.minute, r.close, r.volume) for r in got] == [(570, 1.5, 0.0), (572, 2.0, 7.0)]
    days = si.read_intraday_extended(spark, str(tmp_path), "SPY", least=3).collect()
    assert [(r.rth_open, r.rth_close, r.pre_first, r.post_last) for r in days] == [(1.0, 2.0, None, 1.8)]
    assert si.read_intraday_extended(spark, str(tmp_path), "SPY").count() == 0


def test_bar_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("time,Open,High,Low,Close,Volume,X Sig Dir\n2024-07-01T13:30:00Z,1,2,0.5,1.5,,1\n1719840660,1,2,x,1.5,3,0\n"
                    "2024-07-01T09:32:00-04:00,1,2,0.5,1.7,9,NaN\n")
    rows = tb.read_bar_csv(spark, str(good), "SPY").orderBy("ts").collect()
    assert [(r.ts, r.volume, r.x_sig_dir) for r in rows] == [(1719840600, 0.0, 1.0), (1719840720, 9.0, None)]
    assert tb.signal_rows(tb.read_bar_csv(spark, str(good), "SPY")).count() == 1
    naive = tmp_path / "naive.csv"
    naive.write_text("time,open,high,low,close\n2024-07-01 09:30:00,1,2,0.5,1.5\n")
    with pytest.raises(Exception, match="UTC offset"):
        tb.read_bar_csv(spark, str(naive), "SPY").collect()
    short = tmp_path / "short.csv"
    short.write_text("time,open,high,low\n1,1,1,1\n")
    with pytest.raises(ValueError):
        tb.read_bar_csv(spark, str(short), "SPY")


def test_vol_index_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "VIX.csv"
    f.write_bytes("﻿DATE,OPEN,CLOSE\n1/2/2024,13.0,13.2\nbad,1,1\n1/3/2024,14.0,oops\n".encode())
    got = tb.close_series(tb.read_vol_index_csv(spark, str(f))).orderBy("day").collect()
    assert [(str(r.day), r.level) for r in got] == [("2024-01-02", 13.2), ("2024-01-03", 14.0)]


def test_journal_round_trip(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = spark.createDataFrame([("open", "shadow"), ("blocked", "shadow"), ("open", "shadow")], "action string, mode string")
    tb.write_journal(rows, path)
    tb.write_journal(rows.limit(1), path)
    (tmp_path / "j" / "torn.json").write_text('{"action": "op\n')
    got = {r.kind: r.n for r in tb.journal_summary(tb.read_journal(spark, path)).collect()}
    assert got == {"shadow:open": 3, "shadow:blocked": 1}


def test_missing_calendar_is_empty(spark, tmp_path):
    assert tb.read_event_calendar(spark, str(tmp_path / "none.json")).count() == 0


def test_stream_bars_equal_batch(spark, tmp_path):
    ticks = spark.read.parquet(f"{DATA}/events.parquet").select(
        c("event_type").alias("symbol"), "ts", c("value").alias("price"), c("event_id").alias("id"))
    folder = tmp_path / "in"
    cuts = ["2024-01-10", "2024-01-20", "2024-02-01"]
    low = "2023-01-01"
    for k, hi in enumerate(cuts):
        ticks.filter((c("ts") >= F.lit(low).cast("timestamp_ntz")) & (c("ts") < F.lit(hi).cast("timestamp_ntz"))).coalesce(1).write.mode(
            "append").parquet(str(folder))
        low = hi
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = (sb.stream_bars(stream, 30, delay="2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume", "session", "minute"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()}
    want = {tuple(r) for r in ob.bars_from_ticks(ticks, 30).select(*cols).collect()}
    last = max(w[1] for w in want)
    assert got <= want
    assert {w for w in want if w[1] < last - 7200} <= got


def test_daily_panel_files(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("date,close\n2024-01-02,10.5\n2024-01-03,bad\n")
    (tmp_path / "SPY.csv").write_text("date,close\n2024-01-02,470\n")
    universe, bench = tb.read_daily_panel(spark, str(tmp_path))
    assert [(r.symbol, str(r.day), r.close) for r in universe.filter("close is not null").collect()] == [("AAA", "2024-01-02", 10.5)]
    assert [(r.symbol, r.close) for r in bench.collect()] == [("SPY", 470.0)]


def test_spot_and_greek_files(spark, tmp_path):
    (tmp_path / "spot.csv").write_text("Date,SPY\n2024-01-02,470.5\n2024-01-03,\n")
    assert [(r.date, r.spot) for r in tb.read_spot_csv(spark, str(tmp_path / "spot.csv")).collect()] == [("2024-01-02", 470.5)]
    folder = tmp_path / "greeks"
    folder.mkdir()
    (folder / "2024-01.json").write_text(json.dumps([dict(date="2024-01-02", call_gamma="5", put_gamma="-2"), dict(date="2024-01-03", call_gamma="x", put_gamma="1")]))
    (folder / "2024-02.json").write_text(json.dumps([dict(date="2024-01-02", call_gamma="7", put_gamma="-2")]))
    assert [(r.date, r.net) for r in tb.read_greek_series(spark, str(folder)).collect()] == [("2024-01-02", 5.0)]


def test_gamma_snapshot_file(spark, tmp_path):
    good = dict(spot="470", gamma_flip="465", call_wall="480", put_wall="460", net_gex="1e9", as_of_ts="1704200000")
    (tmp_path / "g.json").write_text(json.dumps([good, {**good, "spot": "n/a"}]))
    got = tb.read_gamma_snapshots(spark, str(tmp_path / "g.json"), "SPY").collect()
    assert [(r.symbol, r.call_wall, r.as_of_ts, r.source) for r in got] == [("SPY", 480.0, 1704200000, "file")]


def test_trade_list_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "Trade number,Type,Date and time,Signal,Price USD,Net PnL USD,Return %,Commission USD,Duration (bars)\n"
        "1,Entry long,2024-01-02 09:35,go,100,5,0.5,1,3\n1,Exit long,2024-01-02 09:50,target,106,5,0.5,1,3\n2,Entry short,2024-01-03 10:00,go,99,,,,\n")
    got = tb.read_trade_list(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.trade_no, r.side, r.entry_price, r.exit_reason, r.pnl, r.bars) for r in got] == [(1, "long", 100.0, "target", 5.0, 3)]


def test_registry_and_archive_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "bad"), ("b", 1, "ok")], "signal string, seq long, verdict string")
    tb.write_registry(rows, str(tmp_path / "reg"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "reg"))
    assert {(r.signal, r.verdict) for r in tb.registry_latest(back, "seq").collect()} == {("a", "bad"), ("b", "ok")}
    for series, day in (("flow", "2024-01-02"), ("flow", "2024-01-03"), ("greeks", "2024-01-02")):
        (tmp_path / "arch" / series).mkdir(parents=True, exist_ok=True)
        (tmp_path / "arch" / series / f"{day}.json").write_text("[]")
    got = qa.archive_coverage(tb.archive_files(spark, str(tmp_path / "arch"))).collect()
    assert {(r.series, r.days, r.first_day, r.last_day) for r in got} == {("flow", 2, "2024-01-02", "2024-01-03"), ("greeks", 1, "2024-01-02", "2024-01-02")}


def test_bad_targets_are_refused(spark):
    for weight in (None, float("nan"), -0.1):
        with pytest.raises(Exception, match="target weight"):
            pf.check_targets(spark.createDataFrame([("x", "A", weight)], "book string, symbol string, weight double"), ["book"]).collect()


def test_exact_medians(spark):
    import random
    import statistics

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, rng.gauss(0, 1), rng.gauss(0, 1e6), None]), float(rng.randrange(3))) for _ in range(999)]
    got = {r.g: (r.x, r.y) for r in exact_medians(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"]).collect()}
    want = {g: tuple(statistics.median(v) for v in ([x for k, x, _ in rows if k == g and x is not None], [y for k, _, y in rows if k == g])) for g in ("a", "b", None)}
    assert got == want


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_stream_signals_equal_batch_over_triggers_and_a_restart(spark, tmp_path):
    """Ticks in six files, one a trigger; the second run goes on from the first one's checkpoint."""
    import random
    from dataclasses import replace

    from tapewright.operators import bars as ob
    from tapewright.operators import score as sc
    from tapewright.operators import signals as sg
    from tapewright.operators.config import ModelConfig
    from tapewright.streaming import signals as ss

    cfg = replace(ModelConfig(), traded_window="0930-1500", skip_first_minutes=30, max_signals_per_session=2)
    rng, rows = random.Random(6), []
    for k in range(4000):
        at = 1_710_160_200 + k * 97
        rows.append((k, rng.choice(["A", "B"]), at, round(100 + rng.gauss(0, 3), 2)))
    df = spark.createDataFrame(rows, "id long, symbol string, at long, price double").selectExpr("id", "symbol", "timestamp_seconds(at) AS ts", "price")
    folder = tmp_path / "ticks"

    def put(k):
        df.filter(F.floor(F.col("id") / 700) == k).coalesce(1).write.mode("append").parquet(str(folder))

    def go():
        ticks = sb.read_tick_stream(spark, str(folder), df.schema, "*.parquet")
        ss.run(ss.stream_signals(sb.stream_bars(ticks, 30), cfg), str(tmp_path / "out"), str(tmp_path / "state"))

    for k in range(3):
        put(k)
    go()
    first = spark.read.schema(ss.DECISION).parquet(str(tmp_path / "out")).count()
    for k in range(3, 6):
        put(k)
    go()
    got = sorted(map(str, spark.read.schema(ss.DECISION).parquet(str(tmp_path / "out")).collect()))
    bars = ob.bars_from_ticks(df, 30)
    last = bars.agg(F.max("ts")).first()[0]
    rows = sg.momentum(bars, 6, "direction").filter("direction <> 0").withColumn("blocked_by", F.lit(None).cast("string"))
    batch = sc.session_quota(rows.withColumn("rejection", sc.post_gates(cfg)), ["symbol"], 2).filter(F.col("ts") <= last - 1800)
    want = sorted(map(str, batch.select("symbol", "ts", "session", "direction", "rejection").collect()))
    assert got == want and 0 < first < len(got) and any("session_quota" in r for r in got) and any("rejection=None" in r for r in got)


def test_late_ticks_are_counted(spark, tmp_path):
    """Ticks that come after their bar was written are missing from it, and in the account."""
    start = 1_710_163_800
    def ticks(rows):
        return spark.createDataFrame(rows, "symbol string, at long, price double, id long").selectExpr("symbol", "timestamp_seconds(at) AS ts", "price", "id")

    files = [[("A", start + 600 * k, 1.0 + k, k) for k in range(30)], [("A", start + 600 * k, 2.0, 100 + k) for k in range(30, 40)],
             [("A", start + 60, 9.0, 200), ("A", start + 120, 9.0, 201), ("B", start + 60, 9.0, 202), ("A", start + 600 * 40, 3.0, 203)], [("A", start + 600 * 60, 3.0, 204)]]
    folder = tmp_path / "ticks"

    def go():
        stream = sb.read_tick_stream(spark, str(folder), ticks(files[0]).schema, "*.parquet")
        q = (sb.stream_bars(stream, 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    for rows in files:
        ticks(rows).coalesce(1).write.mode("append").parquet(str(folder))
        go()
    bars = spark.read.parquet(str(tmp_path / "out"))
    late = {(r.symbol, r.ts): r.late for r in sb.late_ticks(spark.read.parquet(str(folder)), bars, 30).collect()}
    assert late == {("A", start): 2, ("B", start): 1}
    assert bars.filter(f"symbol = 'A' AND ts = {start}").first()["volume"] == 3
