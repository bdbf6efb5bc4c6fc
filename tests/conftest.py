import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapewright.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_bars(days=6, per_day=20, seed=3, symbols=("A",), start="2024-03-04"):
    """Random half-hour style bars as tuples in BAR_COLUMNS order (5-minute grid from 09:30)."""
    import datetime as dt
    from zoneinfo import ZoneInfo

    rng = random.Random(seed)
    rows = []
    for sym in symbols:
        px = 100.0
        day = dt.date.fromisoformat(start)
        for _ in range(days):
            while day.weekday() > 4:
                day += dt.timedelta(days=1)
            for k in range(per_day):
                o = px + rng.gauss(0, 0.2)
                c = o + rng.gauss(0, 0.6)
                h, low = max(o, c) + abs(rng.gauss(0, 0.3)), min(o, c) - abs(rng.gauss(0, 0.3))
                at = dt.datetime.combine(day, dt.time(9, 30), ZoneInfo("America/New_York")) + dt.timedelta(minutes=5 * k)
                rows.append((sym, int(at.timestamp()), round(o, 3), round(h, 3), round(low, 3), round(c, 3), float(rng.randint(1, 50)),
                             day.isoformat(), 570 + 5 * k))
                px = c
            day += dt.timedelta(days=1)
    return rows


BAR_SCHEMA = "symbol string, ts long, open double, high double, low double, close double, volume double, session string, minute int"


@pytest.fixture(scope="session")
def bars(spark):
    rows = make_bars(symbols=("A", "B"))
    df = spark.createDataFrame(rows, BAR_SCHEMA).cache()
    return df, rows
