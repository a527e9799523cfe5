"""Forming bars go by their flags, completed ones stay."""

from pyspark.sql import functions as F

from barlight.plans import catalog, screen
from barlight.sources import bars as B
from tests.test_operators import make
from tests.test_queries import DATA


def test_flagged_last_bars_go_and_all_days_stay(spark):
    days = {}
    for r in B.supplier_days(spark, DATA).collect():
        days.setdefault(r.symbol, []).append((r.time, r.close))
    want = {}
    for symbol, rows in days.items():
        rows = sorted(rows)[: -1 if int(symbol) % 8 < 5 else None][-30:]
        if rows:
            want[symbol] = (len(rows), rows[-1][1], rows[-1][0])
    assert {r.symbol: (r.bars, r.price, r.last_time) for r in catalog.QUERIES["flt_12_completed_bars"](spark, DATA).collect()} == want


def test_screens_drop_forming_bars(spark):
    u = spark.createDataFrame([("A", 1, "a", "x", "s", "ok")], "symbol string, ordinal long, name string, exchange string, sector string, status string")
    bars = make(spark, [1, 2, 3]).select("symbol", "time", "open", "high", "low", "close", "volume").withColumn("is_live", F.col("close") == 3)
    assert screen.explained(u, bars, screen.Request()).first().price == 2.0
