"""Jobs over all their rows, by brute force."""

from pyspark.sql import functions as F

from barlight.plans import catalog, relations
from barlight.sources import bars as B
from tests.test_queries import DATA


def test_every_event_has_its_bar(spark):
    bars = {}
    for r in sorted(B.event_bars(spark, DATA).collect(), key=lambda r: r.time):
        bars.setdefault(r.symbol, []).append((r.time, r.close))
    events = B.table(spark, DATA, "events").select("event_id", "event_type", B.epoch(F.col("ts")).alias("t")).collect()
    want = {e.event_id: next((c for t, c in reversed(bars[e.event_type]) if t <= e.t - 3600), None) for e in events}
    got = {r.event_id: r.close for r in catalog.QUERIES["jn_14_as_of"](spark, DATA).collect()}
    assert got == want


def test_bars_carry_over_gaps_and_past_the_last(spark):
    bars = spark.createDataFrame([("a", 0, 1.0), ("a", 10800, 2.0), ("b", 3600, 3.0)], "symbol string, time long, close double")
    left = [(1, "a", 3599), (2, "a", 3600), (3, "a", 14399), (4, "a", 14400), (5, "a", 90000), (6, "b", 90000), (7, "c", 90000), (8, None, 90000), (9, "a", None)]
    out = relations.as_of(spark.createDataFrame(left, "id long, symbol string, time long"), bars).collect()
    assert {r.id: r.close for r in out} == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 3.0, 7: None, 8: None, 9: None}


def test_every_part_has_its_formats(spark):
    parts = [r.p_partkey for r in B.table(spark, DATA, "part").collect()]
    got = {r.id: r for r in catalog.QUERIES["sc_08_formats"](spark, DATA).collect()}
    assert sorted(got) == sorted(parts) and all(r.compact and r.sticker and r.digest for r in got.values())
