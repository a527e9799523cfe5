"""Merged tables of a stream: failures and waits by a loop, batches that run twice, old versions removed, forming bars."""

import random

import pytest
from pyspark.sql import functions as F

from barlight.streaming import schedule as S

ROWS = "symbol string, timeframe string, seconds long, at long, ok boolean"


def by_hand(rows):
    out = {}
    for s, t, seconds, at, ok in sorted(rows, key=lambda r: r[3]):
        n, good = out.get((s, t), (0, None, 0, 0, None))[2:5:2] if (s, t) in out else (0, None)
        n, good = (0, at) if ok else (n + 1, good)
        due = (at // seconds + 1) * seconds + 5 if n == 0 else at + max(300, seconds // 4)
        out[s, t] = (seconds, at, n, due, good)
    return {k: (at, good, n, due) for k, (_, at, n, due, good) in out.items()}


@pytest.mark.parametrize("batches", [1, 4])
def test_refreshes(spark, batches):
    rng = random.Random(2)
    times = rng.sample(range(1_000_000), 240)
    rows = [(rng.choice("ABC"), t, sec, times[k], rng.random() < 0.4) for k in range(240) for t, sec in [rng.choice([("1h", 3600), ("1m", 60), ("1day", 86400)])]]
    df = spark.createDataFrame(rows, ROWS)
    step = 1_000_000 // batches
    slices = [F.col("at").between(k * step, (k + 1) * step - 1) for k in range(batches)]
    got = {(r.symbol, r.timeframe): (r.last_at, r.ok_at, r.failures, r.next_refresh_at) for r in S.refresh_schedule(df, slices).collect()}
    assert got == by_hand(rows)


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    put = S.merging(path, "k string, n long", lambda b: b.groupBy("k").agg(F.count(F.lit(1)).alias("n")), lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n")))
    assert S.current(spark, path, "k string, n long").count() == 0
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    for n in (0, 1, 1, 2, 2, 3):
        put(batch, n)
    assert {r.k: r.n for r in S.current(spark, path, "k string, n long").collect()} == {"a": 8, "b": 4}
    assert sorted(S._versions(spark, path)) == [2, 3]
    # A version that was not written to its end does not count.
    batch.write.parquet(f"{path}/v=9")
    (tmp_path / "t" / "v=9" / "_SUCCESS").unlink()
    assert {r.k: r.n for r in S.current(spark, path, "k string, n long").collect()} == {"a": 8, "b": 4}


def test_due(spark):
    table = spark.createDataFrame([("A", "1h", 3600, 0, 0, 0, 50), ("B", "1h", 3600, 0, None, 2, 20), ("C", "1h", 3600, 0, 0, 0, 90), ("D", "1h", 3600, 0, 0, 0, 20)], S.SCHEDULE)
    assert [r.symbol for r in S.due(table, 60, 2).collect()] == ["B", "D"] and [r.symbol for r in S.due(table, 60, 9).collect()] == ["B", "D", "A"]
