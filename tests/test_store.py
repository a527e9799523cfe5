"""The store of bars by date: what it reads, merges, and the days that a plan names."""

import re
from datetime import date

import pytest

from barlight.sources import bars as B
from barlight.sources import store


def bars(spark, spans, symbols="ABC"):
    rows = [(s, 86400 * (store.SPAN * k + d), 1.0, 2.0, 0.5, float(k + d), 10.0) for s in symbols for k in spans for d in range(0, store.SPAN, 4)]
    return spark.createDataFrame(rows, store.BARS)


def files(df):
    return {int(re.search(r"span=(\d+)", f)[1]) for f in df.inputFiles()}


def test_reads_only_the_spans_it_needs(spark, tmp_path):
    folder = f"{tmp_path}/store"
    store.put(bars(spark, range(100, 130)), folder)
    got = store.latest(spark, folder, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.latest(bars(spark, range(100, 130)), 10).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*span", plan) and files(store.stored(spark, folder)) == set(range(100, 130))
    read = store.stored(spark, folder).where("span IN (128, 129)")
    assert re.search(r"span#\d+ IN \(12[89],12[89]\)", plan), plan
    assert len(read.inputFiles()) <= len(store.stored(spark, folder).inputFiles())


def test_symbols_that_ended_long_ago(spark, tmp_path):
    folder = f"{tmp_path}/store"
    every = bars(spark, range(100, 104), "A").unionByName(bars(spark, range(60, 62), "Z"))
    store.put(every, folder)
    want = sorted(map(tuple, B.latest(every, 9).collect()))
    assert sorted(map(tuple, store.latest(spark, folder, 9).collect())) == want and {w[0] for w in want} == {"A", "Z"}
    asked = spark.createDataFrame([("A",), ("nobody",)], "symbol string")
    got = store.latest(spark, folder, 9, asked)
    assert sorted(map(tuple, got.collect())) == [w for w in want if w[0] == "A"]
    assert not re.search(r"span#\d+ IN \([^)]*6[01]", got._jdf.queryExecution().executedPlan().toString())


def test_batches_are_merged_span_by_span(spark, tmp_path):
    folder = f"{tmp_path}/store"
    store.put(bars(spark, [100, 101]), folder)
    before = {f for f in store.stored(spark, folder).inputFiles() if "span=100" in f}
    late = spark.createDataFrame([("A", 86400 * store.SPAN * 101, 9.0, 9.0, 9.0, 9.0, 9.0), ("D", 86400 * store.SPAN * 102, 1.0, 1.0, 1.0, 1.0, 1.0)], store.BARS)
    store.put(late, folder)
    got = {(r.symbol, r.time): r.close for r in store.stored(spark, folder).collect()}
    want = {(r.symbol, r.time): r.close for r in bars(spark, [100, 101]).collect()} | {(r.symbol, r.time): r.close for r in late.collect()}
    assert got == want and {f for f in store.stored(spark, folder).inputFiles() if "span=100" in f} == before
    assert {r.symbol: r.i for r in store.latest(spark, folder, 100).groupBy("symbol").agg({"i": "max"}).withColumnRenamed("max(i)", "i").collect()} == {"A": 16, "B": 16, "C": 16, "D": 1}


def test_candidate_dates():
    friday, days = date(2024, 3, 1), store.candidate_dates(5, until=date(2024, 3, 3))
    assert days[0] == friday and len(days) == 13 and all(d.weekday() < 5 for d in days)
    assert len(store.candidate_dates(5, crypto=True, until=friday)) == 7 and store.candidate_dates(5, crypto=True, until=date(2024, 3, 3))[0] == date(2024, 3, 3)
    assert [store.source_days(10, a, u, c) for a, u, c in ((3, "d", False), (2, "w", False), (2, "w", True), (1, "mo", False), (1, "mo", True))] == [30, 100, 140, 210, 300]
    assert len(store.candidate_dates(400, 1, "mo", until=friday)) == store.MOST_DAYS and len(store.candidate_dates(100, 1, "d", until=friday)) == 125


@pytest.mark.parametrize("unit", ["d", "w"])
def test_empty_store(spark, tmp_path, unit):
    folder = f"{tmp_path}/store"
    assert store.stored(spark, folder) is None
    store.put(bars(spark, [100]), folder)
    assert store.latest_of(spark, folder, 5, 1, unit, until=date(2030, 1, 1)).count() == 0


def test_bars_are_written_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(store, "scratch", lambda _: made.append(1) or f"{tmp_path}/scratch{len(made)}", raising=False)
    for _ in range(2):
        store.put(bars(spark, [100, 101]), f"{tmp_path}/store")
    assert not made and store.stored(spark, f"{tmp_path}/store").count() == 48
