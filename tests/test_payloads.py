"""Cached payloads, cases by hand."""

import json

import pytest
from pyspark.sql import functions as F

from barlight.operators import payloads as P


def candle(t, close=1.0, **more):
    return {"time": t, "open": 1.0, "high": 2.0, "low": 0.5, "close": close, "volume": 3.0, **more}


def one(spark, payload, *columns):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    p = P.parsed(F.col("t"))
    return spark.createDataFrame([(text,)], "t string").select(*[c(p).alias(f"c{k}") for k, c in enumerate(columns)]).first()


@pytest.mark.parametrize("text", [None, "", "nonsense", '{"symbol": "A", "candles": [', "[1, 2]", "3"])
def test_malformed(spark, text):
    r = one(spark, text, lambda p: p.isNull(), lambda p: P.recent(p, 3).isNull(), lambda p: P.session_compatible(p, F.lit("A"), 3600), lambda p: P.within_history(p, F.lit("2030-01-01").cast("date")))
    assert tuple(r) == (True, True, False, False)


def test_candles_without_time_go_and_absent_arrays_are_empty(spark):
    r = one(spark, {"symbol": "A", "price": 7, "candles": [candle(None), candle(5)]}, lambda p: F.size(p["candles"]))
    assert r.c0 == 1
    r = one(spark, {"symbol": "A", "price": 7}, lambda p: F.size(p["candles"]), lambda p: P.recent(p, 3)["price"], lambda p: F.size(P.marked(p, F.lit(None).cast("long"), F.lit(5))["candles"]), lambda p: P.within_history(p, F.lit("2030-01-01").cast("date")))
    assert tuple(r) == (0, 7.0, 0, False)


def test_trimmed_and_repriced(spark):
    payload = {"symbol": "A", "price": -1, "candles": [candle(t, close=float(t)) for t in range(6)]}
    r = one(spark, payload, lambda p: P.recent(p, 2)["candles"]["time"], lambda p: P.recent(p, 2)["price"], lambda p: P.recent(p, 6)["price"], lambda p: P.recent(p, 0)["price"])
    assert tuple(r) == ([4, 5], 5.0, -1.0, -1.0)


def test_marks(spark):
    closed, forming = ({"symbol": "A", "candles": [candle(0, is_closed=False), candle(3600, **m)]} for m in ({}, {"is_closed": False}))
    mark = lambda now: lambda p: P.marked(p, F.lit(7200), F.lit(now))["candles"]["is_closed"]
    assert tuple(one(spark, closed, mark(7199), mark(7200))) == ([False, False], [False, None])
    assert tuple(one(spark, forming, mark(7199), mark(7200))) == ([False, False], [False, None])
    assert one(spark, {"symbol": "A", "candles": [candle(0, is_closed=True)]}, mark(9000)).c0 == [True]


def test_sessions(spark):
    noon = 1704733200  # Monday, 8 January 2024, 12:00 in New York
    day = [candle(noon + 3600 * k) for k in (-6, -1, 0, 1, 5)]
    r = one(spark, {"symbol": "A", "candles": day, "session_policy": P.REGULAR}, lambda p: P.in_session_only(p, 2)["candles"]["time"], lambda p: P.session_compatible(p, F.lit("A"), 3600), lambda p: P.session_compatible(p, F.lit("BTC-USD"), 3600), lambda p: P.anchored(p, 30), lambda p: P.anchored(p, 60))
    assert r.c0 == [noon, noon + 3600] and tuple(r)[1:] == (True, True, True, False)
    r = one(spark, {"symbol": "A", "candles": day}, lambda p: P.session_compatible(p, F.lit("A"), 3600), lambda p: P.session_compatible(p, F.lit("A"), 86400), lambda p: P.session_compatible(p, F.lit("A"), 3600, P.DEFAULT))
    assert tuple(r) == (False, True, True)
    r = one(spark, {"symbol": "A", "candles": day}, lambda p: P.within_history(p, F.lit("2024-01-08").cast("date")), lambda p: P.within_history(p, F.lit("2024-01-07").cast("date")), lambda p: P.fetch_multiplier(F.lit("A"), 3600), lambda p: P.fetch_multiplier(F.lit("A"), 86400))
    assert tuple(r) == (True, False, 2.5, 1.0)
