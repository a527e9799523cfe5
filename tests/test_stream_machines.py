"""State machines on a stream against one fold: several batches, late ticks, ticks out of order in a batch, and symbols that end."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from barlight.streaming import machines as M

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def ticks(spark, rows):
    return spark.createDataFrame([(s, START + timedelta(minutes=m), i, float(x), b) for s, m, i, x, b in rows], "symbol string, ts timestamp, id long, value double, batch int")


def test_advanced_by_hand():
    s = M.advanced(None, 1, 1, 10.0, 3, 1.0)
    assert s[4:] == (10.0, 10.0, 0.0, 10.0, 10.0, 10.0, 10.0, True)
    s = M.advanced(s, 2, 2, 13.0, 3, 1.0)  # the range is 1, the stop 12
    assert s[4:] == pytest.approx((11.5, 11.0, 1.0, 13.0, 13.0, 10.0, 12.0, True))
    s = M.advanced(s, 3, 3, 11.0, 3, 1.0)  # below 12: it turns
    assert s[6] == pytest.approx(4 / 3) and s[10] == pytest.approx(11 + 4 / 3) and s[11] is False and s[8:10] == (11.0, 11.0)


def test_batches_equal_one_fold(spark):
    rng, rows = random.Random(3), []
    for k, s in enumerate("ABC"):
        rows += [(s, m, 100 * k + m, 100 + rng.gauss(0, 3), min(3, m // 15)) for m in range(60)]
    # Two ticks of B come in the last batch but are older than what was seen before, one of them with the time of another.
    rows += [("B", 10, 900, 1.0, 3), ("B", 44, 0, 2.0, 3)]
    rng.shuffle(rows)
    df = ticks(spark, rows)
    out = M.in_batches(df, [F.col("batch") == k for k in range(4)], n=5, factor=1.5)
    last = {r.symbol: r for r in out.groupBy("symbol").agg(F.max(F.struct("seen", "late", "ema", "rma", "stop", "up")).alias("m")).select("symbol", "m.*").collect()}
    assert out.where("symbol = 'A'").count() == 4 and out.where("expired").count() == 0
    for s in "ABC":
        state = None
        for _, m, i, x, _ in sorted((r for r in rows if r[0] == s and r[2] not in (900, 0) or r[0] == s == "A"), key=lambda r: (r[1], r[2])):
            state = M.advanced(state, m, i, x, 5, 1.5)
        r = last[s]
        assert (r.seen, r.late) == (60, 2 if s == "B" else 0)
        assert (r.ema, r.rma, r.stop, r.up) == (pytest.approx(state[4]), pytest.approx(state[5]), pytest.approx(state[10]), state[11])


def test_symbols_that_end(spark):
    rows = [("A", m, m, 10.0 + m, 0) for m in range(5)] + [("B", m, m, 20.0, 0) for m in range(5)] + [("B", 60 * 30 + m, 500 + m, 21.0, 1) for m in range(5)] + [("A", 60 * 60, 999, 50.0, 2)]
    out = M.in_batches(ticks(spark, rows), [F.col("batch") == k for k in range(3)], n=3, idle="2 hours", wait="10 minutes")
    a = sorted(((r.seen, r.expired, r.ema) for r in out.where("symbol = 'A'").collect()), key=str)
    assert (5, True, pytest.approx(13.0625)) in a and (1, False, 50.0) in a  # a new life after the end of the first
    assert out.where("symbol = 'B' AND NOT expired").agg(F.max("seen")).first()[0] == 10
