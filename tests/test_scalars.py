"""Scalars by hand, and settings that are checked before anything is read."""

import pytest
from pyspark.sql import functions as F

from barlight.functions import scalars as X
from barlight.operators import relational as R
from barlight.sources import bars as B


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(("text", "want"), [("1D", (1, "d")), ("1M", (1, "mo")), ("1m", (1, "m")), ("15 min", (15, "m")), ("4Hours", (4, "h")), ("2wk", (2, "w")), ("0h", None), ("h", None), ("1x", None), ("", None), (None, None)])
def test_timeframes(text, want):
    assert X.timeframe(text) == want


def test_timeframes_of_providers():
    assert X.canonical_timeframe("1D") == "1day" and X.canonical_timeframe("1M") == "1mo" and X.timeframe_seconds("2w") == 14 * 86400
    assert [X.provider_timeframe(t) for t in ("1M", "30m", "7m", "2w", "none")] == ["1M", "30m", None, None, None]
    assert X.source_bars("2w", 10) == 100 and X.source_bars("1mo", 10, True) == 300 and X.source_bars("1h", 10) == 10
    with pytest.raises(ValueError):
        X.canonical_timeframe("soon")


def test_formats(spark):
    r = one(spark, a=X.decimal(F.lit("x")), b=X.decimal(F.lit(-1.005), 1, True), c=X.price(F.lit(1234567.891)), d=X.price(F.lit(-0.5)), e=X.price(F.lit(0.001234)), f=X.window_label(F.lit(None).cast("int")), g=X.pattern_label(F.lit(False), F.array(F.lit("x")), F.array(F.lit("y"))), h=R.compact(F.lit(-1234.5)), i=R.compact(F.lit(999.0)), j=R.compact(F.lit(2.5e12)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == ("0.00", "-1.0", "$1,234,567.89", "$-0.5000", "$0.001234", "Last 1 Candle", "No Pattern", "-1.23K", "999", "2.50T")


def test_sessions(spark):
    # Friday 15:59 and 16:00 in New York in winter, a Sunday, and a Monday morning.
    at = {"before": 1704488340, "after": 1704488400, "sunday": 1704650400, "monday": 1704722400}
    r = one(spark, **{k: X.last_session(F.lit(v)).cast("string") for k, v in at.items()})
    assert tuple(r) == ("2024-01-04", "2024-01-05", "2024-01-05", "2024-01-05")
    r = one(spark, a=X.in_hours(F.lit(3600 * 23), "2200-0100"), b=X.in_hours(F.lit(3600 * 12), "2200-0100"), c=X.in_hours(F.lit(0), "9999-0000"), d=X.in_hours(F.lit(0), "0900-1700", 600), e=X.in_hours(F.lit(5), "0000-0000"))
    assert tuple(r) == (True, False, True, True, True)


def test_aliases():
    groups = {"length": ("length", "period"), "rule": ("rule",)}
    assert X.either({"period": 7}, groups, {"rule": "either"}) == {"length": 7, "rule": "either"}
    assert X.either({"period": 7, "length": 7}, groups, {})["length"] == 7
    with pytest.raises(ValueError, match="conflicting"):
        X.either({"period": 7, "length": 8}, groups, {})


def test_numbers_of_providers(spark):
    rows = [("a", "1000", "1", "2", "0.5", "1.5", "x"), ("b", "soon", "1", "2", "0.5", "1.5", "3"), ("c", "1000", "NaN", "2", "0.5", "1.5", "3"), ("d", "1000", "1", "2", "0.5", None, "3")]
    got = B.provider_rows(spark.createDataFrame(rows, "symbol string, t string, o string, h string, l string, c string, v string")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 1.0, 2.0, 0.5, 1.5, 0.0)]


def test_prefilter(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "symbol string, ordinal long")
    seen = spark.createDataFrame([("a",), ("x",)], "symbol string")
    names = lambda df: sorted(r.symbol for r in df.collect())
    assert names(R.prefiltered(wanted, seen, 3)) == ["a"] and names(R.prefiltered(wanted, seen, 4)) == ["a", "b", "c"] and names(R.prefiltered(wanted, seen.where("false"), 1)) == ["a", "b", "c"]
