"""Work that several rules or parts of a query share is done once."""

from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.plans import catalog, rules
from tests.test_queries import DATA


def plan(spark, name):
    return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_first_of_an_array_from_a_position(spark):
    row = spark.createDataFrame([([0] * 99 + [7, 0, 8],)], "x array<int>")
    at = [1, 2, 50, 93, 100, 101, 102, 103]
    got = row.select(*[S.first_from(F.col("x"), F.lit(k), lambda v: v > 0).alias(f"f{k}") for k in at]).first()
    assert list(got) == [7, 7, 7, 7, 7, 8, 8, None]


def test_trend_areas_fold_once(spark):
    assert plan(spark, "chn_05_trend_areas").count("Join") == 1


def test_rules_on_the_same_lines_share_them(spark):
    assert plan(spark, "screen_line_sequences").count("corr(") == 3


def test_settings_that_begin_alike_are_apart():
    assert not rules._named("volume", 20, ("extremes", False), ("session", "")).startswith(rules._named("volume", 20, ("extremes", False)))
