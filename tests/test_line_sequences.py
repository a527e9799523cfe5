"""Clauses on the correlation lines against plain loops over the lines' values."""

import pytest
from pyspark.sql import functions as F

from barlight.plans import rules, screen
from tests.test_machines import frame, walks

NAMES = ["red", "green", "blue"]


def crossed(x, y, i, way):
    if i < 1 or None in (x[i - 1], y[i - 1], x[i], y[i]):
        return False
    return x[i - 1] >= y[i - 1] and x[i] < y[i] if way == "below" else x[i - 1] <= y[i - 1] and x[i] > y[i]


def sequence(lines, which, way, n):
    """By the first crossing of zero among the last n bars."""
    size, zero = len(lines["red"]), [0.0] * len(lines["red"])
    at = {k: next((i for i in range(max(1, size - n), size) if crossed(lines[k], zero, i, "below" if way == "bullish" else "above")), None) for k in NAMES}
    if which == "sequential":
        return None not in at.values() and at["red"] <= at["green"] <= at["blue"]
    first = which.split("_")[0]
    return at[first] is not None and all(at[k] is None or at[first] <= at[k] for k in NAMES)


def pair(lines, name, i):
    x, way, y = name.split("_")
    if y != "both":
        return crossed(lines[x], lines[y], i, way)
    def beyond(j):
        v = [lines[k][j] for k in NAMES]
        return None not in v and (v[0] > max(v[1:]) if way == "above" else v[0] < min(v[1:]))
    return i >= 1 and beyond(i) and not beyond(i - 1)


@pytest.mark.parametrize("way", ["bullish", "bearish"])
def test_sequences_and_pairs(spark, way):
    found = walks(40, 70, 13)
    b = frame(spark, found)
    trees = {f"{w}_{n}": ("sequence", w, way, n) for w in ("red_first", "green_first", "blue_first", "sequential") for n in (5, 30)}
    beyond = "below" if way == "bullish" else "above"
    trees |= {"both": ("within", 8, ("pair", f"red_{beyond}_both")), "two": ("crossed", [f"red_{beyond}_green", f"red_{beyond}_blue", f"green_{beyond}_blue"], 2, 10), "apart": ("all", [("within", 12, ("pair", f"red_{beyond}_green")), ("within", 12, ("pair", f"green_{beyond}_blue"))])}
    out = screen.judged(b, {k: {"rule_of": "vlr", "tree": t, "first": 5, "step": 4} for k, t in trees.items()})
    values, _, _ = rules.vlr(b, "v", first=5, step=4)
    rows = values.select("symbol", "i", "v_r1", "v_r2", "v_r3").orderBy("i").collect()
    lines = {s: {k: [r[f"v_r{j + 1}"] for r in rows if r.symbol == s] for j, k in enumerate(NAMES)} for s in found}
    seen = set()
    for r in out.collect():
        x, n = lines[r.symbol], 70
        want = {k: sequence(x, t[1], way, t[3]) for k, t in trees.items() if t[0] == "sequence"}
        any_of = lambda name, w: any(pair(x, name, i) for i in range(n - w, n))  # noqa: E731,B023
        want["both"] = any_of(f"red_{beyond}_both", 8)
        want["two"] = sum(any_of(p, 10) for p in trees["two"][1]) >= 2
        want["apart"] = any_of(f"red_{beyond}_green", 12) and any_of(f"green_{beyond}_blue", 12)
        assert {k: r[f"passed_{k}"] for k in trees} == want, r.symbol
        seen |= set(want.items())
    assert len(seen) >= 18  # nearly all rules with both answers


def test_named_zones(spark):
    df = spark.createDataFrame([(v,) for v in (-0.9, -0.8, -0.75, -0.7, -0.1, 0.0, 0.1, 0.7, 0.8, 0.95)], "x double")
    hit = lambda name, slack=0.0: [r.x for r in df.where(rules.zone_by_name(F.col("x"), name, slack)).collect()]
    assert hit("positive_extreme") == hit("bullish_exact") == [0.8, 0.95] and hit("bullish_early") == [0.7] and hit("bearish_exact") == [-0.9, -0.8]
    assert hit("negative_early") == [-0.75, -0.7] and hit("neutral", 0.1) == [-0.1, 0.0, 0.1] and hit("above_zero") == [0.1, 0.7, 0.8, 0.95] and hit("positive_extreme", 0.11) == [0.7, 0.8, 0.95]
    with pytest.raises(ValueError, match="none of"):
        rules.zone_by_name(F.col("x"), "odd")


def test_presets_and_needs(spark):
    up = {"A": [(100.0 + k, 101.0 + k, 99.0 + k, 100.0 + k) for k in range(60)], "B": [(100.0, 101.0, 99.0, 100.0 + (k % 2)) for k in range(60)]}
    said = {r.symbol: (r.passed_x, r.passed_y) for r in screen.judged(frame(spark, up), {"x": {"rule_of": "vlr", "tree": ("preset", "bearish_extreme")}, "y": {"rule_of": "vlr", "tree": ("preset", "extreme_watch")}}).collect()}
    assert said == {"A": (True, True), "B": (False, False)}  # a rise is a negative correlation with age
    assert rules.bars_of(("all", [("within", 9, ("sequence", "red_first", "bullish", 20)), ("order", "below")])) == 28
    assert screen.Request({"x": {"rule_of": "vlr", "tree": ("sequence", "red_first", "bullish", 40)}}).depth == 12 + 24 + 2 + 40
    for wrong in (("preset", "odd"), ("pair", "red_above_pink"), ("odd",), ("sequence", "last", "bullish", 3)):
        with pytest.raises(ValueError, match="none of|unknown"):
            rules.vlr(frame(spark, up), "v", wrong)
