"""Trend channels' lines at every bar, and rules on their areas, against plain loops."""

import math

import pytest

from barlight.operators import channels, trend
from barlight.plans import screen
from tests.test_machines import frame, trend_by_hand, walks


def life_by_hand(bars, span, tick=None, wait=True, show_last=True, width=6.0, zone=1 / 7, period=10):
    """The latest channel, bar by bar: (direction, start, created, break, {line: (first end, last end)}), bars from 0."""
    n, fit = len(bars), lambda x: math.floor(x / tick + 0.5 + abs(x / tick + 0.5) * 2**-52) * tick if tick else x
    high, low, close = [b[1] for b in bars], [b[2] for b in bars], [b[3] for b in bars]
    ranges = [high[0] - low[0]] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, n)]
    atr = [sum(ranges[:period]) / period] * period
    for r in ranges[period:]:
        atr.append((atr[-1] * (period - 1) + r) / period)
    seen, slots, last = {"down": [], "up": []}, {"down": None, "up": None}, None
    for t in range(n):
        at, fresh = t - span, []
        if at >= span:
            if high[at] > max(high[at - span : at]) and high[at] >= max(high[at + 1 : at + span + 1]):
                seen["down"].append((at, high[at]))
                fresh += ["down"] if len(seen["down"]) > 1 else []
            if low[at] < min(low[at - span : at]) and low[at] <= min(low[at + 1 : at + span + 1]):
                seen["up"].append((at, low[at]))
                fresh += ["up"] if len(seen["up"]) > 1 else []
        for way, other in (("down", "up"), ("up", "down")):
            if way not in fresh or slots[way] or (wait and slots[other]):
                continue
            (x1, p1), (x2, p2) = seen[way][-2:]
            if (p2 - p1 > 0) if way == "down" else (p2 - p1 < 0):
                continue
            reach = atr[t] * width
            e, s = reach * zone, -1 if way == "down" else 1
            outer, inner = (("bottom", "top") if way == "down" else ("top", "bottom"))
            off = {inner: -s * e, "middle": s * reach / 2, outer: s * (reach + e), f"{inner}_in": s * e, f"{outer}_in": s * (reach - e)}
            off = {"top": off["top"], "middle": off["middle"], "bottom": off["bottom"], "top_zone_lower": off["top_in"], "bottom_zone_upper": off["bottom_in"]}
            slots[way] = {"way": way, "x1": x1, "created": t, "broken": None, "slope": (p2 - p1) / (x2 - x1), "y1": {k: fit(p1 + v) for k, v in off.items()}, "y2": {k: fit(p2 + v) for k, v in off.items()}}
            last = dict(slots[way], y2=dict(slots[way]["y2"]))
            if not show_last:
                slots[other] = None
        for way in ("down", "up"):
            if c := slots[way]:
                c["y2"] = {k: v + c["slope"] for k, v in c["y2"].items()}
                if low[t] > c["y2"]["top"] or high[t] < c["y2"]["bottom"]:
                    last, slots[way] = {**c, "broken": t}, None
    found = [c for c in (slots["down"], slots["up"], last if show_last else None) if c]
    return max(found, key=lambda c: c["created"]) if found and n >= max(2 * span + 1, 5) else None


def line_by_hand(c, k, i, n):
    x2 = n - 1 if c["broken"] is None else c["broken"]
    return c["y1"][k] + (c["y2"][k] - c["y1"][k]) * (i - c["x1"]) / (x2 - c["x1"])


@pytest.mark.parametrize(("span", "tick", "wait", "show"), [(3, None, True, True), (8, 0.01, True, True), (4, 0.5, False, True), (4, None, True, False), (3, None, False, False)])
def test_lines_at_every_bar(spark, span, tick, wait, show):
    found = walks(20, 200, 11)
    b = frame(spark, found)
    given = trend.states_of(b, span, mintick=tick, wait=wait, show_last=show)
    states = {r.symbol: r for r in given.collect()}
    lines = {(r.symbol, r.i): r for r in trend.lined(b, given).collect()}
    ways = set()
    for s, bars in found.items():
        want = life_by_hand(bars, span, tick, wait, show)
        assert (s in states) == (want is not None)
        if want is None:
            continue
        r, n = states[s], len(bars)
        ways.add((want["way"], want["broken"] is not None))
        assert (r.direction, r.start_index, r.created_at, r.break_index) == (want["way"], want["x1"] + 1, want["created"] + 1, None if want["broken"] is None else want["broken"] + 1)
        for i in range(n):
            x = lines[s, i + 1]
            assert x.eligible == (i >= want["x1"] and (want["broken"] is None or i <= want["broken"]))
            for k in trend.KEYS:
                assert (x[k] is None) == (i < want["x1"]) and (x[k] is None or x[k] == pytest.approx(line_by_hand(want, k, i, n)))
    assert len(ways) >= (2 if show else 1)


def says(bar, area, action, c, i, n, tolerance, kind):
    o, h, l, x = bar
    top, bottom = max(o, x), min(o, x)
    if area.endswith("line"):
        y = line_by_hand(c, area.split("_")[0], i, n)
        lo, hi = y - abs(y) * tolerance / 100, y + abs(y) * tolerance / 100
        if action == "touched":
            m = (lo + hi) / 2
            wick_up, wick_down, body = h > top and top <= hi and h >= lo, l < bottom and l <= hi and bottom >= lo, bottom <= hi and top >= lo
            if area == "top_line":
                wick, body = wick_up and top <= m, body and top <= m
            elif area == "bottom_line":
                wick, body = wick_down and bottom >= m, body and bottom >= m
            else:
                wick = wick_up or wick_down
            return {"wick": wick, "body": body, "both": wick or body}[kind]
        return {"closed_above": x > hi, "closed_below": x < lo, "on_line": lo <= x <= hi}[action]
    ends = ("top_zone_lower", "top") if area == "top_zone" else ("bottom", "bottom_zone_upper")
    a, z = (line_by_hand(c, k, i, n) for k in ends)
    lo, hi = a - abs(a) * tolerance / 100, z + abs(z) * tolerance / 100
    wick, body = l <= hi and h >= lo, bottom <= hi and top >= lo
    meets = {"wick": wick, "body": body, "both": wick or body}[kind]
    if action == "breach":
        return {"wick": h > hi if area == "top_zone" else l < lo, "body": top > hi if area == "top_zone" else bottom < lo}["body" if kind == "body" else "wick"]
    return meets and (action == "entered" or (x < a if area == "top_zone" else x > z))


def test_rules_by_plain_loops(spark):
    found = walks(30, 160, 21)
    b = frame(spark, found)
    given = trend.states_of(b, 3)
    rules = [
        {"area": "middle_line", "action": "closed_below", "tolerance": 1.0}, {"area": "top_line", "action": "touched", "tolerance": 15.0, "touch_type": "both"}, {"area": "bottom_line", "action": "on_line", "tolerance": 20.0},
        {"area": "top_zone", "action": "rejected", "tolerance": 12.0}, {"area": "bottom_zone", "action": "entered", "touch_type": "body", "tolerance": 10.0}, {"area": "bottom_zone", "action": "breach", "touch_type": "body"},
    ]
    got = {r.symbol: r for r in trend.areas(b, given, rules).collect()}
    ages = set()
    for s, bars in found.items():
        c, n = life_by_hand(bars, 3), len(bars)
        for k, r in enumerate(rules) if c else []:
            run = 0
            for i in range(n - 1, -1, -1):
                alive = i >= c["x1"] and (c["broken"] is None or i <= c["broken"])
                if not alive or not says(bars[i], r["area"], r["action"], c, i, n, r.get("tolerance", 0.0), r.get("touch_type", "wick")):
                    break
                run += 1
            assert got[s][f"age_{k}"] == run, (s, r)
            ages.add((k, run > 0))
        if c:
            assert got[s].passed == all(got[s][f"age_{k}"] == 1 for k in range(len(rules)))
    assert len(ages) >= 9


def test_windows_disabled_rules_and_confirmations(spark):
    found = {"A": [(100 + k * 0.1, 101 + k * 0.1 + (6 if k % 10 == 5 else 0), 99 + k * 0.1 - (6 if k % 10 == 0 else 0), 100.5 + k * 0.1) for k in range(80)]}
    b = frame(spark, found)
    given = trend.states_of(b, 3)
    age = trend.areas(b, given, {"top_line": "closed_below"}).first().age_0
    assert age > 5
    passed = lambda rules, **more: trend.areas(b, given, rules, **more).first().passed
    assert passed({"top_line": {"action": "closed_below", "window": age}}) and not passed({"top_line": {"action": "closed_below", "window": age - 1}}) and passed({"top_line": "closed_below"}, window=age)
    assert passed({"middle_line": "disabled"}) and not passed({}) and passed([{"area": "disabled", "action": "touched"}, {"area": "top_line", "action": "closed_below", "window": age}])
    confirmed = {t: passed([{"area": "top_line", "action": "closed_below", "window": age, "confirmation": {"type": t, "window": 0}}]) for t in ("bullish", "bearish")}
    assert confirmed == {"bullish": True, "bearish": False}  # all bars rise
    for wrong in ({"side": "touched"}, {"top_line": "entered"}, {"top_zone": "touched"}, {"top_line": {"action": "touched", "window": 0}}, {"top_line": {"action": "touched", "touch_type": "x"}}):
        with pytest.raises(ValueError, match="area|unknown|window"):
            trend.area_rules(wrong)
    with pytest.raises(ValueError, match="areas"):
        screen.Request({"trend": {"areas": {"side": "touched"}}})


def test_screens_take_area_rules(spark):
    found = walks(25, 200, 3)
    b = frame(spark, found)
    out = {r.symbol: r.passed for r in screen._trend(b, span=3, areas={"middle_line": "closed_below"}, mintick=None).collect()}
    want = {r.symbol: r.passed for r in trend.areas(b, trend.states_of(b, 3), {"middle_line": "closed_below"}).collect()}
    assert out == want and out


def test_ends_as_before(spark):
    """The last ends by the formula of another loop."""
    found = walks(10, 150, 2)
    got = {r.symbol: r for r in trend.trend(frame(spark, found), 4).collect()}
    for s, bars in found.items():
        want = trend_by_hand(bars, 4)
        assert (s in got) == (want is not None)
        if want:
            assert (got[s].top, got[s].middle, got[s].bottom) == pytest.approx(want[5:])
    assert channels.line_at is not None
