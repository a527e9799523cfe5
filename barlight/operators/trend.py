"""Trend channels: lines through the last two pivots of one side, from the bar that confirms the second until price leaves them.

The channel's life is one fold over a symbol's bars in the JVM, MAX_BARS structs at most: its state has the last two pivots of
each side, two open slots (falling and rising) and the channel that was last open. Lines are given at every bar: they run from
the first pivot to where the channel stands at its last bar (or at its break), and on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions import candles as K
from barlight.functions import series as S
from barlight.operators import channels, states

KEYS = ["top", "middle", "bottom", "top_zone_lower", "bottom_zone_upper"]
AREAS = {"top_line": "up", "middle_line": None, "bottom_line": "down", "top_zone": "up", "bottom_zone": "down"}
PIVOT = "struct<i:int,p:double>"
SLOT = "struct<x1:int,p1:double,x2:int,p2:double,slope:double,reach:double,created:int,down:boolean,tick:double,top:double,bottom:double,broken:int>"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def rounded(x: Column, tick: Column) -> Column:
    """To the nearest tick, halves up; as it is without a tick."""
    y = x / tick + 0.5
    return F.when(tick.isNull(), x).otherwise(F.floor(y + F.abs(y) * F.lit(2.0**-52)) * tick)


def offsets(down: Column, reach: Column, zone: float) -> dict[str, Column]:
    """How far each line lies above the line through the pivots."""
    e = reach * zone
    falling = {"top": e, "middle": -reach / 2, "bottom": -reach - e, "top_zone_lower": -e, "bottom_zone_upper": -reach + e}
    rising = {"top": reach + e, "middle": reach / 2, "bottom": -e, "top_zone_lower": reach - e, "bottom_zone_upper": e}
    return {k: F.when(down, falling[k]).otherwise(rising[k]) for k in KEYS}


def states_of(bars: DataFrame, span: int = 8, width: float = 6.0, zone: float = 1 / 7, period: int = 10, mintick: float | Column | None = None, wait: bool = True, show_last: bool = True) -> DataFrame:
    """A row for each symbol that has a channel: direction, broken, break_index, start_index, created_at (bars counted from 1), slope,
    x1, x2, y1_ and y2_ of each of KEYS, and those lines where the channel ends (at its last bar, or where it broke).

    wait: a channel opens only while none of the other direction is open. show_last: one that broke is shown until a later one
    opens. mintick: the tick that line ends are rounded to when a channel opens, a number or a column that is the same in all bars
    of a symbol; none: not rounded."""
    high, low = states.pivots(span)
    tick = mintick if isinstance(mintick, Column) else F.lit(mintick)
    b = bars.withColumns({"_tr": S.true_range(), "_ph": F.when(high, F.col("high")), "_pl": F.when(low, F.col("low")), "_tick": tick.cast("double")})
    b = b.withColumns({"_atr": states.backfilled_atr(F.col("_tr"), period), "_ph": F.lag("_ph", span).over(S.by()), "_pl": F.lag("_pl", span).over(S.by())})
    bar = F.struct(F.col("i").cast("int").alias("i"), "high", "low", F.col("_atr").alias("atr"), F.col("_ph").alias("ph"), F.col("_pl").alias("pl"), F.col("_tick").alias("tick"))
    rows = b.groupBy("symbol").agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    none, no_pivot = F.lit(None).cast(SLOT), F.lit(None).cast(PIVOT)

    def made(down: bool, v: Column, a: Column, z: Column) -> Column:
        reach, slope = v["atr"] * width, (z["p"] - a["p"]) / (z["i"] - a["i"])
        end = lambda k: rounded(z["p"] + offsets(F.lit(down), reach, zone)[k], v["tick"])
        return F.struct(a["i"].alias("x1"), a["p"].alias("p1"), z["i"].alias("x2"), z["p"].alias("p2"), slope.alias("slope"), reach.alias("reach"), v["i"].alias("created"), F.lit(down).alias("down"), v["tick"].alias("tick"), end("top").alias("top"), end("bottom").alias("bottom"), F.lit(None).cast("int").alias("broken")).cast(SLOT)

    def packed(of: Column, **new: Column) -> Column:
        names = ["h1", "h2", "l1", "l2", "down", "up", "last", "fresh_high", "fresh_low"]
        return F.struct(*[(new[k] if k in new else of[k]).alias(k) for k in names])

    def seen(s: Column, v: Column) -> Column:
        """The state after the pivots that this bar confirms."""
        top, bottom = v["ph"].isNotNull(), v["pl"].isNotNull()
        at = lambda p: F.struct((v["i"] - span).alias("i"), p.alias("p")).cast(PIVOT)
        return packed(s, h1=F.when(top, s["h2"]).otherwise(s["h1"]), h2=F.when(top, at(v["ph"])).otherwise(s["h2"]), l1=F.when(bottom, s["l2"]).otherwise(s["l1"]), l2=F.when(bottom, at(v["pl"])).otherwise(s["l2"]), fresh_high=top & s["h2"].isNotNull(), fresh_low=bottom & s["l2"].isNotNull())

    def beyond(c: Column, v: Column) -> Column:
        """Whether a bar lies beyond a channel's lines, which move on by a bar from the one that it was made at."""
        moved = c["slope"] * (v["i"] - c["created"] + 1)
        return (v["low"] > c["top"] + moved) | (v["high"] < c["bottom"] + moved)

    def opened(s: Column, v: Column, down: bool) -> Column:
        own, other, a, z = ("down", "up", "h1", "h2") if down else ("up", "down", "l1", "l2")
        fresh = s["fresh_high" if down else "fresh_low"]
        right = (s[z]["p"] <= s[a]["p"]) if down else (s[z]["p"] >= s[a]["p"])
        opens = fresh & s[own].isNull() & (s[other].isNull() if wait else F.lit(True)) & right & (v["atr"] * width > 1e-9)
        new = _let(made(down, v, s[a], s[z]), lambda c: c.withField("broken", S.first_from(F.col("bars"), v["i"], lambda w: beyond(c, w))["i"]))
        more = {} if show_last else {other: F.when(opens, none).otherwise(s[other])}
        return _let(F.when(opens, new), lambda c: packed(s, **{own: F.coalesce(c, s[own]), "last": F.coalesce(c, s["last"])}, **more))

    def expired(s: Column, at: Column) -> Column:
        """The state without the channels that broke before a bar; the later of them is the last one, of two at once the rising one."""
        gone = lambda k: s[k]["broken"] < at
        later = F.coalesce((s["down"]["broken"] >= at) | (s["up"]["broken"] >= s["down"]["broken"]), F.lit(True))
        last = F.when(gone("up") & later, s["up"]).when(gone("down"), s["down"]).otherwise(s["last"])
        return F.struct(*[s[k].alias(k) for k in ("h1", "h2", "l1", "l2")], *[F.when(gone(k), none).otherwise(s[k]).alias(k) for k in ("down", "up")], last.alias("last"))

    def step(s: Column, v: Column) -> Column:
        kept = lambda q: F.struct(*[q[k].alias(k) for k in ("h1", "h2", "l1", "l2", "down", "up", "last")])
        return _let(_let(_let(_let(expired(s, v["i"]), lambda q: seen(q, v)), lambda q: opened(q, v, True)), lambda q: opened(q, v, False)), kept)

    start = F.struct(*[no_pivot.alias(k) for k in ("h1", "h2", "l1", "l2")], *[none.alias(k) for k in ("down", "up", "last")])

    def latest(s: Column) -> Column:
        return _let(expired(s, F.lit(2**31 - 1)), shown)

    def shown(s: Column) -> Column:
        still = F.when(s["up"].isNull() | (s["down"]["created"] >= s["up"]["created"]), F.coalesce(s["down"], s["up"])).otherwise(s["up"])
        if not show_last:
            return still
        return F.when(still.isNull() | (s["last"]["created"] > still["created"]), s["last"]).otherwise(still)

    # Only bars that confirm a pivot change the state; where a channel breaks is known when it opens.
    pivots = F.filter("bars", lambda v: v["ph"].isNotNull() | v["pl"].isNotNull())
    out = rows.where(F.size("bars") >= max(2 * span + 1, 5)).select("symbol", F.size("bars").alias("n"), F.aggregate(pivots, start, step, latest).alias("c")).where("c IS NOT NULL")
    c = F.col("c")
    end = F.coalesce(c["broken"], F.col("n"))
    moved = c["slope"] * (end - c["created"] + 1)
    off = offsets(c["down"], c["reach"], zone)
    y1, y2 = ({k: rounded(c[p] + off[k], c["tick"]) for k in KEYS} for p in ("p1", "p2"))
    out = out.select(
        "symbol", F.when(c["down"], "down").otherwise("up").alias("direction"), c["broken"].isNotNull().alias("broken"), c["broken"].cast("long").alias("break_index"), c["x1"].cast("long").alias("start_index"),
        c["created"].cast("long").alias("created_at"), c["slope"].alias("slope"), (c["reach"] * zone).alias("edge"), end.cast("long").alias("end_index"), *[y1[k].alias(f"y1_{k}") for k in KEYS], *[(y2[k] + moved).alias(k) for k in KEYS],
    )
    return out


def trend(bars: DataFrame, span: int = 8, mintick: float | Column | None = None, **more) -> DataFrame:
    """states_of() without the first line ends."""
    out = states_of(bars, span, mintick=mintick, **more)
    return out.select("symbol", "direction", "broken", "break_index", "start_index", "created_at", "slope", "top", "middle", "bottom", "edge")


def lined(bars: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """bars of symbols with a channel (with how left: of all), with its lines at each bar from its first pivot on (null before), the zones' four ends, and
    eligible: whether the bar lies within the channel's life."""
    ends = found.select("symbol", "direction", "broken", "break_index", "start_index", "end_index", *[F.col(f"y1_{k}") for k in KEYS], *[F.col(k).alias(f"y2_{k}") for k in KEYS])
    b = bars.join(ends, "symbol", how)
    i, x1, x2 = (F.col(k).cast("double") for k in ("i", "start_index", "end_index"))
    within = F.col("i") >= F.col("start_index")
    lines = {k: F.when(within, channels.line_at(x1, F.col(f"y1_{k}"), x2, F.col(f"y2_{k}"), i)) for k in KEYS}
    b = b.withColumns(lines | {"eligible": within & (F.col("i") <= F.coalesce("break_index", F.col("i")))})
    b = b.withColumns({"top_zone_upper": F.col("top"), "bottom_zone_lower": F.col("bottom")})
    return b.drop("start_index", "end_index", "break_index", *[f"y{n}_{k}" for n in (1, 2) for k in KEYS])


def by_price(asset: str = "stocks") -> Column:
    """The tick of a symbol by its last close, as a column of its bars; coins have none."""
    last = F.max(F.when(F.col("back") == 1, F.col("close"))).over(S.Window.partitionBy("symbol"))
    return channels.mintick(last, F.lit(asset == "crypto"))


def area_rules(rules) -> list[dict]:
    """Rules on areas, given by area as an action or as settings, or as a list of settings: area, action, tolerance (percent),
    touch_type (wick, body or both), window, breach_type, breach_direction, confirmation (type and window of candles)."""
    given = [{"area": a} | ({"action": r} if isinstance(r, str) else dict(r)) for a, r in rules.items()] if isinstance(rules, dict) else [dict(r) for r in rules]
    for r in given:
        if r.get("area") not in (*AREAS, "disabled"):
            raise ValueError(f"unknown areas: {r.get('area')}")
        line = str(r["area"]).endswith("line")
        if r.get("action") not in (*(channels.LINE_RULES if line else ()), *(() if line else channels.ZONE_RULES), "disabled") and r["area"] != "disabled":
            raise ValueError(f"{r['area']}: unknown action {r.get('action')}")
        if int(r.get("window", 1)) < 1 or r.get("touch_type", "wick") not in ("wick", "body", "both"):
            raise ValueError(f"{r['area']}: a window of 1 or more, and a touch by wick, body or both")
    return given


def areas(bars: DataFrame, found: DataFrame, rules, window: int = 1, tolerance: float = 0.0) -> DataFrame:
    """A row for each symbol of found (states_of): passed, whether every rule on an area has held for just its window of bars up to
    the last, and, if it asks for it, was confirmed from the run's first bar on; and age_k, the bars that the k-th active rule has
    held for; and the channel's direction and whether it is broken. Bars before the channel's first pivot or after its break are not eligible, so a channel that broke before the last bar
    has no run. If all rules are disabled it passes, without rules it does not."""
    given = area_rules(rules)
    active = [r for r in given if "disabled" not in (r["area"], r.get("action"))]
    if not active:
        return found.select("symbol", F.lit(bool(given)).alias("passed"))
    b = lined(bars, found)
    for k, r in enumerate(active):
        side, what = r["area"].split("_")
        own = {n: r[n] for n in ("touch_type", "breach_type", "breach_direction") if n in r} | {"tolerance": float(r.get("tolerance", tolerance) or 0.0)}
        hit = channels.line_rule(F.col(side), r["action"], AREAS[r["area"]], **own) if what == "line" else channels.zone_rule(F.col(f"{side}_zone_lower"), F.col(f"{side}_zone_upper"), r["action"], AREAS[r["area"]], **own)
        b = b.withColumn(f"_a{k}", F.coalesce(hit, F.lit(False)) & F.col("eligible"))
        if confirm := r.get("confirmation"):
            b = K.with_confirmation(b, confirm["type"], int(confirm.get("window", 1)), f"_ok{k}", confirm.get("patterns"))
    ages = [channels.age(F.col(f"_a{k}")).alias(f"age_{k}") for k in range(len(active))]
    # The run's first bar, if it has the length asked for, is the one that many bars back.
    oks = [F.max(F.when(F.col("back") == int(r.get("window", window)), F.col(f"_ok{k}"))).alias(f"ok_{k}") if r.get("confirmation") else F.lit(True).alias(f"ok_{k}") for k, r in enumerate(active)]
    runs = b.groupBy("symbol").agg(*ages, *oks, F.max(F.col("direction") == "up").alias("_up"), F.max("broken").alias("broken"))
    every = F.lit(True)
    for k, r in enumerate(active):
        every = every & (F.col(f"age_{k}") == int(r.get("window", window))) & F.coalesce(F.col(f"ok_{k}"), F.lit(False))
    return runs.select("symbol", every.alias("passed"), *[f"age_{k}" for k in range(len(active))], F.when(F.col("_up"), "up").otherwise("down").alias("direction"), "broken")
