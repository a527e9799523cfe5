"""Screens: a universe, its bars, and the rules that the last completed bars of an instrument must pass.

All rules of a request are columns of one bar table: one exchange by symbol, windows on it, and one aggregation by symbol at the
end, on the same partitioning. Post-filters and rules of whole instruments are aggregations of the same bars, joined by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions import candles as K
from barlight.operators import channels, confluence, indicators, postfilters, trend
from barlight.operators import relational as R
from barlight.plans.rules import RULES
from barlight.sources import bars as B

#: Rules on an instrument's own columns, and post-filters on all its bars: those before the rules exclude what they find.
COLUMN_RULES = ["float", "shares_outstanding"]
POST_FILTERS = ["dead_assets", "channel_respect", "confluence", "trend"]
STOCKS_ONLY = ["float", "shares_outstanding"]


def _respect(b: DataFrame, length=100, line="middle", least=2, most=None, tolerance=1.0, gap=3, touch_type="wick", channel="lrc", span=8, asset="stocks") -> DataFrame:
    """How often one or several lines of a channel were respected, within bounds that a request may leave open."""
    if channel == "trend":
        c = trend.lined(b, trend.states_of(b, span, mintick=trend.by_price(asset))).withColumns({"upper": F.col("top"), "lower": F.col("bottom")})
    else:
        recent = b.where(F.col("back") <= length)
        c = channels.regression(recent) if channel == "lrc" else channels.weighted(recent, length)
    n = F.col("respects")
    found = postfilters.respects(c, postfilters.lines_of(line), tolerance, min(max(gap, 3), 5), touch_type=touch_type)
    within = (F.lit(True) if least is None else n >= least) & (F.lit(True) if most is None else n <= most)
    return found.select("symbol", within.alias("passed"), n.cast("double").alias("value"))


def _confluence(b: DataFrame, **config) -> DataFrame:
    found = confluence.confluence(b, **config)
    return found.select("symbol", "passed", F.col("second_back").cast("double").alias("value"))


def _dead(b: DataFrame, kinds=("strong", "slow", "failed", "flat"), recovery="disabled", **config) -> DataFrame:
    """Passes what shows none of the kinds of dead trends, or has recovered, in a way of postfilters.RECOVERIES, if that counts."""
    found = F.col("kind").isin(*kinds)
    way = {True: "close_above_swing_high", False: "disabled"}.get(recovery, recovery)
    back = F.lit(False) if way == "disabled" else F.col(way)
    return postfilters.dead(b, **config).select("symbol", (~found | back).alias("passed"), F.lit(None).cast("double").alias("value"))


def _trend(b: DataFrame, direction=None, span=8, mintick="price", broken=None, areas=None, asset="stocks", **more) -> DataFrame:
    """The latest pivot channel, of a direction if one is asked for, open or broken if that is, and with rules on its areas. Lines are
    rounded to a tick, that of the last price if none is given."""
    found = trend.states_of(b, span, mintick=trend.by_price(asset) if mintick == "price" else mintick, **more)
    right = (F.lit(True) if direction is None else F.col("direction") == direction) & (F.lit(True) if broken is None else F.col("broken") == broken)
    out = found.select("symbol", right.alias("passed"), F.col("middle").alias("value"))
    if areas is not None:
        held = trend.areas(b, found, areas).select("symbol", F.col("passed").alias("held"))
        out = out.join(held, "symbol").select("symbol", (F.col("passed") & F.col("held")).alias("passed"), "value")
    return out


WHOLE = {"channel_respect": _respect, "confluence": _confluence, "dead_assets": _dead, "trend": _trend}
WHOLE_NEED = {"channel_respect": lambda length=100, channel="lrc", **_: B.MAX_BARS if channel == "trend" else length, "confluence": confluence.need, "dead_assets": lambda **_: B.MAX_BARS, "trend": lambda **_: B.MAX_BARS}


def _kind(name: str, config: dict) -> str:
    return config.get("rule_of", name)


def _split(config: dict) -> tuple[dict, int, dict | None]:
    """A rule's own settings, its window, and how its signals must be confirmed."""
    own = {k: v for k, v in config.items() if k not in ("window", "confirmation", "timeframe", "rule_of")}
    return own, int(config.get("window", 1)), config.get("confirmation")


@dataclass
class Request:
    """What to screen for. rules: settings by name; a name is that of its rule unless rule_of gives it. Besides its own settings a
    rule takes window (any of the last bars, or for rules of exact age a run of just so many), confirmation (a type of candle and
    how many bars ahead it may come) and timeframe (the scope in which it counts). logic: a tree (all | any | not, [names or
    trees]); rules that it does not name, or all without one, must pass too. Unknown rules and impossible settings are errors before any data is read; an unknown
    rule is no empty result."""

    rules: dict[str, dict] = field(default_factory=dict)
    price: tuple[float | None, float | None] = (None, None)
    status: str | None = None
    sectors: list[str] = field(default_factory=list)
    limit: int = 0
    logic: tuple | None = None
    symbols: list[str] = field(default_factory=list)
    asset: str = "stocks"
    seconds: int = 86400

    def __post_init__(self):
        kinds = {n: _kind(n, c) for n, c in self.rules.items()}
        if unknown := {k for k in kinds.values() if k not in RULES and k not in COLUMN_RULES and k not in POST_FILTERS}:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        low, high = self.price
        if low is not None and high is not None and low > high:
            raise ValueError("price: the minimum is above the maximum")
        if self.asset not in ("stocks", "crypto"):
            raise ValueError(f"asset: {self.asset} is neither stocks nor crypto")
        if self.asset == "crypto" and (self.sectors or self.status or any(k in STOCKS_ONLY for k in kinds.values())):
            raise ValueError("sectors, compliance, float and shares are for stocks only")
        for name, config in self.rules.items():
            own, window, confirmation = _split(config)
            if window < 1:
                raise ValueError(f"{name}: window is below 1")
            if confirmation and (confirmation.get("type") not in K.FAMILIES or int(confirmation.get("window", 1)) < 0):
                raise ValueError(f"{name}: confirmation needs a type of {sorted(K.FAMILIES)} and a window of 0 or more")
            if kinds[name] == "confluence":
                confluence.check(**own)
            if kinds[name] == "trend" and own.get("areas") is not None:
                trend.area_rules(own["areas"])
            if kinds[name] == "dead_assets" and (not set(own.get("kinds", ("flat",))) or own.get("lookback", 200) < 20 or own.get("window", 20) < 1):
                raise ValueError(f"{name}: at least one kind of dead trend, and a lookback of 20 bars or more")
            if kinds[name] == "dead_assets" and (own.get("recovery", False) not in (True, False, *postfilters.RECOVERIES) or not (isinstance(own.get("trend", 200), int) or own["trend"] in postfilters.TREND_LINES)):
                raise ValueError(f"{name}: a recovery of {postfilters.RECOVERIES} and a trend line of {sorted(postfilters.TREND_LINES)}")
            if kinds[name] == "channel_respect" and (own.get("channel", "lrc") not in ("lrc", "regression", "trend") or own.get("touch_type", "wick") not in ("wick", "body", "both")):
                raise ValueError(f"{name}: a channel of lrc, regression or trend, touched by wick, body or both")
        check_logic(self.logic)
        named = set(_names(self.logic))
        if unknown := sorted(named - set(self.rules)):
            raise ValueError(f"logic: no rule {unknown[0]}")

    def scoped(self, timeframe: str) -> Request:
        """The request with those rules that count in a scope (rules that name none count in all)."""
        kept = {n: c for n, c in self.rules.items() if c.get("timeframe", timeframe) == timeframe}
        return Request(kept, self.price, self.status, self.sectors, self.limit, self.logic, self.symbols, self.asset, self.seconds)

    @property
    def depth(self) -> int:
        """Bars that the rules need, at most MAX_BARS; one, if no rule looks at bars."""
        needs = [1]
        for name, config in self.rules.items():
            kind, (own, window, confirmation) = _kind(name, config), _split(config)
            if kind in RULES:
                needs.append(RULES[kind].need(**own) + window - 1 + (int(confirmation.get("window", 1)) if confirmation else 0))
            elif kind in WHOLE:
                needs.append(WHOLE_NEED[kind](**own))
        return min(B.MAX_BARS, max(needs))


def check_logic(logic) -> None:
    """A tree is the name of a rule, or all, any or not with a list of trees, of which there is at least one."""
    if logic is None or isinstance(logic, str):
        return
    if not isinstance(logic, (tuple, list)) or len(logic) != 2 or logic[0] not in ("all", "any", "not") or not isinstance(logic[1], (tuple, list)) or not logic[1]:
        raise ValueError(f"logic: {logic!r} is no rule, and not all, any or not with a list of rules")
    for part in logic[1]:
        check_logic(part)


def _names(logic) -> list[str]:
    if logic is None:
        return []
    return [logic] if isinstance(logic, str) else [n for part in logic[1] for n in _names(part)]


def _logic(logic, passed: dict[str, Column]) -> Column:
    if isinstance(logic, str):
        return passed[logic]
    parts = [_logic(x, passed) for x in logic[1]]
    both = reduce(lambda a, b: a & b, parts, F.lit(True))
    some = reduce(lambda a, b: a | b, parts, F.lit(False))
    return {"all": both, "any": some, "not": ~some}[logic[0]]


def judged(bars: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """A row for each symbol of numbered bars: last_time, price, and passed_<rule> and value_<rule> of each rule on bars."""
    b, aggregates = bars, []
    for k, (name, config) in enumerate(rules.items()):
        kind, (own, window, confirmation) = _kind(name, config), _split(config)
        rule, p = RULES[kind], f"_r{k}"
        if kind == "relative_volume" and own.get("rule") == "highest":
            own["window"] = window
        b, hit, value = rule.add(b, p, **own)
        hit = F.coalesce(hit, F.lit(False))
        if confirmation:
            b = K.with_confirmation(b, confirmation["type"], int(confirmation.get("window", 1)), f"{p}_ok", confirmation.get("patterns"))
            hit = hit & F.col(f"{p}_ok")
        b = b.withColumns({f"{p}_hit": hit, f"{p}_value": value.cast("double")})
        hit = F.col(f"{p}_hit")
        passed = channels.age(hit) == window if rule.exact else F.max(hit & (F.col("back") <= window))
        aggregates += [F.coalesce(passed, F.lit(False)).alias(f"passed_{name}"), F.max(F.when(F.col("back") == 1, F.col(f"{p}_value"))).alias(f"value_{name}")]
    now = F.col("back") == 1
    return b.groupBy("symbol").agg(F.max(F.when(now, F.col("close"))).alias("price"), F.max(F.when(now, F.col("time"))).alias("last_time"), *aggregates)


def explained(universe: DataFrame, bars: DataFrame, request: Request) -> DataFrame:
    """Each instrument of the universe with what every stage and rule says of it: nothing is cut short."""
    u = universe
    if request.symbols:
        u = u.where(F.col("symbol").isin(request.symbols))
    if request.status:
        u = u.where(F.col("status") == request.status)
    if request.sectors:
        u = u.where(F.col("sector").isin(request.sectors))
    u = R.in_order(u, request.limit)
    b = B.latest(B.completed(bars).join(u.select("symbol"), "symbol", "left_semi"), request.depth)
    of = lambda kinds: {n: c for n, c in request.rules.items() if _kind(n, c) in kinds}
    if of(WHOLE):
        # Several aggregations read these bars, MAX_BARS a symbol at most: they are made once and kept on the executors, partitioned as they are.
        b = b.persist()
    out = u.join(judged(b, of(RULES)), "symbol", "left").withColumn("in_price_range", F.coalesce(R.price_between(F.col("price"), *request.price), F.lit(False)))
    for name, config in of(WHOLE).items():
        own = _split(config)[0] | ({"asset": request.asset} if _kind(name, config) in ("trend", "channel_respect") else {})
        found = WHOLE[_kind(name, config)](b, **own)
        out = out.join(found.withColumnsRenamed({"passed": f"passed_{name}", "value": f"value_{name}"}), "symbol", "left")
    for name, config in of(COLUMN_RULES).items():
        column = "shares_outstanding" if _kind(name, config) == "shares_outstanding" else config.get("column", "shares_outstanding")
        x = F.col(column)
        out = out.withColumns({f"passed_{name}": indicators.within(x, config.get("low"), config.get("high"), config.get("tolerance", 0.0)), f"value_{name}": x.cast("double")})
    out = out.withColumns({f"passed_{n}": F.coalesce(f"passed_{n}", F.lit(False)) for n in request.rules})
    passed = {n: F.col(f"passed_{n}") for n in request.rules}
    before = {n: c for n, c in passed.items() if _kind(n, request.rules[n]) == "dead_assets"}
    rest = {n: c for n, c in passed.items() if n not in before}
    stages = {"no_data": F.col("price").isNotNull(), "price_range": F.col("in_price_range")}
    # Rules that the tree does not name must pass besides it.
    stages |= {**{n: c for n, c in {**before, **rest}.items() if n not in _names(request.logic)}, **({"rules": _logic(request.logic, passed)} if request.logic else {})}
    out = out.withColumn("reason", R.first_exclusion(stages))
    matched = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in passed.items()])) if passed else F.array().cast("array<string>")
    evidence = F.map_from_arrays(F.array(*map(F.lit, request.rules)), F.array(*[F.col(f"value_{n}") for n in request.rules])) if passed else F.lit(None)
    return out.withColumns({"matched": matched, "evidence": evidence.cast("map<string,double>")})


def screened(universe: DataFrame, bars: DataFrame, request: Request) -> DataFrame:
    """The instruments that pass everything, in the order of the universe, with the rules that they pass."""
    out = explained(universe, bars, request).where("reason = 'included'")
    return out.select("symbol", "ordinal", "name", "exchange", "sector", "price", "last_time", F.concat_ws("+", "matched").alias("matched"))


def gated(universe: DataFrame, gate_bars: DataFrame, gate: Request, entry_bars: DataFrame, entry: Request) -> DataFrame:
    """Two stages: those that pass the gate on coarse bars are the universe of the entry on fine ones."""
    if gate.seconds <= entry.seconds:
        raise ValueError("the gate's bars must be longer than the entry's")
    passed = screened(universe, gate_bars, gate).select("symbol")
    return screened(universe.join(passed, "symbol", "left_semi"), entry_bars, entry)


def any_of(universe: DataFrame, bars: DataFrame, request: Request) -> DataFrame:
    """The instruments that pass at least one rule."""
    ok = reduce(lambda a, b: a | b, (F.col(f"passed_{r}") for r in request.rules))
    return explained(universe, bars, request).where(ok).select("symbol")




def on_snapshots(stored: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rules on one row of stored values for each symbol (close, and rsi, stochrsi's k, sma, ema, macd and signal, aroon as far as
    asked for): a boolean of each rule by its name, and passed."""
    c = F.col("close")
    of = {
        "rsi": lambda location="neutral", tolerance=0.0: indicators.rsi_location(F.col("rsi"), location, tolerance),
        "stochrsi": lambda rule="oversold": {"oversold": F.col("k") <= 20, "overbought": F.col("k") >= 80}[rule],
        "aroon": lambda level="above_50", tolerance=0.0: indicators.aroon_level(F.col("aroon"), level, tolerance),
        "macd": lambda rule="above_signal": {"above_signal": F.col("macd") > F.col("signal"), "below_signal": F.col("macd") < F.col("signal"), "above_zero": F.col("macd") > 0, "below_zero": F.col("macd") < 0}[rule],
        "sma": lambda rule="above": c > F.col("sma") if rule == "above" else c < F.col("sma"),
        "ema": lambda rule="above": c > F.col("ema") if rule == "above" else c < F.col("ema"),
    }
    if unknown := set(rules) - set(of):
        raise ValueError(f"no stored values for: {sorted(unknown)}")
    said = {n: F.coalesce(of[n](**config), F.lit(False)) for n, config in rules.items()}
    return stored.select("symbol", *[v.alias(n) for n, v in said.items()], reduce(lambda a, b: a & b, said.values(), F.lit(True)).alias("passed"))
