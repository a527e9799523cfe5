"""Queries on post-filters, whole screens and streams: POST, ENG and STR."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barlight.functions import candles as K
from barlight.functions import series as S
from barlight.operators import channels, confluence, indicators, postfilters
from barlight.operators import relational as R
from barlight.plans import screen
from barlight.plans.features import _ADX, _LRC, _MACD, _O, _PAT, _RSI, _WT, BARS, REC, TR, _age_sql, _pivot_sql, _touch_sql, days
from barlight.plans.registry import query
from barlight.sources import bars as B
from barlight.streaming import bars as stream
from barlight.streaming import machines, schedule

_CLEAR = "greatest(abs(x) * 0.02, abs(x) * 0.001, 1e-6)"


@query(
    "post_02_channel_respect",
    f"""{REC}{BARS}{B.latest_sql('supplier_days', 100)}, {_LRC}, b AS (SELECT symbol, i, line, open, high, low, close, x, x - abs(x) * 0.01 AS lo, x + abs(x) * 0.01 AS hi FROM (SELECT *, middle + k * 2 * dev AS x FROM lrc, (VALUES ('upper', 1), ('middle', 0), ('lower', -1)) v(line, k))),
h AS (SELECT symbol || '/' || line AS symbol, i, {_touch_sql("lo", "hi")["wick"]} OR {_touch_sql("lo", "hi")["body"]} AS hit, abs(close - x) >= {_CLEAR} OR abs(open - x) >= {_CLEAR} OR abs((high + low) / 2 - x) >= {_CLEAR} AS away FROM b),
f AS (SELECT symbol, i, CASE WHEN hit THEN i ELSE -1 END AS last, false AS apart, CAST(hit AS BIGINT) AS n FROM h WHERE i = 1
  UNION ALL
  SELECT h.symbol, h.i, CASE WHEN hit THEN h.i ELSE last END, NOT hit AND (apart OR (last >= 0 AND away)), n + CAST(hit AND (last < 0 OR (h.i - last > 3 AND apart)) AS BIGINT) FROM f JOIN h ON h.symbol = f.symbol AND h.i = f.i + 1),
g AS (SELECT split_part(symbol, '/', 1) AS symbol, split_part(symbol, '/', 2) AS line, arg_max(n, i) AS n FROM f GROUP BY ALL)
SELECT symbol, CAST(sum(n) FILTER (line = 'middle') AS BIGINT) AS middle, CAST(sum(n) FILTER (line <> 'middle') AS BIGINT) AS both, CAST(sum(n) FILTER (line <> 'lower') AS BIGINT) AS upper_middle, CAST(sum(n) AS BIGINT) AS every, sum(n) BETWEEN 8 AND 12 AS within FROM g GROUP BY symbol""",
)
def post_02(spark, sf_dir):
    """Also AGG-04: distinct touches of a regression channel's lines, of one, two or all of them, and whether they are within bounds."""
    c = channels.regression(days(spark, sf_dir, 100))
    out = None
    for name, ask in (("middle", "middle"), ("both", "both"), ("upper_middle", "upper_middle"), ("every", "all")):
        found = postfilters.respects(c, postfilters.lines_of(ask), 1.0, 3, name, "both")
        out = found if out is None else out.join(found, "symbol")
    return out.withColumn("within", F.col("every").between(8, 12))


#: What a confluence query looks at: the middle of one regression channel and a band of another; percent of tolerance.
_FIRST, _SECOND, _NEAR = 60, 30, 8.0
#: Each of the last dates counts as a last one.
_DATES = 20


def _lines(name: str, n: int) -> str:
    """The regression over the last n bars of c, and its deviation."""
    return f"""{name}0 AS (SELECT symbol, regr_slope(close, i) AS slope, regr_intercept(close, i) AS icpt, var_pop(close) AS v, corr(close, i) AS r FROM c WHERE back <= {n} GROUP BY symbol),
{name} AS (SELECT c.symbol, c.i, icpt + slope * c.i AS middle, 2 * sqrt(greatest(v * (1 - r * r), 0) + slope * slope) AS dev FROM c JOIN {name}0 USING (symbol) WHERE back <= {n})"""


def _confluence_sql() -> str:
    """By joins of a symbol's last bars with each other, a row for each pair that matches."""
    held = lambda k, way: "coalesce(" + " OR ".join(_touch_sql(f"(low{k} - s{k})", f"(high{k} + s{k})", way).values()) + ", false)"
    shows = {
        ("bullish", 0, 0, "dual_support"): "s.sup2 AND s.run2 BETWEEN 1 AND 4 AND f.sup1",
        ("bullish", 0, 1, "stacked_support"): "s.sup2 AND s.mid2 < s.mid1 AND l.near2 AND f.sup1 AND NOT EXISTS (SELECT 1 FROM t z WHERE z.symbol = s.symbol AND z.back <= f.back AND z.back > s.back AND NOT coalesce(z.close >= z.low1, false)) AND NOT EXISTS (SELECT 1 FROM t z WHERE z.symbol = s.symbol AND z.back <= s.back AND NOT coalesce(z.close >= z.low2, false))",
        ("bearish", 1, 0, "stacked_resistance"): "s.res2 AND s.mid2 > s.mid1 AND f.res1 AND l.close < l.low1",
        ("bearish", 1, 1, "clustered_resistance"): f"s.res2 AND abs(s.mid1 - s.mid2) <= greatest(abs(s.mid1), abs(s.mid2), 1) * {_NEAR} / 100 AND s.run1 BETWEEN 1 AND 4 AND l.close <= l.high1 + l.s1 AND f.res1",
        ("breakout", 2, 0, "dual_resistance_break"): "s.broke2 AND s.run2 BETWEEN 1 AND 4 AND f.broke1",
        ("breakout", 2, 1, "support_then_resistance_break"): "s.broke2 AND s.run2 BETWEEN 1 AND 3 AND f.sup1",
        ("breakout", 2, 2, "resistance_break_then_support"): "s.sup2 AND l.near2 AND f.broke1 AND NOT EXISTS (SELECT 1 FROM t z WHERE z.symbol = s.symbol AND z.back <= f.back AND NOT coalesce(z.close > z.high1, false))",
        ("role_reversal", 3, 0, "role_reversal"): "s.sup2 AND l.near2 AND f.broke1 AND NOT EXISTS (SELECT 1 FROM t z WHERE z.symbol = s.symbol AND z.back <= f.back AND NOT coalesce(z.close > z.high1, false))",
    }
    pairs = " UNION ALL ".join(f"SELECT s.symbol, '{kind}' AS kind, {m} AS m, s.back AS second_back, {k} AS k, f.back AS first_back, '{name}' AS scenario FROM t s JOIN t f ON f.symbol = s.symbol AND f.back >= s.back JOIN t l ON l.symbol = s.symbol AND l.back = 1 WHERE {ok}" for (kind, m, k, name), ok in shows.items())
    run = lambda ok: f"(SELECT CASE WHEN count(*) FILTER (WHERE {ok}) > 0 AND max(CASE WHEN {ok} THEN z.back END) = count(*) FILTER (WHERE {ok}) THEN count(*) FILTER (WHERE {ok}) END FROM t0 z WHERE z.symbol = t0.symbol AND z.back <= t0.back)"
    kinds = ", ".join(f"max(CASE WHEN kind = '{k}' THEN scenario END) AS {k}" for k in ("bullish", "bearish", "breakout", "role_reversal"))
    return f"""WITH {BARS}{B.latest_sql('supplier_days').replace('c AS (', 'whole AS (', 1)}, c AS (SELECT symbol || '@' || k AS symbol, time, open, high, low, close, i, back - k AS back FROM whole, range({_DATES}) d(k) WHERE back - k BETWEEN 1 AND {_FIRST}),
{_lines("one", _FIRST)}, {_lines("two", _SECOND)},
v AS (SELECT c.*, one.middle AS low1, one.middle AS high1, two.middle - two.dev * 0.4 AS low2, two.middle + two.dev * 0.2 AS high2, lag(close) OVER o AS c1, lag(one.middle) OVER o AS p1, lag(two.middle + two.dev * 0.2) OVER o AS p2 FROM c JOIN one USING (symbol, i) JOIN two USING (symbol, i) WINDOW o AS (PARTITION BY c.symbol ORDER BY c.i)),
w AS (SELECT *, (low1 + high1) / 2 AS mid1, (low2 + high2) / 2 AS mid2, greatest(abs((low1 + high1) / 2), 1) * {_NEAR} / 100 AS s1, greatest(abs((low2 + high2) / 2), 1) * {_NEAR} / 100 AS s2 FROM v),
t0 AS (SELECT *, {held(1, 'down')} AS sup1, {held(2, 'down')} AS sup2, {held(1, 'up')} AS res1, {held(2, 'up')} AS res2, coalesce(c1 <= p1 AND close > high1, false) AS broke1, coalesce(c1 <= p2 AND close > high2, false) AS broke2, close >= low2 AND close <= high2 + s2 AS near2 FROM w WHERE back <= 4),
t AS (SELECT *, {run('z.close > z.high2')} AS run2, {run('z.close < z.low1')} AS run1 FROM t0),
p AS ({pairs}),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY second_back, k, first_back DESC) AS nr, row_number() OVER (PARTITION BY symbol, kind <> 'role_reversal' ORDER BY m, second_back, k, first_back DESC) AS nr_any FROM p),
of_kinds AS (SELECT symbol, {kinds} FROM r WHERE nr = 1 GROUP BY symbol),
of_any AS (SELECT symbol, scenario AS any_scenario, second_back, first_back FROM r WHERE nr_any = 1 AND kind <> 'role_reversal')
SELECT symbol, bullish, bearish, breakout, role_reversal, any_scenario, CAST(second_back AS BIGINT) AS second_back, CAST(first_back AS BIGINT) AS first_back FROM (SELECT DISTINCT symbol FROM t) LEFT JOIN of_kinds USING (symbol) LEFT JOIN of_any USING (symbol)"""


@query("post_03_confluence", _confluence_sql())
def post_03(spark, sf_dir):
    """CF-02 to CF-10, JN-12 and POST-05: all kinds of confluence of a line and a zone, with the bars of the match, by symbol and last date."""
    ends = days(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(_DATES - 1))).alias("k"))
    ends = ends.withColumns({"symbol": F.concat_ws("@", "symbol", "k"), "back": F.col("back") - F.col("k")}).where(F.col("back").between(1, _FIRST))
    b = channels.regression_of(ends, F.col("back") <= _FIRST, p="a")
    b = channels.regression_of(b, F.col("back") <= _SECOND, p="b")
    dev = F.col("b_middle") - F.col("b_lower")
    within = lambda x, n: F.when(F.col("back") <= n, x)
    b = b.withColumns({"low1": within(F.col("a_middle"), _SECOND), "high1": within(F.col("a_middle"), _SECOND), "low2": within(F.col("b_middle") - dev * 0.4, _SECOND), "high2": within(F.col("b_middle") + dev * 0.2, _SECOND)})
    kinds = ["bullish", "bearish", "breakout", "role_reversal"]
    found = confluence.matches(b, [*kinds, "any"], 4, _NEAR)
    return found.select("symbol", *[F.col(f"{k}.scenario").alias(k) for k in kinds], F.col("any.scenario").alias("any_scenario"), F.col("any.second_back").cast("long").alias("second_back"), F.col("any.first_back").cast("long").alias("first_back"))


@query("post_04_liquidity_sweep", f"WITH {BARS}{B.latest_sql('supplier_days', 120)}, l AS (SELECT *, {S.lag_sql('low')} AS l1, {S.lag_sql('high')} AS h1 FROM c) SELECT symbol, time, coalesce((low < l1 AND close > l1) OR (high > h1 AND close < h1), false) AS sweep FROM l")
def post_04(spark, sf_dir):
    return days(spark, sf_dir, 120).select("symbol", "time", postfilters.liquidity_sweep().alias("sweep"))


def _runs(name: str, flag: str, price: str, lookback: int) -> str:
    return f"""{name}0 AS (SELECT symbol, i, back, {price} AS p, lag({price}) OVER (PARTITION BY symbol ORDER BY i) AS q, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS rk FROM b WHERE {flag}),
{name} AS (SELECT symbol, min(CASE WHEN NOT coalesce(p < q, false) THEN rk END) - 1 AS run, bool_or(coalesce(p > q, false) AND back <= {lookback}) AS higher, arg_max(p, i) AS last FROM {name}0 GROUP BY symbol)"""


def _dead_sql(line: str, lookback: int = 200, bounce: float = 20.0, window: int = 20) -> str:
    return f"""{REC}{BARS}{B.latest_sql('supplier_days')}, t AS (SELECT *, {TR} AS tr FROM c), {line}, {S.rma_sql("r", "t", {"running": ("tr", 14)})},
seed AS (SELECT symbol, avg(tr) AS seed FROM t WHERE i <= 14 GROUP BY symbol),
b AS (SELECT t.*, line, CASE WHEN i <= 14 THEN seed ELSE running END AS atr, {_pivot_sql(5)} FROM t JOIN e USING (symbol, i) JOIN r USING (symbol, i) JOIN seed USING (symbol)),
{_runs("hi", "pivot_high", "high", lookback)}, {_runs("lo", "pivot_low", "low", lookback)},
up AS (SELECT s.symbol, s.i AS s, any_value(s.low) AS p, min(z.i) AS u FROM b s JOIN b z ON s.symbol = z.symbol AND z.i > s.i AND z.high >= s.low * (1 + {bounce} / 100) WHERE s.pivot_low AND s.low > 0 GROUP BY s.symbol, s.i),
failed AS (SELECT DISTINCT up.symbol, true AS failed FROM up JOIN b z ON z.symbol = up.symbol AND z.i BETWEEN u AND u + {window} AND z.low < p),
a AS (SELECT symbol, count(*) AS n, max(CASE WHEN back = 1 THEN line END) AS line_end, arg_min(line, i) FILTER (back <= {lookback} + 1) AS line_start, max(CASE WHEN back = 1 THEN close END) AS close, max(CASE WHEN back = 2 THEN close END) AS close_before, max(CASE WHEN back = 1 THEN high END) AS high, avg(CASE WHEN back <= {lookback} THEN CAST(close < line AS INT) END) AS below,
  {', '.join(f'avg(CASE WHEN back BETWEEN {p} AND {q} THEN {x} END) AS {x}_{k}' for x in ('volume', 'atr') for k, p, q in (('now', 1, 20), ('long', 1, 100), ('prior', 21, 40)))} FROM b GROUP BY symbol),
k AS (SELECT a.*, line_end < line_start AND NOT coalesce(hi.higher, false) AND below >= 0.8 AS slow, coalesce(hi.run >= 3, false) AND coalesce(lo.run >= 3, false) AS runs, coalesce(failed, false) AS failed, coalesce(close > hi.last, false) AS recovered, hi.last AS top
  FROM a LEFT JOIN hi USING (symbol) LEFT JOIN lo USING (symbol) LEFT JOIN failed USING (symbol))
SELECT symbol, CASE WHEN slow AND runs THEN 'strong' WHEN slow THEN 'slow' WHEN failed THEN 'failed' WHEN (volume_now < 0.5 * volume_long OR volume_now <= 0.7 * volume_prior) AND atr_now < 0.5 * atr_long THEN 'flat' ELSE 'none' END AS kind, recovered, coalesce(high > top, false) AS wick, recovered AND coalesce(close_before > top, false) AS twice FROM k"""


@query("post_06_dead_assets", _dead_sql(S.ema_sql("e", "t", {"line": ("close", 200)})))
def post_06(spark, sf_dir):
    """Also POST-07 to POST-10, JN-13 and AGG-05 to AGG-07."""
    return postfilters.dead(days(spark, sf_dir)).select("symbol", "kind", "recovered", F.col("wick_above_swing_high").alias("wick"), F.col("two_closes_above_swing_high").alias("twice"))


@query("post_10_dead_lines", _dead_sql("e AS (SELECT symbol, i, regr_intercept(close, i) OVER w + regr_slope(close, i) OVER w * i AS line FROM t WINDOW w AS (PARTITION BY symbol))", 30, 2500.0, 1))
def post_10(spark, sf_dir):
    """Also TH-08 and POST-09: dead trends held against the least-squares line, and each way of recovering."""
    found = postfilters.dead(days(spark, sf_dir), lookback=30, bounce=2500.0, window=1, trend="linear_regression")
    return found.select("symbol", "kind", "recovered", F.col("wick_above_swing_high").alias("wick"), F.col("two_closes_above_swing_high").alias("twice"))


_REQUEST = screen.Request(rules={"sma": {"rule": "below"}, "rsi": {"location": "neutral", "tolerance": 10}, "macd": {}}, price=(100.0, 9000.0))
_STAGES = f"""{REC}{BARS}{B.UNIVERSE}, {B.latest_sql('supplier_days', 200)}, avgs AS (SELECT symbol, close, time, back, {S.sma_sql("close", 20)} AS sma FROM c), {_RSI}, {_MACD},
x AS (SELECT u.symbol, u.ordinal, u.name, u.exchange, u.sector, m.close AS price, m.time AS last_time, coalesce(m.close < m.sma, false) AS a, coalesce(q.rsi BETWEEN 20 AND 80, false) AS b, coalesce(z.macd > z.signal, false) AS d
  FROM universe u LEFT JOIN avgs m ON m.symbol = u.symbol AND m.back = 1 LEFT JOIN rsi q ON q.symbol = u.symbol AND q.back = 1 LEFT JOIN macd z ON z.symbol = u.symbol AND z.back = 1),
y AS (SELECT *, CASE WHEN price IS NULL THEN 'excluded:no_data' WHEN NOT price BETWEEN 100 AND 9000 THEN 'excluded:price_range' WHEN NOT a THEN 'excluded:sma' WHEN NOT b THEN 'excluded:rsi' WHEN NOT d THEN 'excluded:macd' ELSE 'included' END AS reason FROM x)"""


@query("screen_single", f"{_STAGES} SELECT symbol, ordinal, name, exchange, sector, price, last_time, 'sma+rsi+macd' AS matched FROM y WHERE reason = 'included'")
def screen_single(spark, sf_dir):
    """ENG-01, ENG-03 to ENG-07: universe, price range, rules, projection."""
    return screen.screened(B.universe(spark, sf_dir), B.supplier_days(spark, sf_dir), _REQUEST)


@query("screen_reasons", f"{_STAGES} SELECT symbol, reason, a AS passed_sma, b AS passed_rsi, d AS passed_macd FROM y")
def screen_reasons(spark, sf_dir):
    """Also ENG-02, PRJ-05 and PRJ-07: every rule's answer, and the first stage that excludes."""
    out = screen.explained(B.universe(spark, sf_dir), B.supplier_days(spark, sf_dir), _REQUEST)
    return out.select("symbol", "reason", "passed_sma", "passed_rsi", "passed_macd")


@query("screen_long_lengths")
def screen_long(spark, sf_dir):
    """Rules whose lengths need more bars than their defaults."""
    request = screen.Request(rules={"sma": {"length": 200}, "rsi": {"length": 60}, "aroon": {"length": 60, "level": "above_50"}})
    out = screen.explained(B.universe(spark, sf_dir), B.supplier_days(spark, sf_dir), request)
    return out.select("symbol", "reason", "passed_sma", "passed_rsi", "passed_aroon")


@query("agg_12_audit", f"{_STAGES} SELECT CAST(count(*) AS BIGINT) AS universe, CAST(count(price) AS BIGINT) AS with_bars, CAST(count(*) FILTER (reason = 'included') AS BIGINT) AS included FROM y")
def agg_12(spark, sf_dir):
    out = screen.explained(B.universe(spark, sf_dir), B.supplier_days(spark, sf_dir), _REQUEST)
    return out.agg(F.count(F.lit(1)).alias("universe"), F.count("price").alias("with_bars"), F.count(F.when(F.col("reason") == "included", 1)).alias("included"))


_MONTH = "(year(CAST(make_timestamp(time * 1000000) AS DATE)) * 12 + month(CAST(make_timestamp(time * 1000000) AS DATE)) - 1)"


@query(
    "screen_gate_entry",
    f"""WITH {BARS}{B.UNIVERSE}, mo AS (SELECT symbol, min(time) AS time, arg_max(close, time) AS close FROM (SELECT *, {_MONTH} AS k FROM supplier_days) GROUP BY symbol, k), {B.latest_sql('mo', 20, 'g')},
gm AS (SELECT symbol, close, back, {S.sma_sql("close", 20)} AS sma FROM g), gate AS (SELECT symbol FROM gm WHERE back = 1 AND close < sma),
{B.latest_sql('supplier_days', 60)}, v AS (SELECT symbol, time, close, back, volume / ({S.sma_sql("volume", 30, 1)}) AS rvol FROM c)
SELECT symbol, ordinal, close AS price, time AS last_time FROM v JOIN universe USING (symbol) WHERE back = 1 AND rvol BETWEEN 0.3 AND 1000 AND symbol IN (SELECT symbol FROM gate)""",
)
def screen_gate_entry(spark, sf_dir):
    """Also JN-02: months decide who enters, days who stays."""
    d, u = B.supplier_days(spark, sf_dir), B.universe(spark, sf_dir)
    months = B.rolled_up(d, R.calendar_bucket(F.col("time"), 1, "mo"))
    out = screen.gated(u, months, screen.Request(rules={"sma": {"rule": "below"}}, seconds=30 * 86400), d, screen.Request(rules={"relative_volume": {"low": 0.3, "high": 1000.0}}))
    return out.select("symbol", "ordinal", "price", "last_time")


def _explained(name: str, request: screen.Request, ctes: str, flags: dict[str, str], logic: str | None = None, doc: str = ""):
    """Registers a screen that says of every instrument what each rule says. flags: by rule, SQL of (symbol, passed)."""
    alone = [r for r in flags if r not in screen._names(request.logic)]
    cases = " ".join(f"WHEN NOT {r} THEN 'excluded:{r}'" for r in alone) + (f" WHEN NOT ({logic}) THEN 'excluded:rules'" if logic else "")
    joins = " ".join(f"LEFT JOIN ({q}) t{k} ON t{k}.symbol = u.symbol" for k, q in enumerate(flags.values()))
    sql = f"""{REC}{BARS}{B.UNIVERSE}, {B.latest_sql('supplier_days', request.depth)}{", " + ctes if ctes else ""},
said AS (SELECT u.symbol, m.close AS price, {', '.join(f'coalesce(t{k}.passed, false) AS {r}' for k, r in enumerate(flags))} FROM universe u LEFT JOIN (SELECT symbol, close FROM c WHERE back = 1) m ON m.symbol = u.symbol {joins})
SELECT symbol, {', '.join(f'{r} AS passed_{r}' for r in flags)}, CASE WHEN price IS NULL THEN 'excluded:no_data' {cases} ELSE 'included' END AS reason FROM said"""

    @query(name, sql)
    def run(spark, sf_dir):
        out = screen.explained(B.universe(spark, sf_dir), B.supplier_days(spark, sf_dir), request)
        return out.select("symbol", *[f"passed_{r}" for r in flags], "reason")

    run.__doc__ = doc


def _any(table: str, condition: str, window: int = 1) -> str:
    return f"SELECT symbol, bool_or(coalesce({condition}, false) AND back <= {window}) AS passed FROM {table} GROUP BY symbol"


#: The same tables under names that the other indicators' do not have.
_ADX_BESIDE = re.sub(r"\bm\b", "moves", _ADX)

_explained(
    "screen_momentum",
    screen.Request({"rsi": {"location": "overbought", "tolerance": 10, "window": 5}, "turn": {"rule_of": "rsi", "direction": "turning_up", "window": 3}, "macd": {"rule": "bullish_cross", "tolerance": 1.0, "window": 5}}, logic=("any", ["macd", ("all", ["rsi", "turn"])])),
    f"{_RSI}, rl AS (SELECT *, {S.lag_sql('rsi')} AS r1, {S.lag_sql('rsi', 2)} AS r2 FROM rsi), {_MACD}, ml AS (SELECT *, {S.lag_sql('near')} AS n1 FROM macd)",
    {"rsi": _any("rsi", "rsi >= 60", 5), "turn": _any("rl", "r1 - r2 <= 1e-9 AND rsi - r1 > 1e-9", 3), "macd": _any("ml", "m1 <= s1 + n1 AND macd > signal - near", 5)},
    "macd OR (rsi AND turn)",
    "ENG-08: groups of rules; windows of any of the last bars; two rules of one kind.",
)
_explained(
    "screen_trend_strength",
    screen.Request({"adx": {"conditions": ("bullish", "strong"), "threshold": 20.0, "window": 3}, "ema": {"length": 20, "rule": "above", "tolerance": 1.0}, "weak": {"rule_of": "adx", "conditions": ("weak",)}, "cross_": {"rule_of": "adx", "conditions": ("bullish_cross",), "window": 10}, "state": {"rule_of": "adx", "conditions": ("state_up",)}}, logic=("any", ["adx", ("not", ["ema", "weak"]), "cross_", "state"])),
    f"{_ADX}, al AS (SELECT *, {S.lag_sql('dip')} AS p1, {S.lag_sql('dim')} AS m1 FROM adx), {S.ema_sql('e', 'c', {'ema': ('close', 20)})}, em AS (SELECT symbol, i, back, close, ema FROM c JOIN e USING (symbol, i))",
    {"adx": _any("adx", "dip > dim AND adx >= 20", 3), "ema": _any("em", "close >= ema - abs(ema) * 0.01"), "weak": _any("adx", "adx < dip AND adx < dim"), "cross_": _any("al", "p1 <= m1 AND dip > dim", 10), "state": _any("adx", "trend_value > 4 AND trend_value <= 10")},
    "adx OR NOT (ema OR weak) OR cross_ OR state",
    "AX conditions in a screen.",
)
_explained(
    "screen_wavetrend",
    screen.Request({"zone": {"rule_of": "wavetrend", "clauses": (("zone", "oversold"), ("direction", "rising")), "inner": 20.0, "window": 10}, "cross_up": {"rule_of": "wavetrend", "clauses": (("cross", "bullish"), ("compare", "above_zero")), "logic": "any", "window": 2}, "either": {"rule_of": "wavetrend", "clauses": (("cross", "any"), ("zone", "overbought")), "logic": "any"}}),
    f"{_WT}, wl AS (SELECT *, {S.lag_sql('wt1')} AS p1, {S.lag_sql('wt2')} AS p2 FROM w)",
    {"zone": _any("wl", "wt1 <= -20 AND wt1 - p1 > 1e-9", 10), "cross_up": _any("wl", "coalesce(p1 <= p2 AND wt1 > wt2, false) OR wt1 > 0", 2), "either": _any("wl", "coalesce(p1 <= p2 AND wt1 > wt2, false) OR coalesce(p1 >= p2 AND wt1 < wt2, false) OR wt1 >= 53")},
    None,
    "WT-01 to WT-04: clauses of zones, crossings, directions and comparisons.",
)
_RV = f"rv AS (SELECT *, CASE WHEN {S.sma_sql('volume', 30, 1)} > 0 THEN volume / ({S.sma_sql('volume', 30, 1)}) END AS rvol, {S.sma_sql('volume', 30)} AS mean FROM c), rvl AS (SELECT *, {S.lag_sql('rvol')} AS p, {S.lag_sql('volume')} AS v1, max(rvol) {_O(4, 0)} AS top FROM rv)"
_explained(
    "screen_volume",
    screen.Request({"rvol": {"rule_of": "relative_volume", "rule": "above", "low": 1.2, "window": 3}, "crossed": {"rule_of": "relative_volume", "rule": "crossed_above", "low": 1.0, "window": 4}, "top": {"rule_of": "relative_volume", "rule": "highest", "window": 5}, "more": {"rule_of": "relative_volume", "rule": "increased_volume"}, "average": {"rule_of": "current_volume", "rule": "above_average"}, "percent": {"rule_of": "current_volume", "rule": "between_average_percent", "low": 50, "high": 120, "window": 2}}, logic=("any", ["rvol", ("all", ["crossed", "average"]), ("not", ["percent", "top"])])),
    _RV,
    {"rvol": _any("rvl", "rvol >= 1.2", 3), "crossed": _any("rvl", "p <= 1 AND rvol > 1", 4), "top": _any("rvl", "rvol >= top", 5), "more": _any("rvl", "volume > v1"), "average": _any("rvl", "volume > mean"), "percent": _any("rvl", "floor(100 * volume / mean + 0.5) BETWEEN 50 AND 120", 2)},
    "rvol OR (crossed AND average) OR NOT (percent OR top)",
    "The rules of relative and current volume.",
)
_explained(
    "screen_wave_conditions",
    screen.Request({n: {"rule_of": "wavetrend", **c} for n, c in {
        "from_low": {"condition": "cross_up", "zone": "oversold", "inner": 15.0, "window": 20}, "watch": {"condition": "overbought_watch", "level": 1, "outer": 40.0, "tolerance": 5.0, "window": 12}, "turned": {"condition": "turning_down", "zone": "overbought", "inner": 30.0, "window": 25},
        "any_cross": {"condition": "cross_any"}, "hist": {"clauses": (("compare", "hist", ">=", 4.0), ("direction", "rising", "hist")), "window": 2}, "near": {"clauses": (("compare", "wt1", "near", "wt2"), ("compare", "red", "<=", 10.0)), "tolerance": 1.5, "window": 3},
    }.items()}, logic=("any", ["from_low", ("all", ["watch", "turned"]), ("not", ["any_cross", "hist", "near"])])),
    f"{_WT}, wl AS (SELECT *, {S.lag_sql('wt1')} AS p1, {S.lag_sql('wt2')} AS p2, {S.lag_sql('wt1', 2)} AS q1, {S.lag_sql('wt1')} - {S.lag_sql('wt2')} AS ph FROM w)",
    {
        "from_low": _any("wl", "p1 <= p2 AND wt1 > wt2 AND wt2 <= -15", 20), "watch": _any("wl", "wt1 >= 35", 12), "turned": _any("wl", "p1 - q1 >= -1e-9 AND wt1 - p1 < -1e-9 AND wt1 >= 30", 25),
        "any_cross": _any("wl", "(p1 <= p2 AND wt1 > wt2) OR (p1 >= p2 AND wt1 < wt2)"), "hist": _any("wl", "wt1 - wt2 >= 4 AND wt1 - wt2 - ph > 1e-9", 2), "near": _any("wl", "abs(wt1 - wt2) <= 1.5 AND wt2 <= 11.5", 3),
    },
    "from_low OR (watch AND turned) OR NOT (any_cross OR hist OR near)",
    "WT-05 and WT-06: conditions by name, in zones of either level, and clauses on the histogram.",
)
_MEAN = S.sma_sql("volume", 20)
_explained(
    "screen_volume_options",
    screen.Request({n: {"rule_of": "volume", "length": 20, **c} for n, c in {
        "plain": {"rule": "bull", "times": 1.0, "extremes": False, "hammers": False, "window": 2}, "colored": {"rule": "bearish", "times": 1.0, "hammers": False, "same_color": True, "window": 4}, "hours": {"rule": "any", "times": 0.8, "extremes": False, "session": "2300-0100", "window": 3},
        "hammer": {"times": 0.8, "extremes": False, "window": 90},
    }.items()} | {"entry": {"rule_of": "relative_volume", "rule": "entry", "lines": ("ma2", "ma4"), "window": 60}, "smooth": {"rule_of": "current_volume", "average": "ema", "length": 10}, "weighed": {"rule_of": "current_volume", "average": "lwma", "length": 8, "rule": "above_average_percent", "low": 90}}, logic=("any", ["plain", "entry", ("all", ["colored", "smooth"]), ("all", ["hours", "weighed", "hammer"])])),
    f"vv AS (SELECT *, volume > {_MEAN} AS big1, volume > 0.8 * ({_MEAN}) AS big08, {S.lag_sql('high')} AS h1, lead(high) OVER (PARTITION BY symbol ORDER BY i) AS hn, low + (high - low) / 2 AS mid FROM c), "
    + "vb AS (SELECT symbol, back - 1 AS back, big1 AND i >= 2 AS plain, big1 AND i >= 2 AND high > h1 AND high > hn AND close < open AS colored, big08 AND i >= 2 AND ((open < mid AND close < mid) OR (open > mid AND close > mid)) AS hours, big08 AND i >= 2 AND ((open < mid AND close < mid) OR (open > mid AND close > mid)) AS hammer FROM vv WHERE back > 1), "
    + f"en AS (SELECT *, {', '.join(f'CASE WHEN i >= {n} THEN regr_intercept(volume, i) {_O(n - 1, 0)} + regr_slope(volume, i) {_O(n - 1, 0)} * i END AS m{n}' for n in (50, 6))} FROM c), el AS (SELECT *, {S.lag_sql('m50')} AS p50, {S.lag_sql('m6')} AS p6 FROM en), "
    + S.ema_sql("ve", "c", {"vm": ("volume", 10)}) + f", vs AS (SELECT c.symbol, c.back, volume > vm AND c.i >= 10 AS smooth, floor(volume * 100 / ({' + '.join(f'{k + 1} * lag(volume, {k}) OVER (PARTITION BY c.symbol ORDER BY c.i)' for k in range(8))}) * 36 + 0.5) >= 90 AS weighed FROM c JOIN ve USING (symbol, i))",
    {"plain": _any("vb", "plain", 2), "colored": _any("vb", "colored", 4), "hours": _any("vb", "hours", 3), "hammer": _any("vb", "hammer", 90), "entry": _any("el", "(p50 <= 0 AND m50 > 0) OR (p6 <= 0 AND m6 > 0)", 60), "smooth": _any("vs", "smooth"), "weighed": _any("vs", "weighed")},
    "plain OR entry OR (colored AND smooth) OR (hours AND weighed AND hammer)",
    "IND-09, IND-11, VH-02 and VH-03: the toggles of volume spikes, entries by any line, and other means of volume.",
)


def _label_sql(mode: str) -> str:
    own, other, name = ("dip", "dim", "Bullish") if mode == "bullish" else ("dim", "dip", "Bearish")
    return f"CASE WHEN adx IS NULL THEN 'Early {name} / Weak Strength' WHEN adx > 40 THEN '{name} Exhaustion Warning' WHEN adx > 25 AND adx > {own} AND adx > {other} THEN 'Strong {name} Confirmed' WHEN adx > 15 AND adx > {own} THEN '{name} Confirmed' WHEN adx >= 15 THEN '{name} Strength Building' ELSE 'Early {name} / Weak Strength' END"


@query("ax_06_directional_labels", f"{REC}{BARS}{B.latest_sql('supplier_days', 200)}, {_ADX} SELECT symbol, CAST(i AS BIGINT) AS i, {_label_sql('bullish')} AS bullish, {_label_sql('bearish')} AS bearish FROM adx")
def ax_06(spark, sf_dir):
    """What every bar says of a rising and of a falling trend's strength."""
    x = indicators.trend_strength(days(spark, sf_dir, 200), 11)
    return x.select("symbol", F.col("i").cast("long").alias("i"), *[indicators.directional_label(m, 15.0).alias(m) for m in ("bullish", "bearish")])


_AR = f"ar AS (SELECT symbol, i, back, CASE WHEN i >= 15 THEN 100.0 * (arg_max(i, row(high, -i)) {_O(14, 0)} - arg_min(i, row(low, i)) {_O(14, 0)}) / 14 END AS x FROM c), arl AS (SELECT *, {S.lag_sql('x')} AS x1, {S.lag_sql('x', 2)} AS x2 FROM ar)"
_explained(
    "screen_aroon",
    screen.Request({"level": {"rule_of": "aroon", "level": "above_50", "window": 4}, "turning": {"rule_of": "aroon", "level": "below_-50", "direction": "turning_up", "extreme": 30.0, "window": 30}, "sma": {"length": 10, "rule": "touch", "tolerance": 5.0, "window": 2}}),
    f"{_AR}, sm AS (SELECT symbol, i, back, close, {S.sma_sql('close', 10)} AS m FROM c)",
    {"level": _any("ar", "x >= 50", 4), "turning": _any("arl", "x <= -50 AND x1 - x2 <= 1e-9 AND x - x1 > 1e-9 AND x1 <= -30", 30), "sma": _any("sm", "abs(close - m) <= abs(m) * 0.05", 2)},
    None,
    "RH-02: levels and turns of the oscillator within a window.",
)
_VOLA = f"vr AS (SELECT *, close / nullif({S.lag_sql('close')}, 0) - 1 AS ret, CASE WHEN low <> 0 THEN {TR} * 100 / abs(low) END AS daily FROM c), vv AS (SELECT *, sum(CASE WHEN low <> 0 THEN (high - low) / abs(low) * 100 / 14 END) {_O(13, 0)} AS range_avg, CASE WHEN count(ret) {_O(19, 0)} = 20 THEN stddev_pop(ret) {_O(19, 0)} * 100 END AS realised FROM vr)"
_explained(
    "screen_volatility",
    screen.Request({"range_": {"rule_of": "volatility", "mode": "range_avg", "low": 10.0, "high": 500.0}, "daily": {"rule_of": "volatility", "mode": "daily", "low": 1.0, "high": 20.0, "tolerance": 5.0, "window": 3}, "returns": {"rule_of": "volatility", "mode": "returns_std", "high": 60.0}}),
    _VOLA,
    {"range_": _any("vv", "range_avg BETWEEN 10 AND 500"), "daily": _any("vv", "daily BETWEEN -4 AND 25", 3), "returns": _any("vv", "realised <= 60")},
)
_CONF = f"pf AS (SELECT *, close > open OR {' OR '.join(K.FAMILIES['bullish'])} AS ok FROM p), pc AS (SELECT *, max(ok) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS confirmed FROM pf)"
_explained(
    "screen_patterns",
    screen.Request({"pattern": {"names": ("bullish_pin_bar", "bullish_engulfing", "tweezer_bottom"), "window": 20, "confirmation": {"type": "bullish", "window": 2}}, "doji": {"rule_of": "pattern", "names": ("doji",), "window": 5}}),
    f"{_PAT}, {_CONF}",
    {"pattern": _any("pc", "(bullish_pin_bar OR bullish_engulfing OR tweezer_bottom) AND confirmed", 20), "doji": _any("p", "doji", 5)},
    None,
    "Patterns with a confirmation that may come some bars later.",
)
_explained(
    "screen_channel_lines",
    screen.Request({"middle": {"rule_of": "lrc", "lines": (("middle", "close_above"),), "window": 1}, "lower": {"rule_of": "lrc", "lines": (("lower", "stay_above"), ("upper", "close_above")), "strength": "ignore", "window": 4}, "two": {"rule_of": "lrc", "lines": (("middle", "close_below"),), "window": 2, "tolerance": 1.0}}),
    f"w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS j FROM c WHERE back <= 100), l AS (SELECT *, regr_slope(close, i) OVER q AS slope, regr_intercept(close, i) OVER q AS icpt, var_pop(close) OVER q AS var, corr(close, i) OVER q AS r FROM w WINDOW q AS (PARTITION BY symbol)), lrc AS (SELECT *, icpt + slope * i AS middle, sqrt(greatest(var * (1 - r * r), 0) + slope * slope) AS dev FROM l)",
    {"middle": f"SELECT symbol, {_age_sql('close > middle')} = 1 AS passed FROM lrc GROUP BY symbol", "lower": f"SELECT symbol, {_age_sql('low > middle - 2 * dev OR close > middle + 2 * dev')} = 4 AS passed FROM lrc GROUP BY symbol", "two": f"SELECT symbol, {_age_sql('close < middle - abs(middle) * 0.01')} = 2 AS passed FROM lrc GROUP BY symbol"},
    None,
    "CHN-04 in a screen: runs of an exact age.",
)
_explained(
    "screen_correlation_lines",
    screen.Request({"order_": {"rule_of": "vlr", "tree": ("order", "below"), "window": 3}, "tree": {"rule_of": "vlr", "tree": ("any", [("all", [("compare", "r1", "<", "r2"), ("direction", "r1", "falling")]), ("not", [("zone", "r3", -0.5, 0.5)])])}, "cross_": {"rule_of": "vlr", "tree": ("cross", "r1", "r2", "above"), "window": 15}, "early": {"rule_of": "vlr", "tree": ("any", [("reversal", "early", "bullish"), ("reversal", "exact", "bearish")]), "window": 60}}, logic=("any", ["order_", "tree", "cross_", "early"])),
    f"r AS (SELECT symbol, i, back, {', '.join(f'CASE WHEN i >= {n} THEN -corr(close, i) {_O(n - 1, 0)} END AS r{k}' for k, n in ((1, 12), (2, 24), (3, 36)))} FROM c), vl AS (SELECT *, {S.lag_sql('r1')} AS p1, {S.lag_sql('r1', 2)} AS q1, {S.lag_sql('r2')} AS p2 FROM r)",
    {
        "order_": _any("vl", "r1 < r2 AND r2 < r3", 3), "tree": _any("vl", "coalesce(r1 < r2 AND r1 - p1 < -1e-9, false) OR NOT coalesce(r3 BETWEEN -0.5 AND 0.5, false)"), "cross_": _any("vl", "p1 <= p2 AND r1 > r2", 15),
        "early": _any("vl", "coalesce(p1 >= 0.7 AND p1 < 0.8 AND p1 - q1 >= -1e-9 AND r1 - p1 < -1e-9, false) OR coalesce(p1 <= -0.8 AND p1 >= -1 AND p1 - q1 <= 1e-9 AND r1 - p1 > 1e-9, false)", 60),
    },
    "order_ OR tree OR cross_ OR early",
    "VL-02 to VL-08: a tree of clauses on the correlation lines.",
)
_SEQ, _NAMES = 40, ["red_below_green", "red_below_blue", "green_below_blue"]
_explained(
    "screen_line_sequences",
    screen.Request(
        {n: {"rule_of": "vlr", "tree": t} for n, t in {
            **{w: ("sequence", w, way, _SEQ) for w, way in (("red_first", "bullish"), ("green_first", "bullish"), ("blue_first", "bearish"), ("sequential", "bullish"))},
            "crossed": ("crossed", _NAMES, 2, 12), "apart": ("within", 3, ("pair", "red_above_both")), "joined": ("all", [("within", 10, ("pair", "red_below_green")), ("within", 20, ("zone", "green", "negative"))]),
            "ordered": ("within", 2, ("preset", "order_watch")), "early": ("within", 30, ("zone", "red", "bearish_early")),
        }.items()},
        logic=("any", ["green_first", ("all", ["red_first", "sequential", "crossed", ("not", ["blue_first", "apart", "joined", "ordered", "early"])])]),
    ),
    f"r AS (SELECT symbol, i, back, {', '.join(f'CASE WHEN i >= {n} THEN -corr(close, i) {_O(n - 1, 0)} END AS r{k}' for k, n in ((1, 12), (2, 24), (3, 36)))} FROM c), vl AS (SELECT *, {', '.join(f'{S.lag_sql(x)} AS p{x[1]}' for x in ('r1', 'r2', 'r3'))} FROM r), "
    + "ev AS (SELECT symbol, " + ", ".join(f"min(CASE WHEN back <= {_SEQ} AND p{k} {'>=' if w == 'd' else '<='} 0 AND r{k} {'<' if w == 'd' else '>'} 0 THEN i END) AS {w}{k}" for w in "du" for k in (1, 2, 3)) + " FROM vl GROUP BY symbol), "
    + "cr AS (SELECT symbol, " + ", ".join(f"coalesce(bool_or(p{x} >= p{y} AND r{x} < r{y} AND back <= 12), false)::INT AS x{x}{y}" for x, y in ((1, 2), (1, 3), (2, 3))) + " FROM vl GROUP BY symbol)",
    {
        "red_first": "SELECT symbol, d1 IS NOT NULL AND (d2 IS NULL OR d1 <= d2) AND (d3 IS NULL OR d1 <= d3) AS passed FROM ev", "green_first": "SELECT symbol, d2 IS NOT NULL AND (d1 IS NULL OR d2 <= d1) AND (d3 IS NULL OR d2 <= d3) AS passed FROM ev",
        "blue_first": "SELECT symbol, u3 IS NOT NULL AND (u1 IS NULL OR u3 <= u1) AND (u2 IS NULL OR u3 <= u2) AS passed FROM ev", "sequential": "SELECT symbol, coalesce(d1 <= d2 AND d2 <= d3, false) AS passed FROM ev",
        "crossed": "SELECT symbol, x12 + x13 + x23 >= 2 AS passed FROM cr", "apart": _any("vl", "coalesce(r1 > greatest(r2, r3) AND r3 IS NOT NULL, false) AND NOT p1 > greatest(p2, p3)", 3),
        "joined": "SELECT symbol, bool_or(coalesce(p1 >= p2 AND r1 < r2, false) AND back <= 10) AND bool_or(coalesce(r2 < 0, false) AND back <= 20) AS passed FROM vl GROUP BY symbol",
        "ordered": _any("vl", "(r1 > r2 AND r2 > r3) OR (r1 < r2 AND r2 < r3)", 2), "early": _any("vl", "r1 > -0.8 AND r1 <= -0.7", 30),
    },
    "green_first OR (red_first AND sequential AND crossed AND NOT (blue_first OR apart OR joined OR ordered OR early))",
    "VL-01, VL-03, VL-07, VL-09 and VL-10: named zones, presets, pairs and the order in which lines cross zero, each within its own bars.",
)
_explained(
    "screen_waves",
    screen.Request({"wave": {"rule_of": "ema_wave", "rule": "above", "window": 5}, "spike": {"rule_of": "ema_wave", "rule": "any_spike", "cutoff": 3.0, "window": 5}, "candles": {"rule_of": "linreg_candles", "position": "above", "close": "bullish", "window": 1}, "on_": {"rule_of": "linreg_candles", "position": "on", "window": 2}}),
    f"h AS (SELECT symbol, time, i, back, (high + low + close) / 3 AS x FROM c), {S.ema_sql('e', 'h', {'a': ('x', 5), 'b': ('x', 25), 'cc': ('x', 50)})}, g AS (SELECT h.symbol, h.i, h.back, x - a AS ga, x - b AS gb, x - cc AS gc FROM h JOIN e USING (symbol, i)), "
    + f"w AS (SELECT symbol, i, back, {S.sma_sql('ga', 4)} AS wa, {S.sma_sql('gb', 4)} AS wb, {S.sma_sql('gc', 4)} AS wc FROM g), b AS (SELECT symbol, i, back, "
    + ", ".join(f"CASE WHEN i >= 11 THEN regr_intercept({x}, i) {_O(10, 0)} + regr_slope({x}, i) {_O(10, 0)} * i END AS b{x[0]}" for x in ("open", "high", "low", "close"))
    + f" FROM c), sg AS (SELECT *, {S.sma_sql('bc', 11)} AS signal FROM b)",
    {"wave": _any("w", "wa > 0 AND wb > 0 AND wc > 0", 5), "spike": _any("w", "coalesce(wb / nullif(wa, 0) > 3, false) OR coalesce(wc / nullif(wb, 0) > 3, false)", 5), "candles": f"SELECT symbol, {_age_sql('bl > signal AND bc - bo > 1e-6')} = 1 AS passed FROM sg GROUP BY symbol", "on_": f"SELECT symbol, {_age_sql('bl <= signal AND bh >= signal')} = 2 AS passed FROM sg GROUP BY symbol"},
    None,
    "RH-05, RH-06: waves and virtual candles.",
)


_explained(
    "screen_rule_options",
    screen.Request(
        {
            "hist": {"rule_of": "macd", "rule": "histogram_rising_above_zero", "window": 2}, "sinking": {"rule_of": "macd", "rule": "histogram_falling_below_zero", "window": 2}, "started": {"rule_of": "adx", "conditions": ("bullish_started",), "bars": 5}, "active": {"rule_of": "adx", "conditions": ("bearish_active", "background_bearish"), "bars": 2},
            "near": {"rule_of": "adx", "conditions": ("adx_near_plus",), "distance": 5.0, "window": 10}, "all_lines": {"rule_of": "vlr", "tree": ("both", "r1", "above"), "window": 15}, "crossings": {"rule_of": "vlr", "tree": ("crossings", 2), "window": 60},
        },
        logic=("any", ["hist", "sinking", "started", "active", "near", "all_lines", "crossings"]),
    ),
    f"{_MACD}, mh AS (SELECT *, macd - signal AS h, {S.lag_sql('macd - signal')} AS h1 FROM macd), {_ADX_BESIDE}, au AS (SELECT *, i - coalesce(max(CASE WHEN NOT (dip > dim) THEN i END) OVER (PARTITION BY symbol ORDER BY i), 0) AS run_up, i - coalesce(max(CASE WHEN NOT (dim > dip) THEN i END) OVER (PARTITION BY symbol ORDER BY i), 0) AS run_down FROM adx), "
    + f"vr AS (SELECT symbol, i, back, {', '.join(f'CASE WHEN i >= {n} THEN -corr(close, i) {_O(n - 1, 0)} END AS r{k}' for k, n in ((1, 12), (2, 24), (3, 36)))} FROM c), vo AS (SELECT *, CASE WHEN r2 IS NOT NULL OR r3 IS NOT NULL THEN coalesce(r1 > greatest(r2, r3), false) ELSE false END AS over_, {', '.join(f'{S.lag_sql(x)} AS {x}p' for x in ('r1', 'r2', 'r3'))} FROM vr), vb AS (SELECT *, {S.lag_sql('over_')} AS was, {' + '.join(f'CAST(coalesce(({x}p <= {y}p AND {x} > {y}) OR ({x}p >= {y}p AND {x} < {y}), false) AS INT)' for x, y in (('r1', 'r2'), ('r1', 'r3'), ('r2', 'r3')))} AS n FROM vo)",
    {
        "hist": _any("mh", "h > h1 AND macd > signal", 2), "sinking": _any("mh", "h < h1 AND macd < signal", 2), "started": _any("au", "run_up BETWEEN 1 AND 5"), "active": _any("au", "run_down >= 2 AND trend_value < -4"), "near": _any("au", "abs(adx - dip) <= 5", 10), "all_lines": _any("vb", "over_ AND NOT coalesce(was, true)", 15), "crossings": _any("vb", "n >= 2", 60),
    },
    "hist OR sinking OR started OR active OR near OR all_lines OR crossings",
    "AX-03 to AX-05, RH-03, VL-09: backgrounds, histogram colors, crossings of several lines.",
)


@query("screen_post_filters")
def screen_post(spark, sf_dir):
    """POST-01 and PL-03: dead trends go first, then rules, then channel respect, confluence and the trend channel; tested by parts."""
    request = screen.Request({"dead_assets": {"kinds": ("strong", "slow")}, "sma": {"length": 50, "rule": "touch", "tolerance": 50.0, "window": 10}, "channel_respect": {"least": 1}, "trend": {"direction": "up"}, "confluence": {"kind": "any", "tolerance": 20.0}})
    out = screen.explained(B.universe(spark, sf_dir), B.supplier_days(spark, sf_dir), request)
    return out.select("symbol", *[f"passed_{r}" for r in request.rules], "reason", F.concat_ws("+", "matched").alias("matched"))


@query("str_01_closed_bars", f"WITH {B.event_sql(3600)} SELECT symbol, time, open, high, low, close, volume FROM event_bars WHERE time + 3600 <= (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) - 3600 FROM events)")
def str_01(spark, sf_dir):
    """Also STR-03 to STR-05: a stream's bars, each once its window is closed; repeated events count once."""
    return stream.drained(stream.closed_bars(stream.events(spark, sf_dir)))


@query("str_08_forming_bars", f"WITH {B.event_sql(3600)} SELECT symbol, time, close, CAST(volume AS BIGINT) AS volume FROM event_bars")
def str_08(spark, sf_dir):
    """Micro-batches of partial bars, merged when read."""
    return stream.upserted_bars(stream.events(spark, sf_dir))


_TICKS = """t AS (SELECT event_type AS symbol, ts, event_id AS id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL)"""


@query(
    "str_09_machines",
    f"""WITH RECURSIVE {_TICKS}, m AS (
  SELECT symbol, i, value AS ema, value AS rma, 0.0::DOUBLE AS spread, value AS last, value AS hi, value AS lo, value AS stop, true AS up FROM t WHERE i = 1
  UNION ALL
  SELECT symbol, i, ema, rma, spread, x, CASE WHEN (x >= cand) = up THEN h ELSE x END, CASE WHEN (x >= cand) = up THEN l ELSE x END, CASE WHEN (x >= cand) = up THEN cand WHEN x >= cand THEN x - 2 * spread ELSE x + 2 * spread END, x >= cand
  FROM (SELECT *, CASE WHEN up THEN greatest(stop, h - 2 * spread) ELSE least(stop, l + 2 * spread) END AS cand
    FROM (SELECT t.symbol, t.i, t.value AS x, ema + (value - ema) * 2 / 15 AS ema, rma + (value - rma) / 14 AS rma, spread + (abs(value - last) - spread) / 14 AS spread, greatest(hi, value) AS h, least(lo, value) AS l, stop, up FROM m JOIN t ON t.symbol = m.symbol AND t.i = m.i + 1)))
SELECT symbol, CAST(i AS BIGINT) AS seen, round(ema, 6) + 0.0 AS ema, round(rma, 6) + 0.0 AS rma, round(stop, 6) + 0.0 AS stop, up FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1""",
)
def str_09(spark, sf_dir):
    """Averages and a stop carried on by a stream's keyed state over four batches, as one fold over all ticks gives them."""
    e = B.table(spark, sf_dir, "events").where("value IS NOT NULL")
    ticks = e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").cast("double").alias("value"))
    at = F.unix_seconds("ts")
    first, last = ticks.agg(F.min(at), F.max(at)).first()
    cuts = [first + (last - first) * k // 4 for k in (1, 2, 3)]
    slices = [at < cuts[0], at.between(cuts[0], cuts[1] - 1), at.between(cuts[1], cuts[2] - 1), at >= cuts[2]]
    out = machines.in_batches(ticks, slices, idle="3650 days", partitions=2 * spark.sparkContext.defaultParallelism).groupBy("symbol").agg(F.max(F.struct("seen", "ema", "rma", "stop", "up")).alias("m"))
    return out.select("symbol", "m.seen", *[(F.round(F.col(f"m.{k}"), 6) + 0.0).alias(k) for k in ("ema", "rma", "stop")], "m.up")


@query(
    "str_06_refresh_schedule",
    """WITH o AS (SELECT event_type || '-' || (user_id % 40) AS symbol, ['1h', '4h', '1day'][event_id % 3 + 1] AS timeframe, [3600, 14400, 86400][event_id % 3 + 1] AS seconds, CAST(floor(epoch(ts)) AS BIGINT) AS tm, event_id * 7 % 10 > 3 AS ok FROM events),
g AS (SELECT symbol, timeframe, max(tm) FILTER (ok) AS ok_at FROM o GROUP BY ALL),
s AS (SELECT symbol, timeframe, max(seconds) AS seconds, max(tm) AS last_at, any_value(ok_at) AS ok_at, count(*) FILTER (NOT ok AND tm > coalesce(ok_at, -1)) AS failures FROM o JOIN g USING (symbol, timeframe) GROUP BY symbol, timeframe)
SELECT symbol, timeframe, CAST(last_at AS BIGINT) AS last_at, CAST(ok_at AS BIGINT) AS ok_at, CAST(failures AS BIGINT) AS failures, CAST(CASE WHEN failures = 0 THEN (last_at // seconds + 1) * seconds + 5 ELSE last_at + greatest(300, seconds // 4) END AS BIGINT) AS next_refresh_at FROM s""",
)
def str_06(spark, sf_dir):
    """When each symbol's next refresh is due, kept in a merged table over three batches of outcomes; failures wait."""
    e, k = B.table(spark, sf_dir, "events"), F.col("event_id") % 3
    at = B.epoch(F.col("ts"))
    o = e.select(F.concat_ws("-", "event_type", F.col("user_id") % 40).alias("symbol"), F.when(k == 0, "1h").when(k == 1, "4h").otherwise("1day").alias("timeframe"), F.when(k == 0, 3600).when(k == 1, 14400).otherwise(86400).cast("long").alias("seconds"), at.alias("at"), (F.col("event_id") * 7 % 10 > 3).alias("ok"))
    first, last = o.agg(F.min("at"), F.max("at")).first()
    cuts = [first + (last - first) * k // 3 for k in (1, 2)]
    slices = [F.col("at") < cuts[0], F.col("at").between(cuts[0], cuts[1] - 1), F.col("at") >= cuts[1]]
    return schedule.refresh_schedule(o, slices).drop("seconds")
