"""Queries on series and indicators: WIN, IND, PAT and CHN."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import candles as K
from barlight.functions import series as S
from barlight.operators import channels, indicators, states, trend
from barlight.plans.registry import query
from barlight.sources import bars as B

REC = "WITH RECURSIVE "
BARS = f"{B.SUPPLIER_DAYS}, "


def days(spark, sf_dir, n: int = B.MAX_BARS) -> DataFrame:
    return B.latest(B.supplier_days(spark, sf_dir), n)


def rounded(df: DataFrame, *keep: str, digits: int = 4) -> DataFrame:
    return df.select(*keep, *[(F.round(c, digits) + 0.0).alias(c) for c in df.columns if c not in keep])


def rounded_sql(columns: dict[str, str], digits: int = 4) -> str:
    return ", ".join(f"round({v}, {digits}) + 0.0 AS {k}" for k, v in columns.items())


C120 = BARS + B.latest_sql("supplier_days", 120)
_O = lambda a, b: f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {a} PRECEDING AND {f'{b} PRECEDING' if b > 0 else f'{-b} FOLLOWING' if b < 0 else 'CURRENT ROW'})"


def _weighted_sql(x: str, weights: list[float]) -> str:
    n = len(weights)
    total = " + ".join(f"{float(w)!r}::DOUBLE * " + (S.lag_sql(x, k) if k else x) for k, w in enumerate(weights))
    return f"CASE WHEN i >= {n} THEN ({total}) / {float(sum(weights))!r}::DOUBLE END"


def _alma_weights(n: int) -> list[float]:
    import math

    return [math.exp(-((j - 0.85 * (n - 1)) ** 2) / (2 * (n / 6.0) ** 2)) for j in range(n)]


@query(
    "win_01_moving_averages",
    f"""WITH {C120} SELECT symbol, time, {rounded_sql({
        "sma": S.sma_sql("close", 20), "wma": _weighted_sql("close", list(range(9, 0, -1))), "lwma": _weighted_sql("close", list(range(1, 10))),
        "alma": _weighted_sql("close", _alma_weights(9)), "previous_average": S.sma_sql("volume", 30, 1),
        "vwma": f"CASE WHEN i >= 20 AND sum(greatest(volume, 0)) {_O(19, 0)} > 0 THEN sum(close * greatest(volume, 0)) {_O(19, 0)} / sum(greatest(volume, 0)) {_O(19, 0)} END",
        "stdev": f"CASE WHEN i >= 20 THEN stddev_pop(close) {_O(19, 0)} END"})} FROM c""",
)
def win_01(spark, sf_dir):
    c, v = F.col("close"), F.col("volume")
    out = days(spark, sf_dir, 120).select("symbol", "time", S.sma(c, 20).alias("sma"), S.wma(c, 9).alias("wma"), S.lwma(c, 9).alias("lwma"), S.alma(c, 9).alias("alma"), S.sma(v, 30, 1).alias("previous_average"), S.vwma(c, v, 20).alias("vwma"), S.stdev(c, 20).alias("stdev"))
    return rounded(out, "symbol", "time")


@query(
    "win_02_recursive_averages",
    f"""{REC}{C120},
{S.ema_sql("e", "c", {"ema": ("close", 14)})},
{S.rma_sql("r", "c", {"rma": ("close", 14)})},
{S.fold_sql("a", "c", {"total": "b.volume"}, {"total": "s.total - s.total / 11 + b.volume"})}
SELECT symbol, time, {rounded_sql({"ema": "ema", "rma": "rma", "recursive_sum": "total"})} FROM c JOIN e USING (symbol, i) JOIN r USING (symbol, i) JOIN a USING (symbol, i)""",
)
def win_02(spark, sf_dir):
    a = days(spark, sf_dir, 120).select("symbol", "time", S.ema(F.col("close"), 14).alias("ema"), S.rma(F.col("close"), 14).alias("rma"), S.recursive_sum(F.col("volume"), 11).alias("recursive_sum"))
    return rounded(a, "symbol", "time")


@query(
    "win_09_rolling_regression",
    f"""WITH {C120} SELECT symbol, time, {rounded_sql({
        "linreg": f"CASE WHEN i >= 11 THEN regr_intercept(close, i) {_O(10, 0)} + regr_slope(close, i) {_O(10, 0)} * i END",
        "linreg_ago": f"CASE WHEN i >= 11 THEN regr_intercept(close, i) {_O(10, 0)} + regr_slope(close, i) {_O(10, 0)} * (i - 2) END",
        "pearson": f"CASE WHEN i >= 12 THEN -corr(close, i) {_O(11, 0)} END"})} FROM c""",
)
def win_09(spark, sf_dir):
    c = F.col("close")
    out = days(spark, sf_dir, 120).select("symbol", "time", S.linreg(c, 11).alias("linreg"), S.linreg(c, 11, 2).alias("linreg_ago"), S.pearson(c, 12).alias("pearson"))
    return rounded(out, "symbol", "time")


@query(
    "win_12_hull_average",
    f"""WITH {C120}, d AS (SELECT symbol, time, i, 2 * ({_weighted_sql("close", list(range(4, 0, -1)))}) - ({_weighted_sql("close", list(range(9, 0, -1)))}) AS x FROM c)
SELECT symbol, time, round(CASE WHEN i >= 11 THEN (3 * x + 2 * {S.lag_sql("x")} + {S.lag_sql("x", 2)}) / 6 END, 4) AS hma FROM d""",
)
def win_12(spark, sf_dir):
    """WMA over the root of the length of twice the fast WMA less the slow one."""
    c = F.col("close")
    x = days(spark, sf_dir, 120).withColumn("x", 2 * S.wma(c, 4) - S.wma(c, 9))
    return x.select("symbol", "time", F.round(S.wma(F.col("x"), 3), 4).alias("hma"))


TR = f"CASE WHEN i = 1 THEN high - low ELSE greatest(high - low, abs(high - {S.lag_sql('close')}), abs(low - {S.lag_sql('close')})) END"


@query(
    "win_15_true_ranges",
    f"""{REC}{C120}, t AS (SELECT symbol, time, i, {TR} AS tr, high, low, volume, close FROM c),
seed AS (SELECT symbol, avg(tr) AS seed FROM t WHERE i <= 14 GROUP BY symbol), n AS (SELECT symbol, max(i) AS n FROM t GROUP BY symbol),
{S.rma_sql("r", "t", {"running": ("tr", 14)})}
SELECT symbol, time, {rounded_sql({"tr": "tr", "wilder_atr": "CASE WHEN i <= 14 AND n > 14 THEN seed ELSE running END", "strict_atr": "CASE WHEN i >= 14 THEN running END",
    "range_volatility": f"sum(CASE WHEN low <> 0 THEN (high - low) / abs(low) * 100 / 14 END) {_O(13, 0)}"})}
FROM t JOIN r USING (symbol, i) JOIN seed USING (symbol) JOIN n USING (symbol)""",
)
def win_15(spark, sf_dir):
    t = days(spark, sf_dir, 120).withColumn("tr", S.true_range())
    t = t.withColumn("range_volatility", F.sum(F.when(F.col("low") != 0, (F.col("high") - F.col("low")) / F.abs("low") * 100 / 14)).over(S.frame(-13, 0)))
    t = t.withColumns({"wilder_atr": states.backfilled_atr(F.col("tr"), 14), "strict_atr": S.seeded_rma(F.col("tr"), 14)})
    return rounded(t.select("symbol", "time", "tr", "wilder_atr", "strict_atr", "range_volatility"), "symbol", "time")


@query(
    "win_20_directions_and_crossings",
    f"""WITH {C120}, m AS (SELECT symbol, time, i, close, {S.sma_sql("close", 5)} AS fast, {S.sma_sql("close", 20)} AS slow FROM c),
l AS (SELECT *, {S.lag_sql("close")} AS c1, {S.lag_sql("close", 2)} AS c2, {S.lag_sql("close", 3)} AS c3, {S.lag_sql("fast")} AS f1, {S.lag_sql("slow")} AS s1 FROM m)
SELECT symbol, time, coalesce(close - c1 > 1e-9, false) AS rising, coalesce(close - c1 < -1e-9, false) AS falling, coalesce(c1 - c2 <= 1e-9 AND close - c1 > 1e-9, false) AS turning_up,
  coalesce(c1 - c2 >= -1e-9 AND close - c1 < -1e-9, false) AS turning_down, coalesce(f1 <= s1 AND fast > slow, false) AS crossed_above, coalesce(f1 >= s1 AND fast < slow, false) AS crossed_below,
  CASE WHEN c3 < c2 AND c2 < c1 THEN 'up' WHEN c3 > c2 AND c2 > c1 THEN 'down' END AS trend_before,
  CAST(coalesce(time - max(CASE WHEN close > c1 THEN time END) OVER (PARTITION BY symbol ORDER BY i), -1) AS BIGINT) AS seconds_since_rise FROM l""",
)
def win_20(spark, sf_dir):
    c = F.col("close")
    m = days(spark, sf_dir, 120).withColumns({"fast": S.sma(c, 5), "slow": S.sma(c, 20)})
    c1, c2, c3 = (S.back(c, k) for k in (1, 2, 3))
    trend = F.when((c3 < c2) & (c2 < c1), "up").when((c3 > c2) & (c2 > c1), "down")
    m = m.withColumns({"rise": c > c1, "trend_before": trend, **{k: S.direction(c, k) for k in ("rising", "falling", "turning_up", "turning_down")}})
    m = m.withColumns({"crossed_above": S.crossed_above(F.col("fast"), F.col("slow")), "crossed_below": S.crossed_above(F.col("slow"), F.col("fast"))})
    since = F.col("time") - F.max(F.when(F.col("rise"), F.col("time"))).over(S.by().rowsBetween(Window.unboundedPreceding, 0))
    flags = ("rising", "falling", "turning_up", "turning_down", "crossed_above", "crossed_below")
    return m.select("symbol", "time", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], "trend_before", F.coalesce(since, F.lit(-1)).alias("seconds_since_rise"))


def _pivot_sql(s: int) -> str:
    before, after = _O(s, 1), f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {s} FOLLOWING)"
    whole = f"count(*) {before} = {s} AND count(*) {after} = {s}"
    return f"({whole} AND high > max(high) {before} AND high >= max(high) {after}) AS pivot_high, ({whole} AND low < min(low) {before} AND low <= min(low) {after}) AS pivot_low"


@query("win_24_pivots", f"WITH {BARS}{B.latest_sql('supplier_days')}, p AS (SELECT symbol, time, i, high, low, {_pivot_sql(5)} FROM c) SELECT symbol, time, pivot_high, pivot_low, CAST(i + 5 AS BIGINT) AS confirmed_at FROM p WHERE pivot_high OR pivot_low")
def win_24(spark, sf_dir):
    high, low = states.pivots(5)
    p = days(spark, sf_dir).withColumns({"pivot_high": high, "pivot_low": low}).where("pivot_high OR pivot_low")
    return p.select("symbol", "time", "pivot_high", "pivot_low", (F.col("i") + 5).cast("long").alias("confirmed_at"))


@query(
    "win_26_bars_of_a_day",
    f"""WITH {B.event_sql(3600)}, r AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol, time // 86400 ORDER BY time) AS bar_of_day FROM event_bars)
SELECT symbol, time, CAST(bar_of_day AS BIGINT) AS bar_of_day, last_value(CASE WHEN bar_of_day % 4 = 1 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time) AS sampled FROM r""",
)
def win_26(spark, sf_dir):
    """The count of bars within the UTC day, and every fourth close carried forward (an as-of lookup within the series)."""
    bar = F.row_number().over(Window.partitionBy("symbol", F.floor(F.col("time") / 86400)).orderBy("time"))
    r = B.event_bars(spark, sf_dir).withColumn("bar_of_day", bar.cast("long"))
    sampled = F.last(F.when(F.col("bar_of_day") % 4 == 1, F.col("close")), ignorenulls=True).over(S.by().rowsBetween(Window.unboundedPreceding, 0))
    return r.select("symbol", "time", "bar_of_day", sampled.alias("sampled"))


@query(
    "win_34_realised_volatility",
    f"""WITH {C120}, r AS (SELECT *, close / nullif({S.lag_sql("close")}, 0) - 1 AS ret, {TR} * 100 / nullif(abs(low), 0) AS daily FROM c)
SELECT symbol, time, {rounded_sql({"daily": "daily", "realised": f"CASE WHEN count(ret) {_O(19, 0)} = 20 THEN stddev_pop(ret) {_O(19, 0)} * 100 END",
    "volume_ratio": f"CASE WHEN {S.sma_sql('volume', 30, 1)} > 0 THEN volume / ({S.sma_sql('volume', 30, 1)}) END"})},
  volume >= max(volume) {_O(9, 0)} AS highest_volume FROM r""",
)
def win_34(spark, sf_dir):
    r = days(spark, sf_dir, 120).withColumn("tr", S.true_range()).withColumns({"ret": F.try_divide("close", S.back(F.col("close"))) - 1, "daily": F.try_divide(F.col("tr") * 100, F.abs("low"))})
    before = S.sma(F.col("volume"), 30, 1)
    out = r.select("symbol", "time", "daily", (S.stdev(F.col("ret"), 20) * 100).alias("realised"), F.when(before > 0, F.col("volume") / before).alias("volume_ratio"), (F.col("volume") >= F.max("volume").over(S.frame(-9, 0))).alias("highest_volume"))
    return rounded(out, "symbol", "time", "highest_volume")


# Indicators: the last bar's values, and whether rules hold.


def last(df: DataFrame) -> DataFrame:
    return df.where("back = 1")


_MOVE = f"close - {S.lag_sql('close')}"
_RSI = f"""g AS (SELECT symbol, time, i - 1 AS i, back, greatest({_MOVE}, 0) AS gain, greatest(-({_MOVE}), 0) AS loss FROM c QUALIFY i >= 1),
{S.rma_sql("r", "g", {"up": ("gain", 14), "down": ("loss", 14)})},
rsi AS (SELECT g.symbol, g.time, g.i, g.back, CASE WHEN g.i < 14 THEN NULL WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM g JOIN r USING (symbol, i))"""


@query(
    "ind_01_rsi",
    f"""{REC}{BARS}{B.latest_sql('supplier_days', 60)}, {_RSI},
l AS (SELECT *, {S.lag_sql("rsi")} AS r1, {S.lag_sql("rsi", 2)} AS r2 FROM rsi)
SELECT symbol, round(max(CASE WHEN back = 1 THEN rsi END), 4) AS rsi,
  bool_or(back <= 3 AND rsi <= 40) AS oversold, bool_or(back <= 3 AND rsi >= 60) AS overbought, bool_or(back <= 3 AND rsi BETWEEN 20 AND 80) AS neutral,
  bool_or(back <= 3 AND coalesce(r1 - r2 <= 1e-9 AND rsi - r1 > 1e-9, false)) AS turning_up
FROM l GROUP BY symbol""",
)
def ind_01(spark, sf_dir):
    r = indicators.rsi(days(spark, sf_dir, 60), 14)
    recent = F.col("back") <= 3
    within = lambda c: F.max(recent & F.coalesce(c, F.lit(False)))
    r = r.withColumn("up", S.direction(F.col("rsi"), "turning_up"))
    return r.groupBy("symbol").agg(F.round(F.max(F.when(F.col("back") == 1, F.col("rsi"))), 4).alias("rsi"), *[within(indicators.rsi_location(F.col("rsi"), k, 10)).alias(k) for k in ("oversold", "overbought", "neutral")], within(F.col("up")).alias("turning_up"))


@query(
    "ind_02_aroon",
    f"""WITH {BARS}{B.latest_sql('supplier_days', 60)}, a AS (SELECT symbol, time, i, back, arg_max(i, row(high, -i)) {_O(14, 0)} AS hi, arg_min(i, row(low, i)) {_O(14, 0)} AS lo FROM c),
v AS (SELECT *, CASE WHEN i >= 15 THEN 100.0 * (hi - lo) / 14 END AS aroon FROM a)
SELECT symbol, round(aroon, 4) AS aroon, aroon >= 50 AS above_50, (aroon > 0 AND aroon <= 50) AS between_50_0, aroon BETWEEN -10 AND 10 AS near_0, (aroon >= -50 AND aroon < 0) AS "between_0_-50", aroon <= -50 AS "below_-50" FROM v WHERE back = 1""",
)
def ind_02(spark, sf_dir):
    a = last(days(spark, sf_dir, 60).withColumn("aroon", indicators.aroon(14)))
    return a.select("symbol", F.round("aroon", 4).alias("aroon"), *[indicators.aroon_level(F.col("aroon"), k).alias(k) for k in ("above_50", "between_50_0", "near_0", "between_0_-50", "below_-50")])


_WT = f"""h AS (SELECT symbol, time, i, back, (high + low + close) / 3 AS x FROM c), {S.ema_sql("e1", "h", {"esa": ("x", 10)})},
k AS (SELECT h.*, esa, abs(x - esa) AS gap FROM h JOIN e1 USING (symbol, i)), {S.ema_sql("e2", "k", {"d": ("gap", 10)})},
ci AS (SELECT k.symbol, k.time, k.i, k.back, CASE WHEN d > 0 THEN (x - esa) / (0.015 * d) END AS ci FROM k JOIN e2 USING (symbol, i)),
{S.fold_sql("e3", "ci", {"wt1": "b.ci"}, {"wt1": f"CASE WHEN s.wt1 IS NULL THEN b.ci ELSE {2 / 22!r}::DOUBLE * b.ci + {1 - 2 / 22!r}::DOUBLE * s.wt1 END"})},
wt AS (SELECT ci.symbol, ci.time, ci.i, ci.back, wt1 FROM ci JOIN e3 USING (symbol, i)),
w AS (SELECT *, {S.sma_sql("wt1", 4)} AS wt2 FROM wt)"""


@query(
    "ind_03_wavetrend",
    f"""{REC}{C120}, {_WT}, l AS (SELECT *, wt1 - wt2 AS hist, {S.lag_sql("wt1 - wt2")} AS h1 FROM w)
SELECT symbol, {rounded_sql({"wt1": "wt1", "wt2": "wt2"})}, wt1 <= -53 AS oversold, wt1 >= 53 AS overbought, (h1 <= 0 AND hist > 0) AS cross_up, (h1 >= 0 AND hist < 0) AS cross_down FROM l WHERE back = 1""",
)
def ind_03(spark, sf_dir):
    w = indicators.wavetrend(days(spark, sf_dir, 120)).withColumn("hist", F.col("wt1") - F.col("wt2"))
    h, h1 = F.col("hist"), S.back(F.col("hist"))
    w = w.withColumns({"oversold": F.col("wt1") <= -53, "overbought": F.col("wt1") >= 53, "cross_up": (h1 <= 0) & (h > 0), "cross_down": (h1 >= 0) & (h < 0)})
    return last(w).select("symbol", F.round("wt1", 4).alias("wt1"), F.round("wt2", 4).alias("wt2"), "oversold", "overbought", "cross_up", "cross_down")


_ADX = f"""p AS (SELECT *, coalesce({S.lag_sql("high")}, 0) AS ph, coalesce({S.lag_sql("low")}, 0) AS pl, coalesce({S.lag_sql("close")}, 0) AS pc FROM c),
m AS (SELECT symbol, time, i, back, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
        CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS plus, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS minus FROM p),
{S.fold_sql("f", "m", {"str": "b.tr", "sp": "b.plus", "sm": "b.minus"}, {"str": "s.str - s.str / 11 + b.tr", "sp": "s.sp - s.sp / 11 + b.plus", "sm": "s.sm - s.sm / 11 + b.minus"})},
di AS (SELECT m.symbol, m.i, m.back, CASE WHEN str <> 0 THEN sp / str * 100 ELSE 0 END AS dip, CASE WHEN str <> 0 THEN sm / str * 100 ELSE 0 END AS dim FROM m JOIN f USING (symbol, i)),
x AS (SELECT *, CASE WHEN dip + dim <> 0 THEN abs(dip - dim) / (dip + dim) * 100 ELSE 0 END AS dx FROM di),
adx AS (SELECT *, {S.sma_sql("dx", 11)} AS adx, dip - dim AS trend_value FROM x)"""


@query(
    "ind_04_trend_strength",
    f"""{REC}{BARS}{B.latest_sql('supplier_days', 200)}, {_ADX}
SELECT symbol, {rounded_sql({"di_plus": "dip", "di_minus": "dim", "adx": "adx"})}, dip > dim AS bullish, (adx < dip AND adx < dim) AS weak,
  CASE WHEN trend_value > 19 THEN 'top' WHEN trend_value > 10 THEN 'rising' WHEN trend_value > 4 THEN 'up' WHEN trend_value >= -4 THEN 'neutral' WHEN trend_value >= -10 THEN 'down' WHEN trend_value >= -19 THEN 'falling' ELSE 'bottom' END AS state
FROM adx WHERE back = 1""",
)
def ind_04(spark, sf_dir):
    a = last(indicators.trend_strength(days(spark, sf_dir, 200), 11))
    p, m, x = F.col("di_plus"), F.col("di_minus"), F.col("adx")
    return a.select("symbol", *[F.round(c, 4).alias(c) for c in ("di_plus", "di_minus", "adx")], (p > m).alias("bullish"), ((x < p) & (x < m)).alias("weak"), indicators.trend_state(p - m).alias("state"))


@query(
    "ind_05_correlation_lines",
    f"""WITH {C120}, r AS (SELECT symbol, i, back, {', '.join(f'CASE WHEN i >= {n} THEN -corr(close, i) {_O(n - 1, 0)} END AS r{k}' for k, n in ((1, 12), (2, 24), (3, 36)))} FROM c),
l AS (SELECT *, {S.lag_sql("r1")} AS p1, {S.lag_sql("r1", 2)} AS p2 FROM r)
SELECT symbol, {rounded_sql({"r1": "r1", "r2": "r2", "r3": "r3"})}, (r1 < r2 AND r2 < r3) AS ordered_below, (p1 BETWEEN 0.8 AND 1 AND p1 - p2 >= -1e-9 AND r1 - p1 < -1e-9) AS exact_bullish_reversal FROM l WHERE back = 1""",
)
def ind_05(spark, sf_dir):
    r = days(spark, sf_dir, 120).withColumns({f"r{k}": S.pearson(F.col("close"), n) for k, n in ((1, 12), (2, 24), (3, 36))})
    r = r.withColumn("turn", S.back(F.col("r1")).between(0.8, 1) & S.direction(F.col("r1"), "turning_down"))
    return last(r).select("symbol", *[F.round(c, 4).alias(c) for c in ("r1", "r2", "r3")], ((F.col("r1") < F.col("r2")) & (F.col("r2") < F.col("r3"))).alias("ordered_below"), F.col("turn").alias("exact_bullish_reversal"))


@query(
    "ind_06_ema_rules",
    f"""{REC}{C120}, {S.ema_sql("e", "c", {"ema": ("close", 20)})}
SELECT symbol, round(ema, 4) AS ema, close >= ema - abs(ema) * 0.01 AS above, close <= ema + abs(ema) * 0.01 AS below, abs(close - ema) <= abs(ema) * 0.01 AS touch FROM c JOIN e USING (symbol, i) WHERE back = 1""",
)
def ind_06(spark, sf_dir):
    e = last(indicators.with_ema(days(spark, sf_dir, 120), F.col("close"), {"ema": 20}))
    c, m = F.col("close"), F.col("ema")
    near = F.abs(m) * 0.01
    return e.select("symbol", F.round("ema", 4).alias("ema"), (c >= m - near).alias("above"), (c <= m + near).alias("below"), (F.abs(c - m) <= near).alias("touch"))


@query(
    "ind_07_ema_wave",
    f"""{REC}{C120}, h AS (SELECT symbol, time, i, back, (high + low + close) / 3 AS x FROM c), {S.ema_sql("e", "h", {"a": ("x", 5), "b": ("x", 25), "cc": ("x", 50)})},
g AS (SELECT h.symbol, h.i, h.back, x - a AS ga, x - b AS gb, x - cc AS gc FROM h JOIN e USING (symbol, i)),
w AS (SELECT symbol, i, back, {S.sma_sql("ga", 4)} AS wa, {S.sma_sql("gb", 4)} AS wb, {S.sma_sql("gc", 4)} AS wc FROM g)
SELECT symbol, {rounded_sql({"wa": "wa", "wb": "wb", "wc": "wc"})}, coalesce(wc / nullif(wb, 0) > 1.5, false) AS wave_c_spike, coalesce(wb / nullif(wa, 0) > 1.5, false) AS wave_b_spike FROM w WHERE back = 1""",
)
def ind_07(spark, sf_dir):
    w = last(indicators.ema_wave(days(spark, sf_dir, 120)))
    spike = lambda a, b: F.coalesce(F.try_divide(a, b) > 1.5, F.lit(False))
    return w.select("symbol", *[F.round(c, 4).alias(c) for c in ("wa", "wb", "wc")], spike("wc", "wb").alias("wave_c_spike"), spike("wb", "wa").alias("wave_b_spike"))


_MACD = f"""{S.ema_sql("e", "c", {"fast": ("close", 12), "slow": ("close", 26)})},
m AS (SELECT c.symbol, c.i, c.back, fast - slow AS macd FROM c JOIN e USING (symbol, i)),
s AS (SELECT *, {S.sma_sql("macd", 9)} AS signal FROM m), macd AS (SELECT *, {S.lag_sql("macd")} AS m1, {S.lag_sql("signal")} AS s1, greatest(abs(macd), abs(signal)) * 0.01 AS near FROM s)"""


@query(
    "ind_08_macd",
    f"""{REC}{BARS}{B.latest_sql('supplier_days', 200)}, {_MACD}
SELECT symbol, {rounded_sql({"macd": "macd", "signal": "signal", "histogram": "macd - signal"})}, macd > 0 AS above_zero, macd > signal AS above_signal,
  (m1 <= s1 + near AND macd > signal - near) AS bullish_cross, (m1 >= s1 - near AND macd < signal + near) AS bearish_cross FROM macd WHERE back = 1""",
)
def ind_08(spark, sf_dir):
    m = indicators.macd(days(spark, sf_dir, 200))
    a, s = F.col("macd"), F.col("signal")
    near = F.greatest(F.abs(a), F.abs(s)) * 0.01
    m = m.withColumns({"bullish_cross": (S.back(a) <= S.back(s) + near) & (a > s - near), "bearish_cross": (S.back(a) >= S.back(s) - near) & (a < s + near)})
    return last(m).select("symbol", F.round("macd", 4).alias("macd"), F.round("signal", 4).alias("signal"), F.round(a - s, 4).alias("histogram"), (a > 0).alias("above_zero"), (a > s).alias("above_signal"), "bullish_cross", "bearish_cross")


@query(
    "ind_09_volume_spikes",
    f"""WITH {BARS}{B.latest_sql('supplier_days')}, v AS (SELECT *, volume > 1.2 * ({S.sma_sql("volume", 20)}) AS big, {S.lag_sql("high")} AS h1, {S.lag_sql("low")} AS l1, lead(high) OVER (PARTITION BY symbol ORDER BY i) AS hn, lead(low) OVER (PARTITION BY symbol ORDER BY i) AS ln, (high + low) / 2 AS mid FROM c),
r AS (SELECT symbol, i + 1 AS i, coalesce(big AND high > h1 AND high > hn AND open < mid AND close < mid, false) AS bearish, coalesce(big AND low < l1 AND low < ln AND open > mid AND close > mid, false) AS bullish FROM v WHERE i >= 2 AND hn IS NOT NULL)
SELECT symbol, CAST(count(*) FILTER (bullish) AS BIGINT) AS bullish, CAST(count(*) FILTER (bearish) AS BIGINT) AS bearish, CAST(coalesce(max(CASE WHEN bullish OR bearish THEN i END), 0) AS BIGINT) AS latest FROM r GROUP BY symbol""",
)
def ind_09(spark, sf_dir):
    r = indicators.volume_spikes(days(spark, sf_dir), 20, 1.2)
    return r.where("i >= 3").groupBy("symbol").agg(F.count(F.when(F.col("bullish"), 1)).alias("bullish"), F.count(F.when(F.col("bearish"), 1)).alias("bearish"), F.coalesce(F.max(F.when(F.col("bullish") | F.col("bearish"), F.col("i"))), F.lit(0)).cast("long").alias("latest"))


@query(
    "ind_10_relative_volume",
    f"""WITH {C120}, v AS (SELECT *, CASE WHEN {S.sma_sql("volume", 30, 1)} > 0 THEN volume / ({S.sma_sql("volume", 30, 1)}) END AS rvol, CASE WHEN i >= 50 THEN regr_intercept(volume, i) {_O(49, 0)} + regr_slope(volume, i) {_O(49, 0)} * i END AS ma2, CASE WHEN i >= 21 THEN stddev_pop(volume) {_O(20, 0)} END AS sd FROM c),
l AS (SELECT *, {S.lag_sql("rvol")} AS p FROM v)
SELECT symbol, round(rvol, 4) AS rvol, rvol >= 1.5 AS above, rvol <= 0.5 AS below, (p <= 1 AND rvol > 1) AS crossed_above, volume - ma2 > sd AS anomaly FROM l WHERE back = 1""",
)
def ind_10(spark, sf_dir):
    v = indicators.relative_volume(days(spark, sf_dir, 120))
    v = v.withColumn("crossed_above", S.crossed_above(F.col("rvol"), F.lit(1.0)))
    return last(v).select("symbol", F.round("rvol", 4).alias("rvol"), (F.col("rvol") >= 1.5).alias("above"), (F.col("rvol") <= 0.5).alias("below"), "crossed_above", (F.col("volume") - F.col("ma2") > F.col("sd21")).alias("anomaly"))


@query("ind_11_current_volume", f"""WITH {C120} SELECT symbol, volume, CAST(floor(100 * volume / ({S.sma_sql("volume", 30)}) + 0.5) AS BIGINT) AS percent, volume > ({S.sma_sql("volume", 30)}) AS above_average FROM c QUALIFY back = 1""")
def ind_11(spark, sf_dir):
    v = days(spark, sf_dir, 120).withColumn("mean", S.sma(F.col("volume"), 30))
    return last(v).select("symbol", "volume", F.floor(F.try_divide(100 * F.col("volume"), F.col("mean")) + 0.5).alias("percent"), (F.col("volume") > F.col("mean")).alias("above_average"))


@query(
    "ind_12_volatility",
    f"""WITH {C120}, r AS (SELECT *, close / nullif({S.lag_sql("close")}, 0) - 1 AS ret FROM c), v AS (SELECT *, sum(CASE WHEN low <> 0 THEN (high - low) / abs(low) * 100 / 14 END) {_O(13, 0)} AS range_avg, CASE WHEN count(ret) {_O(19, 0)} = 20 THEN stddev_pop(ret) {_O(19, 0)} * 100 END AS realised FROM r)
SELECT symbol, {rounded_sql({"range_avg": "range_avg", "realised": "realised"})}, range_avg BETWEEN 10 AND 200 AS range_ok, realised BETWEEN 1 AND 1000 AS realised_ok FROM v WHERE back = 1""",
)
def ind_12(spark, sf_dir):
    v = last(indicators.volatility(days(spark, sf_dir, 120)))
    return v.select("symbol", F.round("range_avg", 4).alias("range_avg"), F.round("realised", 4).alias("realised"), F.col("range_avg").between(10, 200).alias("range_ok"), F.col("realised").between(1, 1000).alias("realised_ok"))


@query(
    "ind_13_volatility_stop",
    f"""{REC}{C120}, t AS (SELECT symbol, i, back, close AS x, {TR} AS tr FROM c), {S.rma_sql("r", "t", {"running": ("tr", 20)})},
d AS (SELECT t.symbol, t.i, t.back, x, CASE WHEN t.i >= 20 THEN running * 2.0 ELSE tr END AS d FROM t JOIN r USING (symbol, i)),
v AS (SELECT symbol, i, x AS hi, x AS lo, x AS stop, true AS up FROM d WHERE i = 1
  UNION ALL
  SELECT symbol, i, CASE WHEN now = up THEN hi ELSE x END, CASE WHEN now = up THEN lo ELSE x END, CASE WHEN now = up THEN cand WHEN now THEN x - d ELSE x + d END, now
  FROM (SELECT *, x >= cand AS now FROM (SELECT d.symbol, d.i, d.x, d.d, v.up, greatest(v.hi, d.x) AS hi, least(v.lo, d.x) AS lo,
          CASE WHEN v.up THEN greatest(v.stop, greatest(v.hi, d.x) - d.d) ELSE least(v.stop, least(v.lo, d.x) + d.d) END AS cand FROM v JOIN d ON d.symbol = v.symbol AND d.i = v.i + 1)))
SELECT symbol, round(v.stop, 4) AS stop, v.up, x > v.stop AS price_above FROM v JOIN d USING (symbol, i) WHERE back = 1""",
)
def ind_13(spark, sf_dir):
    v = last(states.volatility_stop(days(spark, sf_dir, 120), 20, 2.0))
    return v.select("symbol", F.round("stop", 4).alias("stop"), "up", (F.col("close") > F.col("stop")).alias("price_above"))


def _lr(x: str) -> str:
    return f"CASE WHEN i >= 11 THEN regr_intercept({x}, i) {_O(10, 0)} + regr_slope({x}, i) {_O(10, 0)} * i END"


@query(
    "ind_14_regression_candles",
    f"""WITH {C120}, b AS (SELECT symbol, i, back, {_lr("open")} AS bo, {_lr("high")} AS bh, {_lr("low")} AS bl, {_lr("close")} AS bc FROM c), s AS (SELECT *, {S.sma_sql("bc", 11)} AS signal FROM b)
SELECT symbol, {rounded_sql({"bo": "bo", "bc": "bc", "signal": "signal"})}, bl > signal AS above, bh < signal AS below, (bl <= signal AND bh >= signal) AS on_line, bc - bo > 1e-6 AS bullish,
  CAST((SELECT coalesce(min(y.back), 121) - 1 FROM s y WHERE y.symbol = s.symbol AND NOT coalesce(y.bl > y.signal, false)) AS BIGINT) AS age_above FROM s WHERE back = 1""",
)
def ind_14(spark, sf_dir):
    b = indicators.regression_candles(days(spark, sf_dir, 120))
    b = b.withColumn("above", F.coalesce(F.col("bl") > F.col("signal"), F.lit(False)))
    age = b.groupBy("symbol").agg((F.coalesce(F.min(F.when(~F.col("above"), F.col("back"))), F.lit(121)) - 1).cast("long").alias("age_above"), *[F.max(F.when(F.col("back") == 1, F.col(c))).alias(c) for c in ("bo", "bh", "bl", "bc", "signal")])
    s = F.col("signal")
    return age.select("symbol", *[F.round(c, 4).alias(c) for c in ("bo", "bc", "signal")], (F.col("bl") > s).alias("above"), (F.col("bh") < s).alias("below"), ((F.col("bl") <= s) & (F.col("bh") >= s)).alias("on_line"), (F.col("bc") - F.col("bo") > 1e-6).alias("bullish"), "age_above")


_LRC = """l AS (SELECT *, regr_slope(close, i) OVER w AS slope, regr_intercept(close, i) OVER w AS icpt, var_pop(close) OVER w AS var, corr(close, i) OVER w AS r FROM c WINDOW w AS (PARTITION BY symbol)),
lrc AS (SELECT *, icpt + slope * i AS middle, sqrt(greatest(var * (1 - r * r), 0) + slope * slope) AS dev FROM l)"""


@query(
    "ind_15_regression_channel",
    f"""WITH {BARS}{B.latest_sql('supplier_days', 100)}, {_LRC}
SELECT symbol, {rounded_sql({"r": "r", "middle": "middle", "upper": "middle + 2 * dev", "lower": "middle - 2 * dev"})}, abs(r) >= 0.7 AS strong, close > middle AS close_above FROM lrc WHERE back = 1""",
)
def ind_15(spark, sf_dir):
    c = last(channels.regression(days(spark, sf_dir, 100)))
    return c.select("symbol", *[F.round(x, 4).alias(x) for x in ("r", "middle", "upper", "lower")], (F.abs("r") >= 0.7).alias("strong"), (F.col("close") > F.col("middle")).alias("close_above"))


def _filled(x: str, n: int) -> str:
    return f"(sum({x}) {_O(n - 1, 0)} + greatest({n} - i, 0) * {x}) / {n}"


@query(
    "ind_16_weighted_channel",
    f"""WITH {BARS}{B.latest_sql('supplier_days', 100)}, f AS (SELECT *, {_filled("close", 20)} AS f FROM c), d AS (SELECT *, close - f AS dev FROM f),
g AS (SELECT *, {_filled("dev", 20)} AS mean, sqrt({_filled("dev * dev", 20)}) AS sd FROM d),
z AS (SELECT symbol, i, back, close, f + mean AS middle, mean / 10 AS slope, sd FROM g), y AS (SELECT symbol, max(i) AS n, max(CASE WHEN back = 1 THEN middle END) AS m, max(CASE WHEN back = 1 THEN slope END) AS s, max(CASE WHEN back = 1 THEN sd END) AS d FROM z GROUP BY symbol)
SELECT symbol, i, {rounded_sql({"middle": "m - s * (n - i)", "upper": "m - s * (n - i) + d", "lower": "m - s * (n - i) - d", "q1": "m - s * (n - i) - d / 2", "q3": "m - s * (n - i) + d / 2"})} FROM z JOIN y USING (symbol) WHERE back <= 20""",
)
def ind_16(spark, sf_dir):
    c = channels.weighted(days(spark, sf_dir, 100), 20).where("back <= 20")
    return c.select("symbol", F.col("i").cast("long").alias("i"), *[F.round(x, 4).alias(x) for x in ("middle", "upper", "lower", "q1", "q3")])


@query("ind_17_trend_channel")
def ind_17(spark, sf_dir):
    """The latest channel of pivots of each symbol, with its lines at the last bar; a state machine, tested by its rules."""
    return trend.trend(days(spark, sf_dir), 8, mintick=0.01)


@query("ind_18_float", f"""WITH {B.UNIVERSE} SELECT symbol, shares_outstanding, coalesce(shares_outstanding BETWEEN 1000 * 0.95 AND 6000 * 1.05, false) AS passed FROM universe""")
def ind_18(spark, sf_dir):
    s = F.col("shares_outstanding")
    return B.universe(spark, sf_dir).select("symbol", "shares_outstanding", indicators.within(s, 1000.0, 6000.0, 5.0).alias("passed"))


@query(
    "ind_19_stochastic_rsi",
    f"""{REC}{BARS}{B.latest_sql('supplier_days', 60)}, {_RSI},
k AS (SELECT *, CASE WHEN i >= 27 AND max(rsi) {_O(13, 0)} > min(rsi) {_O(13, 0)} THEN 100 * (rsi - min(rsi) {_O(13, 0)}) / (max(rsi) {_O(13, 0)} - min(rsi) {_O(13, 0)}) END AS raw FROM rsi),
s AS (SELECT *, {S.sma_sql("raw", 3)} AS k FROM k), d AS (SELECT *, {S.sma_sql("k", 3)} AS d FROM s)
SELECT symbol, {rounded_sql({"k": "k", "d": "d"})}, k <= 20 AS oversold, k >= 80 AS overbought FROM d WHERE back = 1""",
)
def ind_19(spark, sf_dir):
    s = last(indicators.stochastic_rsi(days(spark, sf_dir, 60)))
    return s.select("symbol", F.round("k", 4).alias("k"), F.round("d", 4).alias("d"), (F.col("k") <= 20).alias("oversold"), (F.col("k") >= 80).alias("overbought"))


def _pattern_sql() -> dict[str, str]:
    one, two = ("o1", "h1", "l1", "c1"), ("o2", "h2", "l2", "c2")
    up = lambda b: f"{b[3]} > {b[0]}"
    down = lambda b: f"{b[3]} < {b[0]}"
    now = ("open", "high", "low", "close")
    body, rng = "abs(close - open)", "greatest(high - low, 1e-9)"
    upper, lower = "(high - greatest(open, close))", "(least(open, close) - low)"
    low_pin = f"{lower} >= {body} * 2 AND {upper} <= greatest({body}, {rng} * 0.15)"
    high_pin = f"{upper} >= {body} * 2 AND {lower} <= greatest({body}, {rng} * 0.15)"
    fell, rose = "c3 > c2 AND c2 > c1", "c3 < c2 AND c2 < c1"
    pause, near = "abs(c1 - o1) <= greatest(h1 - l1, 1e-9) * 0.35", "close * 0.001"
    return {
        "bullish_engulfing": f"{down(one)} AND {up(now)} AND open <= c1 AND close >= o1", "bearish_engulfing": f"{up(one)} AND {down(now)} AND open >= c1 AND close <= o1",
        "piercing_line": f"{down(one)} AND {up(now)} AND open < l1 AND close > (o1 + c1) / 2 AND close < o1", "dark_cloud_cover": f"{up(one)} AND {down(now)} AND open > h1 AND close < (o1 + c1) / 2 AND close > o1",
        "tweezer_bottom": f"abs(low - l1) <= {near} AND {up(now)}", "tweezer_top": f"abs(high - h1) <= {near} AND {down(now)}",
        "morning_star": f"{down(two)} AND {pause} AND {up(now)} AND close > (o2 + c2) / 2", "evening_star": f"{up(two)} AND {pause} AND {down(now)} AND close < (o2 + c2) / 2",
        "three_white_soldiers": f"{up(two)} AND {up(one)} AND {up(now)} AND c2 < c1 AND c1 < close", "three_black_crows": f"{down(two)} AND {down(one)} AND {down(now)} AND c2 > c1 AND c1 > close",
        "double_bottom": f"abs(l2 - low) <= {near} AND h1 > greatest(l2, low) + {near}", "double_top": f"abs(h2 - high) <= {near} AND l1 < least(h2, high) - {near}",
        "doji": f"{body} <= {rng} * 0.1", "bullish_pin_bar": low_pin, "bearish_pin_bar": high_pin, "hammer": f"{low_pin} AND {fell}", "shooting_star": f"{high_pin} AND {rose}", "inverted_hammer": f"{high_pin} AND {fell}",
        "bullish_marubozu": f"{body} / {rng} >= 0.85 AND {up(now)}", "bearish_marubozu": f"{body} / {rng} >= 0.85 AND {down(now)}",
        "strong_breakout_candle": f"{body} / {rng} >= 0.7 AND {up(now)} AND {upper} <= {rng} * 0.15", "strong_breakdown_candle": f"{body} / {rng} >= 0.7 AND {down(now)} AND {lower} <= {rng} * 0.15",
    }


_PAT = f"""q AS (SELECT *, {', '.join(f'{S.lag_sql(x, k)} AS {x[0]}{k}' for x in ('open', 'high', 'low', 'close') for k in (1, 2, 3))} FROM c),
p AS (SELECT *, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _pattern_sql().items())} FROM q)"""


@query("pat_01_patterns", f"WITH {C120}, {_PAT} SELECT symbol, time, {', '.join(_pattern_sql())} FROM p")
def pat_01(spark, sf_dir):
    return K.with_patterns(days(spark, sf_dir, 120)).select("symbol", "time", *K.patterns())


@query(
    "pat_03_confirmations",
    f"""WITH {C120}, {_PAT}, m AS (SELECT symbol, time, i, close > open OR {' OR '.join(K.FAMILIES['bullish'])} AS bullish, (close < open AND abs(close - open) > greatest(high - low, 1e-9) * 0.6) OR {' OR '.join(K.FAMILIES['strong_bearish'])} AS strong_bearish FROM p)
SELECT symbol, time, bool_or(bullish) OVER w AS bullish, bool_or(strong_bearish) OVER w AS strong_bearish FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""",
)
def pat_03(spark, sf_dir):
    """Also JN-11: a look-ahead frame in place of an interval join."""
    p = K.with_patterns(days(spark, sf_dir, 120))
    p = p.select("symbol", "time", K.matches("bullish").alias("b"), K.matches("strong_bearish").alias("s"))
    return p.select("symbol", "time", K.confirmed(F.col("b"), 2).alias("bullish"), K.confirmed(F.col("s"), 2).alias("strong_bearish"))


def _touch_sql(lo: str, hi: str, way: str | None = None) -> dict[str, str]:
    top, bottom = "greatest(open, close)", "least(open, close)"
    mid = f"({lo} + {hi}) / 2"
    a = f" AND {top} <= {mid}" if way == "up" else ""
    b = f" AND {bottom} >= {mid}" if way == "down" else ""
    upper = f"(high > {top} AND {top} <= {hi} AND high >= {lo}{a})"
    lower = f"(low < {bottom} AND low <= {hi} AND {bottom} >= {lo}{b})"
    return {"wick": {"up": upper, "down": lower}.get(way, f"({upper} OR {lower})"), "body": f"({bottom} <= {hi} AND {top} >= {lo}{a}{b})"}


@query(
    "tch_01_touches",
    f"""WITH {C120}, t AS (SELECT *, ({S.sma_sql("close", 20)}) * 0.98 AS lo, ({S.sma_sql("close", 20)}) * 1.02 AS hi FROM c)
SELECT symbol, time, {_touch_sql("lo", "hi")["wick"]} AS wick, {_touch_sql("lo", "hi")["body"]} AS body, {_touch_sql("lo", "hi", "up")["wick"]} AS wick_up, {_touch_sql("lo", "hi", "down")["body"]} AS body_down FROM t WHERE lo IS NOT NULL""",
)
def tch_01(spark, sf_dir):
    m = S.sma(F.col("close"), 20)
    t = days(spark, sf_dir, 120).withColumns({"lo": m * 0.98, "hi": m * 1.02}).where("lo IS NOT NULL")
    lo, hi = F.col("lo"), F.col("hi")
    return t.select("symbol", "time", K.touch(lo, hi).alias("wick"), K.touch(lo, hi, "body").alias("body"), K.touch(lo, hi, "wick", "up").alias("wick_up"), K.touch(lo, hi, "body", "down").alias("body_down"))


def _age_sql(match: str, n: int = 100) -> str:
    return f"coalesce(min(CASE WHEN NOT coalesce({match}, false) THEN back END), max(back) + 1) - 1"


@query(
    "chn_04_line_rules",
    f"""WITH {BARS}{B.latest_sql('supplier_days', 100)}, {_LRC}, x AS (SELECT *, floor(middle / 0.01 + 0.5) * 0.01 AS m FROM lrc), b AS (SELECT *, m - abs(m) * 0.01 AS lo, m + abs(m) * 0.01 AS hi FROM x)
SELECT symbol, {', '.join(f'CAST({_age_sql(v)} AS BIGINT) AS {k}' for k, v in {"touch": _touch_sql("lo", "hi")["wick"], "close_above": "close > hi", "close_below": "close < lo", "stay_above": "low > lo", "stay_below": "high < hi"}.items())} FROM b GROUP BY symbol""",
)
def chn_04(spark, sf_dir):
    """How long, up to the last bar, each action on the channel's middle line has held; a rule asks for an exact age."""
    c = channels.regression(days(spark, sf_dir, 100))
    return c.groupBy("symbol").agg(*[channels.age(channels.action("middle", a, 1.0, 0.01)).alias(a) for a in channels.ACTIONS])


@query(
    "chn_06_line_actions",
    f"""WITH {C120}, t AS (SELECT *, {S.sma_sql("close", 20)} AS line, {S.lag_sql("close")} AS before FROM c)
SELECT symbol, time, low <= line AND high >= line AS touched, close > line AS closed_above, close < line AS closed_below, abs(close - line) <= abs(line) * 0.01 AS on_line, (low < line AND high > line) AS breach FROM t WHERE line IS NOT NULL""",
)
def chn_06(spark, sf_dir):
    t = days(spark, sf_dir, 120).withColumn("line", S.sma(F.col("close"), 20)).where("line IS NOT NULL")
    x = F.col("line")
    return t.select("symbol", "time", ((F.col("low") <= x) & (F.col("high") >= x)).alias("touched"), (F.col("close") > x).alias("closed_above"), (F.col("close") < x).alias("closed_below"), (F.abs(F.col("close") - x) <= F.abs(x) * 0.01).alias("on_line"), ((F.col("low") < x) & (F.col("high") > x)).alias("breach"))
