"""Queries on scalars, configurations and checks: SC, PL, VAL and the small rows of FLT, JN, LIM and SNK."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.functions import scalars as X
from barlight.functions import series as S
from barlight.operators import channels, filters, indicators, states, trend
from barlight.operators import relational as R
from barlight.plans import screen
from barlight.plans.features import _MACD, _RSI, BARS, REC, _O, _alma_weights, _filled, _pivot_sql, _weighted_sql, days, rounded, rounded_sql
from barlight.plans.registry import query
from barlight.sources import bars as B
from barlight.sources import shared

_RAW = "CASE id % 8 WHEN 0 THEN ' x:c' || id || 'usd' WHEN 1 THEN 'C' || id || '/USD' WHEN 2 THEN 'c' || id || '-USD' WHEN 3 THEN 'c-' || id || '_usd' WHEN 4 THEN 'C' || id || ':USD' WHEN 5 THEN '-usd' WHEN 6 THEN 'C' || id || '-USDT' ELSE 's' || id || ' ' END"


def _symbols(spark, sf_dir):
    k = F.col("p_partkey")
    forms = [F.concat(F.lit(" x:c"), k, F.lit("usd")), F.concat(F.lit("C"), k, F.lit("/USD")), F.concat(F.lit("c"), k, F.lit("-USD")), F.concat(F.lit("c-"), k, F.lit("_usd")), F.concat(F.lit("C"), k, F.lit(":USD")), F.lit("-usd"), F.concat(F.lit("C"), k, F.lit("-USDT")), F.concat(F.lit("s"), k, F.lit(" "))]
    return B.table(spark, sf_dir, "part").select(k.alias("id"), F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("raw"), "p_type", "p_brand", "p_retailprice")


@query(
    "sc_02_provider_symbols",
    f"""WITH p AS (SELECT p_partkey AS id FROM part), r AS (SELECT id, {_RAW} AS raw FROM p), u AS (SELECT *, upper(trim(raw)) AS s FROM r),
b AS (SELECT *, regexp_replace(CASE WHEN s LIKE 'X:_%USD' THEN s[3:-4] ELSE regexp_replace(s, '[-/_:]USD$', '') END, '[^A-Z0-9]', '', 'g') AS base FROM u)
SELECT id, CASE WHEN base = '' THEN '' ELSE 'X:' || base || 'USD' END AS crypto, raw LIKE '%-USD' AS is_crypto,
  CASE WHEN raw LIKE '%-USD' THEN 'X:' || upper(trim(replace(raw[:-5], '-', ''))) || 'USD' ELSE s END AS stock,
  CASE WHEN s LIKE '%-USD' THEN replace(s[:-5], '-', '') || 'USDT' ELSE replace(s, '-', '') END AS coin,
  replace(CASE WHEN s LIKE '%-USD' THEN s[:-5] WHEN s LIKE '%-USDT' THEN s[:-6] ELSE s END, '-', '') AS base, CASE WHEN raw LIKE '%-USD' THEN 'crypto' ELSE 'stocks' END AS provider FROM b""",
)
def sc_02(spark, sf_dir):
    """Also SC-03 and PL-13: what providers call a symbol, and which provider has it."""
    x = F.col("raw")
    return _symbols(spark, sf_dir).select("id", X.provider_crypto(x).alias("crypto"), X.is_crypto(x).alias("is_crypto"), X.stock_provider_symbol(x).alias("stock"), X.coin_provider_symbol(x).alias("coin"), X.coin_base(x).alias("base"), X.provider(x).alias("provider"))


@query(
    "sc_04_tokens",
    """WITH p AS (SELECT p_partkey AS id, ' ' || p_type || '-x ' AS t, CASE p_partkey % 7 WHEN 0 THEN ' xnas' WHEN 1 THEN 'NYSE' WHEN 2 THEN 'XASE ' WHEN 3 THEN 'amex' WHEN 4 THEN 'XLON' WHEN 5 THEN NULL ELSE 'xnys' END AS mic, CASE p_partkey % 4 WHEN 0 THEN 'sp500' WHEN 1 THEN 'Dow Jones' WHEN 2 THEN 'russell-2000' ELSE 'mid_cap_x' END AS cat FROM part)
SELECT id, replace(replace(lower(trim(t)), ' ', '_'), '-', '_') AS token, upper(trim(t)) AS symbol, CASE upper(trim(mic)) WHEN 'XNAS' THEN 'nasdaq' WHEN 'NYSE' THEN 'nyse' WHEN 'XNYS' THEN 'nyse' WHEN 'XASE' THEN 'amex' WHEN 'AMEX' THEN 'amex' END AS exchange_group,
  CASE id % 4 WHEN 0 THEN 'S&P 500' WHEN 1 THEN 'Dow Jones' WHEN 2 THEN 'Russell 2000' ELSE 'Mid Cap X' END AS label,
  array_to_string(CASE WHEN id % 3 = 0 THEN list_sort(list_distinct(list_filter([lower(trim(mic)), 'a', 'b'], lambda v: v IS NOT NULL))) WHEN mic IS NOT NULL THEN [lower(trim(mic))] ELSE [] END, ',') AS exchanges FROM p""",
)
def sc_04(spark, sf_dir):
    """Also SC-06, SC-07, PL-06 and PL-07: tokens, exchange groups, labels, and an item's exchanges."""
    k = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    p = B.table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit(" "), "p_type", F.lit("-x ")).alias("t"), pick(" xnas", "NYSE", "XASE ", "amex", "XLON", None, "xnys").alias("mic"), pick("sp500", "Dow Jones", "russell-2000", "mid_cap_x").alias("cat"))
    many = F.when(F.col("id") % 3 == 0, F.array("mic", F.lit("B "), F.lit("a"), F.lit("A"), F.lit("")))
    return p.select("id", X.token(F.col("t")).alias("token"), X.symbol(F.col("t")).alias("symbol"), X.exchange_group(F.col("mic")).alias("exchange_group"), X.category_label(F.col("cat")).alias("label"), F.array_join(X.availability(many, F.col("mic")), ",").alias("exchanges"))


@query(
    "sc_09_stickers",
    """WITH p AS (SELECT p_partkey AS id, p_retailprice - 1500 AS x, p_partkey % 4 AS w FROM part), h AS (SELECT *, CAST(floor(abs(x) * 100 + 0.5) AS BIGINT) AS n FROM p)
SELECT id, CASE WHEN x < 0 THEN '-' ELSE '+' END || (n // 100) || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS decimal,
  'RSI' || CASE WHEN id % 2 = 0 THEN ' (14)' ELSE '' END || CASE WHEN id % 3 = 0 THEN ' | Oversold' ELSE '' END || ' | Below 30 | ' || CASE WHEN id % 5 = 0 THEN 'Bullish Engulfing' WHEN id % 5 = 1 THEN 'Strong Bullish' ELSE 'No Pattern' END || ' | Last ' || greatest(w, 1) || CASE WHEN w <= 1 THEN ' Candle' ELSE ' Candles' END AS sticker FROM h""",
)
def sc_09(spark, sf_dir):
    """Also SC-08 and SC-10: signed decimals, and stickers of what a rule found."""
    k = F.col("p_partkey")
    pattern = X.pattern_label(k % 5 < 2, F.array(F.lit("strong_bullish")), F.when(k % 5 == 0, F.array(F.lit("bullish_engulfing"))))
    text = X.sticker(F.lit("RSI"), F.when(k % 2 == 0, F.lit(14)), F.when(k % 3 == 0, "Oversold").otherwise(""), F.lit("Below 30"), pattern, k % 4)
    return B.table(spark, sf_dir, "part").select(k.alias("id"), X.decimal(F.col("p_retailprice") - 1500, 2, True).alias("decimal"), text.alias("sticker"))


@query(
    "sc_17_sessions",
    """WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, timezone('America/New_York', timezone('UTC', ts)) AS local FROM events), d AS (SELECT *, CAST(local AS DATE) AS today FROM e),
s AS (SELECT *, CASE WHEN isodow(today) <= 5 AND hour(local) >= 16 THEN today ELSE today - 1 END AS near FROM d), l AS (SELECT *, near - greatest(isodow(near) - 5, 0)::INT AS last FROM s)
SELECT event_id, CAST(last AS VARCHAR) AS last_session, CAST(last - CASE WHEN isodow(last) = 1 THEN 3 ELSE 1 END AS VARCHAR) AS before, CAST(last - 7 AS VARCHAR) AS five_back,
  (hour(make_timestamp(t * 1000000)) * 60 + minute(make_timestamp(t * 1000000)) + 120) % 1440 >= 1320 OR (hour(make_timestamp(t * 1000000)) * 60 + minute(make_timestamp(t * 1000000)) + 120) % 1440 < 60 AS at_night FROM l""",
)
def sc_17(spark, sf_dir):
    """Also SC-18, PL-09 and PL-10: the last session that is over, the weekdays before it, and hours that run past midnight."""
    e = B.table(spark, sf_dir, "events").select("event_id", B.epoch(F.col("ts")).alias("t"))
    e = e.withColumn("last", X.last_session(F.col("t"))).withColumn("days", X.weekdays_back(F.col("last"), 6))
    day = lambda k: F.element_at("days", k).cast("string")
    return e.select("event_id", day(1).alias("last_session"), day(2).alias("before"), day(6).alias("five_back"), X.in_hours(F.col("t"), "2200-0100", 120).alias("at_night"))


@query(
    "sc_19_timestamps",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS utc FROM events""",
)
def sc_19(spark, sf_dir):
    """Timestamps with Z, with an offset, dates, and text that is none."""
    e = B.table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(text, F.lit("Z"))).when(k == 1, F.concat(text, F.lit("+02:00"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon")
    return e.select("event_id", X.canonical_utc(said).alias("utc"))


@query(
    "sc_25_last_values",
    f"WITH {BARS}{B.latest_sql('supplier_days', 60)}, v AS (SELECT *, CASE WHEN volume > 25 THEN close END AS x FROM c), r AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS k FROM v WHERE x IS NOT NULL) SELECT symbol, max(CASE WHEN k = 1 THEN x END) AS last, max(CASE WHEN k = 2 THEN x END) AS previous FROM r GROUP BY symbol",
)
def sc_25(spark, sf_dir):
    """The last and the one before of the values that are there."""
    v = days(spark, sf_dir, 60).withColumn("x", F.when(F.col("volume") > 25, F.col("close"))).where("x IS NOT NULL")
    at = F.sort_array(F.collect_list(F.struct("i", "x")), asc=False)
    return v.groupBy("symbol").agg(at.alias("v")).select("symbol", F.element_at("v", 1)["x"].alias("last"), F.try_element_at("v", F.lit(2))["x"].alias("previous"))


@query(
    "sc_27_content_ids",
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status FROM orders)
SELECT id, sha256('{"cust":' || cust || ',"status":"' || status || '"}')[:24] AS content_id, sha256('{"cust":' || cust || ',"status":"' || status || '"}')[:24] <> sha256('{"cust":' || cust || ',"status":"' || CASE WHEN id % 5 = 0 THEN 'X' ELSE status END || '"}')[:24] AS drifted,
  CASE WHEN id % 2 = 0 THEN '{"a":"1","b":"n","c":"3"}' ELSE '{"a":"1","b":"2"}' END AS merged FROM o""",
)
def sc_27(spark, sf_dir):
    """Also SC-29, VAL-08 and VAL-12: ids by content, drift of a row from its stored id, and merged settings."""
    k = F.col("o_orderkey")
    o = B.table(spark, sf_dir, "orders")
    of = lambda status: X.content_id(F.struct(F.col("o_custkey").alias("cust"), status.alias("status")))
    now = F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    merged = X.merged_json(F.lit('{"a":"1","b":"2"}'), F.when(k % 2 == 0, '{"c":"3","b":"n"}'))
    return o.select(k.alias("id"), of(F.col("o_orderstatus")).alias("content_id"), (of(F.col("o_orderstatus")) != of(now)).alias("drifted"), merged.alias("merged"))


@query(
    "jn_07_prefilter",
    f"WITH {B.UNIVERSE}, s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem WHERE l_quantity >= 50), n AS (SELECT count(*) AS wanted, (SELECT count(*) FROM s) AS seen FROM universe) SELECT symbol, ordinal FROM universe, n WHERE NOT (wanted >= 50 AND seen > 0) OR symbol IN (SELECT symbol FROM s)",
)
def jn_07(spark, sf_dir):
    """Symbols without a snapshot go, but only of many symbols, and only if there are snapshots at all."""
    u = B.universe(spark, sf_dir).select("symbol", "ordinal")
    seen = B.table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").cast("string").alias("symbol")).distinct()
    return R.prefiltered(u, seen, 50)


@query(
    "val_11_split",
    "WITH d AS (SELECT event_id, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS k FROM events) SELECT event_id, CASE WHEN k <= 20 THEN 'train' WHEN k <= 30 THEN 'validation' END AS part FROM d",
)
def val_11(spark, sf_dir):
    """The first twenty days train, the next ten validate. Days are few, so they are ranked alone and joined."""
    e = B.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    return R.split_by_day(e, 20, 10).select("event_id", "part")


@query(
    "lim_06_pivot_order",
    f"WITH {BARS}{B.latest_sql('supplier_days')}, p AS (SELECT symbol, i, high, low, {_pivot_sql(5)} FROM c), q AS (SELECT symbol, i, i + 5 AS sure, true AS is_low FROM p WHERE pivot_low UNION ALL SELECT symbol, i, i + 5, false FROM p WHERE pivot_high) SELECT symbol, string_agg(CASE WHEN is_low THEN 'L' ELSE 'H' END || i, ',' ORDER BY sure, i, NOT is_low) AS pivots FROM q GROUP BY symbol",
)
def lim_06(spark, sf_dir):
    """A symbol's pivots in the order in which they are confirmed, lows before highs; at most 500 bars a symbol."""
    high, low = states.pivots(5)
    p = days(spark, sf_dir).withColumns({"hi": high, "lo": low}).where("hi OR lo")
    each = p.select("symbol", "i", F.explode(F.array_compact(F.array(F.when(F.col("lo"), F.lit(0)), F.when(F.col("hi"), F.lit(1))))).alias("kind"))
    packed = F.array_sort(F.collect_list(F.struct((F.col("i") + 5).alias("at"), "i", "kind")))
    return each.groupBy("symbol").agg(F.array_join(F.transform(packed, lambda s: F.concat(F.when(s["kind"] == 0, "L").otherwise("H"), s["i"].cast("string"))), ",").alias("pivots"))


@query(
    "chn_07_zone_actions",
    f"""WITH {BARS}{B.latest_sql('supplier_days', B.MAX_BARS)}, z AS (SELECT *, {S.sma_sql('close', 20)} AS m, greatest(open, close) AS top, least(open, close) AS bottom FROM c), t AS (SELECT *, m * 1.05 AS lo, m * 1.3 AS hi FROM z), l AS (SELECT *, coalesce(count(CASE WHEN volume > 0 THEN 1 END) {_O(20, 1)} >= 3 AND volume >= 1.15 * avg(CASE WHEN volume > 0 THEN volume END) {_O(20, 1)}, false) OR coalesce(count(*) {_O(20, 1)} >= 3 AND high - low >= 1.2 * avg(high - low) {_O(20, 1)}, false) AS elevated FROM t)
SELECT symbol, time, bottom <= hi * 1.1 AND top >= lo * 0.9 AS entered, low <= hi AND high >= lo AND close < lo AS rejected, low <= hi AND high >= lo AND close > hi AS rejected_below, greatest(top, high) > hi * 1.02 AS breach, bottom < lo * 0.9 AS breach_down,
  high > m * 1.2 OR low < m * 0.5 AS wick, top > m AS body_up, low <= hi AND high >= lo AS overlap, elevated,
  close > m * 1.2 AS closed_above, close < m - m * 0.2 AS closed_below, close BETWEEN m * 0.8 AND m * 1.2 AS on_line, bottom < m AS line_breach FROM l WHERE m IS NOT NULL""",
)
def chn_07(spark, sf_dir):
    """Also CHN-06, CHN-08, CHN-10 and TH-05: rules on a zone over a mean and on the mean, breaches, and elevated liquidity."""
    b = days(spark, sf_dir).withColumns({"m": S.sma(F.col("close"), 20), "elevated": channels.liquidity_elevated()})
    b = b.withColumns({"lo": F.col("m") * 1.05, "hi": F.col("m") * 1.3})
    lo, hi, m = F.col("lo"), F.col("hi"), F.col("m")
    zone, line = channels.zone_rule, channels.line_rule
    return b.where("m IS NOT NULL").select(
        "symbol", "time", zone(lo, hi, "entered", "up", 10.0, "body").alias("entered"), zone(lo, hi, "rejected", "up").alias("rejected"), zone(lo, hi, "rejected", "down").alias("rejected_below"), zone(lo, hi, "breach", "up", 2.0, breach_type="both").alias("breach"),
        zone(lo, hi, "breach", "up", 10.0, "body", breach_direction="down").alias("breach_down"), channels.breach(m * 1.2, "wick", below=m * 0.5).alias("wick"), channels.breach(m, "body", "up").alias("body_up"), channels.zone_overlap(lo, hi).alias("overlap"), "elevated",
        line(m, "closed_above", "up", 20.0).alias("closed_above"), line(m, "closed_below", "up", 20.0).alias("closed_below"), line(m, "on_line", None, 20.0).alias("on_line"), line(m, "breach", "up", breach_type="body", breach_direction="down").alias("line_breach"),
    )


@query("chn_01_ticks", "WITH p AS (SELECT p_partkey AS id, p_retailprice / 7 AS x FROM part) SELECT id, ceil(round(x / 0.05, 9)) * 0.05 AS upper, floor(round(x / 0.05, 9)) * 0.05 AS lower, floor(x / 0.05 + 0.5) * 0.05 AS middle, CASE WHEN id % 3 = 0 THEN NULL WHEN x < 150 THEN 0.01 ELSE 0.01 END AS tick, 10 + (x - 10) * (id - 1) / 4.0 AS at FROM p")
def chn_01(spark, sf_dir):
    """Also CHN-02, CHN-03 and CHN-11: lines to ticks, the tick of an instrument, and a line through two points."""
    k, x = F.col("p_partkey"), F.col("p_retailprice") / 7
    line = lambda name: channels.line_to_tick(x, 0.05, name).alias(name)
    return B.table(spark, sf_dir, "part").select(k.alias("id"), line("upper"), line("lower"), line("middle"), channels.mintick(x, k % 3 == 0).alias("tick"), channels.line_at(F.lit(1), F.lit(10.0), F.lit(5), x, k).alias("at"))


_SRC = {"hl2": "(high + low) / 2", "ohlc4": "(open + high + low + close) / 4", "hlcc4": "(high + low + 2 * close) / 4"}


@query(
    "win_08_named_averages",
    f"""{REC}{BARS}{B.latest_sql('supplier_days', 120)}, x AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _SRC.items())} FROM c), {S.ema_sql('e', 'x', {'ema': ('hl2', 9)})}, {S.rma_sql('r', 'x', {'rma': ('ohlc4', 9)})}
SELECT symbol, time, {rounded_sql({"sma": S.sma_sql("hlcc4", 9), "wma": _weighted_sql("hl2", list(range(9, 0, -1))), "lwma": _weighted_sql("open", list(range(1, 10))), "alma": _weighted_sql("high", _alma_weights(9)), "vwma": f"CASE WHEN i >= 9 AND sum(greatest(volume, 0)) {_O(8, 0)} > 0 THEN sum(low * greatest(volume, 0)) {_O(8, 0)} / sum(greatest(volume, 0)) {_O(8, 0)} END", "ema": "ema", "rma": "CASE WHEN i >= 9 THEN rma END"})} FROM x JOIN e USING (symbol, i) JOIN r USING (symbol, i)""",
)
def win_08(spark, sf_dir):
    """Also WIN-35: averages by name over prices by name."""
    of = {"sma": "hlcc4", "wma": "hl2", "lwma": "open", "alma": "high", "vwma": "low", "ema": "hl2", "rma": "ohlc4"}
    return rounded(days(spark, sf_dir, 120).select("symbol", "time", *[S.average(S.source(x), 9, kind).alias(kind) for kind, x in of.items()]), "symbol", "time")


def _filled_sql(weights: list[float]) -> str:
    total = " + ".join(f"{float(w)!r}::DOUBLE * " + (f"coalesce({S.lag_sql('close', k)}, close)" if k else "close") for k, w in enumerate(weights))
    return f"({total}) / {float(sum(weights))!r}::DOUBLE"


@query(
    "win_30_filters",
    f"""WITH {BARS}{B.latest_sql('supplier_days', 60)} SELECT symbol, time, {rounded_sql({"sma": _filled("close", 9), "lwma": _filled_sql(list(range(9, 0, -1))), "alma": _filled_sql(_alma_weights(9)), "vwma": f"(sum(close * volume) {_O(8, 0)} + greatest(9 - i, 0) * close * volume) / (sum(volume) {_O(8, 0)} + greatest(9 - i, 0) * volume)"})} FROM c""",
)
def win_30(spark, sf_dir):
    """Filters in which bars before the first count as the current one."""
    return rounded(days(spark, sf_dir, 60).select("symbol", "time", *[channels.filled(F.col("close"), 9, kind).alias(kind) for kind in ("sma", "lwma", "alma", "vwma")]), "symbol", "time")


def _period_sql() -> str:
    """Frames of another length at each bar as joins, averages with a memory by recursion."""
    age = "b.i - j.i"
    bell = "exp(-pow(n - 1 - k - 0.85 * (n - 1), 2) / (2 * pow(n / 6.0, 2)))"
    return f"""WITH RECURSIVE {B.event_sql()}, {B.latest_sql('event_bars', B.MAX_BARS)}, b AS (SELECT *, CAST(1 + i * 7 % 13 AS BIGINT) AS n FROM c),
f AS (SELECT b.symbol, b.i, b.n, k, coalesce(j.close, b.close) AS x, coalesce(j.volume, b.volume) AS v FROM b JOIN range(13) r(k) ON k < n LEFT JOIN c j ON j.symbol = b.symbol AND j.i = b.i - k),
w AS (SELECT symbol, i, avg(x) AS sma, sum((n - k) * x) / sum(n - k) AS lwma, sum(x * v) / sum(v) AS vwma, sum(x * {bell}) / sum({bell}) AS alma FROM f GROUP BY symbol, i),
e AS (SELECT symbol, i, close AS ema, close AS rma FROM b WHERE i = 1
  UNION ALL SELECT b.symbol, b.i, e.ema + (b.close - e.ema) * 2.0 / (b.n + 1), (e.rma * (b.n - 1) + b.close) / b.n FROM e JOIN b ON b.symbol = e.symbol AND b.i = e.i + 1)
SELECT symbol, CAST(i AS BIGINT) AS i, {rounded_sql({k: k for k in ('sma', 'lwma', 'vwma', 'alma', 'ema', 'rma')}, 7)} FROM w JOIN e USING (symbol, i)"""


@query("win_30_period_filters", _period_sql())
def win_30_periods(spark, sf_dir):
    """Also TH-10: filters over a number of bars that differs by bar."""
    b = B.latest(B.event_bars(spark, sf_dir))
    for kind in filters.KINDS:
        b = filters.by_period(b, F.col("close"), 1 + F.col("i") * 7 % 13, kind, kind)
    return rounded(b.select("symbol", F.col("i").cast("long").alias("i"), *filters.KINDS), "symbol", "i", digits=7)


def _day_sql(step: int) -> str:
    so_far = "OVER (PARTITION BY symbol, day ORDER BY i ROWS UNBOUNDED PRECEDING)"
    return f"""d{step} AS (SELECT symbol, time, i - 1 AS place, row_number() OVER (PARTITION BY symbol ORDER BY i) AS i, day, close FROM days WHERE (bar_of_day - 1) % {step} = 0),
p{step} AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY i) AS n, avg(close) {so_far} AS f FROM d{step}), q{step} AS (SELECT *, close - f AS d FROM p{step}),
g{step} AS (SELECT *, avg(d) {so_far} AS m, avg(d * d) {so_far} AS s FROM q{step}), h{step} AS (SELECT *, CASE WHEN n > 1 AND s > 0 THEN m / sqrt(s) * sqrt(s) / ((n + 1) // 2) ELSE 0 END AS slope FROM g{step}),
l{step} AS (SELECT h.symbol, h.time, h.slope, sqrt(h.s) AS dev, h.f + h.slope * (h.place - coalesce(z.place, 0)) AS middle FROM h{step} h LEFT JOIN h{step} z ON z.symbol = h.symbol AND z.i = h.i - (h.n + 1) // 2),
t{step} AS (SELECT w.symbol, w.time, w.back, w.day, l.middle AS tracer, l.slope, l.dev FROM days w ASOF LEFT JOIN l{step} l ON l.symbol = w.symbol AND w.time >= l.time),
o{step} AS (SELECT t.symbol, t.time, {step} AS step, t.tracer, e.tracer - e.slope * (t.back - 1) AS middle, e.dev AS dev FROM t{step} t JOIN t{step} e ON e.symbol = t.symbol AND e.back = 1 AND e.day = t.day)"""


@query(
    "ind_16_day_channel",
    f"""WITH {B.event_sql()}, {B.latest_sql('event_bars', B.MAX_BARS)}, days AS (SELECT *, time // 86400 AS day, row_number() OVER (PARTITION BY symbol, time // 86400 ORDER BY time) AS bar_of_day FROM c),
{_day_sql(1)}, {_day_sql(3)}, o AS (SELECT * FROM o1 UNION ALL SELECT * FROM o3)
SELECT symbol, time, CAST(step AS BIGINT) AS step, {rounded_sql({'tracer': 'tracer', 'middle': 'middle', 'upper': 'middle + dev', 'lower': 'middle - dev', 'q1': 'middle - dev / 2', 'q3': 'middle + dev / 2'}, 7)} FROM o""",
)
def ind_16_days(spark, sf_dir):
    """The filtered regression over the bars of the UTC day, of every bar and of every third."""
    b = B.latest(B.event_bars(spark, sf_dir))
    both = [filters.day_channel(b, step=k).withColumn("step", F.lit(k).cast("long")) for k in (1, 3)]
    return rounded(both[0].unionByName(both[1]).drop("back"), "symbol", "time", "step", digits=7)


@query(
    "ind_16_weighted_filters",
    f"""WITH {BARS}{B.latest_sql('supplier_days', 100)}, f AS (SELECT *, {_filled_sql(list(range(20, 0, -1)))} AS f FROM c), d AS (SELECT symbol, i, back, close - f AS close, f FROM f),
q AS (SELECT symbol, i, back, close * close AS close FROM d), w AS (SELECT symbol, i, {_filled_sql(list(range(20, 0, -1)))} AS m2 FROM q), g AS (SELECT *, {_filled("close", 20)} AS s1, {_filled("close * close", 20)} AS s2 FROM d),
z AS (SELECT g.symbol, g.back, f, sqrt(m2) AS sd, CASE WHEN s2 > 0 THEN s1 / sqrt(s2) * sqrt(m2) ELSE 0 END AS pull FROM g JOIN w USING (symbol, i))
SELECT symbol, {rounded_sql({"middle": "f + pull", "upper": "f + pull + sd", "lower": "f + pull - sd"})} FROM z WHERE back = 1""",
)
def ind_16_filters(spark, sf_dir):
    """Also TH-10: the channel of deviations from another filter than the plain mean."""
    c = channels.weighted(days(spark, sf_dir, 100), 20, kind="lwma").where("back = 1")
    return rounded(c.select("symbol", "middle", "upper", "lower"), "symbol")


@query(
    "win_22_crossings",
    f"WITH {BARS}{B.latest_sql('supplier_days', 60)}, m AS (SELECT *, {S.sma_sql('close', 5)} AS a, {S.sma_sql('close', 20)} AS b FROM c), l AS (SELECT *, {S.lag_sql('a')} AS a1, {S.lag_sql('b')} AS b1 FROM m) SELECT symbol, time, coalesce((a1 <= b1 AND a > b) OR (a1 >= b1 AND a < b), false) AS either, coalesce((a1 < b1 AND a > b) OR (a1 > b1 AND a < b), false) AS strict FROM l",
)
def win_22(spark, sf_dir):
    """Crossings in either direction, from a line on or from beyond it."""
    m = days(spark, sf_dir, 60).withColumns({"a": S.sma(F.col("close"), 5), "b": S.sma(F.col("close"), 20)})
    a, b = F.col("a"), F.col("b")
    return m.select("symbol", "time", F.coalesce(S.crossed(a, b), F.lit(False)).alias("either"), F.coalesce(S.crossed(a, b, strict=True), F.lit(False)).alias("strict"))


@query("flt_01_manual_symbols", f"WITH {B.UNIVERSE}, {BARS}p AS (SELECT symbol, arg_max(close, time) AS price FROM supplier_days GROUP BY symbol) SELECT symbol, ordinal, price FROM universe JOIN p USING (symbol) WHERE symbol IN ('3', '1', '7', '9999')")
def flt_01(spark, sf_dir):
    """Also FLT-10 and PL-02: symbols given by hand short-cut the universe; rules of another scope don't count."""
    request = screen.Request({"sma": {"length": 400, "timeframe": "secondary"}}, symbols=["3", "1", "7", "9999"]).scoped("primary")
    return screen.screened(B.universe(spark, sf_dir), B.supplier_days(spark, sf_dir), request).select("symbol", "ordinal", "price")


@query(
    "ind_20_snapshots",
    f"""{REC}{BARS}{B.latest_sql('supplier_days', 200)}, {_RSI}, {_MACD}, snap AS (SELECT c.symbol, c.close, rsi.rsi, macd.macd, macd.signal FROM c JOIN rsi ON rsi.symbol = c.symbol AND rsi.back = 1 JOIN macd ON macd.symbol = c.symbol AND macd.back = 1 WHERE c.back = 1)
SELECT symbol, rsi BETWEEN 20 AND 80 AS rsi, macd > signal AS macd, rsi BETWEEN 20 AND 80 AND macd > signal AS passed FROM snap""",
)
def ind_20(spark, sf_dir):
    """Rules on a table of the last values of indicators, computed before: no bar is read again."""
    b = indicators.macd(indicators.rsi(days(spark, sf_dir, 200)))
    stored = b.where("back = 1").select("symbol", "close", "rsi", "macd", "signal")
    return screen.on_snapshots(stored, {"rsi": {"location": "neutral", "tolerance": 10}, "macd": {"rule": "above_signal"}})


@query("snk_07_reports", f"WITH {B.UNIVERSE} SELECT exchange, CAST(count(*) AS BIGINT) AS n, '| ' || exchange || ' | ' || count(*) || ' |' AS line FROM universe GROUP BY exchange")
def snk_07(spark, sf_dir):
    """A report written as JSON, CSV and Markdown, read back from each."""
    rows = B.universe(spark, sf_dir).groupBy("exchange").agg(F.count(F.lit(1)).alias("n"))
    at = shared.reported(rows, shared.scratch(spark))
    lines = spark.read.text(at["md"]).select(F.regexp_extract("value", r"^\| (.*) \| \d+ \|$", 1).alias("exchange"), F.col("value").alias("line"))
    csv = spark.read.option("header", True).schema("exchange string, n long").csv(at["csv"])
    return spark.read.schema("exchange string, n long").json(at["json"]).join(csv, ["exchange", "n"]).join(lines, "exchange").select("exchange", "n", "line")


@query("chn_05_trend_areas")
def chn_05(spark, sf_dir):
    """Also TH-02 to TH-04, CHN-11 and LIM-10: for how many bars rules on the latest trend channel's lines and zones have held, up to
    its break; held against plain loops in tests."""
    b = days(spark, sf_dir)
    rules = [{"area": "middle_line", "action": "closed_above"}, {"area": "bottom_zone", "action": "entered", "touch_type": "both", "tolerance": 20.0}, {"area": "top_line", "action": "closed_below", "tolerance": 10.0}, {"area": "top_zone", "action": "breach", "touch_type": "body"}]
    found = trend.states_of(b, 8, mintick=trend.by_price())
    runs = trend.areas(b, found, [*rules, {"area": "middle_line", "action": "closed_below"}])
    return runs.select("symbol", "direction", "broken", *[f"age_{k}" for k in range(4)], (F.col("age_4") == 1).alias("passed"))
