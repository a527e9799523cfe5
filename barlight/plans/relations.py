"""Queries on sources, sinks, filters, projections, joins, aggregations, limits, sets and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.operators import payloads
from barlight.operators import relational as R
from barlight.plans.registry import query
from barlight.sources import bars as B
from barlight.sources import shared, store

DAYS = B.SUPPLIER_DAYS
NY = "timezone('America/New_York', timezone('UTC', make_timestamp(time * 1000000)))"


@query("src_06_provider_rows", """SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS time, value AS open, value AS high, value AS low, value AS close, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS volume
FROM events WHERE event_id % 7 > 1 AND value IS NOT NULL""")
def src_06(spark, sf_dir):
    """Also SRC-09: one price in seven is missing and one is no number; neither row becomes a bar."""
    e = B.table(spark, sf_dir, "events")
    seventh = F.col("event_id") % 7
    known = F.when(seventh == 1, "n/a").when(seventh > 1, F.col("value").cast("string"))
    rows = e.select(F.col("event_type").alias("symbol"), (B.epoch(F.col("ts")) * 1000 + 1).alias("t"), known.alias("o"), F.col("value").alias("h"), F.col("value").alias("l"), F.col("value").alias("c"), F.when(F.col("event_id") % 5 != 0, F.lit(1.0)).alias("v"))
    return B.provider_rows(rows)


@query("src_07_positional_rows", """SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS time, value AS open, value + 1 AS high, value - 1 AS low, value AS close, 2.0 AS volume FROM events WHERE event_id % 11 > 1""")
def src_07(spark, sf_dir):
    """One array in eleven is too short, and one has a price that is no number."""
    e = B.table(spark, sf_dir, "events")
    v = F.col("value")
    cells = F.array(*[c.cast("string") for c in (B.epoch(F.col("ts")) * 1000, v, v + 1, v - 1, F.when(F.col("event_id") % 11 == 1, "Infinity").otherwise(v.cast("string")), F.lit(2.0))])
    rows = e.select(F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 11 != 0, cells).otherwise(F.slice(cells, 1, 4)).alias("row"))
    return B.kline_rows(rows)


@query("src_08_sanitized_bars", """WITH r AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) // 600 * 600 AS time, event_id, value AS open, value + event_id % 3 - 0.5 AS high, value - event_id % 2 AS low, value AS close, 1.0 AS volume FROM events)
SELECT symbol, time, arg_max(open, event_id) AS open, arg_max(high, event_id) AS high, arg_max(low, event_id) AS low, arg_max(close, event_id) AS close, arg_max(volume, event_id) AS volume
FROM r WHERE low <= least(open, close) AND high >= greatest(open, close) AND low <= high GROUP BY symbol, time""")
def src_08(spark, sf_dir):
    e, v, n = B.table(spark, sf_dir, "events"), F.col("value"), F.col("event_id")
    rows = e.select(F.col("event_type").alias("symbol"), (F.floor(B.epoch(F.col("ts")) / 600) * 600).cast("long").alias("time"), n, v.alias("open"), (v + n % 3 - 0.5).alias("high"), (v - n % 2).alias("low"), v.alias("close"), F.lit(1.0).alias("volume"))
    return B.sanitized(rows, "event_id")


CATEGORIES = "list_sort(list_distinct(list_filter([CASE WHEN ordinal % 3 = 0 THEN 'sp500' END, CASE WHEN ordinal % 10 = 0 THEN 'dow_jones' END, CASE WHEN ordinal % 2 = 0 THEN 'nyse' ELSE 'nasdaq' END], lambda x: x IS NOT NULL)))"


def categorized(spark, sf_dir):
    """The universe with its sorted set of categories: index memberships, looked up in a members table, and exchange group."""
    u = B.universe(spark, sf_dir)
    n = F.col("ordinal")
    members = u.select("symbol", F.explode(F.array_compact(F.array(F.when(n % 3 == 0, "sp500"), F.when(n % 10 == 0, "dow_jones")))).alias("index_id"))
    sets = members.groupBy("symbol").agg(F.collect_set("index_id").alias("indexes"))
    group = F.array(F.when(n % 2 == 0, "nyse").otherwise("nasdaq"))
    joined = u.join(sets, "symbol", "left")
    return joined.withColumn("asset_categories", F.array_sort(F.array_distinct(F.concat(F.coalesce("indexes", F.array().cast("array<string>")), group)))).drop("indexes")


@query("prj_02_universe_categories", f"WITH {B.UNIVERSE} SELECT symbol, name, exchange, sector, sector AS category, status, array_to_string({CATEGORIES}, ',') AS asset_categories FROM universe")
def prj_02(spark, sf_dir):
    """Also SRC-01, SRC-04, SRC-05, JN-03 and JN-04."""
    return categorized(spark, sf_dir).select("symbol", "name", "exchange", "sector", F.col("sector").alias("category"), "status", F.concat_ws(",", "asset_categories").alias("asset_categories"))


@query("flt_03_stock_universe", f"WITH {B.UNIVERSE}, k AS (SELECT *, {CATEGORIES} AS categories FROM universe) SELECT symbol, sector FROM k WHERE status = 'COMPLIANT' AND list_has_any(categories, ['sp500', 'dow_jones']) AND sector IN ('ASIA', 'EUROPE', 'REGION_0', 'REGION_1')")
def flt_03(spark, sf_dir):
    """Also FLT-02 and FLT-04: status is pushed to the scan's side of the lookups."""
    u = categorized(spark, sf_dir).where(F.col("status") == "COMPLIANT")
    return u.where(R.overlaps(F.col("asset_categories"), ["sp500", "dow_jones"]) & F.col("sector").isin("ASIA", "EUROPE", "REGION_0", "REGION_1")).select("symbol", "sector")


COINS = "coins AS (SELECT p_partkey AS id, 'x:c' || p_partkey || 'usd' AS raw, p_type AS category, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'binance' END, CASE WHEN p_partkey % 3 = 0 THEN 'kraken' END, CASE WHEN p_partkey % 5 = 0 THEN 'okx' END], lambda x: x IS NOT NULL) AS exchanges FROM part)"


def coins(spark, sf_dir):
    p, k = B.table(spark, sf_dir, "part"), F.col("p_partkey")
    exchanges = F.array_compact(F.array(F.when(k % 2 == 0, "binance"), F.when(k % 3 == 0, "kraken"), F.when(k % 5 == 0, "okx")))
    return p.select(k.alias("id"), F.concat(F.lit("x:c"), k, F.lit("usd")).alias("raw"), F.col("p_type").alias("category"), exchanges.alias("exchanges"))


@query("flt_05_crypto_universe", f"""WITH {COINS} SELECT 'C' || id || '-USD' AS symbol, CASE WHEN len(exchanges) = 0 THEN 'global' WHEN list_contains(exchanges, 'kraken') OR list_contains(exchanges, 'okx') THEN array_to_string(list_filter(['kraken', 'okx'], lambda x: list_contains(exchanges, x)), ',') ELSE array_to_string(exchanges, ',') END AS exchange
FROM coins WHERE lower(trim(coalesce(category, ''))) NOT IN ('economy', 'promo') AND (list_contains(exchanges, 'binance') OR list_contains(exchanges, 'okx'))""")
def flt_05(spark, sf_dir):
    """Also SRC-02, FLT-06, FLT-07, FLT-08, PRJ-03, SET-03 and LIM-04: exchanges asked for that a coin has, at most five."""
    c = coins(spark, sf_dir)
    kept = c.where(~F.lower(F.trim(F.coalesce("category", F.lit("")))).isin("economy", "promo") & R.overlaps(F.col("exchanges"), ["binance", "okx"]))
    common = F.array_intersect(F.array(F.lit("kraken"), F.lit("okx")), F.col("exchanges"))
    shown = F.when(F.size("exchanges") == 0, "global").when(F.size(common) > 0, F.concat_ws(",", F.slice(common, 1, 5))).otherwise(F.concat_ws(",", F.slice("exchanges", 1, 5)))
    return kept.select(R.normal_crypto(F.col("raw")).alias("symbol"), shown.alias("exchange"))


@query("agg_03_exchange_counts", f"WITH {COINS} SELECT e AS exchange, CAST(count(DISTINCT id) AS BIGINT) AS n FROM (SELECT id, unnest(exchanges) AS e FROM coins) GROUP BY e ORDER BY e")
def agg_03(spark, sf_dir):
    return coins(spark, sf_dir).select("id", F.explode("exchanges").alias("exchange")).groupBy("exchange").agg(F.countDistinct("id").alias("n")).orderBy("exchange")


@query("src_13_last_bars", f"WITH {DAYS} SELECT symbol, time, close FROM supplier_days QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 5")
def src_13(spark, sf_dir):
    """Also LIM-02, SRC-12, SRC-19 and SRC-20: the last bars of each symbol by a limit within groups."""
    return B.latest(B.supplier_days(spark, sf_dir), 5).select("symbol", "time", "close")


_WEEKS = 8


@query("src_14_stored_weeks", f"""WITH {DAYS}, u AS (SELECT CAST(make_timestamp(max(time) * 1000000) AS DATE) AS last_day FROM supplier_days), d AS (SELECT last_day - CAST(k AS INTEGER) AS day FROM u, range(200) r(k)),
s AS (SELECT min(day) AS first_day FROM (SELECT day FROM d WHERE isodow(day) < 6 ORDER BY day DESC LIMIT {5 * _WEEKS + 8})),
w AS (SELECT *, date_trunc('week', make_timestamp(time * 1000000)) AS bucket FROM supplier_days, s WHERE make_timestamp(time * 1000000) >= first_day),
g AS (SELECT symbol, min(time) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM w GROUP BY symbol, bucket)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= {_WEEKS}""")
def src_14(spark, sf_dir):
    """Also PL-09: weeks rolled up from a store by date, of which only the days that so many weeks need are read."""
    folder = shared.scratch(spark)
    days = B.supplier_days(spark, sf_dir)
    store.put(days, folder)
    until = days.agg(F.date_from_unix_date((F.max("time") / 86400).cast("int"))).first()[0]
    return store.latest_of(spark, folder, _WEEKS, 1, "w", until=until).drop("i", "back")


@query("src_19_stored_days", f"WITH {DAYS} SELECT symbol, time, close, volume FROM (SELECT * FROM supplier_days WHERE CAST(symbol AS BIGINT) % 3 > 0) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 20")
def src_19(spark, sf_dir):
    """The last bars of requested symbols from a store by date, newest first; the store is filled in two batches, the second of which
    writes some bars again."""
    folder, days = shared.scratch(spark), B.supplier_days(spark, sf_dir)
    store.put(days.where(F.pmod("time", F.lit(86400 * 5)) > 0).withColumn("volume", F.lit(0.0)), folder)
    store.put(days, folder)
    asked = days.select("symbol").distinct().where(F.col("symbol").cast("long") % 3 > 0)
    return store.latest(spark, folder, 20, asked).select("symbol", "time", "close", "volume")


@query("src_15_snapshots", """WITH g AS (SELECT user_id AS symbol, arg_max(value, row(ts, event_id)) FILTER (event_type = 'view') AS minute, arg_max(value, row(ts, event_id)) FILTER (event_type = 'click') AS day, arg_max(value, row(ts, event_id)) AS previous FROM events GROUP BY user_id)
SELECT symbol, coalesce(minute, day, previous) AS price, CASE WHEN minute IS NOT NULL THEN 'min' WHEN day IS NOT NULL THEN 'day' ELSE 'prevDay' END AS origin FROM g""")
def src_15(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    at, v = F.struct("ts", "event_id"), F.col("value")
    of = lambda kind: F.max_by(F.when(F.col("event_type") == kind, v), F.when(F.col("event_type") == kind, at))
    g = e.groupBy(F.col("user_id").alias("symbol")).agg(of("view").alias("minute"), of("click").alias("day"), F.max_by(v, at).alias("previous"))
    return g.select("symbol", F.coalesce("minute", "day", "previous").alias("price"), F.when(F.col("minute").isNotNull(), "min").when(F.col("day").isNotNull(), "day").otherwise("prevDay").alias("origin"))


@query("jn_08_pair_preference", """WITH q AS (SELECT p_brand AS base, CASE p_size % 6 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USDC' WHEN 2 THEN 'FDUSD' WHEN 3 THEN 'BUSD' WHEN 4 THEN 'USD' ELSE 'EUR' END AS quote, p_partkey AS id, p_retailprice AS price FROM part)
SELECT base, base || quote AS pair, price AS open, price AS high, price AS low, price AS close, 0.0 AS volume FROM q QUALIFY row_number() OVER (PARTITION BY base ORDER BY CASE quote WHEN 'USDT' THEN 1 WHEN 'USDC' THEN 2 WHEN 'FDUSD' THEN 3 WHEN 'BUSD' THEN 4 WHEN 'USD' THEN 5 ELSE 6 END, id) = 1""")
def jn_08(spark, sf_dir):
    """Also SRC-17, SRC-22 and JN-06: of the pairs of a coin the one with the best quote, as a flat bar."""
    p = B.table(spark, sf_dir, "part")
    quote = F.element_at(F.array(*map(F.lit, [*R.QUOTES, "EUR"])), (F.col("p_size") % 6 + 1).cast("int"))
    q = p.select(F.col("p_brand").alias("base"), quote.alias("quote"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    place = F.array_position(F.array(*map(F.lit, R.QUOTES)), F.col("quote"))
    best = R.by_preference(q, ["base"], F.when(place > 0, place).otherwise(99), F.col("id"))
    return best.select("base", F.concat("base", "quote").alias("pair"), *[F.col("price").alias(c) for c in B.PRICES], F.lit(0.0).alias("volume"))


@query("src_18_fundamentals", f"WITH {B.UNIVERSE} SELECT u.symbol, coalesce(w.total, u.shares_outstanding) AS shares_outstanding FROM universe u LEFT JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(count(*) AS DOUBLE) AS total FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) w USING (symbol)")
def src_18(spark, sf_dir):
    weighted = B.table(spark, sf_dir, "lineitem").where("l_discount > 0.09").groupBy(F.col("l_suppkey").cast("string").alias("symbol")).agg(F.count(F.lit(1)).cast("double").alias("total"))
    return B.universe(spark, sf_dir).join(weighted, "symbol", "left").select("symbol", F.coalesce("total", "shares_outstanding").alias("shares_outstanding"))


@query("snk_01_upsert", f"""WITH {DAYS}, o AS (SELECT symbol, '1day' AS timeframe, close AS payload, time AS updated_at FROM supplier_days QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time) = 1),
n AS (SELECT symbol, '1day' AS timeframe, close AS payload, time AS updated_at FROM supplier_days WHERE CAST(symbol AS BIGINT) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE symbol NOT IN (SELECT symbol FROM n)""")
def snk_01(spark, sf_dir):
    """Also SNK-03, SNK-06 and STR-05: the last write wins."""
    d = B.supplier_days(spark, sf_dir)
    row = lambda df, agg: df.groupBy("symbol").agg(agg("close", "time").alias("payload"), (F.max if agg is F.max_by else F.min)("time").alias("updated_at")).withColumn("timeframe", F.lit("1day"))
    return R.upserted(row(d, F.min_by), row(d.where(F.col("symbol").cast("long") % 2 == 0), F.max_by), ["symbol", "timeframe"])


INTEREST = "interest AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CASE o_orderkey % 3 WHEN 0 THEN '1h' WHEN 1 THEN '4h' ELSE '1day' END AS timeframe, max(CAST(epoch(o_orderdate) AS BIGINT)) AS last_requested_at, min(CAST(epoch(o_orderdate) AS BIGINT)) AS next_refresh_at FROM orders GROUP BY 1, 2)"


def interest(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    at, k = B.epoch(F.col("o_orderdate")), F.col("o_orderkey") % 3
    rows = o.select(F.col("o_custkey").cast("string").alias("symbol"), F.when(k == 0, "1h").when(k == 1, "4h").otherwise("1day").alias("timeframe"), at.alias("last_requested_at"), at.alias("next_refresh_at"))
    return R.interest_merged(rows.where("false"), rows)


@query("snk_02_interest", f"WITH {INTEREST} SELECT * FROM interest")
def snk_02(spark, sf_dir):
    return interest(spark, sf_dir)


@query("snk_05_pruned", f"WITH {INTEREST} SELECT symbol, timeframe, last_requested_at FROM interest WHERE (SELECT max(last_requested_at) FROM interest) - last_requested_at <= CASE timeframe WHEN '1h' THEN 172800 WHEN '4h' THEN 604800 ELSE 2592000 END")
def snk_05(spark, sf_dir):
    i = interest(spark, sf_dir)
    now = i.agg(F.max("last_requested_at")).first()[0] or 0
    return R.pruned(i, now).select("symbol", "timeframe", "last_requested_at")


@query("snk_04_cleared", f"WITH {INTEREST}, {B.UNIVERSE} SELECT symbol, timeframe FROM interest WHERE symbol NOT IN (SELECT symbol FROM universe)")
def snk_04(spark, sf_dir):
    """Also SET-05: rows without the symbols of another table."""
    return R.without(interest(spark, sf_dir).select("symbol", "timeframe"), B.universe(spark, sf_dir), ["symbol"])


@query("lim_03_due_symbols", f"WITH {INTEREST} SELECT symbol, timeframe, next_refresh_at FROM interest WHERE next_refresh_at <= 1000000000 ORDER BY next_refresh_at, symbol, timeframe LIMIT 50")
def lim_03(spark, sf_dir):
    return interest(spark, sf_dir).where("next_refresh_at <= 1000000000").orderBy("next_refresh_at", "symbol", "timeframe").limit(50).select("symbol", "timeframe", "next_refresh_at")


@query("agg_13_due_by_timeframe", f"WITH {INTEREST} SELECT timeframe, CAST(count(*) AS BIGINT) AS due, CAST(sum(last_requested_at - next_refresh_at) AS BIGINT) AS spread FROM interest WHERE next_refresh_at <= 1000000000 GROUP BY timeframe")
def agg_13(spark, sf_dir):
    return interest(spark, sf_dir).where("next_refresh_at <= 1000000000").groupBy("timeframe").agg(F.count(F.lit(1)).alias("due"), F.sum(F.col("last_requested_at") - F.col("next_refresh_at")).alias("spread"))


@query("flt_09_price_range", f"WITH {DAYS}, p AS (SELECT symbol, arg_max(close, time) AS price FROM supplier_days GROUP BY symbol) SELECT symbol, price FROM p WHERE price BETWEEN 1000 AND 3000")
def flt_09(spark, sf_dir):
    p = B.supplier_days(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "time").alias("price"))
    return p.where(R.price_between(F.col("price"), 1000, 3000))


@query(
    "flt_12_completed_bars",
    f"""WITH {DAYS}, m AS (SELECT symbol, max(time) AS last FROM supplier_days GROUP BY symbol),
d AS (SELECT s.* FROM supplier_days s JOIN m USING (symbol) WHERE NOT (time = last AND CAST(symbol AS BIGINT) % 8 <= 4)), {B.latest_sql('d', 30)}
SELECT symbol, CAST(count(*) AS BIGINT) AS bars, arg_max(close, time) AS price, max(time) AS last_time FROM c GROUP BY symbol""",
)
def flt_12(spark, sf_dir):
    """Also FLT-11: of all days, forming bars go by their flags (given to the last bar of some symbols, a flag each), the last 30
    stay, the price is the last close. The last bar of one symbol in eight is flagged as closed, and stays."""
    d = B.supplier_days(spark, sf_dir)
    last = d.groupBy("symbol").agg(F.max("time").alias("last"))
    kind = F.when(F.col("time") == F.col("last"), F.pmod(F.col("symbol").cast("long"), F.lit(8)))
    flags = {flag: F.when(kind == k, F.lit(forming)).when(kind == 5, F.lit(not forming)) for k, (flag, forming) in enumerate(B.FLAGS.items())}
    return _last_price(B.completed(d.join(last, "symbol").withColumns(flags).drop("last")))


def _last_price(d):
    return B.latest(d, 30).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max_by("close", "time").alias("price"), F.max("time").alias("last_time"))


_SESSION = f"(isodow({NY}) <= 5 AND hour({NY}) * 60 + minute({NY}) >= 570 AND hour({NY}) * 60 + minute({NY}) < 960)"


@query("flt_13_session_bars", f"WITH {B.event_sql(300)} SELECT symbol, time, close FROM event_bars WHERE {_SESSION}")
def flt_13(spark, sf_dir):
    """Also FLT-14: bars that open in the exchange's regular session, by its own clock."""
    return B.event_bars(spark, sf_dir, 300).where(R.in_session(F.col("time"))).select("symbol", "time", "close")


@query("agg_01_session_bars", f"""WITH {B.event_sql(300)}, s AS (SELECT *, time - ((hour({NY}) * 60 + minute({NY}) - 570) * 60) % 3600 AS bucket FROM event_bars WHERE {_SESSION})
SELECT symbol, CAST(bucket AS BIGINT) AS time, arg_min(open, s.time) AS open, max(high) AS high, min(low) AS low, arg_max(close, s.time) AS close, sum(volume) AS volume FROM s GROUP BY symbol, bucket""")
def agg_01(spark, sf_dir):
    """Also SC-16 and STR-02: hours counted from the session's open; the last one is short."""
    s = B.event_bars(spark, sf_dir, 300).where(R.in_session(F.col("time"))).withColumn("bucket", R.session_bucket(F.col("time"), 60))
    return s.groupBy("symbol", "bucket").agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("bucket", "time")


def _roll_sql(bucket: str) -> str:
    return f"WITH {DAYS}, b AS (SELECT *, {bucket} AS bucket FROM supplier_days) SELECT symbol, min(time) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM b GROUP BY symbol, bucket"


_DATE = "CAST(make_timestamp(time * 1000000) AS DATE)"


@query("agg_02_weeks", _roll_sql("date_trunc('week', make_timestamp(time * 1000000))"))
def agg_02_weeks(spark, sf_dir):
    return B.rolled_up(B.supplier_days(spark, sf_dir), R.calendar_bucket(F.col("time"), 1, "w"))


@query("agg_02_quarters", _roll_sql(f"(year({_DATE}) * 12 + month({_DATE}) - 1) // 3"))
def agg_02_quarters(spark, sf_dir):
    return B.rolled_up(B.supplier_days(spark, sf_dir), R.calendar_bucket(F.col("time"), 3, "mo"))


@query("agg_02_ten_days", _roll_sql("(time // 86400 + 719163) // 10"))
def agg_02_days(spark, sf_dir):
    return B.rolled_up(B.supplier_days(spark, sf_dir), R.calendar_bucket(F.col("time"), 10, "d"))


@query("sc_14_bucket_closes", f"""WITH {DAYS} SELECT symbol, time, CAST(epoch(date_trunc('week', {_DATE}) + INTERVAL 14 DAY) AS BIGINT) AS weeks, CAST(epoch(date_trunc('month', {_DATE}) + INTERVAL 1 MONTH) AS BIGINT) AS month,
CAST((((time // 86400 + 719163) // 10 + 1) * 10 - 719163) * 86400 AS BIGINT) AS ten_days, CAST((time // 14400 + 1) * 14400 + 5 AS BIGINT) AS next_refresh FROM supplier_days""")
def sc_14(spark, sf_dir):
    """Also SC-12, SC-13, SC-15 and FLT-16: when calendar blocks close, and when a fixed one is due for refresh."""
    t = F.col("time")
    return B.supplier_days(spark, sf_dir).select("symbol", "time", R.calendar_close(t, 2, "w").cast("long").alias("weeks"), R.calendar_close(t, 1, "mo").alias("month"), R.calendar_close(t, 10, "d").cast("long").alias("ten_days"), ((F.floor(t / 14400) + 1) * 14400 + 5).cast("long").alias("next_refresh"))


@query("flt_17_aligned_payloads", f"WITH {B.event_sql(300)} SELECT symbol, bool_and(time % 1800 = 0) AS aligned, bool_and({_SESSION}) AS in_session, CAST(max(time) AS BIGINT) AS last_time FROM event_bars GROUP BY symbol")
def flt_17(spark, sf_dir):
    """Whether every bar of a payload is on its anchor and in session."""
    t = F.col("time")
    return B.event_bars(spark, sf_dir, 300).groupBy("symbol").agg(F.min(t % 1800 == 0).alias("aligned"), F.min(R.in_session(t)).alias("in_session"), F.max("time").alias("last_time"))


_NOW = 30_000


@query(
    "src_21_cached_payloads",
    f"""WITH {B.event_sql()}, d AS (SELECT *, time // 86400 AS day, row_number() OVER (PARTITION BY symbol, time // 86400 ORDER BY time DESC) AS back FROM event_bars),
g AS (SELECT symbol, day, CAST(count(*) AS BIGINT) AS n, arg_max(close, time) AS last_close, max(time) AS last_time, CAST(count(*) FILTER (WHERE {_SESSION}) AS BIGINT) AS regular, CAST(min(CASE WHEN back <= 5 THEN time END) AS BIGINT) AS first_kept, bool_and((hour({NY}) * 60 + minute({NY}) - 570) % CASE WHEN day % 2 = 0 THEN 30 ELSE 60 END = 0) AS anchored,
  CAST(max(CASE WHEN {_SESSION} THEN time END) AS BIGINT) AS last_regular, max(CAST({NY} AS DATE)) AS last_date FROM d GROUP BY symbol, day)
SELECT symbol, CAST(day AS BIGINT) AS day, day % 7 > 0 AS valid, CASE WHEN day % 7 > 0 THEN least(n, 5) END AS kept, CASE WHEN day % 7 > 0 THEN CASE WHEN n > 5 THEN last_close ELSE -1 END END AS price, CASE WHEN day % 7 > 0 THEN first_kept END AS first_kept,
  CASE WHEN day % 7 > 0 THEN day * 86400 + day % 4 * {_NOW} < last_time + 3600 END AS forming, CASE WHEN day % 7 > 0 THEN least(regular, 3) END AS regular, CASE WHEN day % 7 > 0 THEN last_regular END AS last_regular, CASE WHEN day % 7 > 0 THEN anchored END AS anchored,
  day % 7 > 0 AND last_date <= DATE '2024-01-15' AS in_history, day % 7 > 0 AND day % 2 = 0 AS compatible FROM g""",
)
def src_21(spark, sf_dir):
    """Also PL-10 to PL-12: payloads of a day's candles as JSON, some of them cut off, read back, trimmed, marked and judged."""
    bars = B.event_bars(spark, sf_dir).withColumn("day", F.floor(F.col("time") / 86400).cast("long"))
    candles = F.sort_array(F.collect_list(F.struct("time", "open", "high", "low", "close", "volume")))
    policy = F.when(F.col("day") % 2 == 0, payloads.REGULAR)
    text = F.to_json(F.struct("symbol", F.lit(-1.0).alias("price"), "candles", policy.alias("session_policy")))
    cached = bars.groupBy("symbol", "day").agg(candles.alias("candles")).select("symbol", "day", F.when(F.col("day") % 7 == 0, F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text).alias("text"))
    p = cached.withColumn("p", payloads.parsed(F.col("text"))).withColumn("few", payloads.recent(F.col("p"), 5))
    last = F.try_element_at(F.col("few.candles"), F.lit(-1))["time"]
    p = p.withColumns({"now_marked": payloads.marked(F.col("few"), last + 3600, F.col("day") * 86400 + F.col("day") % 4 * _NOW), "regular": payloads.in_session_only(F.col("p"), 3)})
    forming = F.try_element_at(F.col("now_marked.candles"), F.lit(-1))["is_closed"].eqNullSafe(F.lit(False))
    valid = F.col("p").isNotNull()
    return p.select(
        "symbol", "day", valid.alias("valid"), F.when(valid, F.size("few.candles").cast("long")).alias("kept"), F.col("few.price").alias("price"), F.get("few.candles", F.lit(0))["time"].alias("first_kept"), F.when(valid, forming).alias("forming"),
        F.when(valid, F.size("regular.candles").cast("long")).alias("regular"), F.try_element_at("regular.candles", F.lit(-1))["time"].alias("last_regular"), F.when(F.col("day") % 2 == 0, payloads.anchored(F.col("p"), 30)).otherwise(payloads.anchored(F.col("p"), 60)).alias("anchored"), payloads.within_history(F.col("p"), F.lit("2024-01-15").cast("date")).alias("in_history"),
        payloads.session_compatible(F.col("p"), F.col("symbol"), 3600).alias("compatible"),
    )


@query("flt_18_point_in_time", f"WITH {DAYS} SELECT symbol, CAST(count(*) AS BIGINT) AS bars, arg_max(close, time) AS price FROM supplier_days WHERE time <= 946684800 GROUP BY symbol")
def flt_18(spark, sf_dir):
    return B.supplier_days(spark, sf_dir).where("time <= 946684800").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max_by("close", "time").alias("price"))


@query("flt_19_supported_split", f"WITH {B.UNIVERSE} SELECT symbol, symbol IN (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 50) AND exchange IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5') AS kept FROM universe")
def flt_19(spark, sf_dir):
    """The universe's rows that a provider supports, and the others."""
    u = B.universe(spark, sf_dir)
    supported = B.table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").cast("string").alias("symbol")).distinct()
    listed = F.col("exchange").isin(*[f"NATION_{k}" for k in range(1, 6)])
    kept = u.where(listed).join(supported, "symbol", "left_semi").select("symbol", F.lit(True).alias("kept"))
    removed = u.select("symbol").join(kept, "symbol", "left_anti").select("symbol", F.lit(False).alias("kept"))
    return kept.unionByName(removed)


@query("jn_01_metadata", f"WITH {DAYS}, {B.UNIVERSE}, p AS (SELECT symbol, arg_max(close, time) AS price, CAST(count(*) AS BIGINT) AS candles_count, max(time) AS last_candle_time FROM supplier_days GROUP BY symbol) SELECT p.*, name, exchange, sector, CASE WHEN status IS NOT NULL THEN 'AAOIFI' END AS compliance_standard FROM p LEFT JOIN universe USING (symbol)")
def jn_01(spark, sf_dir):
    """Also PRJ-01: what a response says of each symbol. The universe is broadcast only below Spark's own threshold."""
    p = B.supplier_days(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "time").alias("price"), F.count(F.lit(1)).alias("candles_count"), F.max("time").alias("last_candle_time"))
    u = B.universe(spark, sf_dir).select("symbol", "name", "exchange", "sector", F.when(F.col("status").isNotNull(), "AAOIFI").alias("compliance_standard"))
    return p.join(u, "symbol", "left")


@query("jn_05_fresh_stale_missing", f"WITH {DAYS}, {B.UNIVERSE}, p AS (SELECT symbol, max(time) AS t FROM supplier_days WHERE CAST(symbol AS BIGINT) % 7 <> 0 GROUP BY symbol) SELECT symbol, CASE WHEN t IS NULL THEN 'missing' WHEN t >= 1009584000 THEN 'fresh' ELSE 'stale' END AS state FROM universe LEFT JOIN p USING (symbol)")
def jn_05(spark, sf_dir):
    """Also PRJ-04 and STR-07."""
    p = B.supplier_days(spark, sf_dir).where(F.col("symbol").cast("long") % 7 != 0).groupBy("symbol").agg(F.max("time").alias("t"))
    state = F.when(F.col("t").isNull(), "missing").when(F.col("t") >= 1009584000, "fresh").otherwise("stale")
    return B.universe(spark, sf_dir).select("symbol").join(p, "symbol", "left").select("symbol", state.alias("state"))


@query("jn_09_alignment_audit", f"""WITH {B.event_sql(3600)}, a AS (SELECT symbol, time, close FROM event_bars WHERE time % 18000 <> 0), b AS (SELECT symbol, time, close * CASE WHEN time % 10800 = 0 THEN 1.01 ELSE 1 END AS close FROM event_bars WHERE time % 25200 <> 0)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.time, b.time) AS time, CASE WHEN a.close IS NULL THEN 'missing_one' WHEN b.close IS NULL THEN 'missing_other' WHEN abs(a.close - b.close) <= 0.001 * greatest(abs(a.close), abs(b.close)) THEN 'match' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.symbol = b.symbol AND a.time = b.time""")
def jn_09(spark, sf_dir):
    """Also JN-10, SET-08, VAL-09 and VAL-10."""
    e, t = B.event_bars(spark, sf_dir), F.col("time")
    other = e.where(t % 25200 != 0).withColumn("close", F.col("close") * F.when(t % 10800 == 0, 1.01).otherwise(1.0))
    return R.audited(e.where(t % 18000 != 0), other, 0.001).select("symbol", "time", "state")


@query("jn_15_expected_symbols", f"WITH {DAYS}, {B.UNIVERSE}, e AS (SELECT symbol FROM universe WHERE status = 'COMPLIANT'), a AS (SELECT symbol FROM supplier_days GROUP BY symbol HAVING arg_max(close, time) > 2000) SELECT coalesce(e.symbol, a.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'not_found' WHEN e.symbol IS NULL THEN 'unexpected' ELSE 'both' END AS verdict FROM e FULL JOIN a ON e.symbol = a.symbol")
def jn_15(spark, sf_dir):
    """Also JN-16, SET-06 and VAL-07: expected against found symbols, in one full outer join."""
    e = B.universe(spark, sf_dir).where("status = 'COMPLIANT'").select("symbol", F.lit(True).alias("expected"))
    a = B.supplier_days(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "time").alias("price")).where("price > 2000").select("symbol", F.lit(True).alias("found"))
    verdict = F.when(F.col("found").isNull(), "not_found").when(F.col("expected").isNull(), "unexpected").otherwise("both")
    return e.join(a, "symbol", "full_outer").select("symbol", verdict.alias("verdict"))


def _as_of_sql(where: str) -> str:
    return f"""WITH {B.event_sql(3600)}, t AS (SELECT event_id, event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS time FROM events{where})
SELECT t.event_id, b.close FROM t ASOF LEFT JOIN event_bars b ON t.symbol = b.symbol AND t.time - 3600 >= b.time"""


def as_of(left, bars, seconds=3600):
    """left (symbol, time and others) with the close of the last bar completed by then. What is asked for comes down to a row for each
    symbol and bar, however many rows of left ask it; these are put among the bars, one window carries closes on to them, and left
    meets them in an equi-join that can split a symbol's rows. Gaps that nobody asks about cost nothing."""
    rows = left.withColumn("bar", (F.floor((F.col("time") - seconds) / seconds) * seconds).cast("long"))
    asked = rows.select("symbol", "bar").distinct().select("symbol", "bar", F.lit(None).cast("double").alias("close"), F.lit(1).alias("asks"))
    known = bars.select("symbol", F.col("time").alias("bar"), F.col("close").cast("double").alias("close"), F.lit(0).alias("asks"))
    # A bar comes before a question about the same hour.
    so_far = Window.partitionBy("symbol").orderBy("bar", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(known).withColumn("close", F.last("close", ignorenulls=True).over(so_far)).where("asks = 1").drop("asks")
    return rows.join(found, ["symbol", "bar"], "left").drop("bar")


def _event_times(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), B.epoch(F.col("ts")).alias("time"))


@query("jn_14_as_of", _as_of_sql(""))
def jn_14(spark, sf_dir):
    """Each event with the close of the last hour completed before it."""
    return as_of(_event_times(spark, sf_dir), B.event_bars(spark, sf_dir)).select("event_id", "close")


@query("agg_08_latest_signals", f"WITH {DAYS}, {B.latest_sql('supplier_days', 60)}, s AS (SELECT *, coalesce(close > 1.5 * {S.lag_sql('close')}, false) AS sig FROM c) SELECT symbol, CAST(coalesce(max(CASE WHEN sig AND back <= 5 THEN i END), 0) AS BIGINT) AS recent, CAST(coalesce(max(CASE WHEN sig THEN i END), 0) AS BIGINT) AS ever, CAST(count(*) FILTER (sig AND back <= 10) AS BIGINT) AS in_ten FROM s GROUP BY symbol")
def agg_08(spark, sf_dir):
    """Also AGG-09 and AGG-11."""
    c = B.latest(B.supplier_days(spark, sf_dir), 60).withColumn("sig", F.coalesce(F.col("close") > 1.5 * S.back(F.col("close")), F.lit(False)))
    recent, ever = R.last_within(F.col("sig"), 5)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return c.groupBy("symbol").agg(zero(recent).alias("recent"), zero(ever).alias("ever"), F.count(F.when(F.col("sig") & (F.col("back") <= 10), 1)).alias("in_ten"))


@query("set_01_symbols", f"WITH {B.UNIVERSE}, {COINS}, s AS (SELECT symbol, ordinal AS k FROM universe UNION ALL SELECT 'C' || id || '-USD', 1000000000 + id FROM coins UNION ALL SELECT symbol, 2000000000 + ordinal FROM universe) SELECT symbol, CAST(min(k) AS BIGINT) AS ordinal FROM s GROUP BY symbol")
def set_01(spark, sf_dir):
    """Also SET-02 and LIM-07: the union of stocks and coins without repeats, each at its first place."""
    u, c = B.universe(spark, sf_dir).select("symbol", "ordinal"), coins(spark, sf_dir)
    coin = c.select(R.normal_crypto(F.col("raw")).alias("symbol"), (F.col("id") + 1_000_000_000).alias("ordinal"))
    again = u.select("symbol", (F.col("ordinal") + 2_000_000_000).alias("ordinal"))
    return u.unionByName(coin).unionByName(again).groupBy("symbol").agg(F.min("ordinal").alias("ordinal"))


@query("lim_01_first_symbols", f"WITH {B.UNIVERSE} SELECT symbol, sector, CAST(CASE sector WHEN 'REGION_2' THEN 1 WHEN 'REGION_0' THEN 2 ELSE 3 END AS BIGINT) AS place FROM universe ORDER BY ordinal LIMIT 25")
def lim_01(spark, sf_dir):
    """Also LIM-09: the first symbols in the order of the universe, and where a sector stands in a given list."""
    place = F.array_position(F.array(F.lit("REGION_2"), F.lit("REGION_0")), F.col("sector"))
    return R.in_order(B.universe(spark, sf_dir), 25).select("symbol", "sector", F.when(place > 0, place).otherwise(3).cast("long").alias("place"))


_WORDS = " ".join(f"WHEN {' OR '.join(f'''contains(d, '{w}')''' for w in words)} THEN '{name}'" for name, words in R.SECTOR_WORDS)
_GROUPS = " ".join(f"WHEN m IN ({', '.join(map(str, g))}) THEN '{name}'" for name, g in R.SECTOR_GROUPS)


@query("sc_05_sectors", f"WITH p AS (SELECT p_partkey AS id, upper(p_name) AS d, CAST(CAST(p_partkey * 37 % 10000 AS VARCHAR) AS INT) // 100 AS m FROM part), x AS (SELECT id, m, CASE id % 12 WHEN 0 THEN 'Natural Gas ' WHEN 1 THEN 'Savings bank ' WHEN 2 THEN 'Retail ' ELSE '' END || d AS d0 FROM p), y AS (SELECT id, m, upper(d0) AS d FROM x) SELECT id, CASE {_WORDS} {_GROUPS} ELSE 'Other' END AS sector FROM y")
def sc_05(spark, sf_dir):
    p, k = B.table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(F.when(k % 12 == 0, "Natural Gas ").when(k % 12 == 1, "Savings bank ").when(k % 12 == 2, "Retail ").otherwise(""), F.col("p_name"))
    return p.select(k.alias("id"), R.sector((k * 37 % 10000).cast("string"), text).alias("sector"))


@query("sc_08_formats", """WITH p AS (SELECT p_partkey AS id, (p_retailprice + 0.003) * pow(10, p_partkey % 11 - 2) AS x FROM part), u AS (SELECT id, x, CASE WHEN x >= 1e12 THEN 1e12 WHEN x >= 1e9 THEN 1e9 WHEN x >= 1e6 THEN 1e6 WHEN x >= 1e3 THEN 1e3 ELSE 1 END::DOUBLE AS unit FROM p),
h AS (SELECT id, x, unit, CAST(floor(x / unit * 100 + 0.5) AS HUGEINT) AS n FROM u)
SELECT id, CASE WHEN unit = 1 AND x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE n // 100 || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') END || CASE unit WHEN 1e12 THEN 'T' WHEN 1e9 THEN 'B' WHEN 1e6 THEN 'M' WHEN 1e3 THEN 'K' ELSE '' END AS compact,
concat_ws(' | ', 'RSI (14)', CASE WHEN id % 2 = 0 THEN 'Oversold' END, 'Last ' || (id % 3 + 1) || CASE WHEN id % 3 = 0 THEN ' Candle' ELSE ' Candles' END) AS sticker, sha256('s' || id) AS digest FROM h""")
def sc_08(spark, sf_dir):
    """Also SC-09, SC-10, SC-27 and PRJ-06: compact numbers, rounded half up, stickers and digests of all parts."""
    return _formats(B.table(spark, sf_dir, "part"))


def _formats(p):
    k = F.col("p_partkey")
    x = (F.col("p_retailprice") + 0.003) * F.pow(F.lit(10.0), k % 11 - 2)
    sticker = F.concat_ws(" | ", F.lit("RSI (14)"), F.when(k % 2 == 0, "Oversold"), F.concat(F.lit("Last "), k % 3 + 1, F.when(k % 3 == 0, " Candle").otherwise(" Candles")))
    return p.select(k.alias("id"), R.compact(x).alias("compact"), sticker.alias("sticker"), F.sha2(F.concat(F.lit("s"), k), 256).alias("digest"))


@query("sc_28_json_payloads", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, regexp_replace('token=' || event_id || '&x=1', 'token=[^&]*', 'token=***') AS url FROM events")
def sc_28(spark, sf_dir):
    """Also SC-11 and SC-29."""
    e = B.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.regexp_replace(F.concat(F.lit("token="), F.col("event_id"), F.lit("&x=1")), "token=[^&]*", "token=***").alias("url"))
