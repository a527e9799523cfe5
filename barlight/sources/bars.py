"""Bar tables: (symbol, time in epoch seconds UTC, open, high, low, close, volume), built from raw rows or provider rows.

Every bar table comes from one aggregation by (symbol, time) with map-side partial aggregates; the series operators after it
share one exchange by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BARS = 500
PRICES = ["open", "high", "low", "close"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's time zone."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def ohlcv(rows: DataFrame, symbol: Column, time: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    """Bars of raw trades: first, highest, lowest, last price in the order given, and the sum of volumes. The order is one
    number, unlike within a bar, so that all aggregates have buffers of fixed width and are made by hash, without a sort."""
    flat = rows.select(symbol.alias("symbol"), time.alias("time"), price.alias("p"), F.coalesce(volume, F.lit(0.0)).alias("v"), order.alias("k"))
    return flat.groupBy("symbol", "time").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("v").alias("volume"))


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a bar's rows the order is that of ship date, order and line: seconds of the day, 42 bits for the order, 4 for the line."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    price, at = F.col("l_extendedprice") / F.col("l_quantity"), epoch(F.col("l_shipdate"))
    order = F.shiftleft(at % 86400, 46) + F.shiftleft(F.col("l_orderkey").cast("long"), 4) + F.col("l_linenumber")
    return ohlcv(rows, F.col("l_suppkey").cast("string"), F.unix_date(F.to_date("l_shipdate")).cast("long") * 86400, price, F.col("l_quantity"), order)


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 3600, symbol: str = "event_type") -> DataFrame:
    """Of a bar's events, of a day at most, the order is that of time in microseconds, then of the id's last 24 bits."""
    rows = table(spark, sf_dir, "events")
    ts = F.col("ts")
    micros = (epoch(ts) % 86400) * 1_000_000 + ((F.date_part(F.lit("SECOND"), ts) - F.second(ts)) * 1_000_000).cast("long")
    return ohlcv(rows, F.col(symbol).cast("string"), F.floor(epoch(ts) / seconds).cast("long") * seconds, F.col("value"), F.lit(1.0), F.shiftleft(micros, 24) + F.pmod(F.col("event_id").cast("long"), F.lit(1 << 24)))


def sanitized(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Without bars whose high or low contradict open and close; of bars with the same symbol and time the last one ingested."""
    sound = rows.where((F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.col("high")))
    last = sound.groupBy("symbol", "time").agg(F.max_by(F.struct(*PRICES, "volume"), sequence).alias("bar"))
    return last.select("symbol", "time", "bar.*")


def number(x: Column, default: float | None = None) -> Column:
    """x as a finite number; the default where it is none."""
    v = x.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(ok, v).otherwise(F.lit(default).cast("double"))


def provider_rows(rows: DataFrame) -> DataFrame:
    """Bars of provider objects t (ms), o, h, l, c, v: rows whose t or a price is missing or no number go, such a volume is 0."""
    cells = rows.select("symbol", F.floor(number(F.col("t")) / 1000).cast("long").alias("time"), *[number(F.col(c[0])).alias(c) for c in PRICES], number(F.col("v"), 0.0).alias("volume"))
    return cells.dropna(subset=["time", *PRICES])


def kline_rows(rows: DataFrame) -> DataFrame:
    """Bars of positional arrays of strings [t, o, h, l, c, v, ...]; shorter arrays go, and those with a cell that is no number."""
    cell = lambda i: number(F.get("row", F.lit(i)))
    cells = rows.where(F.size("row") >= 6).select("symbol", F.floor(cell(0) / 1000).cast("long").alias("time"), *[cell(i).alias(c) for i, c in enumerate([*PRICES, "volume"], 1)])
    return cells.dropna()


def latest(bars: DataFrame, n: int = MAX_BARS) -> DataFrame:
    """The last n bars of each symbol, numbered i = 1, 2, ... by time and back = 1, 2, ... from the last."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("time").desc()))
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("time"))
    return bars.withColumn("back", back).where(F.col("back") <= n).withColumn("i", i)


#: A bar is forming if one of the first four is false or the last is true; null, or no such column, says nothing.
FLAGS = {"is_closed": False, "is_complete": False, "complete": False, "closed": False, "is_live": True}


def completed(bars: DataFrame) -> DataFrame:
    """Bars that no flag calls forming, without the flags."""
    out = bars
    for flag, forming in FLAGS.items():
        if flag in bars.columns:
            out = out.where(~F.col(flag).eqNullSafe(F.lit(forming)))
    return out.drop(*FLAGS)


def rolled_up(bars: DataFrame, bucket: Column) -> DataFrame:
    """Bars of daily bars: time and open of the oldest, close of the newest in each bucket."""
    keyed = bars.withColumn("bucket", bucket)
    out = keyed.groupBy("symbol", "bucket").agg(F.min("time").alias("time"), F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"))
    return out.drop("bucket")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments: suppliers with their nation as exchange and region as sector. The two dimensions have at most a few
    dozen rows, so Spark broadcasts them by its own size check."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    status = F.when(F.col("s_acctbal") < 0, "NON_COMPLIANT").when(F.col("s_acctbal") < 1000, "QUESTIONABLE").otherwise("COMPLIANT")
    return joined.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("name"), F.col("n_name").alias("exchange"), F.col("r_name").alias("sector"), status.alias("status"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("shares_outstanding"))


# The same tables as DuckDB SQL.
SUPPLIER_DAYS = """supplier_days AS (
  SELECT symbol, time, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(v) AS volume
  FROM (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) AS time,
               l_extendedprice / l_quantity AS p, l_quantity AS v,
               row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS k
        FROM lineitem WHERE l_quantity > 0)
  GROUP BY symbol, time)"""


def event_sql(seconds: int = 3600, symbol: str = "event_type", name: str = "event_bars") -> str:
    return f"""{name} AS (
  SELECT symbol, time, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM (SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(floor(epoch(ts)) AS BIGINT) // {seconds} * {seconds} AS time, value AS p, row(ts, event_id) AS k FROM events)
  GROUP BY symbol, time)"""


def latest_sql(source: str, n: int = MAX_BARS, name: str = "c") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM {source}) WHERE back <= {n})"""


UNIVERSE = """universe AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_suppkey AS ordinal, s_name AS name, n_name AS exchange, r_name AS sector,
         CASE WHEN s_acctbal < 0 THEN 'NON_COMPLIANT' WHEN s_acctbal < 1000 THEN 'QUESTIONABLE' ELSE 'COMPLIANT' END AS status,
         CASE WHEN s_acctbal > 0 THEN s_acctbal END AS shares_outstanding
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
