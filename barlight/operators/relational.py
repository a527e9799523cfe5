"""Relational operators around the bar tables: universe filters, lookups, upserts, session and calendar buckets, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The trading session of the exchange, in minutes of the local day, and seconds kept by timeframe.
ZONE, OPEN, CLOSE = "America/New_York", 570, 960
RETENTION = {"1h": 172_800, "4h": 604_800, "1day": 2_592_000}
QUOTES = ["USDT", "USDC", "FDUSD", "BUSD", "USD"]


def local(time: Column) -> Column:
    """Epoch seconds as the exchange's wall clock (a timestamp without zone, so the session's zone has no part in it)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc(time))


def utc(time: Column) -> Column:
    """Epoch seconds as UTC wall clock without zone."""
    return F.timestamp_add("SECOND", F.pmod(time, F.lit(86400)).cast("int"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(time / 86400).cast("int")).cast("timestamp_ntz"))


def minute_of_day(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def in_session(time: Column) -> Column:
    """Whether a bar opens on a weekday from 09:30 to before 16:00 on the exchange's clock."""
    t = local(time)
    return F.dayofweek(t).between(2, 6) & (minute_of_day(t) >= OPEN) & (minute_of_day(t) < CLOSE)


def session_bucket(time: Column, minutes: int) -> Column:
    """Start of the bucket of a bar in session, counted from the session's open."""
    t = local(time)
    into = (minute_of_day(t) - OPEN) * 60 + F.second(t)
    return (time - F.pmod(into, F.lit(minutes * 60))).cast("long")


def ordinal(time: Column) -> Column:
    """Days since 0001-01-01 is day 1."""
    return F.floor(time / 86400) + 719_163


def calendar_bucket(time: Column, amount: int, unit: str) -> Column:
    """Number of the block of days, weeks or months that a bar falls in."""
    day = ordinal(time)
    if unit == "d":
        return F.floor(day / amount)
    if unit == "w":
        return F.floor((day - F.pmod(day - 1, F.lit(7))) / (7 * amount))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(time / 86400).cast("int"))
    return F.floor((F.year(date) * 12 + F.month(date) - 1) / amount)


def calendar_close(time: Column, amount: int, unit: str) -> Column:
    """Epoch seconds at which the calendar block of a bar ends: a block from its own week or month on, or a fixed block of days."""
    day = F.floor(time / 86400)
    if unit == "d":
        return ((F.floor((day + 719_163) / amount) + 1) * amount - 719_163) * 86400
    if unit == "w":
        return (day - F.pmod(day + 3, F.lit(7)) + 7 * amount) * 86400
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return F.unix_date(F.add_months(F.trunc(date, "month"), amount)).cast("long") * 86400


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys. One aggregation, no join."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("row")).select(*keys, "row.*")


def interest_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest request and the earliest refresh of each symbol and timeframe."""
    return old.unionByName(new).groupBy("symbol", "timeframe").agg(F.max("last_requested_at").alias("last_requested_at"), F.min("next_refresh_at").alias("next_refresh_at"))


def pruned(interest: DataFrame, now: int) -> DataFrame:
    keep = F.create_map(*[F.lit(x) for kv in RETENTION.items() for x in kv])
    return interest.where(F.lit(now) - F.col("last_requested_at") <= F.try_element_at(keep, F.col("timeframe")))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def price_between(price: Column, low: float | None, high: float | None) -> Column:
    ok = price.isNotNull()
    ok = ok & (price >= low) if low is not None else ok
    return ok & (price <= high) if high is not None else ok


def overlaps(have: Column, wanted: list[str]) -> Column:
    """True if nothing is asked for, else whether any is there."""
    return F.coalesce(F.arrays_overlap(have, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)


def normal_crypto(symbol: Column) -> Column:
    """BASE-USD of any way to write a coin's pair with USD; empty where no base is left."""
    s = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    s = F.when(s.rlike(r"^X:.+USD$"), F.regexp_extract(s, r"^X:(.+)USD$", 1)).otherwise(F.regexp_replace(s, r"[-/_:]USD$", ""))
    base = F.regexp_replace(s, r"[^A-Z0-9]", "")
    return F.when(base == "", "").otherwise(F.concat(base, F.lit("-USD")))


def compact(x: Column) -> Column:
    """A number as 1.23K, 1.23M, 1.23B or 1.23T, rounded half up; whole numbers under a thousand have no decimals."""
    a, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    unit, mark = F.lit(1.0), F.lit("")
    for size, name in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        unit, mark = F.when(a >= size, F.lit(size)).otherwise(unit), F.when(a >= size, F.lit(name)).otherwise(mark)
    n = F.floor(a / unit * 100 + 0.5).cast("long")
    two = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.concat(sign, F.when((a < 1e3) & (a == F.floor(a)), F.floor(a).cast("string")).otherwise(two), mark)


# Words of an industry's description that decide its sector, in this order, then major groups of its code.
SECTOR_WORDS = [
    ("Technology", ["COMPUTER", "SOFTWARE", "SEMICONDUCTOR"]),
    ("Healthcare", ["PHARMACEUTICAL", "MEDICAL", "SURGICAL", "HEALTH", "HOSPITAL"]),
    ("Financials", ["BANK", "FINANCE", "INSURANCE", "INVESTMENT"]),
    ("Real Estate", ["REAL ESTATE", "REIT"]),
    ("Communication Services", ["TELEPHONE", "COMMUNICATION", "BROADCAST", "CABLE"]),
    ("Energy", ["OIL", "GAS", "PETROLEUM", "COAL"]),
    ("Utilities", ["ELECTRIC", "WATER", "UTILITY"]),
    ("Consumer Defensive", ["FOOD", "BEVERAGE", "TOBACCO"]),
    ("Consumer Cyclical", ["RETAIL", "APPAREL", "RESTAURANT", "HOTEL"]),
    ("Basic Materials", ["MINING", "METAL", "CHEMICAL"]),
]
SECTOR_GROUPS = [
    ("Technology", [35, 36, 37, 48, 73]),
    ("Energy", [28, 29]),
    ("Financials", [60, 61, 62, 63, 64, 65, 67]),
    ("Consumer Defensive", [20, 21]),
    ("Consumer Cyclical", [22, 23, 25, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59]),
    ("Basic Materials", [10, 11, 12, 13, 14]),
    ("Healthcare", [38]),
    ("Utilities", [49]),
    ("Industrials", [15, 16, 17, 30, 31, 32, 33, 34, 39, 40, 41, 42, 43, 44, 45, 46, 47, 80, 81, 82, 83, 84, 86, 87, 88, 89]),
]


def sector(code: Column, description: Column) -> Column:
    text = F.upper(F.coalesce(description, F.lit("")))
    major = F.floor(F.substring(F.trim(code), 1, 4).try_cast("int") / 100)
    tests = [(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), name) for name, words in SECTOR_WORDS]
    tests += [(F.coalesce(major.isin(groups), F.lit(False)), name) for name, groups in SECTOR_GROUPS]
    return F.coalesce(*[F.when(t, name) for t, name in tests], F.lit("Other"))


def audited(one: DataFrame, other: DataFrame, tolerance: float) -> DataFrame:
    """Two providers' bars side by side: whether each time is missing on a side, and whether closes agree."""
    a = one.select("symbol", "time", F.col("close").alias("one"))
    b = other.select("symbol", "time", F.col("close").alias("other"))
    x, y = F.col("one"), F.col("other")
    state = F.when(x.isNull(), "missing_one").when(y.isNull(), "missing_other").when(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)), "match").otherwise("differs")
    return a.join(b, ["symbol", "time"], "full_outer").withColumn("state", state)


def first_exclusion(stages: dict[str, Column]) -> Column:
    """Name of the first stage that a row fails, or included."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"excluded:{name}")) for name, ok in stages.items()], F.lit("included"))


def in_order(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("ordinal").limit(n) if n else df


def last_within(signal: Column, w: int) -> tuple[Column, Column]:
    """Aggregates by symbol: position of the latest signal in the last w bars, and of the latest ever."""
    return F.max(F.when(signal & (F.col("back") <= w), F.col("i"))), F.max(F.when(signal, F.col("i")))


def by_preference(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order given."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def prefiltered(wanted: DataFrame, seen: DataFrame, least: int) -> DataFrame:
    """wanted (symbol, ...) without symbols that are not in seen (symbol, distinct), if there are at least so many wanted and any
    seen at all; otherwise all of them. The two counts are one row each."""
    counts = wanted.agg(F.count(F.lit(1)).alias("n")).crossJoin(seen.agg(F.count(F.lit(1)).alias("m")))
    applies = counts.select(((F.col("n") >= least) & (F.col("m") > 0)).alias("applies"))
    marked = wanted.join(seen.withColumn("there", F.lit(True)), "symbol", "left").crossJoin(F.broadcast(applies))
    return marked.where(~F.col("applies") | F.col("there").isNotNull()).select(*wanted.columns)


def split_by_day(rows: DataFrame, train: int, validation: int) -> DataFrame:
    """rows (day, ...) with part: train for the first days that occur, validation for the next ones, null after. Only the distinct
    days, some hundreds a year, are ranked; Spark decides by their size how to join them."""
    rank = F.row_number().over(Window.orderBy("day"))
    days = rows.select("day").distinct().withColumn("k", rank)
    part = F.when(F.col("k") <= train, "train").when(F.col("k") <= train + validation, "validation")
    return rows.join(days, "day").withColumn("part", part).drop("k")
