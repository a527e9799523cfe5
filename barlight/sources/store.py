"""A store of bars by date: read newest first, and only as far back as a number of bars needs.

Bars lie in folders of SPAN days each (span=K, days since 1970 over SPAN). Beside them is how many bars each symbol has in each
span, a table that is smaller by about a bar's size times SPAN; from it the spans are known that hold a symbol's last bars, before any bar is
read. The list of spans (one for each folder at most) becomes a filter on the partition column, so other folders are not even
listed. Batches are merged span by span: only spans that a batch touches are written anew.
"""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.sources import bars as B

#: Days in a folder.
SPAN = 32
#: Days that a plan reads besides those it counts on, as a number and as a part of the bars asked for, and its longest.
PADDING, COIN_PADDING, PADDING_RATIO, MOST_DAYS = 8, 2, 0.25, 800
#: Days of trading in a unit, of stocks and of coins.
UNITS = {"d": (1, 1), "w": (5, 7), "mo": (21, 30)}
BARS = "symbol string, time long, open double, high double, low double, close double, volume double"


def source_days(n: int, amount: int = 1, unit: str = "d", crypto: bool = False) -> int:
    """Daily bars that n bars of so many units are made of."""
    return n * max(1, amount * UNITS[unit][crypto]) if unit in UNITS else n


def candidate_dates(n: int, amount: int = 1, unit: str = "d", crypto: bool = False, until: date | None = None) -> list[date]:
    """The days to read for the last n bars, newest first: as many as they are made of and some more; stocks have none at weekends."""
    spare = COIN_PADDING if crypto and (amount, unit) == (1, "d") else max(COIN_PADDING if crypto else PADDING, math.ceil(n * PADDING_RATIO))
    most, out, day = min(MOST_DAYS, source_days(n, amount, unit, crypto) + spare), [], until or date.today()
    while len(out) < most:
        if crypto or day.weekday() < 5:
            out.append(day)
        day -= timedelta(days=1)
    return out


def _with_span(bars: DataFrame) -> DataFrame:
    return bars.withColumn("span", F.floor(F.col("time") / (86400 * SPAN)).cast("int"))


def put(bars: DataFrame, folder: str) -> None:
    """Merges bars into the store: of bars with the same symbol and time the new one stays. Spans without new bars are not read."""
    spark = bars.sparkSession
    new = _with_span(bars.select(*[c.split()[0] for c in BARS.split(", ")]))
    old, rest = stored(spark, folder), [c for c in new.columns if c not in ("symbol", "time", "span")]
    spans = None
    if old is not None:
        spans = [r.span for r in new.select("span").distinct().collect()]  # a number for each folder
        new = old.where(F.col("span").isin(spans)).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # One file or few in a folder, whatever the number of tasks; bars meet their later versions on the same exchange.
    new = new.repartition("span")
    if old is not None:
        new = new.groupBy("symbol", "time", "span").agg(*[F.max_by(c, "_new").alias(c) for c in rest])
    # Folders are replaced when all are written, so those being read may be written.
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span").parquet(f"{folder}/bars")
    merged = stored(spark, folder)
    counts = (merged if spans is None else merged.where(F.col("span").isin(spans))).groupBy("symbol", "span").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span").parquet(f"{folder}/counts")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """All bars of a store, none if there is no store yet."""
    return spark.read.schema(f"{BARS}, span int").parquet(f"{folder}/bars") if _there(spark, f"{folder}/bars") else None


def latest(spark: SparkSession, folder: str, n: int, symbols: DataFrame | None = None, since: date | None = None) -> DataFrame:
    """B.latest(n) of the stored bars, of those symbols (a column symbol) and since that day if given. Only spans are read in which
    one of the symbols has one of its last n bars, and of these only the symbols' own bars from their first such span on."""
    counts = spark.read.schema("symbol string, n long, span int").parquet(f"{folder}/counts")
    if since is not None:
        counts = counts.where(F.col("span") >= (since - date(1970, 1, 1)).days // SPAN)
    if symbols is not None:
        counts = counts.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    later = F.coalesce(F.sum("n").over(Window.partitionBy("symbol").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = counts.withColumn("later", later).where(F.col("later") < n)
    spans = [r.span for r in needed.select("span").distinct().collect()]  # a number for each folder
    first = needed.groupBy("symbol").agg(F.min("span").alias("first"))
    bars = stored(spark, folder).where(F.col("span").isin(spans)).join(first, "symbol").where(F.col("span") >= F.col("first")).drop("span", "first")
    if since is not None:
        bars = bars.where(F.col("time") >= (since - date(1970, 1, 1)).days * 86400)
    return B.latest(bars, n)


def latest_of(spark: SparkSession, folder: str, n: int, amount: int, unit: str, crypto: bool = False, until: date | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """The last n bars of so many units, rolled up from the days that candidate_dates() names; days outside of them are not read."""
    from barlight.operators import relational as R

    days = latest(spark, folder, MOST_DAYS, symbols, candidate_dates(n, amount, unit, crypto, until)[-1])
    return B.latest(B.rolled_up(days.drop("i", "back"), R.calendar_bucket(F.col("time"), amount, unit)), n)
