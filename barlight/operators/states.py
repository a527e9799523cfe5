"""Series with a state: averages seeded backwards, the volatility stop, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.operators.indicators import KEEP, folded


def backfilled_atr(ranges: Column, n: int) -> Column:
    """Wilder's average of true ranges; bars before the n-th carry its seed, a shorter series its running mean."""
    every = Window.partitionBy("symbol")
    seed = F.avg(F.when(F.col("i") <= n, ranges)).over(every)
    return F.when((F.count(ranges).over(every) > n) & (F.col("i") <= n), seed).otherwise(S.rma(ranges, n))


def pivots(span: int) -> tuple[Column, Column]:
    """Whether a bar's high (low) is strictly beyond those of the span bars before and not below (above) those after."""
    before, after = S.frame(-span, -1), S.frame(1, span)
    whole = (F.count("high").over(before) == span) & (F.count("high").over(after) == span)
    h, l = F.col("high"), F.col("low")
    high = whole & (h > F.max(h).over(before)) & (h >= F.max(h).over(after))
    low = whole & (l < F.min(l).over(before)) & (l <= F.min(l).over(after))
    return F.coalesce(high, F.lit(False)), F.coalesce(low, F.lit(False))


def volatility_stop(bars: DataFrame, n: int = 20, factor: float = 2.0, keep: list[str] = KEEP) -> DataFrame:
    """A trailing stop at the extreme since the last turn less (plus) the distance: factor times ATR, the true range before there is one."""
    of = "struct<hi:double,lo:double,stop:double,up:boolean>"

    def value(a):
        given = F.arrays_zip(a["x"].alias("x"), a["d"].alias("d"))

        def step(s, v, i):
            x, d = v["x"], v["d"]
            hi, lo = F.greatest(s["hi"], x), F.least(s["lo"], x)
            cand = F.when(s["up"], F.greatest(s["stop"], hi - d)).otherwise(F.least(s["stop"], lo + d))
            now = x >= cand
            same = now == s["up"]
            turned = F.when(now, x - d).otherwise(x + d)
            later = F.struct(F.when(same, hi).otherwise(x).alias("hi"), F.when(same, lo).otherwise(x).alias("lo"), F.when(same, cand).otherwise(turned).alias("stop"), now.alias("up"))
            return F.when(s.isNull(), F.struct(x.alias("hi"), x.alias("lo"), x.alias("stop"), F.lit(True).alias("up"))).otherwise(later)

        return {"state": S.scan(given, step, of)}

    b = bars.withColumn("_tr", S.true_range()).withColumn("_d", F.coalesce(S.seeded_rma(F.col("_tr"), n) * factor, F.col("_tr")))
    out = folded(b.withColumn("_x", F.col("close")), {"x": F.col("_x"), "d": F.col("_d")}, value, keep)
    return out.withColumns({"stop": F.col("state.stop"), "up": F.col("state.up")}).drop("state")
