"""Lines on volumes that end at exactly 0 cross it where their SQL, which rounds, says so."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.plans import rules


def made():
    """Bars of symbols with many six-bar lines that end at 0: 11a + 8b + 5c + 2d = e + 4f, newest first."""
    r, rows = random.Random(6), []
    for symbol in range(60):
        volumes = []
        while len(volumes) < 110:
            v = [r.randint(1, 30) for _ in range(4)] + [r.randint(1, 150), 0]
            rest = 11 * v[0] + 8 * v[1] + 5 * v[2] + 2 * v[3] - v[4]
            if rest > 0 and rest % 4 == 0:
                v[5] = rest // 4
                volumes += [float(x) for x in reversed(v)] + [float(r.randint(1, 60)) for _ in range(r.randint(0, 2))]
        rows += [(f"S{symbol}", 86400 * i, 1.0, 1.0, 1.0, 1.0, v, len(volumes) + 1 - i, i) for i, v in enumerate(volumes, 1)]
    return rows


def test_entries_as_in_sql(spark):
    rows = made()
    frame = pd.DataFrame(rows, columns=["symbol", "time", "open", "high", "low", "close", "volume", "back", "i"])
    over = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    duck = duckdb.connect()
    duck.register("c", frame)
    sql = f"WITH en AS (SELECT symbol, i, CASE WHEN i >= 6 THEN regr_intercept(volume, i) {over} + regr_slope(volume, i) {over} * i END AS m FROM c), el AS (SELECT *, {S.lag_sql('m')} AS p FROM en) SELECT symbol, i, m, coalesce(p <= 0 AND m > 0, false) FROM el ORDER BY ALL"
    want = {(s, i): (m, hit) for s, i, m, hit in duck.execute(sql).fetchall()}
    b = spark.createDataFrame(frame)
    b, hit, _ = rules.relative_volume(b, "_r0", rule="entry", lines=("ma4",))
    exact, rounded = (next(F.col(c) for c in b.columns if c.endswith(x)) for x in ("_ma4", "_end4"))
    got = {(r.symbol, r.i): r for r in b.select("symbol", "i", exact.alias("exact"), rounded.alias("rounded"), F.coalesce(hit, F.lit(False)).alias("hit")).collect()}
    zero = [k for k, r in got.items() if r.exact == 0]
    assert len(zero) > 900 and any(want[k][0] > 0 for k in zero)
    assert {k: r.hit for k, r in got.items()} == {k: hit for k, (_, hit) in want.items()}
    assert [got[k].rounded for k in zero] == [want[k][0] for k in zero]
