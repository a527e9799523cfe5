"""Folders that the driver and all executors share, and reports written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the session names; where it names none, one of our own in local mode, elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="barlight-")
    return f"{folder.rstrip('/')}/barlight-{uuid.uuid4().hex}"


def reported(rows: DataFrame, folder: str) -> dict[str, str]:
    """Writes rows as JSON lines, as CSV with a header, and as the rows of a table in Markdown (bars in cells become slashes);
    returns the folder of each."""
    out = {kind: f"{folder}/{kind}" for kind in ("json", "csv", "md")}
    rows.write.json(out["json"])
    rows.write.option("header", True).csv(out["csv"])
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/")) for c in rows.columns]
    rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.text(out["md"])
    return out
