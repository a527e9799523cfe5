"""Reading the input tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, one of our own in local mode; elsewhere an error, as
    executors don't see each other's local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="barlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: a lost executor costs no recomputation beyond this point."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barlight/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Removes saved() tables that nothing will read any more."""
    for table in tables:
        session = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def released(spark: SparkSession) -> None:
    """To be called after a large step. Spark removes the files of shuffles that no query can need any more when the driver's garbage
    is collected; this asks for it now, so that a chain of steps does not hold the shuffles of all of them on the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of a bounded number of rows, so that very long texts do not pile up in one batch. The setting is read when
    a query runs, so it stays lowered."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
