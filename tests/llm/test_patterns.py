"""Every pattern that the JVM matches texts with, on texts that are one long run of what it repeats."""

import pytest
from pyspark.sql import functions as F

from barlight.llm import importance, mixing


@pytest.mark.parametrize("filler", ["\n", ". ", "a", "a ", "/", "é", "\U0001f600", "A_", "sk-", "\x00"])
def test_long_runs(spark, filler):
    df = spark.createDataFrame([(1, filler * 1_000_000)], "doc_id long, text string")
    got = df.select(mixing.n_words(F.col("text")), F.size(importance.words(F.col("text"))), F.size(F.regexp_extract_all("text", F.lit("[A-Za-z_-]{5,}"), F.lit(0)))).first()
    assert all(n >= 0 for n in got)
