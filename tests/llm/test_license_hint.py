"""Sentences are found however their words are parted."""

import pytest

from barlight.llm import licenses


@pytest.mark.parametrize("gap", [" ", "\n", "-", "  \n  "])
def test_wrapped_public_domain(spark, gap):
    text = f"This is free and unencumbered software released into the public{gap}domain.\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scanned(df).first().licenses == ["Unlicense"]
