"""What op10 sends when its filters are small for the tree: deeper runs only where both of their parts may be branches, few bytes a key."""

import random

import pytest

from barlight.llm import lm_scoring as L


@pytest.fixture(scope="module")
def docs(spark):
    r, rows = random.Random(10), []
    words = [f"w{k}" for k in range(3000)]
    lines = [" ".join(r.choices(words, k=12)) for _ in range(1500)]
    for k in range(800):
        rows.append((2 * k, " ".join(r.choices(lines, k=20))))
        rows.append((2 * k + 1, " ".join(r.choices(words, k=400))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def written(spark, docs):
    """MB that scoring shuffles, and its rows."""
    of = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = of()
    out = sorted(map(tuple, L.scored(docs).collect()))
    return (of() - before) / 1e6, out


def test_small_filters_send_little_more(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "USUAL", 100)
    roomy, want = written(spark, docs)
    monkeypatch.setattr(L.Filter.__init__, "__defaults__", (L.BUCKET,))
    small, got = written(spark, docs)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert small < 1.25 * roomy
