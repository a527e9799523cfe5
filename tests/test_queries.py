"""Every query of the engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from barlight.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def cell(v):
        if v is None or v != v:
            return None
        return float(f"{float(v):.6g}") + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return list(frame.columns), sorted((tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if n.startswith("screen_")])
def test_screens_say_something(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0

    assert set(e.oracle_sql()) <= set(e.queries()) and math.isfinite(len(e.queries()))
