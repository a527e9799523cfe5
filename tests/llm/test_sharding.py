"""Resharding: the flow against all ways there are, the query against its contract, stored shards against their rows."""

import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barlight.llm import sharding as S
from barlight.llm.tables import read

SCHEMA = "doc_id long, text string, shard string, block string, size string"


def cheapest(sizes, capacities, cost):
    """The least cost over all ways to deal the units out one by one."""
    best = {tuple(capacities[k] for k in sorted(capacities)): 0}
    for i in sorted(sizes):
        for _ in range(sizes[i]):
            step = {}
            for room, paid in best.items():
                for k, j in enumerate(sorted(capacities)):
                    if room[k]:
                        to = (*room[:k], room[k] - 1, *room[k + 1 :])
                        step[to] = min(step.get(to, 1 << 60), paid + cost(i, j))
            best = step
    return min(best.values())


@pytest.mark.parametrize("cost", [S.moved_costs, lambda i, j: (i * 7 + j * 5) % 4, lambda i, j: abs(i - j)])
def test_flow_is_the_cheapest(cost):
    for sizes, capacities in itertools.product([{0: 4, 1: 1, 2: 0}, {0: 2, 1: 3, 3: 2}, {5: 6}], [{0: 3, 1: 2, 2: 3}, {1: 4, 2: 4}, {k: 2 for k in range(4)}]):
        found = S.flow(sizes, capacities, cost)
        for i, n in sizes.items():
            assert sum(x for (a, _), x in found.items() if a == i) == n
        assert all(sum(x for (_, b), x in found.items() if b == j) <= n for j, n in capacities.items())
        assert sum(x * cost(i, j) for (i, j), x in found.items()) == cheapest(sizes, capacities, cost)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = {r.doc_id: r for r in read(spark, f"/root/testdata/{sf}", "documents").collect()}
    got = S.op13_sharding(spark, f"/root/testdata/{sf}").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size = {i: len(r.text.encode()) + 16 for i, r in docs.items()}
    old = {i: zlib.crc32(r.source.encode()) % S.OLD_SHARDS for i, r in docs.items()}
    held, moved, slots = Counter(), 0, {}
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], zlib.crc32(docs[r.doc_id].text.encode()), "bytes", None)
        held[r.shard] += r.size
        moved += r.size * (r.shard != old[r.doc_id])
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(S.SHARDS))
    aim, before = sum(size.values()) / S.SHARDS, Counter()
    for i, k in old.items():
        before[k] += size[i]
    # Hardly more than the fewest bytes that an exact deal has to move, and no shard off by more than half the largest document.
    assert moved <= sum(max(0, before[k] - aim // 1) for k in before) + S.SHARDS * max(size.values()) / 4
    assert max(abs(held[k] - aim) for k in range(S.SHARDS)) <= max(size.values()) / 2


def test_tables_of_small_rows_are_dealt_evenly(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = S.resharded(df, F.when(F.col("doc_id") % 3 > 0, 1).otherwise(F.col("doc_id") % 7), 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    n = [r.n for r in got]
    assert len(n) == 5 and max(n) - min(n) <= 2 * S.TOLERANCE * sum(n) / 5 + 66


def test_fewer_shards_and_odd_rows(spark):
    rows = [(i, "w" * (i % 40), "a", "b", "c") for i in range(300)] + [(7, "same", None, None, None)] * 40 + [(None, None, None, None, None)] * 40 + [(None, "", None, None, None), (999, "long " * 50_000, "s", "b", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    old = F.pmod(F.coalesce(F.col("doc_id"), F.lit(3)), F.lit(9))
    one, two = (sorted(map(tuple, S.resharded(df.repartition(n), old, 4).collect()), key=repr) for n in (1, 7))
    assert one == two and len(one) == len(rows) and {r[3] for r in one} == {0, 1, 2, 3}
    for k in range(4):
        assert sorted(r[4] for r in one if r[3] == k) == list(range(sum(r[3] == k for r in one)))
    assert S.resharded(df.where("false"), old, 4).count() == 0


def test_rows_that_agree_in_all_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 10)
    df = spark.createDataFrame([(7, "same")] * 95 + [(8, "other")], "doc_id long, text string")
    got = S.measured(df, F.lit(0)).collect()
    assert sorted(r.nr for r in got if r.doc_id == 7) == list(range(1, 96)) and len(got) == 96


def test_stored_shards(spark, tmp_path):
    df = spark.range(3000).select("id", F.repeat(F.lit("y"), (F.col("id") % 90).cast("int")).alias("text"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 4).cast("int").alias("shard"))
    df.repartition(6).write.partitionBy("shard").parquet(f"{tmp_path}/old")
    parts = S.rewritten(spark, f"{tmp_path}/old", 5, f"{tmp_path}/new")
    rows, sizes = [], {}
    for k, paths in parts.items():
        found = [r for p in paths for r in spark.read.parquet(p).select("id", "text").collect()]
        sizes[k] = sum(len(r.text) + 16 for r in found)
        rows += [(r.id, r.text) for r in found]
    assert sorted(rows) == sorted((r.id, r.text) for r in df.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * S.TOLERANCE * sum(sizes.values()) / 5 + 106
    kept = [p for paths in parts.values() for p in paths if "/old/" in p]
    assert kept, "files without moving rows stay"
