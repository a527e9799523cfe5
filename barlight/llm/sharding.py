"""Sharding by resharding: a minimum-cost flow from old shard sizes to new capacities says which blocks move where.

A dataset lies in old shards; new shards have capacities, near equal by default. A byte that stays in its shard costs nothing,
one that moves costs `cost(old, new)`, by default 1, so the flow moves the fewest bytes there can be. The flow is solved on the
driver over shard sizes alone (at most old plus new numbers). What a shard gives away is cut off its blocks in order: blocks
that lie inside one transfer move whole, only those that a transfer's end falls into are split, row by row. A row that lies
across such an end stays; further rounds solve the flow again for what is left and move small rows only, until shards are
within `tolerance` of their capacity. Until then no receiver gets too much, no row moves twice, and all rounds together move no
more than the first flow says. Only where shards hold so few rows that this does not come near, rows that a transfer's end
halves go where they bring both shards nearer to their capacity. Shards without capacity give all they have.

A block is a range of hashes of about sqrt(n) rows in tables, a file in stored shards. Rows are summed by block, blocks by
shard, so no task sees a whole shard, however large; only numbers by shard reach the driver. `rewritten` applies a plan to
stored shards: files without moving rows stay as they are, the others are written anew.

A size is the UTF-8 bytes of the text plus 16; a null text has none. Rows without doc_id are ordered first; rows that
agree in everything measured are told apart by a running number, so results do not depend on partitioning. Very long texts
are only measured: one above a shard's capacity stays where it is. An empty table gives an empty result. Further columns, whatever
their names, are read only when files are rewritten.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlight.llm.tables import deleted, read, saved, shared_folder

SHARDS, OLD_SHARDS, OVERHEAD = 40, 32, 16
TOLERANCE = 0.001
#: By round: which rows a transfer takes, and how large they may be as a part of it (any in the first).
LATER = [("inside", 1), ("inside", 0.25), ("inside", 1), ("middle", 2), ("inside", 0.25), ("middle", 2)]
#: Rows that agree in everything measured are numbered in runs of this length.
RUN = 100_000


def moved_costs(old: int, new: int) -> int:
    return int(old != new)


def flow(sizes: dict[int, int], capacities: dict[int, int], cost: Callable[[int, int], int] = moved_costs) -> dict[tuple[int, int], int]:
    """The cheapest way to deal sizes to capacities (of the same total or more): units by (old, new). Successive shortest paths
    with potentials, for non-negative costs."""
    olds, news = sorted(k for k, v in sizes.items() if v), sorted(k for k, v in capacities.items() if v)
    source, sink = ("s", 0), ("t", 0)
    room: dict[tuple, dict[tuple, int]] = {source: {}, sink: {}}
    price: dict[tuple, int] = {}
    for i in olds:
        room[source]["o", i], room["o", i] = sizes[i], {}
    for j in news:
        room["n", j] = {sink: capacities[j]}
    for i in olds:
        for j in news:
            room["o", i]["n", j] = sizes[i]
            price[("o", i), ("n", j)], price[("n", j), ("o", i)] = cost(i, j), -cost(i, j)
    potential = dict.fromkeys(room, 0)
    while True:
        far, via, heap, done = {source: 0}, {}, [(0, source)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for v, left in room[u].items():
                if left > 0 and v not in done:
                    to = d + price.get((u, v), 0) + potential[u] - potential[v]
                    if to < far.get(v, to + 1):
                        far[v], via[v] = to, u
                        heapq.heappush(heap, (to, v))
        if sink not in far:
            break
        for u in room:
            potential[u] += far.get(u, far[sink])
        path = [sink]
        while path[-1] != source:
            path.append(via[path[-1]])
        steps = list(zip(path[1:], path, strict=False))
        units = min(room[u][v] for u, v in steps)
        for u, v in steps:
            room[u][v] -= units
            room[v][u] = room[v].get(u, 0) + units
    return {(i, j): room["n", j]["o", i] for i in olds for j in news if room["n", j].get(("o", i), 0) > 0}


def near_equal(total: int, shards: int) -> dict[int, int]:
    return {k: total // shards + (k < total % shards) for k in range(shards)}


def transfers(sizes: dict[int, int], capacities: dict[int, int], cost=moved_costs) -> dict[int, list[tuple[int, int]]]:
    """What each shard has to give away: (new shard, units), without what stays."""
    out: dict[int, list[tuple[int, int]]] = {}
    for (i, j), units in sorted(flow(sizes, capacities, cost).items()):
        if i != j:
            out.setdefault(i, []).append((j, units))
    return out


def in_range(hashed: Column, ranges: Column) -> Column:
    """The range, of so many, that a 64-bit hash falls into."""
    return F.least(F.floor((hashed.cast("double") + 9223372036854775808.0) / 18446744073709551616.0 * ranges).cast("long"), ranges.cast("long") - 1)


def _dealt(rows: DataFrame, gives: dict[int, list[tuple[int, int]]], limits: dict[int, int | None], order: list[str], takes: dict[int, str]) -> DataFrame:
    """rows with new values of shard: of each giving shard, the rows up to its limit are laid end to end, blocks in order, and a
    transfer takes those that lie inside its stretch, or those that begin there or have their middle there, as takes says."""
    spark, plan = rows.sparkSession, []
    for shard, parts in gives.items():
        at, stretches = 0, []
        for to, units in parts:
            stretches.append((at, at + units, to))
            at += units
        plan.append((shard, limits[shard], takes[shard], stretches))
    # As many rows as there are giving shards.
    plan = F.broadcast(spark.createDataFrame(plan, "shard int, limit long, takes string, stretches array<struct<lo: long, hi: long, to: int>>"))
    able = rows.join(plan, "shard", "left").withColumn("able", F.coalesce(F.col("stretches").isNotNull() & (F.col("limit").isNull() | (F.col("size") <= F.col("limit"))), F.lit(False)))
    sums = able.where("able").groupBy("shard", "block").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, "shard")
    blocks = blocks.withColumns({
        "whole": F.expr("get(filter(stretches, s -> s.lo <= before AND before + bytes <= s.hi), 0).to"),
        "cut": F.expr("exists(stretches, s -> s.lo < before + bytes AND before < s.hi)"),
    }).where("cut").select("shard", "block", "before", "whole")
    found = able.join(saved(blocks, "blocks"), ["shard", "block"], "left").withColumn("split", F.col("able") & F.col("before").isNotNull() & F.col("whole").isNull())
    kept = [c for c in rows.columns if c != "shard"]
    clear = found.where("not split").select(*kept, F.when(F.col("able"), F.coalesce("whole", "shard")).otherwise(F.col("shard")).alias("shard"))
    start = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = "get(filter(stretches, s -> CASE takes WHEN 'begin' THEN s.lo <= start AND start < s.hi WHEN 'middle' THEN s.lo <= start + size / 2 AND start + size / 2 < s.hi ELSE s.lo <= start AND start + size <= s.hi END), 0).to"
    split = found.where("split").withColumn("start", start).select(*kept, F.coalesce(F.expr(inside), F.col("shard")).alias("shard"))
    return clear.unionByName(split)


def balanced(rows: DataFrame, capacities: Callable[[int], dict[int, int]], order: list[str], cost=moved_costs, tolerance: float = TOLERANCE) -> DataFrame:
    """rows: a saved table with shard (int), block, size (long, above 0) and the columns of order, which tell rows of a block
    apart; capacities: of new shards, by the total size. Returns the rows, as a saved table, with new values of shard."""
    aim, seen = None, []
    for turn in range(len(LATER)):
        seen.append({r.shard: r.bytes for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()})
        sizes = seen[-1]
        aim = aim or capacities(sum(sizes.values()))
        near = tolerance * sum(sizes.values()) / max(1, len(aim))
        gives = transfers(sizes, aim, cost)
        forced = {k for k in gives if not aim.get(k)}
        gives = {k: v for k, v in gives.items() if k in forced or sum(units for _, units in v) > near}
        if not gives or seen[-3:].count(sizes) == 3:
            break
        # In the first round any row may move; later those that leave most of a transfer to others, those that just fit, and those
        # that bring both shards nearer to their capacity.
        most = {k: max(units for _, units in v) for k, v in gives.items()}
        takes = {k: "begin" if k in forced else LATER[turn][0] for k in gives}
        limits = {k: None if k in forced or not turn else max(1, int(most[k] * LATER[turn][1])) for k in gives}
        before, rows = rows, saved(_dealt(rows, gives, limits, order, takes), "resharded")
        if turn:
            deleted(before)
    return rows


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with slot: gapless from 0 in each shard, by block and then order. Rows are numbered within blocks, blocks by their counts."""
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("shard", "block", F.coalesce(first, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy(*order))
    return rows.withColumn("place", place).join(first, ["shard", "block"]).withColumn("slot", (F.col("first") + F.col("place") - 1).cast("long")).drop("first", "place")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def measured(df: DataFrame, old: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, shard (the old one), size, text_crc32, nr and h of each row, as a saved table. nr counts rows that agree in all
    else, which come as one row and its count through the shuffle; long runs of them are dealt out before they are numbered."""
    of = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), old.cast("int").alias("shard"), size_of(F.col(text)).alias("size"), F.crc32(of.cast("binary")).alias("text_crc32"))
    keys = rows.columns
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = each.where(f"n <= {RUN}").select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nr"))
    runs = each.where(f"n > {RUN}").select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run")).repartition(*keys, "run")
    many = runs.select(*keys, F.explode(F.sequence(F.col("run") * RUN + 1, F.least("n", (F.col("run") + 1) * RUN))).alias("nr"))
    return saved(few.unionByName(many).withColumn("h", F.xxhash64("doc_id", "size", "text_crc32", "nr")), "measured")


def by_hash(rows: DataFrame) -> DataFrame:
    """rows with block: ranges of h, about sqrt(n) of them in a shard of n rows."""
    ranges = rows.groupBy("shard").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("ranges"))
    ranges = rows.sparkSession.createDataFrame(ranges.collect(), ranges.schema)  # a row for each shard
    return rows.drop("block").join(F.broadcast(ranges), "shard").withColumn("block", in_range(F.col("h"), F.col("ranges"))).drop("ranges")


ORDER = ["h", "doc_id", "size", "text_crc32", "nr"]


def resharded(df: DataFrame, old: Column, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (int) and slot (long) of each row of df, which now lies in shard old; shards of near equal size."""
    rows = measured(df, old, doc_id, text)
    first = saved(by_hash(rows), "by-hash")
    deleted(rows)
    out = balanced(first, lambda total: near_equal(total, shards), ORDER)
    return slots(by_hash(out), ORDER).select("doc_id", "size", "text_crc32", "shard", "slot")


def rewritten(spark: SparkSession, folder: str, shards: int, to: str, text: str = "text", cost=moved_costs) -> dict[int, list[str]]:
    """Reshards Parquet files stored as folder/shard=K/*.parquet, and returns the files or folders that make up each shard afterwards.

    Files of which no row moves stay in place, those that move whole are only named under their new shard, and those that are
    split are written anew, below the folder to. Nothing is deleted: the old layout holds until the caller takes the new one."""
    stored = spark.read.parquet(folder)
    at = F.col("_metadata.file_path")
    rows = stored.select(F.col("shard").cast("int").alias("shard"), size_of(F.col(text)).alias("size"), at.alias("block"), F.col("_metadata.row_index").alias("nr"))
    rows = saved(rows.withColumn("old", F.col("shard")), "stored")
    new = balanced(rows, lambda total: near_equal(total, shards), ["nr"], cost)
    goes = saved(new.groupBy("block").agg(F.min("old").alias("old"), F.min("shard").alias("first"), F.max("shard").alias("last")), "files")
    out: dict[int, list[str]] = {k: [] for k in range(shards)}
    for r in goes.where("first = last").select("block", "first").toLocalIterator():  # one at a time
        out[r["first"]].append(r.block)
    split = goes.where("first < last").select("block")
    texts = stored.withColumn("_file", F.struct(at.alias("block"), F.col("_metadata.row_index").alias("nr"))).drop("shard")
    texts = texts.join(split.select(F.struct("block").alias("_split")), F.col("_file.block") == F.col("_split.block"), "left_semi")
    moved = new.join(split, "block").select(F.struct("block", "nr", "shard").alias("_to"))
    texts.join(moved, (F.col("_file.block") == F.col("_to.block")) & (F.col("_file.nr") == F.col("_to.nr"))).withColumn("shard", F.col("_to.shard")).drop("_file", "_to").repartition("shard").write.partitionBy("shard").parquet(to)
    for r in spark.read.parquet(to).select("shard").distinct().collect():
        out[r.shard].append(f"{to}/shard={r.shard}")
    return out


def op13_sharding(spark, sf_dir, shards: int = SHARDS, old_shards: int = OLD_SHARDS):
    """The documents, dealt by their source to 32 old shards of very unequal size, in 40 shards of near equal size."""
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(old_shards))
    out = resharded(read(spark, sf_dir, "documents"), old, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
