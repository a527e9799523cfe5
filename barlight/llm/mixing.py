"""Mixing sources to target weights, by hierarchical budgets over a tree (domain, language, source).

A node's budget of tokens goes to its children by weight, none above what lies below it (tokens times max_epochs). What a
child can't use goes to its siblings by weight; only when all of them are full does the parent take less, and its own
siblings get the rest. Each leaf then takes whole epochs, and of the next epoch a prefix: its documents in the order of a
seeded hash, as long as their tokens fit.

The prefix is found in two steps, so that no task sees a whole leaf: token sums of about sqrt(n) hash ranges, then single
documents of the one range in which the budget ends. Only sums and that range's rows are shuffled.

Nulls: a null level counts as '', a null text has no tokens, and rows without doc_id are ordered by a hash of their text. Children with weight 0 or less get nothing, and no budget is kept for them. Documents without tokens are taken if the
prefix reaches them; a very long one ends the prefix if it doesn't fit. Ties of the hash go by doc_id, then by a hash of the
whole row, so that the result does not depend on partitioning; repeated rows are documents of their own; an empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlight.llm.tables import read, saved

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Level:
    """A level of the tree: what a row belongs to (SQL), and the whole-numbered weights by value; other values have the default."""

    value: str
    weights: dict[str, int]
    default: int = 1

    def weight(self, of: Column) -> Column:
        out = F.lit(self.default)
        for k, v in self.weights.items():
            out = F.when(of == k, F.lit(v)).otherwise(out)
        return out.cast("long")


def shared_out(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """children: rows with parent, key, cap, w (above 0) and budget (the parent's). Adds got: budget by weight, at most cap, with
    what is left going to siblings. In whole tokens: those that rounding down leaves over go one each to the children with the
    largest remainders (ties by key). Exact in 64-bit integers, as long as tokens times the sum of weights stay below 9e18."""
    ordered = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), key)
    whole = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    out = children.withColumn("full", F.col("cap") * weights <= (F.col("budget") - before) * F.col("w"))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    out = out.withColumns({"rest": rest, "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)})
    out = out.withColumns({"share": F.when(~F.col("full"), F.expr("(rest * w) div open")), "over": F.when(~F.col("full"), F.expr("(rest * w) % open"))})
    left = F.col("rest") - F.sum("share").over(whole)
    place = F.row_number().over(Window.partitionBy(*parent).orderBy(F.col("over").desc_nulls_last(), key))
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") + (place <= left).cast("long"))
    return out.withColumn("got", got.cast("long")).drop("full", "w", "budget", "rest", "open", "share", "over")


def budgets(leaves: DataFrame, levels: list[Level], budget: int) -> DataFrame:
    """leaves: l0.., supply, n, cap. Adds got, the leaf's tokens. Leaves with a weight of 0 or less anywhere above them get nothing
    and are left out before any cap is summed, so that their share goes to siblings."""
    keys = [f"l{i}" for i in range(len(levels))]
    for key, level in zip(keys, levels, strict=True):
        leaves = leaves.where(level.weight(F.col(key)) > 0)
    above = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap")).select(F.lit(0).alias("root"), F.least(F.lit(budget).cast("long"), F.col("cap")).alias("budget"))
    for i, level in enumerate(levels):
        parent = ["root", *keys[:i]]
        below = leaves.withColumn("root", F.lit(0)).groupBy("root", *keys[: i + 1]).agg(F.sum("cap").alias("cap"))
        shared = shared_out(below.withColumn("w", level.weight(F.col(keys[i]))).join(above, parent), parent, keys[i])
        above = shared.select("root", *keys[: i + 1], F.col("got").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "got").drop("root"), keys)


def order_key(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """Of rows without doc_id the text decides."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))))


def planned(df: DataFrame, levels: list[Level], budget_share: float, max_epochs: int, seed: int, doc_id: str, text: str) -> DataFrame:
    """row, id, l0.. and copies: how often each row of df is taken (0: not at all)."""
    keys = [f"l{i}" for i in range(len(levels))]
    rows = df.select(*[F.coalesce(F.expr(v.value).cast("string"), F.lit("")).alias(k) for k, v in zip(keys, levels, strict=True)], F.struct("*").alias("row"))
    rows = rows.withColumns({"id": F.col("row")[doc_id], "tokens": n_words(F.col("row")[text])})
    leaves = saved(rows.groupBy(*keys).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n")), "leaves").withColumn("cap", F.col("supply") * max_epochs)
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    got = budgets(leaves, levels, int(total * budget_share))
    plan = saved(
        got.where("supply > 0 or n > 0").select(
            *keys, F.expr("if(supply > 0, got div supply, 0)").alias("epochs"), F.expr("if(supply > 0, got % supply, 0)").alias("rest"), F.ceil(F.sqrt("n")).alias("ranges"), (F.col("got") >= F.col("cap")).alias("all")
        ),
        "plan",
    )
    keyed = rows.join(plan.where("not `all`"), keys).withColumn("h", order_key(seed, F.col("epochs"), F.col("id"), F.col("row")[text]))
    keyed = keyed.withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * F.col("ranges") / 4294967296.0).cast("long"))
    sums = keyed.groupBy(*keys, "rest", "range").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("range"))
    ends = sums.withColumn("upto", upto).where("upto > rest").groupBy(*keys).agg(F.min(F.struct("range", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
    plan = saved(plan.join(ends, keys, "left").select(*keys, "epochs", "rest", "ranges", "all", F.col("end.range").alias("end_range"), F.col("end.before").alias("before")), "ends")
    flagged = rows.join(plan, keys, "left").withColumn("h", order_key(seed, F.col("epochs"), F.col("id"), F.col("row")[text]))
    flagged = flagged.withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * F.col("ranges") / 4294967296.0).cast("long"))
    at_end = F.coalesce(~F.col("all") & (F.col("range") == F.col("end_range")), F.lit(False))
    copies = F.when(F.col("epochs").isNull(), 0).when(F.col("all"), F.col("epochs")).otherwise(F.col("epochs") + F.when(F.col("end_range").isNull() | (F.col("range") < F.col("end_range")), 1).otherwise(0))
    clear = flagged.where(~at_end).select("row", "id", *keys, copies.cast("long").alias("copies"))
    running = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("h", "id", F.xxhash64(F.to_json("row"))).rowsBetween(Window.unboundedPreceding, 0))
    last = flagged.where(at_end).withColumn("sum", F.col("before") + running)
    return clear.unionByName(last.select("row", "id", *keys, (F.col("epochs") + (F.col("sum") <= F.col("rest")).cast("int")).cast("long").alias("copies")))


def mixed(df: DataFrame, levels: list[Level], budget_share: float, max_epochs: int = 4, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, each as often as the mix takes it."""
    return planned(df, levels, budget_share, max_epochs, seed, doc_id, text).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


#: The tree of the query and the pipeline. A domain is the source's number modulo 4.
DOMAIN = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})', 1) AS bigint) % 4, 0))"
LEVELS = [
    Level(DOMAIN, {"d0": 4, "d1": 3, "d2": 2, "d3": 1}),
    Level("lang", {"en": 5, "de": 2, "fr": 2, "es": 1}),
    Level("source", {"src0": 2}),
]
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.75, 4, 7


def op5_mixing(spark, sf_dir):
    out = planned(read(spark, sf_dir, "documents"), LEVELS, BUDGET_SHARE, MAX_EPOCHS, SEED, "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("l0").alias("domain"), F.col("l1").alias("lang"), F.col("l2").alias("source"), "copies")


def _fill(name: str, parent: str, level: str, weight: str, above: str) -> str:
    keys = f"{parent}, {level}" if parent else level
    part = f"PARTITION BY {parent}" if parent else ""
    join = f"JOIN {above} a USING ({parent})" if parent else f"CROSS JOIN {above} a"
    return f"""
{name}_c AS (SELECT {keys}, c.cap, {weight} AS w, a.budget FROM (SELECT {keys}, sum(cap)::HUGEINT AS cap FROM leaves GROUP BY ALL) c {join}),
{name}_f AS (SELECT *, cap * sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM {name}_c),
{name}_r AS (SELECT *, budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0) AS rest, sum(w) FILTER (NOT is_full) OVER ({part}) AS open_w FROM {name}_f),
{name}_s AS (SELECT *, CASE WHEN NOT is_full THEN (rest * w) // open_w END AS share, CASE WHEN NOT is_full THEN (rest * w) % open_w END AS remainder FROM {name}_r),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE share + CASE WHEN row_number() OVER ({part} ORDER BY remainder DESC NULLS LAST, {level}) <= rest - sum(share) OVER ({part}) THEN 1 ELSE 0 END END::BIGINT AS budget FROM {name}_s)"""


OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, 'd' || coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})', 1) AS BIGINT) % 4, 0) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, {MAX_EPOCHS} * sum(tokens)::BIGINT AS cap FROM docs GROUP BY ALL),
root AS (SELECT least(floor(sum(supply)::DOUBLE * {BUDGET_SHARE})::BIGINT, sum(cap))::BIGINT AS budget FROM leaves),
{_fill("b0", "", "domain", "CASE domain WHEN 'd0' THEN 4::HUGEINT WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 1 ELSE 1 END", "root")},
{_fill("b1", "domain", "lang", "CASE lang WHEN 'en' THEN 5::HUGEINT WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END", "b0")},
{_fill("b2", "domain, lang", "source", "CASE source WHEN 'src0' THEN 2::HUGEINT ELSE 1 END", "b1")},
plan AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest, budget >= cap AS is_all
  FROM leaves JOIN b2 USING (domain, lang, source)),
run AS (SELECT d.doc_id, domain, lang, source, epochs, rest, is_all,
  sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), doc_id) AS upto
  FROM docs d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, (epochs + CASE WHEN NOT is_all AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run
"""
