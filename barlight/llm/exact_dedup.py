"""Exact dedup. Two passes with a Bloom filter: the first finds which filter positions more than one row falls on,
the second sends only the rows on such positions through a shuffle; all others pass straight through.

The first pass has to bring equal positions together, so it shuffles two numbers a row (combined before where they repeat),
never digests or rows. The filter has 16 bits a row, up to max_bits (by default 256 MB, enough for 134 million rows; the
bound of what is broadcast). Beyond that it fills up and more rows are candidates, with the same results: the exact way for
all of them is the join by digest that candidates take anyway. Copies are found by the SHA-256 of their text. Digests are
made once, in a saved table; whole rows are read only to be passed on.

Nulls: a null text counts as empty; rows without doc_id are ordered below all others. Of repeated rows (same text and
doc_id) one stays; where such rows differ in other columns, the one whose JSON has the least hash. Very long texts are only
digested. An empty table gives an empty result. Other columns pass through untouched, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlight.llm.tables import read, saved

BUCKET = 32768
MAX_BITS = 1 << 31


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def positions(digest: Column, bits: int) -> list[Column]:
    """Two filter positions, counted from 1 as Spark's bitmap functions do."""
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) + 1 for k in (1, 2)]


def bitmaps(at: DataFrame) -> DataFrame:
    """Filter positions as bitmaps of BUCKET positions each."""
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def filter_bits(n: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, BUCKET * max(1, -(-16 * n // BUCKET)))


def all_positions(digests: DataFrame, bits: int) -> DataFrame:
    return digests.select(F.explode(F.array(*positions(F.col("digest"), bits))).alias("at"))


def repeated_positions(digests: DataFrame, bits: int) -> DataFrame:
    """Filter positions that are seen again: those that at least two rows fall on."""
    return all_positions(digests, bits).groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("at")


def _is_set(bits: Column, at: Column) -> Column:
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1, F.lit(False))


def digests(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id and digest of each row of df, as a saved table."""
    return saved(df.select(F.col(doc_id).alias("id"), text_digest(F.col(text)).alias("digest")), "digests")


def again(ids: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """The bitmaps of positions that two rows of ids or more fall on, and the filter's size: the first pass."""
    bits = filter_bits(ids.count(), max_bits)
    return saved(bitmaps(repeated_positions(ids.select("digest"), bits)), "repeated"), bits


def flagged(rows: DataFrame, filled: DataFrame, bits: int) -> DataFrame:
    """rows with candidate: whether both filter positions of digest are set in the bitmaps filled, which are of bounded size."""
    one, two = positions(F.col("digest"), bits)
    rows = rows.withColumns({"at1": one, "at2": two})
    for k in "12":
        rows = rows.join(F.broadcast(filled.select(F.col("bucket").alias(f"bucket{k}"), F.col("bits").alias(f"bits{k}"))), F.bitmap_bucket_number(f"at{k}") == F.col(f"bucket{k}"), "left")
    hit = _is_set(F.col("bits1"), F.col("at1")) & _is_set(F.col("bits2"), F.col("at2"))
    return rows.withColumn("candidate", hit).drop("at1", "at2", "bucket1", "bucket2", "bits1", "bits2")


def _groups(candidates: DataFrame) -> DataFrame:
    """Of each text: the doc_id that stays, how many rows have the text, and how many of them have that doc_id."""
    each = candidates.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(F.col("digest").alias("of")).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.max(F.struct("id", "n"))["n"].alias("n_top"))


def copy_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256. Only digests are shuffled, and only of candidates."""
    ids = digests(df, doc_id, text)
    rows = flagged(ids, *again(ids, max_bits))
    alone = rows.where(~F.col("candidate")).select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    candidates = rows.where("candidate").select("id", "digest")
    each = candidates.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    # Read from a table, both sides of the join are dealt by its key alone, and Spark can split a large group.
    joined = each.join(saved(_groups(candidates), "copy-groups"), F.col("digest") == F.col("of")).select("id", "keep_id", "group_size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    return alone.unionByName(joined.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256")))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """df without all but one row of each text: that of the largest doc_id. Whole rows are shuffled only of texts that do repeat
    (and of the few others that a second filter, over those alone, lets through)."""
    ids = digests(df, doc_id, text)
    groups = saved(_groups(flagged(ids, *again(ids, max_bits)).where("candidate").select("id", "digest")).where("group_size > 1"), "copy-groups")
    bits = filter_bits(groups.count(), max_bits)
    rows = df.select(F.struct("*").alias("row")).select("row", F.col("row")[doc_id].alias("id"), text_digest(F.col("row")[text]).alias("digest"))
    rows = flagged(rows, bitmaps(all_positions(groups.select(F.col("of").alias("digest")), bits)), bits)
    joined = rows.where("candidate").join(groups, F.col("digest") == F.col("of"), "left")
    one = joined.where("of IS NULL OR (id <=> keep_id AND n_top = 1)").select("row.*")
    # Rows repeated with text and doc_id, which tables with a key do not have.
    tied = joined.where("id <=> keep_id AND n_top > 1").withColumn("rank", F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.xxhash64(F.to_json("row"))))).where("rank = 1").select("row.*")
    return rows.where(~F.col("candidate")).select("row.*").unionByName(one).unionByName(tied)


def op1_exact_dedup(spark, sf_dir):
    return copy_groups(read(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256)
         AND row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept,
       text_sha256
FROM d
"""
