"""Importance resampling towards a target distribution, over hashed n-gram features.

Every text gives its runs of one to three words; a feature falls into the bucket of its CRC-32. Two passes read the texts: the
first counts buckets (combined in each task before the shuffle, which gets at most BUCKETS rows from a task), the second
adds up the gains of a document's features. The table of gains has a row for each bucket, BUCKETS at most, whatever the corpus
holds, so it is broadcast. Documents are drawn without replacement by the Gumbel top-k rule: the highest of weight plus noise,
noise from a seeded hash of the doc_id. The sort is distributed: each row's place in its range of scores plus the counts of the
ranges before it (a number for each partition) is its rank, so no window spans all rows.

Nulls: a null text has no words, a null doc_id is hashed as the word null and comes last among ties. Texts without words have no
features and weight 0. Texts are read whole, one row of words at a time. Repeated rows are documents of their own with equal
scores and ranks next to each other. An empty table gives an empty result; with an empty target all gains come from the smoothing.
Further columns are not read. Gains are computed in doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.tables import deleted, read, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST = 10_000, 3
#: Percent of the documents with LEAST_WORDS words or more that are drawn, and the seed of the noise.
PERCENT, LEAST_WORDS, SEED = 5, 20, "42"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case. Of ASCII texts lower() changes nothing else, and is faster."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def features(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """rows with an array column words: instead of it, bucket, one row for each feature. Words are exploded with the ones that
    follow them. Where a text ends before a run of words does, and in texts without words, bucket is null."""
    other = [c for c in rows.columns if c != "words"]
    n = F.size("words")
    runs = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(longest)])
    each = rows.select(*other, F.inline_outer(runs).alias(*[f"w{k}" for k in range(longest)]))
    grams = [reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(f"w{k}") for k in range(size)]) for size in range(1, longest + 1)]
    hashed = F.array(*[(F.crc32(g.cast("binary")) % buckets).cast("int") for g in grams])
    return each.select(*other, F.explode(hashed).alias("bucket"))


def counts(df: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and its number of features, for buckets that have any."""
    return features(df.select(words(F.col(text)).alias("words")), longest, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain: a thousand times the logarithm of how much likelier the target is to have the bucket, rounded down, of
    every bucket. source and target are counts()."""
    total = lambda c: c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    s_all, t_all = float(total(source) + buckets), float(total(target) + buckets)
    spark = source.sparkSession
    table = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    table = table.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    ratio = (F.col("t") + 1).cast("double") * F.lit(s_all) / ((F.col("s") + 1).cast("double") * F.lit(t_all))
    return table.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the document's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighted(df: DataFrame, gain: DataFrame, doc_id: str, text: str, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of df. gain has a row for each bucket, so it is broadcast."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    n = F.size("words").cast("long")
    each = features(rows.select("row", "doc_id", n.alias("n_words"), "words"), longest, buckets)
    out = each.join(F.broadcast(gain), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    runs = reduce(lambda a, b: a + b, [F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(longest)])
    return out.select("row", "doc_id", "n_words", runs.alias("n_features"), "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(rows: DataFrame, keep: int, order: list[Column]) -> DataFrame:
    """rows with rank: 1, 2, .. of the first keep in the order given, null for others. Sorted by ranges in a saved table, where a
    row's number counts up within its partition; a partition's rows before it are known from the counts of all partitions."""
    in_order = rows.orderBy(*order).withColumn("nr", F.monotonically_increasing_id())
    table = saved(in_order, "in-order")
    part, place = F.shiftright("nr", 33).cast("int"), F.col("nr").bitwiseAND((1 << 33) - 1)
    found = sorted((r.part, r.n) for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a number for each partition
    before, at = [], 0
    for p, n in found:
        before.append((p, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    rank = F.col("before") + place + 1
    return table.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= keep, rank)).drop("part", "before", "nr")


def resampled(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of df; those with a rank are drawn."""
    source, wanted = saved(counts(df, text), "source-counts"), saved(counts(target, target_text), "target-counts")
    gain = saved(gains(source, wanted), "gains")
    rows = saved(weighted(df, gain, doc_id, text, seed=seed), "weights")
    deleted(source, wanted)
    able = rows.where(F.col("n_words") >= least_words)
    out = ranked(able, able.count() * percent // 100, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")])
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).drop("row")


def op12_importance_resampling(spark, sf_dir):
    out = resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its table of 256 remainders, which a recursion makes; a run of words goes on from the remainder of the run without its
#: last word, so each distinct run costs one word.
OP12_SQL = rf"""WITH RECURSIVE steps(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
lut AS (SELECT list(v ORDER BY i) AS l FROM steps WHERE k = 8),
texts AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
listed AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM texts),
words AS (SELECT side, r, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(ws[3:]) AS w3 FROM listed),
bytes AS (SELECT w, flatten(list_transform(string_split(w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] WHEN unicode(x) < 2048 THEN [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)]
  WHEN unicode(x) < 65536 THEN [224 | (unicode(x) >> 12), 128 | ((unicode(x) >> 6) & 63), 128 | (unicode(x) & 63)] ELSE [240 | (unicode(x) >> 18), 128 | ((unicode(x) >> 12) & 63), 128 | ((unicode(x) >> 6) & 63), 128 | (unicode(x) & 63)] END))::BIGINT[] AS b FROM (SELECT DISTINCT w1 AS w FROM words)),
one AS (SELECT w AS g1, list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, x: xor(s >> 8, l[(xor(s, x) & 255) + 1])) AS c1 FROM bytes, lut),
two AS (SELECT g1, w AS g2, list_reduce(list_prepend(c1, list_prepend(32::BIGINT, b)), lambda s, x: xor(s >> 8, l[(xor(s, x) & 255) + 1])) AS c2 FROM (SELECT DISTINCT w1, w2 FROM words WHERE w2 IS NOT NULL) p JOIN one ON g1 = w1 JOIN bytes ON w = w2, lut),
three AS (SELECT g1, g2, w AS g3, list_reduce(list_prepend(c2, list_prepend(32::BIGINT, b)), lambda s, x: xor(s >> 8, l[(xor(s, x) & 255) + 1])) AS c3 FROM (SELECT DISTINCT w1, w2, w3 FROM words WHERE w3 IS NOT NULL) p JOIN two ON g1 = w1 AND g2 = w2 JOIN bytes ON w = w3, lut),
found AS (SELECT side, r, c1 AS c FROM words JOIN one ON g1 = w1 UNION ALL SELECT side, r, c2 FROM words JOIN two ON g1 = w1 AND g2 = w2 UNION ALL SELECT side, r, c3 FROM words JOIN three ON g1 = w1 AND g2 = w2 AND g3 = w3),
buckets AS (SELECT side, r, xor(c, 4294967295) % {BUCKETS} AS b FROM found),
counts AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM buckets GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE + {BUCKETS} AS s_all, coalesce(sum(t), 0)::DOUBLE + {BUCKETS} AS t_all FROM counts),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * s_all / ((s + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM buckets JOIN gains USING (b) WHERE side = 's' GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM listed LEFT JOIN weights USING (r) WHERE side = 's'),
drawn AS (SELECT *, CASE WHEN n >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place, {PERCENT} * count(*) FILTER (n >= {LEAST_WORDS}) OVER () // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM drawn
"""
