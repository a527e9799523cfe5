"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are five words in lower case (texts of fewer words have one of all). A shingle weighs its count in the text times
FLOOR + (1 - FLOOR) * min(1, ln(N / df) / ln(1 / RARE)): a damped inverse document frequency (0.75 to 1), cut off where fewer
than the share RARE of all texts have the shingle, and mild enough that the edits in a large group of near copies do not outweigh what the
copies share. So only frequent shingles need a count, and there are at most (mean shingles a text) / RARE of them, however
large the corpus. They are found exactly in two passes: blocks of texts report shingles that at least RARE / 2 of their
texts have, which no frequent shingle can escape in all blocks; then those reported often enough are counted in all texts.
(A task of fewer than 2 / RARE texts reports all its shingles, so inputs should not be dealt in smaller pieces.)

Each text gets HASHES samples; a band is the joint hash of ROWS of them (BANDS fixed subsets). Texts that share a band's
value are candidates: all are compared with a leader, by exact weighted Jaccard over whole texts. The leader is the text that
shares most places in buckets with others, as the original of a group of near copies does. Where more than CROWD do not reach
THRESHOLD with it, they get further leaders of the same bucket, as long as that takes many of them out. What is then not
connected in its bucket is compared in blocks of about CROWD by CROWD texts: every pair of different components, unless their
signatures agree in fewer than AGREE places (chance below 1e-5 at THRESHOLD) or a block's links have connected them. No pair
list within a group is ever written. The work in a crowded bucket grows with the pairs of texts outside its largest
component. Classes are the connected components of what was verified; texts with equal words in lower case are one node from
the start (by a 64-bit hash).

Nulls: a null text is empty; texts without words are copies of each other. Rows without doc_id take part; class_id is the
smallest doc_id of the class (null if none has one). One row of each class is kept, that of class_id, of repeated rows the
first (of those that differ in other columns, the one whose JSON has the least hash). Very long texts are scanned whole, in
chunks of their own. An empty table gives an empty result. Other columns pass through, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm.exact_dedup import all_positions, bitmaps, filter_bits, flagged, repeated_positions
from barlight.llm.tables import deleted, read, saved, small_batches
from barlight.llm.textscan import Scan, chunks, grams, mix

WORDS, THRESHOLD = 5, 0.8
HASHES, ROWS, BANDS, SEED = 64, 7, 40, 17
RARE, FLOOR = 0.01, 0.75
AGREE, CROWD = 36, 256
BLOCK = 4096
PIECE = 256 << 10
U = np.uint64


def sets(s: Scan, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and count of each text's distinct shingles, text by text."""
    g, doc = grams(s.word_hashes(), s.tok_off, k)
    n = np.ones(len(g), dtype=np.float32)
    key = mix(g + mix(doc.astype(U) + U(1)))
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if len(again):
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key)
        at = at[np.argsort(key[at], kind="stable")]
        first = np.append(True, key[at][1:] != key[at][:-1])
        n[at[first]] = np.diff(np.append(np.flatnonzero(first), len(at)))
        keep = np.ones(len(g), dtype=bool)
        keep[at[~first]] = False
        return doc[keep], g[keep], n[keep]
    return doc, g, n


class Weights:
    """TF-IDF weights from the counts of frequent shingles."""

    def __init__(self, frequent: dict[int, int], n: int, rare: float, floor: float):
        self.at = np.array(sorted(frequent), dtype=U)
        df = np.array([frequent[int(x)] for x in self.at], dtype=np.float64)
        self.of = (floor + (1 - floor) * np.minimum(1.0, np.log(max(n, 1) / np.maximum(df, 1)) / np.log(1 / rare))).astype(np.float32) if len(df) else np.ones(0, np.float32)

    def __call__(self, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return n
        i = np.minimum(np.searchsorted(self.at, g), len(self.at) - 1)
        return n * np.where(self.at[i] == g, self.of[i], np.float32(1))


def frequent_shingles(texts: DataFrame, n: int, k: int, rare: float) -> dict[int, int]:
    """Document frequency of each shingle that at least the share rare of the n texts have."""

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            at, df = np.unique(np.concatenate(held), return_counts=True)
            some = df >= rare * size / 2
            return pa.RecordBatch.from_arrays([pa.array(at[some].view(np.int64)), pa.array(df[some].astype(np.int64))], ["g", "df"])

        for batch in batches:
            for a, b, s in chunks(batch.column(0), lower=True):
                held.append(sets(s, k)[1])
                size += b - a
                if size >= BLOCK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    found = texts.mapInArrow(reported, "g long, df long").groupBy("g").agg(F.sum("df").alias("df")).where(F.col("df") >= rare * n / 2)
    likely = np.sort(np.array([r.g for r in found.select("g").collect()], dtype=np.int64).view(U))
    if not len(likely):
        return {}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(likely), dtype=np.int64)
        for batch in batches:
            for _, _, s in chunks(batch.column(0), lower=True):
                g = sets(s, k)[1]
                i = np.minimum(np.searchsorted(likely, g), len(likely) - 1)
                df += np.bincount(i[likely[i] == g], minlength=len(likely))
        some = df > 0
        yield pa.RecordBatch.from_arrays([pa.array(likely[some].view(np.int64)), pa.array(df[some])], ["g", "df"])

    rows = texts.mapInArrow(counted, "g long, df long").groupBy("g").agg(F.sum("df").alias("df")).where(F.col("df") >= rare * n).collect()
    return {int(np.int64(r.g).astype(U)): r.df for r in rows}


def samples(doc: np.ndarray, g: np.ndarray, w: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """Consistent weighted samples of each text that has shingles: bit patterns of the least ln a, which stand for the sampled
    (shingle, t), as ln a depends on these alone. r and c are Gamma(2, 1), beta is uniform, all from hashes of the shingle."""
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    out = np.empty((len(start), hashes), dtype=np.uint32)
    rng = np.random.default_rng(seed)
    log_w = np.log(w)
    odd = rng.integers(0, 2**63, (hashes, 2), dtype=np.uint64) * U(2) + U(1)
    scale, tiny = np.float32(2.0**-24), np.float32(2.0**-25)
    unit = lambda z, shift: ((z >> U(shift)) & U(0xFFFFFF)).astype(np.float32) * scale + tiny
    for k in range(hashes):
        z = g * odd[k, 0]
        z ^= z >> U(29)
        z *= U(0xBF58476D1CE4E5B9)
        y = (z ^ (z >> U(32))) * odd[k, 1]
        y ^= y >> U(31)
        r = -np.log(unit(z, 40) * unit(z, 16))
        c = np.log(-np.log(unit(y, 40) * unit(y, 16)))
        beta = unit(z ^ (y << U(7)), 30)
        t = np.floor(log_w / r + beta)
        c -= r * (t - beta + np.float32(1))
        out[:, k] = np.minimum.reduceat(c, start).view(np.uint32)
    return out


def band_values(signature: np.ndarray, rows: int, bands: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed + 1)
    out = np.empty((len(signature), bands), dtype=U)
    for b in range(bands):
        acc = np.full(len(signature), b + 1, dtype=U)
        for j in rng.choice(signature.shape[1], rows, replace=False):
            acc = mix(acc * U(0x9E3779B97F4A7C15) + signature[:, j])
        out[:, b] = acc
    return out


def text_keys(s: Scan) -> np.ndarray:
    """A hash of each text's sequence of words."""
    h = s.word_hashes()
    at = np.arange(len(h)) - np.repeat(s.tok_off[:-1], np.diff(s.tok_off))
    total = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(mix(h + mix(at.astype(U) + U(1))), out=total[1:])
    return mix(total[s.tok_off[1:]] - total[s.tok_off[:-1]] + np.diff(s.tok_off).astype(U) * U(0x9E3779B97F4A7C15))


def sketched(df: DataFrame, text: str, weights: Weights, columns: list[str] | None = None) -> DataFrame:
    """row (all columns of df, or those named), text, key (of its words), signature and bands (none for texts without words). All
    but the text of whole rows, which row has already, comes from a saved table."""
    rows = df.select(F.struct(*(columns or ["*"])).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("key", T.LongType()), T.StructField("signature", T.ArrayType(T.IntegerType())), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in chunks(batch.column(1), lower=True, size=PIECE):
                doc, g, n = sets(s, WORDS)
                signature = samples(doc, g, weights(g, n), HASHES, SEED) if len(g) else np.zeros((0, HASHES), dtype=np.uint32)
                bands = band_values(signature, ROWS, BANDS, SEED)
                off = np.append(0, np.cumsum(np.diff(s.tok_off) > 0)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(off * np.int32(x.shape[1])), pa.array(x.reshape(-1))) for x in (signature.view(np.int32), bands.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(text_keys(s).view(np.int64)), *lists], ["row", "text", "key", "signature", "bands"])

    out = rows.mapInArrow(sketch, schema)
    if columns:
        return saved(out, "sketches")
    return saved(out.drop("text"), "sketches").withColumn("text", F.coalesce(F.col("row")[text], F.lit("")))


def similarities(one: pa.Array, other: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of texts, pair by pair."""
    out = []
    for a, b, s in chunks(one, lower=True):
        (_, _, t), parts, sums = next(chunks(other[a:b], lower=True, size=1 << 62)), [], []
        for scan in (s, t):
            doc, g, n = sets(scan, WORDS)
            w = weights(g, n).astype(np.float64)
            parts.append((doc, mix(g + mix(doc.astype(U) + U(1))), w))
            sums.append(np.bincount(doc, w, minlength=b - a))
        key = np.concatenate([parts[0][1], parts[1][1]])
        w = np.concatenate([parts[0][2], parts[1][2]])
        doc = np.concatenate([parts[0][0], parts[1][0]])
        order = np.argsort(key, kind="stable")
        key, w, doc = key[order], w[order], doc[order]
        both = np.flatnonzero(key[1:] == key[:-1])
        common = np.bincount(doc[both], np.minimum(w[both], w[both + 1]), minlength=b - a)
        out.append(common / np.maximum(sums[0] + sums[1] - common, 1e-12))
    return np.concatenate(out) if out else np.zeros(0)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """pairs (a, b) with same: whether their texts reach the threshold."""
    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "one", "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = similarities(batch.column(2), batch.column(3), weights) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], ["a", "b", "same"])

    return saved(joined.mapInArrow(compare, "a long, b long, same boolean"), "verified")


def among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows whose column has one of the values in wanted, a saved table of them. Only rows that a Bloom filter of bounded size
    lets through are shuffled."""
    bits = filter_bits(wanted.count())
    of_wanted = bitmaps(all_positions(wanted.select(F.col(column).alias("digest")), bits))
    likely = flagged(rows.withColumn("digest", F.col(column)), of_wanted, bits).where("candidate").select(*rows.columns)
    return likely.join(wanted, column, "left_semi")


def candidates(sketches: DataFrame) -> DataFrame:
    """band, bucket and key of those texts that share a bucket with a different one. Of all others only the buckets are shuffled."""
    rows = sketches.select("key", F.posexplode("bands").alias("band", "bucket")).select("band", "bucket", "key")
    again = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "buckets")
    return saved(shared(saved(among(rows, "bucket", again).distinct(), "bands")), "members")


def shared(rows: DataFrame) -> DataFrame:
    """rows in buckets of two rows or more."""
    return rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "bucket", "left_semi")


def links(members: DataFrame, sketches: DataFrame, signatures: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """members: band, bucket, key. Pairs (a, b) of keys that were verified to reach the threshold; all texts of a bucket that are
    linked in any way, if only through others of their bucket, are connected by them."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    score = saved(members.join(sizes, "bucket").groupBy("key").agg(F.sum("n").alias("score")), "scores")
    texts = saved(among(sketches.select("key", "text"), "key", score.select("key")).groupBy("key").agg(F.first("text").alias("text")), "texts")
    left, tested, before = members, None, None
    while True:
        leaders = saved(left.join(score, "key").groupBy("bucket").agg(F.max(F.struct("score", "key"))["key"].alias("leader")), "leaders")
        rest = left.join(leaders, "bucket").where("key != leader").select("band", "bucket", "key", F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
        rest = saved(rest, "rest")
        pairs = rest.select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        now = verified(pairs, texts, weights, threshold)
        tested = now if tested is None else tested.unionByName(now)
        open_rows = saved(rest.join(tested.where("same").select("a", "b"), ["a", "b"], "left_anti").select("band", "bucket", "key"), "open")
        crowded = open_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("bucket")
        was, left = left, saved(open_rows.join(crowded, "bucket", "left_semi"), "left")
        deleted(leaders, rest, open_rows, *([was] if was is not members else []))
        n = left.count()
        # Another leader pays where it takes a class of copies out of a crowded bucket.
        if not n or (before is not None and n > 0.9 * before):
            break
        before = n
    found = tested.where("same").select("a", "b")
    return found.unionByName(further_links(blocks(members, components(found)), signatures, texts, weights, threshold))


def blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, i, j, chunk, band, key and label of the rows of buckets with several labels, dealt out so that any two rows of a
    bucket with different labels meet in one block (bucket, i, j), one as chunk i and one as chunk j. Rows of the bucket's
    main label meet only the others, so a bucket of one large class and few others takes few blocks."""
    rows = saved(members.join(labels, "key", "left").select("band", "bucket", "key", F.coalesce("label", "key").alias("label")), "labelled")
    each = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")).where("n_labels > 1")
    one = F.col("n") <= CROWD
    parts = lambda n: F.ceil(n / CROWD)
    n_main = F.when(one, 0).otherwise(parts(F.col("main.n"))).cast("long")
    n_other = F.when(one, 1).otherwise(parts(F.col("n") - F.col("main.n"))).cast("long")
    mixed = saved(mixed.select("bucket", F.col("main.label").alias("main"), n_main.alias("n_main"), n_other.alias("n_other")), "mixed")
    is_main = (F.col("label") == F.col("main")) & (F.col("n_main") > 0)
    at = F.xxhash64("key", F.lit(1))
    chunk = F.when(is_main, F.col("n_other") + F.pmod(at, F.greatest("n_main", F.lit(1)))).otherwise(F.pmod(at, "n_other"))
    to = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_other") - 1 + F.when(is_main, 0).otherwise(F.col("n_main"))))
    dealt = rows.join(mixed, "bucket").withColumn("chunk", chunk).withColumn("to", to)
    return dealt.select("bucket", F.least("chunk", "to").alias("i"), F.greatest("chunk", "to").alias("j"), "chunk", "band", "key", "label")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows in order of bucket, i and j, and where their blocks start and end; no block is cut."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        new = np.zeros(max(len(t) - 1, 0), dtype=bool)
        for c in ("bucket", "i", "j"):
            x = t[c].to_numpy()
            new |= x[1:] != x[:-1]
        at = [0, *(np.flatnonzero(new) + 1)]
        if len(at) > 1:
            yield t.slice(0, at[-1]).combine_chunks(), at
        held = t.slice(at[-1])
    if held is not None and len(held):
        yield held.combine_chunks(), [0, len(held)]


def _likely(t: pa.Table, at: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each block: the rows of pairs with different labels that agree in AGREE samples or more and share no earlier bucket,
    those that agree most first."""
    i, j, chunk, band, label = (t[c].to_numpy() for c in ("i", "j", "chunk", "band", "label"))
    signature = t["signature"].combine_chunks().flatten().to_numpy().reshape(-1, HASHES).view(np.uint32)
    buckets = band_values(signature, ROWS, BANDS, SEED)
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = a + np.flatnonzero(chunk[a:b] == i[a])
        y = a + np.flatnonzero(chunk[a:b] == j[a])
        apart = label[x][:, None] != label[y][None, :]
        if i[a] == j[a]:
            apart &= x[:, None] < y[None, :]
        p, q = np.nonzero(apart)
        if not len(p):
            continue
        agree = np.zeros((len(x), len(y)), dtype=np.int16)
        for k in range(HASHES):
            agree += signature[x, k][:, None] == signature[y, k][None, :]
        n = agree[p, q]
        p, q, n = x[p[n >= AGREE]], y[q[n >= AGREE]], n[n >= AGREE]
        first = ~(buckets[p, : band[a]] == buckets[q, : band[a]]).any(axis=1)
        order = np.argsort(-n[first], kind="stable")
        yield p[first][order], q[first][order]


def _shingles(texts: pa.Array, weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles of each text in order, and their weights."""
    out = []
    for a, b, s in chunks(texts, lower=True):
        doc, g, n = sets(s, WORDS)
        w = weights(g, n).astype(np.float64)
        at = np.searchsorted(doc, np.arange(b - a + 1))
        for x, y in zip(at[:-1], at[1:], strict=True):
            order = np.argsort(g[x:y])
            out.append((g[x:y][order], w[x:y][order]))
    return out


def further_links(rows: DataFrame, signatures: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """rows: blocks(). Verified pairs (a, b) that connect what is linked in a block and has different labels. Signatures say which
    rows have a likely partner, so only their texts are dealt out; a block compares them until its labels are connected."""
    dealt = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    signed = rows.join(signatures, "key").select(*rows.columns, "signature")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _runs(batches):
            some = np.zeros(len(t), dtype=bool)
            for p, q in _likely(t, at):
                some[p] = some[q] = True
            yield from t.filter(pa.array(some)).to_batches()

    wanted = saved(dealt(signed).mapInArrow(likely, signed.schema), "likely")
    read_ = wanted.join(texts, "key").select(*wanted.columns, "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _runs(batches):
            key, label = t["key"].to_numpy(), t["label"].to_numpy()
            sets_ = _shingles(t["text"].combine_chunks(), weights)
            sums = [w.sum() for _, w in sets_]
            found = []
            for p, q in _likely(t, at):
                up: dict[int, int] = {}

                def top(x: int, up=up) -> int:
                    while x in up:
                        x = up[x]
                    return x

                for x, y in zip(p, q, strict=True):
                    of, to = top(label[x]), top(label[y])
                    if of == to:
                        continue
                    _, u, v = np.intersect1d(sets_[x][0], sets_[y][0], assume_unique=True, return_indices=True)
                    common = np.minimum(sets_[x][1][u], sets_[y][1][v]).sum()
                    if common / max(sums[x] + sums[y] - common, 1e-12) >= threshold:
                        up[of] = to
                        found.append((min(key[x], key[y]), max(key[x], key[y])))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return saved(dealt(read_).mapInArrow(compare, "a long, b long").distinct(), "further")


def components(pairs: DataFrame) -> DataFrame:
    """key and label (the least key that it is connected with), for keys in pairs."""
    both = saved(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("key"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["key"] == near["u"]).select("key", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        step = saved(step, "step")
        jump = step.select(F.col("key").alias("to"), F.col("label").alias("further"))
        done = saved(step.join(jump, step["label"] == jump["to"], "left").select("key", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        deleted(step, labels)
        labels = done.select("key", "label")
        if done.where("label != was").isEmpty():
            return labels


def labelled(df: DataFrame, text: str, threshold: float, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The sketches of df's rows, and key and label of those texts that are linked with a different one."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = texts.count()
    weights = Weights(frequent_shingles(texts, n, WORDS, RARE), n, RARE, FLOOR)
    sketches = sketched(df, text, weights, columns)
    members = candidates(sketches)
    wanted = saved(members.select("key").distinct(), "wanted")
    signatures = saved(among(sketches.select("key", "signature"), "key", wanted).groupBy("key").agg(F.first("signature").alias("signature")), "signatures")
    return sketches, components(links(members, sketches, signatures, weights, threshold))


def judged(own: DataFrame) -> DataFrame:
    """own (row, id, class) with class_id, class_size and kept."""
    each = own.groupBy("class", "id").agg(F.count(F.lit(1)).alias("n"))
    sizes = saved(each.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))["n"].alias("n_first")), "classes")
    out = own.join(sizes, "class").withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))
    single = out.where("not kept or n_first = 1").select("row", "class_id", "class_size", "kept")
    # Rows that share the class's smallest doc_id, which tables with a key do not have.
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64(F.to_json("row"))))
    return single.unionByName(out.where("kept and n_first > 1").withColumn("kept", rank == 1).select("row", "class_id", "class_size", "kept"))


def _own(sketches: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    return sketches.select("row", F.col("row")[doc_id].alias("id"), "key").join(labels, "key", "left").select("row", "id", F.coalesce("label", "key").alias("class"))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """row (all columns of df, or those named, doc_id among them), class_id, class_size, and kept: true for one row of each class."""
    sketches, labels = labelled(df, text, threshold, columns)
    return judged(_own(sketches, labels, doc_id))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without all but one row of each class. Whole rows are shuffled only of texts that may have a copy or a link, by a
    Bloom filter of bounded size over their keys; all others pass straight through."""
    sketches, labels = labelled(df, text, threshold)
    keys = sketches.select(F.col("key").alias("digest"))
    bits = filter_bits(keys.count())
    again = repeated_positions(keys, bits).unionByName(all_positions(labels.select(F.col("key").alias("digest")), bits)).distinct()
    rows = flagged(sketches.select("row", "key", F.col("key").alias("digest")), bitmaps(again), bits)
    linked = judged(_own(rows.where("candidate").select("row", "key"), labels, doc_id)).where("kept")
    return rows.where("not candidate").select("row.*").unionByName(linked.select("row.*"))


def op3_near_dedup(spark, sf_dir):
    out = classes(read(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "class_id", "class_size", "kept")
