"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

The forest is grown on the statistics of labelled rows of good quality, over the box that all labelled rows span, up to SAMPLE rows in the order of a hash of doc_id
(a bound on what reaches the driver, whatever the tables' size). A text's score is the usual 2 ** (-mean path / c). The
threshold comes from the same labelled rows (good ones scored by forests of the other half): the cut with the largest share
of bad rows above it, less FALSE_COST times the share of good ones; of equal cuts the highest. Without labels of both kinds the forest rejects nothing.

Texts are never cut; each task works on chunks of bounded bytes. Nulls: a null text is empty, has no words and fails the
base rule; labels without doc_id or quality are left out, and of several labels of a document the worst counts. Repeated
rows get equal results; an empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm.tables import read, small_batches
from barlight.llm.textscan import Scan, chunks, grams, mix, powers

SAMPLE = 20_000
TREES, PSI, SEED = 200, 256, 11
FALSE_COST = 20.0
MIN_WORDS = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols a word", "capitals a letter", "marks a word", "bars a word", "repeated words", "repeated lines"]


def _table(signs: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(signs.encode())] = True
    return t


SYMBOLS, MARKS, BARS = _table("#*$%&|<>"), _table("!?"), _table("|")
UPPER, LETTERS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[off])


def repeat_words(s: Scan, h: np.ndarray, k: int = 3) -> np.ndarray:
    """Of each text: the words in windows of k words that occur twice or more in it."""
    out = np.zeros(len(h) + 1, dtype=np.int64)
    left = s.tok_off[1:][s.doc_of_words()] - np.arange(len(h))
    at = np.flatnonzero(left >= k)
    if len(at):
        key, doc = grams(h, s.tok_off, k)
        if len(key) != len(at):  # texts of fewer words have a gram of their own
            key, doc = key[np.diff(s.tok_off)[doc] >= k], doc[np.diff(s.tok_off)[doc] >= k]
        key = mix(key + mix(doc.astype(np.uint64)))
        order = np.sort(key)
        again = np.unique(order[1:][order[1:] == order[:-1]])
        if len(again):
            i = np.minimum(np.searchsorted(again, key), len(again) - 1)
            hit = at[again[i] == key]
            np.add.at(out, hit, 1)
            np.add.at(out, hit + k, -1) if not len(hit) or hit[-1] + k <= len(h) else None
            return per_doc(np.cumsum(out[:-1]) > 0, s.tok_off)
    return np.zeros(s.docs, dtype=np.int64)


def dup_lines(s: Scan, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its lines with a word, and those of them that equal an earlier line."""
    n = len(s.data)
    none = np.zeros(s.docs, dtype=np.int64)
    if not n:
        return none, none
    feed = np.flatnonzero(s.data == 10)
    full = np.flatnonzero(np.diff(s.off) > 0)
    start = np.unique(np.concatenate([s.off[:-1][full], feed + 1]))
    start = start[start < n]
    end = np.minimum(np.append(start[1:], n), n)
    end = end - (s.data[end - 1] == 10)
    doc = np.searchsorted(s.off, start, side="right") - 1
    words = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(word_bytes, out=words[1:])
    some = words[end] > words[start]
    start, end, doc = start[some], end[some], doc[some]
    p, inverse = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((s.data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    key = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc, minlength=s.docs), np.bincount(doc[order][1:][same], minlength=s.docs)


def statistics(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES of each text, as columns."""
    word = (s.data != 32) & ((s.data < 9) | (s.data > 13))
    n_words = np.diff(s.tok_off)
    chars = per_doc(word & ((s.data & 0xC0) != 0x80), s.off)
    symbols = per_doc(SYMBOLS[s.data], s.off)
    lines, dups = dup_lines(s, word)
    repeats = repeat_words(s, s.word_hashes())
    part = lambda a, b: a / np.maximum(b, 1)
    features = [part(symbols, n_words), part(per_doc(UPPER[s.data], s.off), per_doc(LETTERS[s.data], s.off)), part(per_doc(MARKS[s.data], s.off), n_words), part(per_doc(BARS[s.data], s.off), n_words), part(repeats, n_words), part(dups, lines)]
    features = np.stack(features, axis=1)
    return np.stack([n_words, chars, symbols, dups, repeats], axis=1), features / (1 + features)


class Forest:
    """Isolation trees as arrays: split feature (-1: leaf), split value, children, and path length at leaves.

    Trees are grown on x, but split values are drawn over the whole box from low to high that a node stands for: what x
    never shows, such as symbols in plain prose, is isolated by one split on it.
    """

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(x))
        self.trees = [self._grown(x[rng.choice(len(x), self.psi, replace=False)], low, high, rng) for _ in range(trees)]

    @staticmethod
    def usual(n: float) -> float:
        """The mean path length of a search in a binary tree of n points."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grown(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(2, self.psi))))
        nodes: list[list] = []

        def grow(points: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + self.usual(len(points))])
            wide = np.flatnonzero(high > low)
            if len(points) > 1 and depth < limit and len(wide):
                f = int(rng.choice(wide))
                v = float(rng.uniform(low[f], high[f]))
                below, above = high.copy(), low.copy()
                below[f] = above[f] = v
                under = points[:, f] <= v
                nodes[at][:4] = [f, v, grow(points[under], low, below, depth + 1), grow(points[~under], above, high, depth + 1)]
            return at

        grow(x, low, high, 0)
        return tuple(np.array(c) for c in zip(*nodes, strict=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, value, low, high, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                a = at[go]
                at[go] = np.where(x[go, f[go]] <= value[a], low[a], high[a])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.usual(self.psi), 1e-9))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, s in chunks(batch.column(0)):
            counts, features = statistics(s)
            yield pa.RecordBatch.from_pydict({"quality": batch.column(1)[a:b].to_pylist(), "n_words": counts[:, 0].tolist(), "n_repeat_words": counts[:, 4].tolist(), "features": features.tolist()}, schema=pa.schema([("quality", pa.int32()), ("n_words", pa.int64()), ("n_repeat_words", pa.int64()), ("features", pa.list_(pa.float64()))]))


def fitted(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[Forest | None, float]:
    """The forest and its threshold, from at most sample labelled rows."""
    small_batches(df.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("of"), "of").limit(sample)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), F.col("id") == F.col("of")).select("text", "quality")
    found = rows.mapInArrow(_sampled, "quality int, n_words long, n_repeat_words long, features array<double>").where(F.col("n_words") >= MIN_WORDS).where("100 * n_repeat_words <= 50 * n_words")
    # Rows that share a labelled id could be more than the labels, so what is collected has its own bound, by a hash that
    # favours neither class; order makes the outcome the same in every run.
    got = found.select("quality", "features").orderBy(F.xxhash64("quality", "features"), "quality").limit(2 * sample).collect()
    got = sorted((r.quality, tuple(r.features)) for r in got)
    good, bad = (np.array([f for q, f in got if (q > 0) == kind]) for kind in (True, False))
    if len(good) < 8 or not len(bad):
        return None, np.inf
    order = np.random.default_rng(SEED).permutation(len(good))
    halves = [good[order[::2]], good[order[1::2]]]
    both = np.concatenate([good, bad])
    box = both.min(axis=0), both.max(axis=0)
    out = [Forest(h, *box) for h in halves]
    clean = np.sort(np.concatenate([out[0].scores(halves[1]), out[1].scores(halves[0])]))
    forest = Forest(good, *box)
    scores = np.sort(forest.scores(bad))
    cuts = np.unique(np.concatenate([clean, scores]))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, np.inf)
    found = 1 - np.searchsorted(scores, cuts, side="right") / len(scores)
    false = 1 - np.searchsorted(clean, cuts, side="right") / len(clean)
    gain = found - FALSE_COST * false
    return forest, float(cuts[np.flatnonzero(gain >= gain.max() - 1e-12)[-1]])


def judged(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, columns: list[str] | None = None) -> DataFrame:
    """row (all columns of df, or those named), the base counts, base_failed, score and kept."""
    forest, threshold = fitted(df, labels, doc_id, text, sample)
    rows = df.select(F.struct(*(columns or ["*"])).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"]] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in chunks(batch.column(1)):
                counts, features = statistics(s)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])
                score = forest.scores(features) if forest else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *[pa.array(counts[:, i]) for i in range(5)], pa.array(failed), pa.array(score), pa.array(~failed & (score <= threshold))], ["row", *COUNTS, "base_failed", "score", "kept"])

    return rows.mapInArrow(judge, schema)


def op6_quality_rules(spark, sf_dir):
    out = judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), columns=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept", "score")
