"""Importance resampling against a loop over plain dictionaries, and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from barlight.llm import importance as I
from barlight.llm.tables import read


def feature_buckets(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]
    return len(found), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target):
    """doc_id, n_features, weight, score, rank of each (doc_id, text)."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(feature_buckets(text)[1])
    for text in target:
        t.update(feature_buckets(text)[1])
    s_all, t_all, out, able = sum(s.values()), sum(t.values()), [], 0
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    for i, text in docs:
        n, found = feature_buckets(text)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
        able += n >= 20
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = [(*r[:4], k + 1 if k < 5 * able // 100 else None) for k, r in enumerate(drawn)]
    return ranks + [(*r[:4], None) for r in out if not r[4]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    target = [r.text for r in read(spark, folder, "benchmark").collect()]
    got = [tuple(r) for r in I.op12_importance_resampling(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, target), key=repr)
    assert sum(r[4] is not None for r in got) == 5 * sum(feature_buckets(t)[0] >= 20 for _, t in docs) // 100 > 0


def test_odd_rows(spark):
    texts = ["ÀÉ Straße x1 2y 数据 ABC", None, "", " .,;", "one", "one two", "a b c " * 3000, "tie " * 25, "tie " * 25, "\x7f[]`{}", "İI ıi ẞ É"]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(50 + i, f"filler number {i} " * 10, "r", 2) for i in range(80)] + [(None, "tie " * 25, None, None)] * 3 + [(7, "tie " * 25, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, row int")
    target = spark.createDataFrame([("filler number x1",), (None,)], "text string")
    for parts in (1, 5):
        got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in I.resampled(df.repartition(parts), target).collect()]
        assert sorted(got, key=repr) == sorted(brute([r[:2] for r in rows], ["filler number x1", None]), key=repr)
    assert I.resampled(df.where("false"), target).count() == 0
    none = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in I.resampled(df, target.where("false")).collect()]
    assert sorted(none, key=repr) == sorted(brute([r[:2] for r in rows], []), key=repr)


def test_all_ranks_over_many_partitions(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS score", "id AS row").repartition(9)
    got = I.ranked(df, 4000, [I.F.col("score").desc(), I.F.col("row")]).orderBy("score", "row").collect()
    want = {r: k + 1 for k, (_, r) in enumerate(sorted((-(i % 7), i) for i in range(5000)))}
    assert all(r["rank"] == (want[r.row] if want[r.row] <= 4000 else None) for r in got)
