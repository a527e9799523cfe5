"""Quality rules: counts by brute force, verdicts on labelled documents."""

import re
from collections import Counter

from pyspark.sql import functions as F

from barlight.llm import quality as Q
from barlight.llm.tables import read

ROOT = "/root/testdata"


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p + k for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeats = len(w), len(again)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n


def test_counts_by_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in read(spark, f"{ROOT}/sf0.01", "documents").collect()}
    got = Q.op6_quality_rules(spark, f"{ROOT}/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_verdicts_on_labels(spark):
    """The forest, fitted on half of the labels, keeps the good documents of the other half and rejects bad ones."""
    docs, labels = read(spark, f"{ROOT}/sf0.1", "documents"), read(spark, f"{ROOT}/sf0.1", "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    held = labels.where(~half).select("doc_id", "quality")
    out = Q.judged(docs, labels.where(half), columns=["doc_id"])
    rows = out.where("not base_failed").select("row.doc_id", "kept").join(held, "doc_id").collect()
    good, bad = ([r.kept for r in rows if (r.quality > 0) == kind] for kind in (True, False))
    assert len(good) > 50 and sum(good) / len(good) >= 0.99
    assert not bad or sum(bad) / len(bad) <= 0.4


def test_odd_rows(spark):
    rows = [(1, None, "r", 1), (2, "", "r", 2), (3, "w%d " * 5 % (1, 2, 3, 4, 5), "r", 3), (4, " ".join(f"w{i}" for i in range(60_000)), "r", 4), (4, " ".join(f"w{i}" for i in range(60_000)), "r", 4), (None, "x\r\ny\v\f", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_words long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = Q.judged(df, labels)
    assert sorted((str(r["row"].doc_id), *(r[c] for c in Q.COUNTS), r.base_failed) for r in got.collect()) == sorted((str(i), *counts(t or "")) for i, t, _, _ in rows)
    assert got.select("row.*").columns == df.columns and Q.judged(df.where("false"), labels).count() == 0
