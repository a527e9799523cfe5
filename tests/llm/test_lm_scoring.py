"""LM scoring against a model of plain dictionaries, and on held-out texts against the base."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barlight.llm import lm_scoring as L

ROOT = "/root/testdata"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Model:
    """The same tree by plain counting: p(word | the words before)."""

    def __init__(self, texts, depth):
        self.depth, runs, followed = depth, Counter(), Counter()
        seqs = [["<s>", *words(t), "</s>"] for t in texts]
        self.c = Counter(w for s in seqs for w in s[1:])
        self.n, self.v = sum(self.c.values()), len(self.c)
        for s in seqs:
            for i in range(1, len(s)):
                for d in range(1, min(i, depth) + 1):
                    runs[tuple(s[i - d : i + 1])] += 1
                    followed[tuple(s[i - d : i])] += 1
        self.of, self.branch, self.left = followed, defaultdict(dict), {}
        kept = set()
        for d in range(1, depth + 1):
            new = defaultdict(dict)
            for run, n in runs.items():
                if len(run) == d + 1 and n >= L.MIN_COUNT and (d == 1 or (run[:-1] in kept and run[1:] in kept)):
                    if n * math.log(n / followed[run[:-1]] / self.p(run[1:-1], run[-1])) > L.DIVERGENCE:
                        new[run[:-1]][run[-1]] = n
            for context, nexts in new.items():
                self.branch[context] = nexts
                self.left[context] = followed[context] - sum(nexts.values()) + L.DISCOUNT * len(nexts) + L.KAPPA
                kept |= {(*context, w) for w in nexts}

    def p(self, context, word):
        if not context:
            return (self.c[word] + 0.5) / (self.n + 0.5 * (self.v + 1))
        shorter = self.p(context[1:], word)
        if context not in self.left:
            return shorter
        n = self.branch[context].get(word)
        return ((n - L.DISCOUNT if n else 0) + self.left[context] * shorter) / (self.of[context] + L.KAPPA)

    def scores(self, text):
        s = ["<s>", *words(text), "</s>"]
        base = sum(math.log10(self.p((), w)) for w in s[1:])
        return len(s) - 1, sum(self.c[w] > 0 for w in s[1:]), base, sum(math.log10(self.p(tuple(s[max(0, i - self.depth) : i]), s[i])) for i in range(1, len(s)))


@pytest.fixture(scope="module")
def corpus():
    phrase = "the quick brown fox jumps over a lazy dog near the river bank at dawn"
    texts = [f"{phrase} number{k % 7} and {phrase.upper()}\n the end of part{k % 5}" for k in range(40)]
    texts += ["", None, " \t\n", "one", "one", "naïve café " * 30, "x " * 5000, "never seen before words"]
    return list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_by_brute_force(spark, corpus, depth):
    model = Model([t for i, t in corpus if not is_held(i)], depth)
    assert depth == 1 or any(len(c) > 1 for c in model.left)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in L.scored(spark.createDataFrame(corpus, "doc_id long, text string"), depth=depth).collect())
    want = sorted((str(i), is_held(i), n, known, model.n, round(base, 6), round(score, 6)) for i, t in corpus for n, known, base, score in [model.scores(t)])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-5)


def test_distributions_sum_to_one(corpus):
    model = Model([t for i, t in corpus if not is_held(i)], 2)
    for context in [(), *model.left]:
        known = sum(model.p(context, w) for w in model.c)
        assert known + model.p(context, "a word that never occurs") == pytest.approx(1)


def test_held_out_texts_score_above_the_base(spark):
    out = L.scored(spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet")).where("held_out")
    r = out.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.avg((F.col("score") >= F.col("base_score")).cast("int")).alias("better")).first()
    assert r.score > r.base and r.better > 0.8


def test_ids_are_text_and_tables_may_be_empty(spark):
    rows = [("a-1", "some words here", 1), ("a-2", "some words here", 2), (None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, key long")
    got = {r.doc_id: r for r in L.scored(df).collect()}
    assert set(got) == {"a-1", "a-2", None} and all(r.held_out == is_held(i) for i, r in got.items()) and got[None].n_tokens == 1
    assert L.scored(df.where("false")).count() == 0
