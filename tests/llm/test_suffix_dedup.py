"""Repeated passages against brute force over all windows of words."""

import random

import pytest

from barlight.llm import suffix_dedup as D
from tests.llm.test_llm import words


def covered(texts):
    """Of each text: the words that stand in a window of MIN_WORDS words that another text has too."""
    where = {}
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - D.MIN_WORDS + 1):
            where.setdefault(tuple(w[p : p + D.MIN_WORDS]), set()).add(i)
    out = []
    for t in texts:
        w, mine = t.split(), set()
        for p in range(len(w) - D.MIN_WORDS + 1):
            if len(where[tuple(w[p : p + D.MIN_WORDS])]) > 1:
                mine |= set(range(p, p + D.MIN_WORDS))
        out.append(mine)
    return out


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"].doc_id: {p for s in r.spans for p in range(s.first_word, s.end_word)} for r in D.repeats(df).collect()}
    return [got[i] for i in range(len(texts))]


def recall(spark, texts):
    want, got = covered(texts), found(spark, texts)
    assert all(g <= w for g, w in zip(got, want, strict=True))
    return sum(len(g) for g in got) / sum(map(len, want)), want, got


def test_crowd_around_a_passage(spark):
    """30 words that 80 texts share, and a passage of 60 words around them that two texts share, at several places."""
    texts = []
    for case, at in enumerate((0, 10, 15, 20, 30)):
        core = words(f"core{case}", 30)
        passage = f"{words(f'l{case}', at)} {core} {words(f'r{case}', 30 - at)}"
        texts += [f"{words(f'a{case}-{k}', 40)} {passage} {words(f'b{case}-{k}', 40)}" for k in range(2)]
        texts += [f"{words(f'x{case}-{k}', 35)} {core} {words(f'y{case}-{k}', 35)}" for k in range(40)]
    share, want, got = recall(spark, texts)
    assert all(got[i] for i, w in enumerate(want) if w) and share >= 0.95


def test_random_edits(spark):
    rng = random.Random(5)
    texts = []
    for k in range(12):
        base = words(f"base{k}", 700).split()
        texts.append(" ".join(base))
        for j in range(4):
            copy = [f"e{k}{j}{p}" if rng.random() < 0.012 else w for p, w in enumerate(base)]
            texts.append(" ".join(copy[rng.randrange(200) :]))
    texts += [words(f"lone{k}", 150) for k in range(10)]
    share, want, got = recall(spark, texts)
    assert share >= 0.95 and [g for g, w in zip(got, want, strict=True) if not w] == [set()] * 10


def test_matches_go_on_beyond_the_reach(spark, monkeypatch):
    """Without further minimisers to go on from, a match is extended in rounds."""
    monkeypatch.setattr(D, "WINDOW", 400)
    passage = words("passage", 600)
    texts = [f"{words('a', 30)} {passage} {words('b', 30)}", f"{words('c', 45)} {passage} {words('d', 10)}"]
    assert found(spark, texts) == [set(range(30, 630)), set(range(45, 645))]


@pytest.mark.parametrize("n", [49, 50])
def test_shortest_passage(spark, n):
    texts = [f"{words('a', 60)} {words('p', n)} {words('b', 60)}", f"{words('c', 33)} {words('p', n)} {words('d', 70)}"]
    assert found(spark, texts) == ([set(), set()] if n < 50 else [set(range(60, 110)), set(range(33, 83))])


def test_odd_rows(spark):
    long = words("long", 30_000)
    rows = [(1, None, 0, "h"), (2, "", 0, "h"), (3, long, 1, "h"), (4, long, 2, "h"), (4, long, 2, "h"), (None, "few words", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, id string")
    got = D.repeats(df)
    assert sorted((str(r["row"].doc_id), r.n_words, [(s.first_word, s.end_word) for s in r.spans]) for r in got.collect()) == [("1", 0, []), ("2", 0, []), ("3", 30000, [(0, 30000)]), ("4", 30000, [(0, 30000)]), ("4", 30000, [(0, 30000)]), ("None", 2, [])]
    assert got.select("row.*").columns == df.columns and D.repeats(df.where("false")).count() == 0
