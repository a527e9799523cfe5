"""Near dedup against all pairs: chains of copies, and several clusters that share much of their text."""

import math
from collections import Counter
from itertools import combinations

import pytest

from barlight.llm import near_dedup
from tests.llm.test_llm import words


def edited(text, places, name):
    out = text.split()
    for p in places:
        out[p] = f"{name}{p}"
    return " ".join(out)


def corpus():
    """Copies of one text with a copy of each copy that is too far from the first text, and clusters around common words."""
    texts = [first := words("first", 400)]
    for k in range(30):
        texts.append(copy := edited(first, [(13 * k) % 390 + 5], f"b{k}x"))
        texts.append(edited(copy, [(13 * k + 40 + 55 * j) % 390 + 5 for j in range(6)], f"c{k}x"))
    for k in range(5):
        texts.append(own := words("common", 330) + " " + words(f"own{k}", 70))
        texts += [edited(own, [30 * j + 7 * k + 5], f"d{k}x{j}") for j in range(6)]
    return texts


def labels_of_all_pairs(texts, threshold):
    bags = []
    for t in texts:
        w = t.lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    df = Counter(g for bag in bags for g in bag)
    weight = {g: 0.75 + 0.25 * min(1.0, math.log(len(texts) / n) / math.log(100)) for g, n in df.items()}
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        common = sum(weight[g] * min(n, bags[j][g]) for g, n in bags[i].items() if g in bags[j])
        union = sum(weight[g] * n for bag in (bags[i], bags[j]) for g, n in bag.items()) - common
        if common / union >= threshold:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("crowd", [256, 8])
def test_chains_and_clusters_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dedup, "CROWD", crowd, raising=False)
    texts = corpus()
    want = labels_of_all_pairs(texts, near_dedup.THRESHOLD)
    assert 1 < len(set(want)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"].doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
