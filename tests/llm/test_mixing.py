"""Mixing by hand-made trees, and against a plain recursion."""

import hashlib
import re
from fractions import Fraction

import pytest

from barlight.llm import mixing as M

LEVELS = [M.Level("lang", {"en": 3, "de": 0}), M.Level("source", {"a": 2, "off": 0})]


def shared(caps, weights, budget):
    """Of named children: tokens by weight, at most their cap, in whole tokens."""
    got, open_, rest = {}, sorted(k for k in caps if weights[k] > 0), budget
    while True:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] * total <= rest * weights[k]]
        if not full:
            break
        first = min(full, key=lambda k: (Fraction(caps[k], weights[k]), k))
        got[first], rest = caps[first], rest - caps[first]
        open_.remove(first)
    shares = {k: divmod(rest * weights[k], total) for k in open_}
    over = rest - sum(s for s, _ in shares.values())
    for place, k in enumerate(sorted(open_, key=lambda k: (-shares[k][1], k))):
        got[k] = shares[k][0] + (place < over)
    return got


def planned(rows, levels, share, epochs, seed):
    """Copies of each row of (doc_id, text, lang, source)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    weight = lambda level, v: level.weights.get(v, level.default)
    leaf = [(r[2] or "", r[3] or "") for r in rows]
    usable = {x for x in leaf if weight(levels[0], x[0]) > 0 and weight(levels[1], x[1]) > 0}
    cap = {x: epochs * sum(s for s, y in zip(size, leaf, strict=True) if y == x) for x in usable}
    tops = {k for k, _ in usable}
    budget = min(int(sum(size) * share), sum(cap.values()))
    first = shared({k: sum(v for x, v in cap.items() if x[0] == k) for k in tops}, {k: weight(levels[0], k) for k in tops}, budget) if tops else {}
    out = [0] * len(rows)
    used = 0
    for k in tops:
        below = {x[1]: v for x, v in cap.items() if x[0] == k}
        for s, tokens in shared(below, {x: weight(levels[1], x) for x in below}, first[k]).items():
            mine = [i for i, x in enumerate(leaf) if x == (k, s)]
            supply = sum(size[i] for i in mine)
            used += tokens
            n, rest = divmod(tokens, supply) if supply else (0, 0)
            key = lambda i, n=n: (hashlib.md5(f"{seed}:{n}:{'null' + hashlib.md5((rows[i][1] or '').encode()).hexdigest() if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][0])
            upto = 0
            for i in sorted(mine, key=key):
                upto += size[i]
                out[i] = n + (tokens < epochs * supply and upto <= rest)
    assert used == budget
    return out


def corpus(n):
    langs, sources = ["en", "de", "fr", None], ["a", "b", "off", None]
    return [(i, " ".join(["w"] * (i * 7 % 23)), langs[i % 3 if i % 11 else 3], sources[i * 5 % 4]) for i in range(n)]


@pytest.mark.parametrize(("n", "share"), [(300, 0.3), (300, 0.9), (300, 7.0), (40, 0.05), (1, 1.0)])
def test_copies_by_brute_force(spark, n, share):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.id: r.copies for r in M.planned(df, LEVELS, share, 4, 7, "doc_id", "text").collect()}
    assert [got[r[0]] for r in rows] == planned(rows, LEVELS, share, 4, 7)


def test_budget_of_children_without_weight_goes_to_siblings(spark):
    leaves = [("en", "a", 250, 250), ("en", "off", 1000, 1000), ("fr", "b", 500, 500), ("de", "a", 900, 900)]
    df = spark.createDataFrame(leaves, "l0 string, l1 string, supply long, cap long")
    assert {(r.l0, r.l1): r.got for r in M.budgets(df, LEVELS, 700).collect()} == {("en", "a"): 250, ("fr", "b"): 450}


def test_rounding_loses_no_token(spark):
    df = spark.createDataFrame([("x", f"s{i}", 10**12, 10**12) for i in range(7)], "l0 string, l1 string, supply long, cap long")
    got = [r.got for r in M.budgets(df, [M.Level("l0", {}), M.Level("l1", {"s0": 3})], 10**11 + 5).collect()]
    assert sum(got) == 10**11 + 5


def test_odd_rows(spark):
    rows = [(None, "a b", "en", "a", "r", 1), (5, None, None, None, "r", 2), (5, "x " * 100_000, "en", "a", None, 3), (5, "x " * 100_000, "en", "a", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, copies long")
    out = M.mixed(df, LEVELS, 1.0, 2, 7)
    assert out.columns == df.columns and out.count() >= 2 and M.mixed(df.where("false"), LEVELS, 1.0).count() == 0


def test_rows_without_id_do_not_depend_on_partitioning(spark):
    rows = [(None, " ".join(["w"] * (1 + i * 7 % 23)) + f" {i // 2}", "en", "a", i) for i in range(40)] + [(3, "same text", "en", "a", i) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int")
    found = [sorted(map(tuple, M.mixed(df.orderBy(o).repartition(n, "n"), LEVELS, 0.4).collect()), key=repr) for n, o in ((1, "n"), (3, "text"), (8, "n"))]
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) < len(rows)
    plain = [r[:4] for r in rows if r[0] is None]
    got = {r["row"].text: r.copies for r in M.planned(df.where("doc_id IS NULL"), LEVELS, 0.4, 4, 7, "doc_id", "text").collect()}
    assert [got[r[1]] for r in plain] == planned(plain, LEVELS, 0.4, 4, 7)
