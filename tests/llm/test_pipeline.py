"""Each stage of the pipeline against a brute-force version, and operators on tables with awkward columns."""

import hashlib
from pathlib import Path

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from barlight.llm import exact_dedup, mixing, near_dedup, pieces
from barlight.llm.tables import deleted, read, saved
from tests.llm.test_llm import SCHEMA, words
from tests.llm.test_mixing import shared
from tests.llm.test_near_chains import corpus, labels_of_all_pairs
from tests.llm.test_quality import counts

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus() + [words(f"own{k}", 60 + k) for k in range(30)]
    texts += texts[:5] + ["short text", "the same three words " * 60, "", None]
    return [(i, t, "en" if i % 3 else "de", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]


def run(spark, stage, rows):
    out = STAGES[stage](spark, spark.createDataFrame(rows, SCHEMA), DATA)
    return sorted(map(tuple, out.collect()), key=repr)


def test_quality_rules(spark, docs):
    """Base failures go; all others are clean prose that the forest keeps."""
    assert run(spark, "quality rules", docs) == sorted((r for r in docs if not counts(r[1] or "")[-1]), key=repr)


def test_exact_dedup(spark, docs):
    last = {r[1] or "": r for r in docs}
    assert run(spark, "exact dedup", docs) == sorted(last.values(), key=repr)


def test_near_dedup(spark, docs):
    rows = [r for r in docs if len((r[1] or "").split()) >= 50]
    label = labels_of_all_pairs([r[1] for r in rows], near_dedup.THRESHOLD)
    assert run(spark, "near dedup", rows) == sorted((r for i, r in enumerate(rows) if label[i] == i), key=repr)


def test_mixing(spark, docs):
    """By the tree of domains, languages and sources, level by level."""
    out = run(spark, "mixing", docs)
    size = {r: len((r[1] or "").split()) for r in docs}
    path = {r: (f"d{int(r[3][3:]) % 4}", r[2], r[3]) for r in docs}
    weight = [lambda v, level=level: level.weights.get(v, level.default) for level in mixing.LEVELS]
    got = {(): int(sum(size.values()) * mixing.BUDGET_SHARE)}
    for d in range(3):
        cap = {}
        for r in docs:
            key = path[r][: d + 1]
            cap[key] = cap.get(key, 0) + mixing.MAX_EPOCHS * size[r]
        nodes, got = got, {}
        for above, budget in nodes.items():
            below = {k: v for k, v in cap.items() if k[:d] == above}
            got |= shared(below, {k: weight[d](k[-1]) for k in below}, min(budget, sum(below.values())))
    want = []
    for leaf, tokens in got.items():
        mine = [r for r in docs if path[r] == leaf]
        supply = sum(size[r] for r in mine)
        n, rest = divmod(tokens, supply)
        upto = 0
        for r in sorted(mine, key=lambda r: hashlib.md5(f"{mixing.SEED}:{n}:{r[0]}".encode()).hexdigest()):
            upto += size[r]
            want += [r] * (n + (tokens < mixing.MAX_EPOCHS * supply and upto <= rest))
    assert out == sorted(want, key=repr)


def test_encoding(spark, docs):
    other = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    want = [(r[0], r[2], r[3], len(ids), ids) for r in docs for ids in [other.encode(r[1] or "")]]
    assert run(spark, "encoding", docs) == sorted(want, key=repr)


def test_whole_run_chains_the_stages(spark):
    step = read(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        step = saved(stage(spark, step, DATA), "step")
    got = corpus_pipeline.run(spark, DATA)
    assert got.exceptAll(step).count() == 0 and step.exceptAll(got).count() == 0


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named like those that operators use inside, one of them a map."""
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate([words("a", 90), words("a", 90), words("b", 80), "few words", ""])]
    names = ["row", "id", "key", "digest", "candidate", "band", "bucket", "label", "class", "kept", "n", "at1", "bits1", "of", "h", "tokens", "l0", "range", "copies", "h1", "spans"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in names})
    return df.withColumn("more", F.create_map(F.lit("k"), F.col("doc_id")))


@pytest.mark.parametrize("stage", ["quality rules", "exact dedup", "near dedup", "mixing"])
def test_stages_with_clashing_columns(spark, clashing, stage):
    out = STAGES[stage](spark, clashing, DATA)
    assert out.columns == clashing.columns and out.count() == {"quality rules": 3, "exact dedup": 4, "near dedup": 4}.get(stage, out.count())


def test_full_filter_gives_the_same_rows(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    few = exact_dedup.copy_groups(df, max_bits=exact_dedup.BUCKET)
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, exact_dedup.copy_groups(df).collect()), key=repr)


def test_repeated_rows_that_differ_elsewhere(spark):
    df = spark.createDataFrame([(1, "same text", "en", c, k) for k, c in enumerate("ab")] + [(1, "same text", "en", "a", 0)], SCHEMA)
    assert exact_dedup.deduplicated(df).count() == 1 and near_dedup.deduplicated(df).count() == 1


def test_deleted_tables_are_gone(spark):
    table = saved(spark.range(10), "gone")
    files = [f.removeprefix("file://") for f in table.inputFiles()]
    assert files and all(Path(f).exists() for f in files)
    deleted(table)
    assert not any(Path(f).exists() for f in files)
