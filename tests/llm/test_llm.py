"""The training-data operators: odd rows, brute force on small tables, and the pipeline's stages."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlight.llm import exact_dedup, near_dedup, pieces, quality, queries, suffix_dedup
from tests.test_queries import duck, rows  # noqa: F401

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    return " ".join(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:6] for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = words("a", 200)
    edited = base.replace(words("a", 200).split()[100], "changed")
    texts = [base, base, edited, words("b", 120), words("c", 60) + " " + words("a", 80), "", None, " \n\t", words("d", 30_000), "one", "one"]
    return spark.createDataFrame([(i, t, "en", "web" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(queries.ORACLES[name]).df())


def test_exact_copies_by_brute_force(spark, odd):
    all_rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.copy_groups(odd).collect()}
    for i, t in all_rows:
        r = got[i, hashlib.sha256(t.encode()).hexdigest()]
        same = [j for j, u in all_rows if u == t]
        assert (r.keep_id, r.group_size, r.kept) == (max(same, key=lambda x: -1 if x is None else x), len(same), i == r.keep_id)


def test_near_copies_by_brute_force(spark, odd):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    all_rows = {r.doc_id: sets(r.text) for r in odd.collect()}
    classes = {r["row"].doc_id: r.class_id for r in near_dedup.classes(odd).collect()}
    for i, a in all_rows.items():
        for j, b in all_rows.items():
            close = len(a & b) / len(a | b) if a | b else 1.0
            if close >= 0.85 or close < 0.7:
                assert (classes[i] == classes[j]) == (close >= 0.85)


def test_near_dedup_keeps_one_of_each_class(spark, odd):
    kept = sorted(r.doc_id for r in near_dedup.deduplicated(odd).where("doc_id IS NOT NULL").collect())
    want = sorted({r.class_id for r in near_dedup.classes(odd).collect() if r.class_id is not None})
    assert kept == want and near_dedup.deduplicated(odd).columns == odd.columns


def test_repeated_passages(spark, odd):
    spans = {r["row"].doc_id: r.spans for r in suffix_dedup.repeats(odd).collect()}
    assert [(s.first_word, s.end_word) for s in spans[4]] == [(60, 140)]
    assert [(s.first_word, s.end_word) for s in spans[0]] == [(0, 200)] and spans[3] == [] and spans[6] == [] and spans[8] == []


def test_quality_without_labels_is_the_base_rule(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judged(odd, labels).collect():
        assert r.kept == (not r.base_failed) and r.n_words == len((r["row"].text or "").split())


def test_pieces_round_trip(spark, odd):
    out = pieces.encoded(odd, pieces.model_bytes())
    assert out.count() == odd.count() and out.where("row.text IS NULL AND size(ids) > 0").count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, stage):
    assert stage(spark, odd, DATA).count() >= 0
    assert stage(spark, odd.where("false"), DATA).count() == 0


def test_stages_keep_the_columns(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DATA).columns == odd.columns


def test_queries_name_each_operator_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
