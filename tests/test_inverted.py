"""The written index against BM25 that counts all words, on random corpora, and what its plan reads."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import inverted, retrieval
from ledgerloom.operators.inverted import Index, bm25_from_index, build_index
from ledgerloom.operators.scratch import fresh_path


def corpus(spark, seed, n, sources=("a", "b", "é")):
    r = random.Random(seed)
    words = ["the", "of", *(f"w{i}" for i in range(25))]
    rows = []
    for i in range(n):
        size = r.choice([0, 1, 3, 10, 40, 120])
        text = " ".join(words[min(int(r.expovariate(0.3)), 26)] for _ in range(size))
        rows.append((i, r.choice([*sources, None]), r.choice([text, text.upper(), text, None]) if i % 9 == 0 else text))
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def rows_of(df):
    return sorted((r.query_id, getattr(r, "source", ""), r["rank"], r.doc_id, pytest.approx(r.score, abs=2e-6)) for r in df.collect())


@pytest.mark.parametrize("seed,at_hand,k", [(1, 1000, 20), (2, 5, 7), (3, 3, 1)])
def test_equals_counting_all_words(spark, monkeypatch, seed, at_hand, k):
    monkeypatch.setattr(inverted, "AT_HAND", at_hand)
    monkeypatch.setattr(inverted, "BLOCK", 4)
    docs = corpus(spark, seed, 300).unionByName(spark.createDataFrame([(999, "alone", "w1 w2")], "doc_id long, source string, text string"))
    asked = [(0, ["the", "w1", "w1"]), (1, ["w24", "w20"]), (2, ["nowhere"]), (3, ["of", "the", "w3", "w9", "w15"]), (4, ["w22", "nowhere"])]
    queries = spark.createDataFrame([(q, s, t) for q, t in asked for s in ("a", "b", "é", "alone", "gone")], "query_id int, source string, terms array<string>")
    index = build_index(docs, fresh_path(spark, "index"), ("source",))
    want = retrieval.bm25_top(queries, docs.where("source is not null"), k=k, on=("source",))
    assert rows_of(bm25_from_index(index, queries, k)) == rows_of(want)
    whole = build_index(docs, fresh_path(spark, "index"))
    queries = spark.createDataFrame(asked, "query_id int, terms array<string>")
    assert rows_of(bm25_from_index(whole, queries, k)) == rows_of(retrieval.bm25_top(queries, docs, k=k))


def test_reads_only_the_terms_and_levels_that_count(spark, capsys):
    docs = corpus(spark, 5, 3000, ("a",)).where("source is not null")
    path = fresh_path(spark, "index")
    build_index(docs, path, ("source",))
    index = Index(path, ("source",))  # opened again by its folder
    asked = spark.createDataFrame([(0, "a", "w5", 1), (0, "a", "w9", 2)], "query_id int, source string, term string, times long")
    levels, _ = inverted._needed_levels(index, asked, 3, True)
    every, _ = inverted._needed_levels(index, asked, 10**6, True)
    assert 0 < levels.count() < every.count()
    queries = spark.createDataFrame([(0, "a", ["w5", "w9", "w9"])], "query_id int, source string, terms array<string>")
    out = bm25_from_index(index, queries, 3)
    assert rows_of(out) == rows_of(retrieval.bm25_top(queries, docs, k=3, on=("source",)))
    capsys.readouterr()
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "In(term, [w5,w9])" in plan.replace("\n", "") or "In(term, [w9,w5])" in plan
    assert "PartitionFilters: [bucket" in plan
    assert "text" not in plan


def test_a_tasks_few_postings_of_a_term_are_one_row(spark):
    """Single postings would be as many rows to move as there are words in documents."""
    docs = corpus(spark, 7, 80).coalesce(1)
    index = build_index(docs, fresh_path(spark, "index"), ("source",))
    rows, terms = index.table(spark, "postings"), index.table(spark, "terms")
    assert rows.count() == terms.count() > 50
    assert rows.select(F.sum(F.size("doc_ids"))).first() == terms.select(F.sum("df")).first()
    assert rows.where(F.floor(F.array_min("weights") * inverted.LEVELS) != F.col("level")).isEmpty()


def test_retrieval_by_an_index_of_chunks(spark):
    r = random.Random(9)
    chunks = [(a, s, i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "words"]) for _ in range(12)), [r.random(), r.random()]) for a in ("m1", "m2") for s in ("hub", "repo") for i in range(15)]
    chunks = spark.createDataFrame(chunks, "artifact_id string, source string, chunk_index int, text string, embedding array<double>")
    questions = spark.createDataFrame([(a, f, [0.5, 0.2], t) for a in ("m1", "m2") for f, t in (("license", ["alpha", "beta"]), ("domain", ["gamma"]))], "artifact_id string, field string, embedding array<double>, terms array<string>")
    order = spark.createDataFrame([("license", "hub", 0), ("license", "repo", 1)], "field string, source string, ord int")
    index = build_index(chunks.withColumnRenamed("chunk_index", "doc_id"), fresh_path(spark, "index"), ("artifact_id", "source"))
    by_index = retrieval.retrieve(questions, chunks, order, partial(bm25_from_index, index))
    assert sorted(by_index.collect()) == sorted(retrieval.retrieve(questions, chunks, order).collect())


def test_empty_and_awkward_documents(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", " \t"), (4, "a", "x " * 50_000), (5, "a", "x")], "doc_id long, source string, text string").withColumn("term", F.lit(1))
    queries = spark.createDataFrame([(0, "a", ["x", "x"]), (1, "a", [])], "query_id int, source string, terms array<string>")
    index = build_index(docs, fresh_path(spark, "index"), ("source",))
    assert rows_of(bm25_from_index(index, queries)) == rows_of(retrieval.bm25_top(queries, docs, on=("source",)))
    none = build_index(docs.limit(0), fresh_path(spark, "index"), ("source",))
    assert bm25_from_index(none, queries).count() == 0
