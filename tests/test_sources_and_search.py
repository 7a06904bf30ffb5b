"""Checkpoints that survive failures, rejected entries, audits of passages, and search of names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, search
from ledgerloom.sources import batch, config

ROWS = "row_index long, status string, payload string"


def rows(spark, lo, hi, payload, ok=True):
    return spark.createDataFrame([(i, "ok" if ok or i % 2 else "failed", payload) for i in range(lo, hi + 1)], ROWS)


def read(spark, path, run="run"):
    return {r.row_index: (r.status, r.payload) for r in batch.read_checkpoint(spark, path, run).collect()}


def test_a_run_that_fails_between_its_writes_is_resumed(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cp"
    todo = spark.createDataFrame([(i,) for i in range(1, 9)], "row_index long")
    assert read(spark, path) == {}
    batch.append_checkpoint(rows(spark, 1, 4, "a", ok=False), path, "run")
    with monkeypatch.context() as m:
        m.setattr(batch, "commit_part", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            batch.append_checkpoint(rows(spark, 5, 8, "b"), path, "run")
    assert set(read(spark, path)) == {1, 2, 3, 4}  # what wasn't committed isn't there
    left = sorted(r.row_index for r in batch.remaining(todo, batch.read_checkpoint(spark, path, "run"), "row_index").collect())
    assert left == [2, 4, 5, 6, 7, 8]
    batch.append_checkpoint(rows(spark, 5, 8, "b"), path, "run")
    batch.append_checkpoint(rows(spark, 5, 8, "b"), path, "run")  # a repeated batch doesn't double its rows
    batch.append_checkpoint(rows(spark, 1, 4, "c"), path, "run")
    assert batch.read_checkpoint(spark, path, "run").count() == 8
    assert read(spark, path) == {**{i: ("ok", "c") for i in range(1, 5)}, **{i: ("ok", "b") for i in range(5, 9)}}
    batch.append_checkpoint(rows(spark, 3, 3, "x"), path, "run", (2, 6))
    assert sorted(read(spark, path)) == [1, 3, 7, 8] and read(spark, path, "other") == {}
    batch.append_checkpoint(rows(spark, 1, 0, "none"), path, "run")
    assert sorted(read(spark, path)) == [1, 3, 7, 8]


def test_rejected_entries_are_told(spark, tmp_path):
    whole = {"question": "q", "keywords": "k", "description": "d", "summary": "s", "retrieval": {"bm25_terms": ["a"]}}
    for name, text in {"good": json.dumps(whole), "broken": "{", "list": "[1]", "bare": "{}", "text": '"x"', "empty": "", "nulls": json.dumps({**whole, "question": None})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    kept, rejected = config.read_bank_files(spark, str(tmp_path))
    assert {r.field for r in kept.collect()} == {"good", "nulls"} and [r.field for r in config.read_bank(spark, str(tmp_path)).collect()] == ["good"]
    assert {r.field: r.reason for r in rejected.collect()} == {"broken": "no JSON", "list": "no object", "text": "no object", "bare": "missing description, keywords, question"}  # an empty file has no row


def test_audit_of_passages(spark):
    sizes = [7, 70, 14, 35, 70, 0]
    bank = spark.createDataFrame([("ai", f"f{i}", {"hypothetical_passage": "x" * n, "bm25_terms": ["t"] * i}) for i, n in enumerate(sizes)], "kind string, field string, retrieval struct<hypothetical_passage:string,bm25_terms:array<string>>").repartition(4)
    out = config.token_rows(bank, most=10).orderBy("place").collect()
    assert [(r.tokens, r.field, r.long) for r in out] == [(20, "f4", True), (20, "f1", True), (10, "f3", False), (4, "f2", False), (2, "f0", False), (0, "f5", False)]
    assert tuple(config.token_audit(bank).first()) == (0, 4, 20, 6)
    assert tuple(config.token_audit(bank.limit(0)).first()) == (None, None, None, 0)


def similarity(a, b):
    x, y = ({f"  {n} "[i : i + 3] for i in range(len(n) + 1)} for n in (a, b))
    return len(x & y) / len(x | y)


def test_search_equals_comparing_all_names(spark):
    r = random.Random(4)
    names = sorted({"".join(r.choice("abc-1") for _ in range(r.randint(1, 9))) for _ in range(120)})
    catalog = spark.createDataFrame([(k, n, i, f"id{i}") for i, n in enumerate(names) for k in ("ai", "data")], "kind string, name string, pos int, identifier string")
    asked = sorted({n if r.random() < 0.2 else n[: r.randint(1, 9)] + r.choice("abz") for n in names})
    got = {x.name_key: (x.name, round(x.similarity, 9)) for x in graph.search_names(spark.createDataFrame([("ai", a) for a in asked], "kind string, name_key string"), catalog, 0.4).collect()}
    want = {}
    for a in asked:
        best = min((-similarity(a, n), i, n) for i, n in enumerate(names))
        if -best[0] >= 0.4:
            want[a] = (best[2], round(-best[0], 9))
    assert got == want and len(got) > 20


def test_names_of_common_words_are_searched_without_comparing_all(spark, monkeypatch):
    r = random.Random(5)
    names = [f"model {r.choice(('large', 'small', 'hot'))} {r.choice(('ring', 'bolt'))} number {i}" for i in r.sample(range(100_000, 999_999), 600)]
    catalog = spark.createDataFrame([("ai", n, i, f"id{i}") for i, n in enumerate(names)], "kind string, name string, pos int, identifier string")
    forms = [lambda n: n, lambda n: n.replace("number", "nunber"), lambda n: n.replace("model", "modell"), lambda n: "unlike " + n[-6:]]
    asked = sorted({forms[i % 4](n) for i, n in enumerate(names)})
    odd = sorted({n[:20] + r.choice("xyz") + n[21:] for n in names[::40]} | {"mo" + n[-9:] for n in names[::60]} | {"", "model", "model large ring"})
    met, inner = [], search.candidates
    monkeypatch.setattr(search, "candidates", lambda *a: met.append(inner(*a)) or met[-1])
    for those in (asked, odd):
        got = {x.name_key: (x.name, round(x.similarity, 9)) for x in graph.search_names(spark.createDataFrame([("ai", a) for a in those], "kind string, name_key string"), catalog, 0.6).collect()}
        best = {a: min((-similarity(a, n), i, n) for i, n in enumerate(names)) for a in those}
        assert got == {a: (n, round(-s, 9)) for a, (s, _, n) in best.items() if -s >= 0.6} and len(got) > 5
    # All names have most trigrams in common, and 600 asked ones would meet some 100 each by these.
    assert met[0].count() < 3 * len(asked)


def test_names_are_resolved_by_search(spark):
    known = spark.createDataFrame([("ai", "Bert Base", "org/b", 1), ("ai", "bert base", "late/b", 2), ("data", "Squad", "d/squad", 1)], "kind string, name string, identifier string, pos int")
    nodes = spark.createDataFrame([("bert-base ", "ai"), ("BERT BASE", "ai"), ("o/n", "ai"), ("squadd", "data"), ("squad", "ai"), ("", "ai"), (None, "ai")], "target string, kind string")
    assert [r.identifier for r in graph.resolve_names(nodes, known, least=0.5).sort(F.asc_nulls_last("target"), "kind").collect()] == [None, "org/b", "org/b", "o/n", None, "d/squad", None]
    exact = {r.target: r.identifier for r in graph.resolve_names(nodes, known).collect()}
    assert exact["bert-base "] is None and exact["BERT BASE"] == "org/b"


def test_combined_documents_are_arrays_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"a{i:03d}", json.dumps({"i": i})) for k in ("ai", "data") for i in range(50)] + [("other", "x", "{}")], "kind string, artifact_id string, json string").repartition(6)
    batch.write_combined(docs, str(tmp_path / "out"))
    for kind, want in (("ai", [{"i": i} for i in range(50)]), ("data", [{"i": i} for i in range(50)]), ("other", [{}])):
        text = "".join(p.read_text() for p in sorted((tmp_path / "out" / f"kind={kind}").glob("*.txt")))
        assert json.loads(text) == want
