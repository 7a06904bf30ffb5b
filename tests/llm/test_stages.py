"""Stages on tables of awkward columns, and what failures leave behind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import common, linededup, neardup

LINE = "This very line is longer than forty code points, surely."


@pytest.fixture(scope="module")
def awkward(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    text = " ".join(words)
    rows = [(i, f"{LINE}\nown text number {i} and mail a{i}@b.example.org", "en", "s", 9) for i in range(6)]
    rows += [(10, text, "en", "s", 1), (11, text, "en", None, 1), (11, text, "en", None, 1), (12, text + " thirteen", None, "s", 1), (None, text, "en", "s", 1), (13, None, "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = {"a.b": F.lit("x"), "row.text": F.lit(1), "c`d": F.lit(2), "e f": F.array(F.lit(1)), "m": F.create_map(F.lit("k"), F.lit(1)), "s": F.struct(F.lit(1).alias("p.q")), "row": F.lit(3), "drops": F.lit(4)}
    return df.withColumns(odd)


def test_all_stages_keep_columns_of_any_name_and_type(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == awkward.columns, name
        docs = common.materialise(out, name)
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {0, 1, 2, 3, 4, 5, 10, None} and docs.count() == 8
    assert left[0].text == "own text number 0 and mail [EMAIL]" and left[5].text.startswith(LINE) and left[0].n_chars == len(left[0].text)
    assert left[10]["a.b"] == "x" and left[10]["m"] == {"k": 1} and left[10]["row.text"] == 1 and left[10]["c`d"] == 2 and left[10]["s"]["p.q"] == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).where("start = 0").count() == 8
    assert corpus_pipeline.near_dedup(spark, awkward.limit(0), None).count() == 0


def test_a_store_that_fails_within_a_batch_is_as_before(spark, monkeypatch):
    batch = lambda i: spark.createDataFrame([(1, 1, i), (2, i, i)], "h1 long, h2 long, doc_id long")
    store = linededup.LineRuns(spark, fanout=2)
    store.add(batch(0))
    store.add(batch(1))
    before = sorted(map(tuple, store.totals().collect()))
    with monkeypatch.context() as m:
        m.setattr(linededup.LineRuns, "_commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(batch(2))
    again = linededup.LineRuns(spark, store.folder, fanout=2)
    assert sorted(map(tuple, again.totals().collect())) == before
    again.add(batch(2))
    assert again.totals().where("h1 = 1").first().n_docs == 3 and linededup.LineRuns(spark, store.folder, fanout=2).totals().count() == 4


def test_a_failed_write_leaves_settings_alone(spark):
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    with pytest.raises(Exception):
        common.materialise(spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("x")), "broken")
    assert spark.conf.get(clean, None) == before


def test_collisions_counted_by_merging_postings():
    r = np.random.default_rng(3)
    for values in (2, 5, 40):
        marks = r.integers(0, values, size=(60, neardup.COORDINATES)).astype(np.int32)
        for i in range(0, 40, 4):  # some that agree in many coordinates
            marks[i + 1, r.random(neardup.COORDINATES) < 0.6] = -1
            marks[i + 1] = np.where(marks[i + 1] == -1, marks[i], marks[i + 1])
        lists, of_row = neardup._postings(marks)
        assert all(len(x) > 1 for x in lists) and [len(x) for x in lists] == sorted(map(len, lists))
        for i in range(60):
            allowed = (r.random(60) < 0.8) & (np.arange(60) != i)
            want = np.flatnonzero(((marks == marks[i]).sum(axis=1) >= neardup.MATCHES) & allowed)
            assert np.array_equal(neardup._matching(lists, of_row[i], allowed), want)
