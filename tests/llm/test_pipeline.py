"""Each stage of the pipeline on its own input, against a brute-force version."""

import collections
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import _base_spans, _components, plain_chain

import corpus_pipeline
from ledgerloom.llm import langid


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_000, "", None, "s", 0), (10_001, "123 456", "en", "s", 7), (10_002, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_stages_are_named_and_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii", "packing"]
    for rows in steps[1:5]:
        assert rows[0].__fields__ == steps[0][0].__fields__


def test_language_stage_rejects_only_texts_without_language(steps):
    gone = {r.doc_id for r in steps[0]} - {r.doc_id for r in steps[1]}
    assert gone == {10_000, 10_001, 10_002}


def test_language_stage_decides_as_plain_sums_do(spark, steps):
    """The mean of each lettered word's highest posterior, from another forward-backward, is 0.4 at least where a text stays."""
    docs = spark.createDataFrame(steps[0], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.learn(docs, F.lit(True))
    kept = {r.doc_id for r in steps[1]}
    for r in steps[0]:
        found = plain_chain(r.text, model)
        sure = np.mean([x.max() for x in found]) if found else 0.0
        assert (r.doc_id in kept) == (sure >= 0.4) or abs(sure - 0.4) < 1e-5


def test_line_stage(steps):
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for r in steps[1]:
        for line in r.text.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r.doc_id)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if last.get(key(x), r.doc_id) == r.doc_id) for r in steps[1]}
    assert {r.doc_id: r.text for r in steps[2]} == want and all(r.n_chars == len(r.text) for r in steps[2])


def test_near_duplicate_stage(steps):
    kept = {d for d, _, _, k in _components([(r.doc_id, r.text) for r in steps[2]]) if k}
    assert {r.doc_id for r in steps[3]} == kept and len(kept) < len(steps[2])


def test_personal_data_stage(steps):
    before = {r.doc_id: r.text for r in steps[3]}
    assert {r.doc_id for r in steps[4]} == set(before)
    for r in steps[4]:
        spans = sorted((a, b, k) for k, a, b in _base_spans(before[r.doc_id]))
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r.text)) >= min(1, len(spans))
        if not spans:
            assert r.text == before[r.doc_id] or "[" in r.text
    assert not any(k == "email" for r in steps[4] for k, _, _ in _base_spans(r.text))


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in steps[5]:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {r.doc_id for r in steps[4]}
    for r in steps[4][:60]:
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1]) and sum(p.length for p in own) == n == own[0].doc_tokens


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100


def test_language_stage_keeps_switched_texts_and_unlabelled_corpora(spark):
    words = {x: [f"{a}{b}{c}" for a in s for b in s for c in s] for x, s in (("aa", "abcde"), ("bb", "fghij"), ("cc", "klmno"), ("dd", "pqrst"))}
    rows = [(100 * n + i, " ".join(w[(i * 7 + j * 3) % 125] for j in range(40)), x, "s", 0) for n, (x, w) in enumerate(words.items()) for i in range(40)]
    rows += [(9000, " ".join(x for w in words.values() for x in w[:30]), "aa", "s", 0), (9001, "12 -- 34", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {r[0] for r in rows} - {9001}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, bare, "").collect()} == {r[0] for r in rows} - {9001}


def test_stages_tell_rows_of_null_or_repeated_ids_apart(spark):
    copied, own = "these ten words stand in many rows of this table", "another text of seven words or more follows here"
    rows = [(1, copied, "en", "a", 0), (2, copied, "en", "a", 0), (2, own, "en", "a", 0), (3, "a b c d e f g", "en", "a", 0), (3, "a b c d e f g", "en", "b", 0)]
    rows += [(1, copied.upper(), "en", "a", 0), (4, None, "en", "a", 0), (4, None, "en", "a", 0), (None, copied, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    left = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    of_one = [r for r in left if r[0] == 1]
    assert len(of_one) == 1 and of_one[0] in rows
    assert sorted(map(str, (r for r in left if r[0] != 1))) == sorted(map(str, [rows[2], rows[3], rows[6], rows[7], rows[8]]))
    mail = "write to a.b@example.org, please"
    private = spark.createDataFrame([(i, mail, "en", "a", 0) for i in (None, 5, 5)], docs.schema)
    assert [r.text for r in corpus_pipeline.pii(spark, private, "").collect()] == ["write to [EMAIL], please"] * 3
