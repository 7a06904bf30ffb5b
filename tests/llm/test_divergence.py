"""The source audit against sums over all kept terms, on random small corpora, with many shards, salts and blocks."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence
from ledgerloom.llm.divergence import Audit, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs=3, scale=10**9, top=200):
    """rows: (text, lang, source)."""
    docs = defaultdict(list)
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)))
    out = []
    for lang, own in docs.items():
        kept = sorted(t for t, n in Counter(t for _, ts in own for t in set(ts)).items() if n >= min_docs)
        count = {s: Counter() for s, _ in own}
        for s, ts in own:
            count[s].update(t for t in ts if t in set(kept))
        all_ = sum(count.values(), Counter())
        p = {s: {t: 1 + scale * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in count.items()}
        q = {t: 1 + scale * (all_[t] + 1) // (all_.total() + len(kept)) for t in kept}
        for s in count:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def result(df, audit=Audit()):
    return sorted(map(tuple, source_divergence(df, audit).collect()))


def corpus(n, sources, langs, words, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß日🙂Z") for _ in range(r.randint(1, 4))) for _ in range(words)]
    rows = []
    for _ in range(n):
        lang = r.choice(langs)
        text = r.choice([" ", "\n", "-", "1", "\0"]).join(vocab[min(int(r.expovariate(0.15)), words - 1)] for _ in range(r.randint(0, 40)))
        rows.append((r.choice([text, text, text.upper(), ""]), lang, r.choice(sources)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA).repartition(5)


SMALL = {"tallies": 60, "chunk": 50, "held": 300, "pairs": 50}


@pytest.mark.parametrize("audit", [Audit(), Audit(terms=7, text=200, sources=2, **SMALL), Audit(terms=1000, text=100, sources=3, top=4, **SMALL)])
def test_equals_sums_over_all_kept_terms(spark, audit):
    rows = corpus(400, ["a", "b", "", "é", "Zz"], ["en", "fr", ""], 60, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert result(frame(spark, rows), audit) == brute(rows, top=audit.top)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows_and_other_columns(spark):
    rows = [(None, None, None), ("", "", ""), ("x x", "en", None), ("X", "en", ""), ("x y", "en", "a"), ("y", "en", "b"), ("y Y", "en", "b"), ("123 !", "de", "a"), ("123 !", "de", "b"), ("w " * 90_000 + "v" * 100_000, "en", "a"), (None, "en", "c")]
    df = frame(spark, rows)
    for name in ("n", "g", "kept", "value", "item", "term", "rank", "a.b"):
        df = df.withColumn(name, F.lit(1))
    assert result(df.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))) == brute(rows)
    assert result(df.limit(0)) == []


def test_one_source_and_no_shared_terms(spark):
    rows = [("only this", "en", "a")] * 3 + [("nur das", "de", s) for s in "abc"] + [(w, "fr", s) for s, w in zip("aaabbb", ["un", "un", "un", "deux", "deux", "deux"])]
    assert result(frame(spark, rows)) == brute(rows)


def test_large_counts_are_exact():
    import numpy as np
    import pyarrow as pa

    n, room = [5 * 10**18, 10**17], 6 * 10**18
    t = pa.table({"lang": ["x"] * 2, "term": ["t"] * 2, "g": pa.array([0, 1], pa.int32()), "n": n, "p": [10**9, 10**8], "p0": [1, 1], "room": [room] * 2})
    (terms, pairs) = list(divergence._of_terms(Audit())(iter(t.to_batches())))
    q = 1 + 10**9 * (sum(n) + 1) // room
    assert terms.column("value").to_pylist() == [(10**9 - q) ** 2 // q]
    assert np.array_equal(np.sort(pairs.column("g").to_numpy()), [0, 1])
