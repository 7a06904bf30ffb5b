"""Each operator on awkward rows, on an empty table and against a brute-force version."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import balltree, bpe, common, hnsw, langid, linededup, lm, neardup, packing, pii, quality

LINE = "This very line is longer than forty code points, surely."
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (5, "one two three"),
    (6, "ONE two\tthree"),
    (None, "a row without an id and enough words to make a shingle or two"),
    (7, "word " * 30000),
    (8, "\n".join([LINE, "x", LINE.upper()])),
    (9, f"  {LINE}\t\nown 1"),
    (10, f"{LINE}\nown 2 mail a.b@c.example.org"),
    (11, f"{LINE}\nown 3 +1 (555) 010-9999"),
    (12, f"{LINE}\nown four, 4111 1111 1111 1111 and 10.0.0.255 1.2.3.256"),
    (13, "12345 ... --- !!!"),
    (14, "ünï日本   \xa0 <|endoftext|> 🙂"),
    (15, "a" * 50000 + "@"),
    (16, "1" * 50000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward documents, with further columns whose names the operators use themselves."""
    names = ["score", "key", "spans", "row", "lines", "drops", "doc", "line_doc", "pii_doc", "pii_text", "of_text", "own_doc", "text_hash", "words", "hub_class"]
    rows = [(i, x, "en", "s", *range(len(names))) for i, x in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} int" for x in names))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_language_model(docs, odd, none):
    held = common.crc_mod("doc_id", 7) == 2
    tokens = lambda x: (x or "").encode().lower().split() + [None]
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = lm.score_texts(df, held).collect()
        is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        count = collections.Counter(t for d, x in rows if not is_held(d) for t in tokens(x))
        n, v = sum(count.values()), len(count)
        want = sorted((str(d), is_held(d), len(tokens(x)), sum(count[t] > 0 for t in tokens(x))) for d, x in rows)
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known) for r in out) == want
        assert {r.train_tokens for r in out} == {n}
        by_id = {r.doc_id: r for r in out}
        for d, x in rows:
            assert by_id[d].base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(x)))
        assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    out = [r for r in lm.score_texts(docs, held).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score_texts(none, held).count() == 0
    assert lm.score_texts(odd, F.lit(True)).count() == len(ODD)


def test_language_model_probabilities_sum_to_one(spark):
    """Over all texts of the known words and one unknown word: the sums up to each length tend to 1."""
    train = ["a b", "a b", "a b", "a", "a c", "b a", "c a b", "c", "", "a b a b"]
    probe = [" ".join(t) for n in range(8) for t in itertools.product(["a", "b", "c", "zz"], repeat=n)]
    rows = spark.createDataFrame([(i, x, i >= len(train)) for i, x in enumerate([*train, *probe])], "doc_id long, text string, held boolean")
    sums = [0.0] * 8
    for r in lm.score_texts(rows, F.col("held")).where("held_out").collect():
        sums[r.n_tokens - 1] += 10**r.score
    rate = sums[7] / sums[5]  # over two lengths, as words alternate
    assert sum(sums) < 1 and sum(sums) + (sums[6] + sums[7]) * rate / (1 - rate) == pytest.approx(1, abs=3e-3)


def test_line_dedup(docs, odd, none):
    out = {(r.doc_id, r.kept_text): (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(odd).collect()}
    assert out[1, ""] == (1, 0) and out[8, "x"] == (3, 2) and out[9, "own 1"] == (2, 1)
    assert (12, ODD[13][1]) in out and out[None, ODD[7][1]] == (1, 0)
    assert linededup.dedup_lines(none).count() == 0
    for batches, fanout in ((1, 2), (7, 2)):
        again = linededup.dedup_lines(odd, batches=batches, fanout=fanout).collect()
        assert sorted(map(str, again)) == sorted(map(str, linededup.dedup_lines(odd).collect()))
    kept = linededup.drop_lines(odd)
    assert kept.columns == odd.columns and texts(kept)[1] is None and texts(kept)[8] == "x"


def test_line_runs_compact(spark):
    store = linededup.LineRuns(spark, fanout=2)
    batch = lambda i: spark.createDataFrame([(1, 1, i), (2, i, i)], "h1 long, h2 long, doc_id long")
    for i in range(4):
        store.add(batch(i))
    store = linededup.LineRuns(spark, store.folder, fanout=2)  # opened again
    store.add(batch(4))
    assert [len(store.level(n)) for n in range(4)] == [1, 0, 1, 0]
    assert store.totals().where("h1 = 1").collect()[0][2:] == (5, 4) and store.totals().count() == 6
    # A hash is in one run only, so the result is the runs': without the first batch's run, its lines are gone.
    assert store.runs().groupBy("h1", "h2").count().where("count > 1").count() == 0
    store.names = [x for x in store.names if not x.startswith("run-2-")]
    assert store.totals().where("h1 = 1").count() == 0


def _tree_and_graph(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 8))
    v[100:200] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)]
    rows += [(500, None), (501, []), (502, [float("nan")] * 8), (503, [None] * 8), (504, [0.0] * 8), (505, [1.0, 2.0]), (507, [float("inf")] * 8), (None, [1.0] * 8), (540, [3.0, 4.0])]
    return rows, spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")


def _brute(rows, queries, k, value, zero):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = {}
    for q, v in good:
        if q in queries:
            found = sorted((-sum(value(a) * value(b) for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_exact_top_k(spark, monkeypatch):
    rows, df = _tree_and_graph(spark)
    import ledgerloom.llm.vectors as vectors

    monkeypatch.setattr(vectors, "SHARD", 64)
    want = _brute(rows, {0, 50, 100, 150, 504, 505, 540}, 5, lambda x: math.floor(256 * x), True)
    got = collections.defaultdict(list)
    for r in balltree.exact_top_k(df, F.col("vec_id").isin(0, 50, 100, 150, 504, 505, 540)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {q: x for q, x in want.items() if x}
    assert balltree.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_hnsw(spark, monkeypatch):
    rows, df = _tree_and_graph(spark)
    import ledgerloom.llm.vectors as vectors

    monkeypatch.setattr(vectors, "SHARD", 128)
    queries = set(range(0, 400, 10)) | {504, 540}
    want = _brute(rows, queries, 20, float, False)
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id").isin(*queries)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert 504 not in got and set(got) <= set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all([s for _, s in x] == sorted((s for _, s in x), reverse=True) for x in got.values())
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def _base_spans(x):
    x, out = x or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)] if len(x) < 20000 else []
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))] if len(x) < 20000 else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub(r"\D", "", m.group())
        if 16 <= len(d) <= 19 and sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return out


CASES = [
    "a@b.c_x@d.e f@g 1.2.3.4.5.6.7.8 001.02.3.4 300.1.1.1 1.2.3",
    "x@y..z a@b.c.d. %+@-.- me@x.y@z.w",
    "4111-1111-1111-1111 4111 1111  1111 1111 41111111111111111111 5 4111111111111111 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1",
    "+1 (555) 010-9999 ++49 30 123456 +1234567 +12345678 +1-2-3-4-5-6-7-8- +1234567890123456 +1",
    "📧 ü@x.com é+4912345678é 日本1.2.3.4日本",
]


def test_personal_data(spark, docs, odd, none):
    made = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "doc_id long, text string")
    for df in (made, docs, odd):
        want = collections.Counter((r.doc_id, ",".join(f"{k}:{a}:{b}" for k, a, b in _base_spans(r.text))) for r in df.collect())
        found = pii.find_personal_data(df).select("doc_id", pii.spans_text(F.filter("spans", lambda s: s["base"])).alias("base"))
        assert collections.Counter((r.doc_id, r.base) for r in found.collect()) == want
    assert pii.find_personal_data(none).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    assert texts(clean)[10].endswith("mail [EMAIL]") and "[CARD] and [IP] 1.2.3.256" in texts(clean)[12] and texts(clean)[1] is None


def test_wider_spans_need_evidence(spark):
    rows = [(i, f"Call our phone line (212) 555-{1000 + i} or +1 212 555 {1000 + i} any day") for i in range(60)]
    rows += [(100, "write to jane (at) example (dot) org, e-mail joe@example.org")]
    out = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.base for s in out[3] if s.kind == "phone"].count(True) == 1
    assert any(s.base for s in out[100] if s.kind == "email")


def test_planted_spans(spark):
    """Precision and recall of what the method adds to the base spans: national numbers and written-out addresses among look-alikes."""
    r = __import__("random").Random(4)
    rows, want = [], {}
    for i in range(400):
        number = f"{r.randint(200, 989)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"
        kind = i % 5
        if kind == 0:
            x, mark = f"You can call our phone {number} or +1 {number.replace('-', ' ')} any day.", number
        elif kind == 1:
            x, mark = f"Tel: ({number[:3]}) {number[4:]}", f"({number[:3]}) {number[4:]}"
        elif kind == 2:
            x, mark = f"please write an e-mail to user{i} [at] mail{i}.com today", f"user{i} [at] mail{i}.com"
        elif kind == 3:
            x, mark = f"Part number ordered, serial {number}kg of it", None
        else:
            x, mark = f"mail a{i}@b{i}.org or phone +44 20 7946 {i:04d}", None
        rows.append((i, x))
        want[i] = mark
    added = {d: {x[s.start : s.end] for s in spans if not s.base} for d, x, spans in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").select("doc_id", "text", "spans").collect()}
    planted = [i for i in want if want[i]]
    hits = sum(want[i] in added[i] for i in planted)
    assert hits >= 0.9 * len(planted) and hits >= 0.95 * sum(map(len, added.values()))


def test_redaction_keeps_rows(spark):
    """Null and repeated ids, and columns of any name."""
    rows = [(None, "to c@d.example", 1), (1, "to a@b.example", 2), (1, "x", 3), (2, None, 4)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    assert sorted((str(r.doc_id), str(r.text), r["row"]) for r in out.collect()) == [("1", "to [EMAIL]", 2), ("1", "x", 3), ("2", "None", 4), ("None", "to [EMAIL]", 1)]


def test_reliabilities_follow_the_majority():
    patterns = [("ip", (1, 1, 1, -1, 1), 90), ("ip", (0, 0, -1, 0, 0), 80), ("ip", (1, 1, -1, -1, 1), 50)]
    p = pii.reliabilities(patterns)
    assert p["ip", (1, 1, 1, -1, 1)] > 0.9 and p["ip", (0, 0, -1, 0, 0)] < 0.1


def test_quality(spark, sf, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = common.crc_mod("doc_id", 4) == 2
    out = quality.score_quality(more, labels, ~held).where(held).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in out]) > 0.93
    few = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (9, None), (10, 7)], "doc_id long, quality int")
    for own in (few, few.limit(0), few.where("quality = 1")):
        scores = [r.score for r in quality.score_quality(odd, own, F.lit(True)).collect()]
        assert len(scores) == len(ODD) and all(0 <= x <= 1 for x in scores)
    assert quality.score_quality(none, few, F.lit(True)).count() == 0


def test_byte_bpe(odd, none):
    out = bpe.encode_decode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in out) == sorted((str(i), (x or "").encode()) for i, x in ODD)
    assert [r.ids for r in out if r.doc_id in (1, 2)] == [[], []]
    assert bpe.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def _components(rows):
    sets = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])))
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old = part[i]
                part = [part[j] if p == old else p for p in part]
    low = {p: min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in part}
    return sorted((rows[i][0], len(sets[i]), low[part[i]], rows[i][0] == low[part[i]]) for i in range(len(rows)))


def _chain(n):
    """Texts that each change one word of the one before: links along the chain, and none from end to end."""
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        words[(7 * i) % 60] = f"n{i}"
        out.append(" ".join(words))
    return out


def test_near_duplicates(spark, docs, odd, none, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(neardup.near_duplicates(docs)) == _components(rows)
    some = [(i, x) for i, x in ODD if i is not None]
    assert as_rows(neardup.near_duplicates(odd.where("doc_id is not null"))) == _components(some)
    assert [r.kept for r in neardup.near_duplicates(odd).where("doc_id is null").collect()] == [True]
    assert neardup.near_duplicates(none).count() == 0
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    chain = [(1000 - i, x) for i, x in enumerate(_chain(70))] + [(5, "an own text of more than five words stands here")]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert as_rows(neardup.near_duplicates(df)) == _components(chain)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    out = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _check_packing(rows, limits):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
    return by_doc, by_seq


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 50)])
def test_packing(docs, odd, none, limits):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    encode = lambda x: [*Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids, 1]
    rows = packing.pack_documents(docs, path, P.PATTERN, limits=limits).collect()
    by_doc, by_seq = _check_packing(rows, limits)
    for d, x in list(texts(docs).items())[:40]:
        own = sorted(by_doc[d], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == encode(x)
    if limits == packing.Limits():
        sizes = [sum(r.length for r in s) for s in by_seq.values()]
        assert sum(2048 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)
    _check_packing(packing.pack_documents(odd.where("doc_id <> 5"), path, P.PATTERN, limits=limits).collect(), limits)
    assert packing.pack_documents(none, path, P.PATTERN).count() == 0


def test_packing_of_instructions(spark):
    """Conversations: prompts bear no loss, and the limit on loss-bearing tokens closes sequences that have room for more tokens."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    said = turns.groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list(F.when(F.col("role") == "user", F.col("text")))).alias("asked"), F.concat_ws(" ", F.collect_list(F.when(F.col("role") != "user", F.col("text")))).alias("answer"))
    limits = packing.Limits(512, 8, 120)
    rows = packing.pack_documents(said, P.path("byte_bpe_50k.json"), P.PATTERN, limits=limits, id_column="conv_id", text_column="answer", prompt_column="asked").collect()
    by_doc, by_seq = _check_packing(rows, limits)
    full = [s for s in by_seq.values() if sum(r.loss_tokens for r in s) == limits.loss]
    assert any(sum(r.length for r in s) < limits.tokens and len(s) < limits.segments for s in full)
    from tokenizers import Tokenizer

    encode = lambda x: Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(x, add_special_tokens=False).ids
    for r in said.limit(20).collect():
        own = sorted(by_doc[r.conv_id], key=lambda p: p.start)
        assert np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist() == [*encode(r.asked), *encode(r.answer), 1]
        assert sum(p.loss_tokens for p in own) == len(encode(r.answer)) + 1 - (not r.asked)


def test_registered_tokenizer_queries(spark, sf, docs):
    """op6's digests against tiktoken, op9's checksums against the tokenizer, op5's columns at its own threshold."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    from ledgerloom.llm import queries

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokenizer, by_id = Tokenizer.from_file(P.path("byte_bpe_50k.json")), texts(docs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op6_byte_bpe(spark, sf).collect():
        ids = codec.encode_ordinary(by_id[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((by_id[r.doc_id] or "").encode()))
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op9_packing(spark, sf).collect():
        ids = np.array([*tokenizer.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        of_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        of_sequence[r.sequence_id].append((r.offset, r.length))
    # Each id of every document lies in exactly one piece; sequences have no gaps and keep their size.
    assert set(of_doc) == set(by_id) and docs.count() == len(by_id)
    for pieces in of_doc.values():
        pieces.sort()
        assert [a for a, _, _ in pieces] == [sum(n for _, n, _ in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n, _ in pieces) == pieces[0][2] and all(n > 0 for _, n, _ in pieces)
    for pieces in of_sequence.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    more = "/root/testdata/sf0.01"
    out = queries.op5_compression_quality(spark, more).join(spark.read.parquet(f"{more}/labels.parquet"), "doc_id").collect()
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.predicted == r.quality for r in out if r.held_out]) > 0.9


def test_registered_quality_scores_equal_texts_packed_again(spark, sf):
    """Every row of op5: its whole text is packed piece by piece under the fitted dictionaries, and the calibrator is written out."""
    import zstandard

    from ledgerloom.llm import queries

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learnt = common.crc_mod("doc_id", 4) != 2
    model = quality.learn(docs.where(learnt), labels.where(learnt), "quality", quality.Training())
    assert model.good != model.bad and any(model.weights)

    def size(raw, dictionary):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(packer.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))

    def score(text):
        raw = (text or "").encode()
        d, s = 0.0, 0.0
        if raw:
            good, bad = size(raw, model.good), size(raw, model.bad)
            d, s = 10 * (bad - good) / (bad + good), min(good, bad) / len(raw)
        odds = sum(w * x for w, x in zip(model.weights, (d, d * abs(d), s, s * s, d * s, 1)))
        return 1 / (1 + math.exp(-max(-30, min(30, odds))))

    by_id, rows = texts(docs), queries.op5_compression_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(by_id)
    for r in rows:
        assert r.score == pytest.approx(score(by_id[r.doc_id]), abs=1e-9)


def test_language_id(spark, docs, odd, none):
    model = langid.learn(docs, common.crc_mod("doc_id", 5) != 0, langid.Training(texts=40, steps=30))
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(common.crc_mod("doc_id", 5) == 0).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.9
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 13, 16)) and len(got) == len({i for i, _ in ODD})
    assert langid.identify(none, model).count() == 0
    empty = langid.learn(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    kept = langid.accepted(odd, model, 0.0)
    assert kept.columns == odd.columns and not {1, 2, 3, 13, 16} & {r.doc_id for r in kept.collect()}
    en, de = (docs.where(f"lang = '{x}'").first().text.split()[:40] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, " ".join(en + de))], "doc_id long, text string")
    runs = langid.identify(mixed, model, runs=True).first().runs
    assert sum(r.words for r in runs) == 80 and {"en", "de"} <= {r.lang for r in runs}


def plain_chain(text, model):
    """(posteriors of the words with a letter) by forward and backward sums in logarithms, word by word over the whole text."""
    words = (text or "").split()
    score = [model.weights[np.unique(langid.features([langid.word_key(w)], model.lexicon)[0])].sum(axis=0, dtype=float) for w in words]
    add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    moves, ahead, behind = model.moves.astype(float), [], []
    for e in score:
        ahead.append(e if not ahead else e + add(ahead[-1][:, None] + moves, 0))
    for e in reversed(score):
        behind.append(np.zeros(len(e)) if not behind else add(moves + (last + behind[-1])[None, :], 1))
        last = e
    both = [a + b for a, b in zip(ahead, reversed(behind))]
    return [np.exp(x - add(x, 0)) for x, w in zip(both, words) if langid.word_key(w)]


def test_registered_language_scores_equal_plain_sums(spark, sf, docs):
    """Every row of op10: label and score from word posteriors that another forward-backward gives with the fitted weights."""
    from ledgerloom.llm import queries

    model = langid.learn(docs, common.crc_mod("doc_id", 5) != 0)
    by_id, rows = texts(docs), queries.op10_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(by_id) and any(r.lang_pred != "und" for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if found := plain_chain(by_id[r.doc_id], model):
            mean = np.mean(found, axis=0)
            assert r.score == pytest.approx(mean.max(), abs=1e-5) and mean[model.labels.index(r.lang_pred)] == pytest.approx(mean.max(), abs=1e-5)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_every_language_is_learnt(spark):
    """More than 200 languages, each of words of its own; and a bound that fails loudly."""
    import string

    names = [a + b for a in string.ascii_lowercase[:15] for b in string.ascii_lowercase[:14]]
    text = lambda x: " ".join(f"{x}{x}{c}" for c in "abcd" * 2)
    docs = spark.createDataFrame([(10 * i + j, text(x), x) for i, x in enumerate(names) for j in range(2)], "doc_id long, text string, lang string").coalesce(2)
    model = langid.learn(docs, F.lit(True), langid.Training(steps=8))
    assert model.labels == sorted(names) and len(names) == 210
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99
    with pytest.raises(ValueError, match="209 languages"):
        langid.learn(docs, F.lit(True), langid.Training(labels=209))


def test_parts_of_the_sample_give_one_model(monkeypatch):
    texts = [(x, f"{x}one {x}two both {x}three " * 20) for x in ("aa", "bb", "cc") for _ in range(5)]
    whole = langid.fit(texts, langid.Training(steps=5))
    monkeypatch.setattr(langid, "CELLS", 30)
    parts = langid.fit(texts, langid.Training(steps=5))
    assert np.allclose(whole.weights, parts.weights, atol=1e-6) and np.allclose(whole.moves, parts.moves, atol=1e-6)


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    e, m = r.normal(size=(5, 3)), r.normal(size=(3, 3))
    weight = {p: math.exp(sum(e[i, p[i]] for i in range(5)) + sum(m[p[i], p[i + 1]] for i in range(4))) for p in itertools.product(range(3), repeat=5)}
    z = sum(weight.values())
    want = [[sum(w for p, w in weight.items() if p[i] == k) / z for k in range(3)] for i in range(5)]
    for segment in (5, 2, 1):
        got, pairs = np.empty((8, 3)), np.zeros((3, 3))
        both = np.concatenate((e[:3], e))  # a shorter text before it
        for words, p in langid.posteriors(both, np.arange(8), np.array([3, 5]), m, segment, pairs if segment == 5 else None):
            got[words] = p
        assert np.allclose(got[3:], want) and (segment < 5 or pairs.sum() == pytest.approx(4 + 2))


def test_switched_texts(docs):
    """Words of texts that change their language every 12 words, held out from learning."""
    held = common.crc_mod("doc_id", 5) == 0
    model = langid.learn(docs, ~held, langid.Training(texts=60, steps=40))
    by = collections.defaultdict(list)
    for r in docs.where(held & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect():
        by[r.lang] += r.text.split()[:300]
    names = sorted(x for x in by if len(by[x]) >= 300)
    assert len(names) >= 2
    words, gold = [], []
    for i in range(0, 300, 12):
        lang = names[(i // 12) % len(names)]
        words += by[lang][i : i + 12]
        gold += [lang] * len(by[lang][i : i + 12])
    runs = langid._label([" ".join(words)], langid.Emissions(model), runs=True)[2][0]
    said = [r["lang"] for r in runs for _ in range(r["words"])]
    lettered = [bool(langid.word_key(w)) for w in words]
    assert np.mean([a == b for a, b, c in zip(said, gold, lettered) if c]) > 0.85


def test_line_dedup_sql(spark, sf):
    from ledgerloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.execute(queries.ORACLE_SQL["op2_line_dedup"]).fetchall()))
    assert sorted(tuple(r) for r in queries.op2_line_dedup(spark, sf).collect()) == want
    assert hashlib.sha256(b"").hexdigest() == queries.op2_line_dedup(spark, sf).selectExpr("sha2(cast('' as binary), 256) h").first().h


def test_near_duplicates_sql(spark, sf):
    from ledgerloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.execute(queries.ORACLE_SQL["op8_minhash_join"]).fetchall()))
    assert sorted(tuple(r) for r in queries.op8_minhash_join(spark, sf).collect()) == want
