import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.operators import fields, routing
from ledgerloom.operators.resolve import CLAIMS, first_by_priority, prioritise, resolve, resolve_dates, resolve_fields, resolve_fuzzy
from ledgerloom.plans.bom import DIRECT, build, sentence_extractor
from ledgerloom.sources import config
from ledgerloom.streaming.claims import current, resolve_stream


def claims(spark, *values, field="license"):
    """values: (source, value) in order, all of one artifact."""
    return spark.createDataFrame([("a", field, s, i, v) for i, (s, v) in enumerate(values)], CLAIMS)


def one(df):
    rows = df.collect()
    return (rows[0].value, rows[0].source, rows[0].conflict) if rows else None


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([("hub", "MIT")], ("MIT", "hub", None)),
        ([], None),
        ([("hub", None), ("repo", "")], None),
        ([("hub", "MIT"), ("repo", "mit ")], ("MIT", "hub", None)),
        ([("hub", "MIT"), ("repo", "MIT"), ("paper", "Apache-2.0")], ("MIT", "hub", "paper: Apache-2.0")),
        ([("paper", "Apache-2.0"), ("hub", "MIT"), ("repo", "MIT")], ("MIT", "hub", "paper: Apache-2.0")),
        ([("hub", "A"), ("repo", "B"), ("paper", "C")], ("A", "hub", "repo: B, paper: C")),
        ([("hub", None), ("repo", "MIT")], ("MIT", "repo", None)),
        ([("a", "X"), ("b", "Y"), ("c", "Y"), ("d", "Y")], ("X", "a", "b: Y, c: Y, d: Y")),
        ([("llm_answer", "MIT")], ("MIT", "paper", None)),
        ([("hub", " "), ("repo", "MIT")], (" ", "hub", "repo: MIT")),
    ],
)
def test_resolve(spark, values, want):
    assert one(resolve(claims(spark, *values))) == want


@pytest.mark.parametrize(
    ("normaliser", "values", "conflict"),
    [
        (fn.normalize_org, ("Meta", "meta"), None),
        (lambda c: fn.normalize_org(c, {"meta": "fb", "facebookresearch": "fb"}), ("Meta", "facebookresearch"), None),
        (fn.normalize_url, ("https://h.co/m/x", "https://www.h.co/m/x/"), None),
        (fn.normalize_version, ("v1.2.3", "1.2.3"), None),
        (fn.normalize_default, ("def456", "abc123"), "repo: abc123"),
    ],
)
def test_normalisers(spark, normaliser, values, conflict):
    assert one(resolve(claims(spark, ("hub", values[0]), ("repo", values[1])), normaliser)) == (values[0], "hub", conflict)


def test_fuzzy(spark):
    close = claims(spark, ("hub", "nlp, text, generation"), ("repo", "nlp, text, classification"))
    assert one(resolve_fuzzy(close, 0.4)) == ("nlp, text, generation", "hub", None)
    assert one(resolve_fuzzy(claims(spark, ("hub", "alpha"), ("repo", "beta")), 0.4)) == ("alpha", "hub", "repo: beta")
    assert one(resolve_fuzzy(claims(spark, ("hub", "x"), ("repo", "a b"), ("paper", "a b c")), 0.5)) == ("a b", "repo", "hub: x")


@pytest.mark.parametrize(
    ("mode", "values", "want"),
    [
        ("latest", ["2024-08-15", "2024-08-13"], ("2024-08-15", "s0", None, None)),
        ("latest", ["2024-08-15", "2024-01-01"], ("2024-08-15", "s0", "s1", 227)),
        ("earliest", ["2024-08-15", "2024-08-01"], ("2024-08-01", "s1", "s0", 14)),
        ("latest", ["2024-08-15", "2024-01-01", "2023-01-01"], ("2024-08-15", "s0", "s2", 592)),
        ("latest", ["2024-08-15", "some day", None], ("2024-08-15", "s0", None, None)),
        ("latest", ["2024-08-15", "2024-08-08"], ("2024-08-15", "s0", None, None)),
        ("latest", ["2024-08-15 12:00:00", "2024-08-08"], ("2024-08-15 12:00:00", "s0", None, None)),
        ("earliest", ["2024-08-15 12:00:00", "2024-08-08"], ("2024-08-08", "s1", "s0", 8)),
        ("latest", ["2024-08-15T00:00:00Z", "2024-08-15"], ("2024-08-15T00:00:00Z", "s0", None, None)),
    ],
)
def test_dates(spark, mode, values, want):
    r = resolve_dates(claims(spark, *((f"s{i}", v) for i, v in enumerate(values)), field="releaseTime"), mode).first()
    assert (r.value, r.source, r.conflict_source, r.delta_days) == want


def test_order_and_partitions_do_not_matter(spark):
    rows = [(str(i % 40), "f", f"s{i % 3}", i % 3, "xyz"[i * 7 % 3]) for i in range(120)]
    want = sorted(map(tuple, resolve(spark.createDataFrame(rows, CLAIMS)).collect()))
    for n in (1, 13):
        assert sorted(map(tuple, resolve(spark.createDataFrame(rows[::-1], CLAIMS).repartition(n)).collect())) == want


def test_priority(spark):
    p = spark.createDataFrame([("license", "paper", 0)], "field string, source string, ord int")
    c = claims(spark, ("hub", "A"), ("repo", "B"), ("paper", "C"))
    assert first_by_priority(prioritise(c, p)).first().value == "C"
    assert one(resolve(prioritise(c.where("source <> 'paper'"), p))) == ("A", "hub", "repo: B")
    schema = config.PRIORITY
    own = config.overlay(spark.createDataFrame([("d", "default", ["hub"]), ("d", "x", ["repo"])], schema), spark.createDataFrame([("d", "x", ["paper"])], schema))
    asked = spark.createDataFrame([("d", "x"), ("d", "y"), ("e", "z")], "section string, field string")
    assert {r.field: r.sources for r in config.lookup(asked, own).collect()} == {"x": ["paper"], "y": ["hub"], "z": config.LAST_RESORT}


def test_priority_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"$comment": "x", "direct": {"default": ["hub"], "license": ["repo", "hub"]}, "dataset": {"default": ["paper"]}}')
    got = {(r.section, r.field): r.sources for r in config.read_priority(spark, str(path)).collect()}
    assert got == {("direct", "default"): ["hub"], ("direct", "license"): ["repo", "hub"], ("data", "default"): ["paper"]}
    path.write_text("{broken")
    assert config.read_priority(spark, str(path)).count() == 0


def test_conflict_words(spark):
    cases = {None: None, "": None, "None": None, "No conflict detected": None, "github: Apache-2.0": ("Apache-2.0", "github"), "github: A, arxiv: B": ("A, B", "github, arxiv"), "they differ": ("they differ", None)}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", fields.parse_conflict(F.col("x")).alias("c")).orderBy("i")
    assert [(r.c.value, r.c.source) if r.c else None for r in df.collect()] == list(cases.values())


def test_real_conflicts(spark):
    made = spark.range(1).select(
        fields.real_conflict(fields.conflict(internal=F.lit("No"), external=F.lit("No"), kind=None)).alias("none"),
        fields.real_conflict(fields.conflict(internal=F.lit("Yes: a"), kind=None)).alias("intra"),
        fields.real_conflict(fields.conflict(internal=F.lit("Yes"), external=F.lit("yes: b"), kind=None)).alias("inter"),
        fields.real_conflict(fields.conflict(F.lit("v"))).alias("typed"),
        fields.real_conflict(fields.conflict()).alias("empty"),
    ).first()
    assert made.none is None and made.empty is None and (made.intra.type, made.inter.type, made.typed.value) == ("intra", "inter", "v")


def audit(spark, text, sources=("hub", "paper", "repo")):
    letters = [("ABC"[i], s) for i, s in enumerate(sources)]
    df = spark.createDataFrame([("a", "f", text, letters, list(sources))], "artifact_id string, field string, text string, letters array<struct<letter:string,source:string>>, priority array<string>")
    return routing.parse_report(df)


def test_report(spark):
    text = '**CLAIM_A:** "MIT".\nCLAIM_B: No relevant information\n CLAIM_C : \'Apache\'\nCONFLICT_WITHIN_C: Yes: two\nCONFLICT_A_VS_C: yes\nCONFLICT_A_VS_B: No\nCONFLICT_A_VS_Z: Yes'
    r = audit(spark, text).first()
    assert r.claims["paper"] is None and r.claims["repo"] == "Apache" and r.internal == {"repo": "two"}
    assert [(x.sources, x.description) for x in r.external] == [(["hub", "repo"], "Yes")]
    empty = audit(spark, None).first()
    assert set(empty.claims.values()) == {None} and not empty.internal and not empty.external


SPEAK = "CLAIM_A: x\nCLAIM_B: y\nCLAIM_C: z\n"


@pytest.mark.parametrize(
    ("text", "chunks", "kept", "selected"),
    [
        (SPEAK, 4, {"hub", "paper", "repo"}, ["hub", "paper", "repo"]),
        ("CLAIM_A: x\nCLAIM_B: y\nCONFLICT_A_VS_B: Yes", 4, {"hub"}, ["hub"]),
        (SPEAK + "CONFLICT_A_VS_B: Yes\nCONFLICT_A_VS_C: Yes", 4, {"paper", "repo"}, ["paper", "repo"]),
        (SPEAK + "CONFLICT_A_VS_B: Yes\nCONFLICT_A_VS_C: Yes\nCONFLICT_B_VS_C: Yes", 4, {"hub"}, ["hub"]),
        (SPEAK + "CONFLICT_WITHIN_A: Yes", 4, {"paper", "repo"}, ["paper", "repo"]),
        (SPEAK + "CONFLICT_WITHIN_A: Yes\nCONFLICT_WITHIN_B: Yes\nCONFLICT_WITHIN_C: Yes", 4, {"hub", "paper", "repo"}, ["hub", "paper", "repo"]),
        (SPEAK + "CONFLICT_A_VS_B: Yes\nCONFLICT_A_VS_C: Yes\nCONFLICT_B_VS_C: Yes", 1, {"hub", "paper", "repo"}, ["hub", "paper", "repo"]),
        ("", 4, {"hub", "paper", "repo"}, []),
    ],
)
def test_routing(spark, text, chunks, kept, selected):
    rows = spark.createDataFrame([("a", "f", s, i) for s in ("hub", "paper", "repo") for i in range(chunks)], "artifact_id string, field string, source string, n int")
    out = routing.route(rows, audit(spark, text)).collect()
    assert {r.source for r in out} == kept and sorted(out[0].selected) == selected


def test_letters(spark):
    present = spark.createDataFrame([("a", "f", s) for s in ("zoo", "repo", "unknown", "hub", "arch", None)], "artifact_id string, field string, source string")
    priority = spark.createDataFrame([("f", "hub", 0), ("f", "repo", 1)], "field string, source string, ord int")
    assert {r.source: r.letter for r in routing.label_sources(present, priority).collect()} == {"hub": "A", "repo": "B", "arch": "C", "zoo": "D"}


def test_marked_answer(spark):
    text = "ANSWER: one\ntwo\nCONFLICT_STATUS: No"
    r = spark.createDataFrame([(text,)], "t string").select(routing.marked_answer(F.col("t"), "ANSWER").alias("a"), routing.marked_answer(F.col("t"), "CONFLICT_STATUS").alias("c")).first()
    assert (r.a, r.c) == ("one\ntwo", "No")


def test_build(spark):
    rows = [("m", "suppliedBy", "hub", 0, "Meta"), ("m", "suppliedBy", "repo", 1, "other"), ("m", "releaseTime", "hub", 0, "2024-01-01"), ("m", "releaseTime", "repo", 1, "2024-05-01"), ("m", "unasked", "hub", 0, "x")]
    out = {r.field: (r.value, r.source, r.conflict and r.conflict.source) for r in build(spark.createDataFrame(rows, CLAIMS), "ai").collect()}
    assert out == {"suppliedBy": ("Meta", "hub", "repo"), "releaseTime": ("2024-05-01", "repo", "hub")}
    assert set(DIRECT) == {"ai", "data"} and resolve_fields(spark.createDataFrame(rows, CLAIMS), DIRECT["ai"]).count() == 2
    chunks = [("m", s, i, f"Filler text of source {s} number {i}." if i else "license: MIT", [float(i), 1.0]) for s in ("hub", "repo") for i in range(3)]
    chunk = spark.createDataFrame(chunks, "artifact_id string, source string, chunk_index int, text string, embedding array<float>")
    q = spark.createDataFrame([("m", "license", "what is the license", [0.0, 1.0], ["license:", "mit"], "normalize_license")], "artifact_id string, field string, question string, embedding array<float>, terms array<string>, post_process string")
    order = spark.createDataFrame([("license", "hub", 0), ("license", "repo", 1)], "field string, source string, ord int")
    got = {r.field: (r.value, r.source) for r in build(spark.createDataFrame(rows, CLAIMS), "ai", questions=q, chunks=chunk, source_order=order).collect()}
    assert got["license"] == ("MIT", "hub")
    assert sentence_extractor("what size", ["None here"], ["hub"]) == (None, None)


def test_stream(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "artifact_id string, field string, source string, ord int, value string, ts timestamp"
    make = lambda *v: spark.createDataFrame([("a", "f", s, i, x) for i, (s, x) in enumerate(v)], CLAIMS).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + len(v) * 100))
    make(("hub", "old")).write.parquet(src)
    make(("hub", "new"), ("repo", "other")).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    resolve_stream(stream, sink, str(tmp_path / "cp")).awaitTermination()
    assert one(current(spark, sink)) == ("new", "hub", "repo: other")
    # A batch only resolves what it touches.
    spark.createDataFrame([("b", "f", "hub", 0, "x")], CLAIMS).withColumn("ts", F.timestamp_seconds(F.lit(1_700_001_000))).write.mode("append").parquet(src)
    resolve_stream(spark.readStream.schema(schema).parquet(src), sink, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(f"{sink}/resolved")
    assert rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select("artifact_id").collect() == [("b",)] and current(spark, sink).count() == 2


def test_bank(spark, tmp_path):
    import json

    entry = {"question": "Which license?", "keywords": "license", "summary": "S", "description": "D", "post_process": "normalize_license", "priority": ["hub"], "retrieval": {"hypothetical_passage": "p " * 20, "bm25_terms": ["a", "b"]}, "extraction": {"instruction": "i", "field_spec": "f", "output_guidance": ""}}
    (tmp_path / "license.json").write_text(json.dumps(entry))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "short.json").write_text(json.dumps({"question": "q"}))
    bank = config.read_bank(spark, str(tmp_path))
    q = config.queries_of(bank).collect()
    assert [(r.field, r.sparse, r.described, r.output_guidance) for r in q] == [("license", "a b", "S\n\nD", "")]
    assert {r.violation for r in config.bank_violations(bank).collect()} == {"too few terms", "no output_guidance"}
    spec = spark.createDataFrame([("license", "S", "New", ["p"])], "field string, summary string, description string, properties array<string>")
    assert config.bank_changes(bank, spec).first().description == "New" and config.bank_changes(bank, spec.withColumn("description", F.lit("D"))).count() == 0
    assert config.spec_owners(spec).first().fields == ["license"] and config.token_audit(bank).first().entries == 1
    page = tmp_path / "spec"
    page.mkdir()
    (page / "a.md").write_text("# Name\n\n## Summary\n\nShort.\n\n## Description\n\nLong\ntext.\n")
    (page / "_skip.md").write_text("# No")
    assert [(r.name, r.summary, r.description) for r in config.read_spec(spark, str(page)).collect()] == [("Name", "Short.", "Long\ntext.")]
    assert config.choose_path(None, None, "NO_SUCH_VARIABLE_HERE", "b") == "b" and config.choose_path("a", "p") == "a"


def test_whole_table_queries(spark, sf, tmp_path, monkeypatch):
    """Every row takes part, whatever its id; shards and blocks of queries change nothing."""
    import math
    import random

    import duckdb

    from ledgerloom import queries
    from ledgerloom.operators import retrieval

    r = random.Random(3)
    vectors = [(i, [r.choice((-1.0, 0.0, 1.0)) for _ in range(4)]) for i in range(1000, 1200)] + [(5000, None), (5020, [1.0, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    parts = [(i, f"Brand#{i % 3}", " ".join(r.sample("abcdefgh", r.randint(1, 5))), r.choice(("X Y", "X Z", ""))) for i in range(600, 900)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(retrieval, "SHARD", 30)
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    norm = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]

    def brute(rows):
        out = {}
        for q, x in rows:
            if q % 20 == 0:
                near = sorted((round(math.dist(x, y), 6), d) for d, y in rows if len(x) == len(y))[:20]
                out |= {(q, d): (s, n) for n, (s, d) in enumerate(near, 1)}
        return out

    rows = [(i, v) for i, v in vectors if v]
    first, second = brute(rows), brute([(i, norm(v)) for i, v in rows if any(v)])
    assert {(x.query_id, x.doc_id): (x.score, x["rank"]) for x in queries.knn_topk(spark, str(tmp_path)).collect()} == first and len(first) == 201
    fused = {k: round(sum(1 / (60 + ranks[k][1]) for ranks in (first, second) if k in ranks), 6) for k in first.keys() | second.keys()}
    assert {(x.query_id, x.doc_id): x.rrf for x in queries.rrf_fusion(spark, str(tmp_path)).collect()} == pytest.approx(fused)
    sets = {i: (b, set(f"{n} {t}".lower().split())) for i, b, n, t in parts}
    want = {(a, b): round(len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]), 6) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.6 * len(sets[a][1] | sets[b][1])}
    got = [tuple(x) for x in queries.jaccard_tags(spark, str(tmp_path)).collect()]
    assert {(a, b): s for a, b, s in got} == want and len(got) == len(want) > 100
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    whole = sorted(con.execute(queries.ORACLE_SQL["linked_bundle"]).fetchall())
    assert sorted(tuple(x) for x in queries.linked_bundle(spark, sf).collect()) == whole and sum(x[1] == "Order" for x in whole) == con.execute("select count(*) from orders").fetchone()[0]


def test_copies_become_pairs_only_where_they_are_returned(spark, monkeypatch):
    import random

    from ledgerloom.operators import retrieval

    monkeypatch.setattr(retrieval, "IDS", 4)
    r = random.Random(6)
    rows = [(r.choice(("g", "h", None)), i, r.choice((["a", "b", "c"], ["c", "b", "a", "a"], ["a", "b", "c", "d"], ["e", None], [None], [], None))) for i in r.sample(range(1000), 150)]
    rows += [("h", 2000 + i, [f"{i}", "a"]) for i in range(20)]
    pairs = retrieval.similar_sets(spark.createDataFrame(rows, "g string, id long, tokens array<string>"), 0.6, ("g",))
    sets = [(g, i, set(t)) for g, i, t in rows if g and t and set(t) != {None}]
    want = {(g, i, j): len(x & y) / len(x | y) for g, i, x in sets for h, j, y in sets if g == h and i < j and len(x & y) >= 0.6 * len(x | y)}
    got = pairs.collect()
    assert {(x.g, x.a, x.b): x.similarity for x in got} == want and len(got) == len(want) > 300
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("Exchange")  # nothing is shuffled once there are pairs


def test_knn_of_the_first_queries(spark, sf):
    import duckdb

    from ledgerloom import queries

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    for name in ("knn_topk", "rrf_fusion"):
        want = sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())
        assert sorted(tuple(x) for x in queries.QUERIES[name](spark, sf).collect()) == want
