import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import fields, graph, retrieval, validate
from ledgerloom.plans import cyclonedx, spdx
from ledgerloom.sources import batch, catalog, metadata

REL = f"parent string, field string, value string, conflict {fields.CONFLICT}"


def walk(spark, rows, depth=5, cap=50, root="m"):
    c = spark.createDataFrame([(p, f, v, None) for p, f, v in rows], REL)
    out = graph.recursive_walk(spark.createDataFrame([(root,)], "parent string"), c, depth, cap)
    return out, [(r.depth, r.relation, r.target, r.enriched) for r in out["nodes"].orderBy("seq").collect()]


def test_one_level(spark):
    rows = [("m", "trainedOnDatasets", "d1, d2"), ("m", "testedOnDatasets", "t1"), ("m", "modelLineage", "base")]
    assert walk(spark, rows, depth=1)[1] == [(1, "trainedOn", "d1", False), (1, "trainedOn", "d2", False), (1, "testedOn", "t1", False), (1, "dependsOn", "base", False)]


def test_cycles_diamonds_and_depth(spark):
    assert [t for _, _, t, _ in walk(spark, [("m", "modelLineage", "b"), ("b", "modelLineage", "M")])[1]] == ["b"]
    three = [("m", "modelLineage", "b"), ("b", "modelLineage", "c"), ("c", "modelLineage", "m")]
    out, nodes = walk(spark, three)
    assert [t for _, _, t, _ in nodes] == ["b", "c"] and out["duplicates"].count() == 1
    diamond = [("m", "modelLineage", "a; b"), ("a", "modelLineage", "x"), ("b", "modelLineage", "x"), ("x", "trainedOnDatasets", "d")]
    assert [(d, t) for d, _, t, _ in walk(spark, diamond)[1]] == [(1, "a"), (1, "b"), (2, "x"), (3, "d")]
    assert [t for _, _, t, _ in walk(spark, diamond, depth=2)[1]] == ["a", "b", "x"]


def test_cap(spark):
    chain = [(f"m{i}", "modelLineage", f"m{i + 1}") for i in range(20)]
    assert [t for _, _, t, _ in walk(spark, chain, depth=20, cap=5, root="m0")[1]] == [f"m{i}" for i in range(1, 6)]


def test_audit_of_a_walk(spark):
    chain = [(f"m{i}", "modelLineage", f"m{i + 1}; x{i}") for i in range(6)]
    out, nodes = walk(spark, chain, depth=20, cap=5, root="m0")
    assert [t for _, _, t, _ in nodes] == ["m1", "x0", "m2", "x1", "m3"]
    assert sorted((r.target, r.depth) for r in out["skipped"].collect()) == [("m4", 4), ("x2", 3), ("x3", 4)] and {r.reason for r in out["skipped"].collect()} == {"safety-cap-reached"}
    assert tuple(out["summary"].first()) == (5, 3, False) and [r.key for r in out["visited"].collect()] == ["ai:m0", "ai:m1", "ai:m2", "ai:m3", "ai:x0", "ai:x1"]
    out, _ = walk(spark, chain, depth=2, root="m0")
    assert tuple(out["summary"].first()) == (4, 2, False)
    out, _ = walk(spark, chain, depth=9, root="m0")
    assert tuple(out["summary"].first()) == (12, 6, True)
    assert tuple(graph.enriched_count(out["nodes"]).first()) == (12, 5)
    assert walk(spark, chain, depth=0, root="m0")[1] == []


def test_enrichment_asks_for_each_level(spark):
    asked = []
    more = {"b": [("b", "modelLineage", "c", None)], "c": [("c", "trainedOnDatasets", "d", None)]}

    def enrich(fresh):
        names = sorted(r.parent for r in fresh.collect())
        asked.append(names)
        return spark.createDataFrame([x for n in names for x in more.get(n, [])], REL)

    c = spark.createDataFrame([("m", "modelLineage", "b", None), ("other", "trainedOnDatasets", "z", ("x", "repo", "inter", None, None, None))], REL)
    out = graph.recursive_walk(spark.createDataFrame([("m",)], "parent string"), c, 5, 50, enrich)
    assert [(r.depth, r.target, r.enriched) for r in out["nodes"].orderBy("seq").collect()] == [(1, "b", True), (2, "c", True), (3, "d", False)]
    assert asked[:3] == [["m"], ["b"], ["c"]] and out["skipped"].count() == 0  # parents that aren't visited are not audited
    seeds = {(r.artifact_id, r.field): r.value for r in graph.seed_children(out["nodes"]).collect()}
    assert seeds["d", "dataset_id"] == "d" and seeds["d", "intendedUse"] == "Referenced by c via trainedOn" and seeds["b", "license"] == "NOASSERTION" and ("d", "urls.huggingface") not in seeds
    known = spark.createDataFrame([("ai", "B", "org/b", 1), ("ai", "b", "late/b", 2)], "kind string, name string, identifier string, pos int")
    nodes = spark.createDataFrame([("b", "ai"), ("o/n", "ai"), ("none", "data")], "target string, kind string")
    assert {r.target: r.identifier for r in graph.resolve_names(nodes, known).collect()} == {"b": "org/b", "o/n": "o/n", "none": None}


def test_contested_fields_lead_nowhere(spark):
    c = spark.createDataFrame([("m", "modelLineage", "b", None), ("m", "trainedOnDatasets", "d", ("x", "repo", "inter", None, None, None)), ("m", "testedOnDatasets", "t", (None, None, None, None, "No", "No"))], REL)
    out = graph.recursive_walk(spark.createDataFrame([("m",)], "parent string"), c)
    assert {r.target for r in out["nodes"].collect()} == {"b", "t"} and [r.target for r in out["skipped"].collect()] == ["d"]


def test_partitions_do_not_matter(spark):
    edges = [(i, p, (i * 7 + p * 3) % 97) for i in range(97) for p in range(2)]
    df = spark.createDataFrame(edges, "parent long, pos int, target long")
    root = spark.createDataFrame([(1,)], "node long")
    want = sorted(map(tuple, graph.walk(df.coalesce(1), root, 6, 40).nodes.collect()))
    assert sorted(map(tuple, graph.walk(df.repartition(7), root, 6, 40).nodes.collect())) == want


def bom(spark, values, kind="ai"):
    rows = spark.createDataFrame([("a1", "direct", f, v, "hub", None) for f, v in values.items()], f"artifact_id string, section string, field string, value string, source string, conflict {fields.CONFLICT}")
    return spdx.by_artifact(rows, spark.createDataFrame([("a1", "Name")], "artifact_id string, name string"))


def NOW():
    return F.lit("2024-01-01T00:00:00Z")



def test_spdx_ai(spark):
    rows = bom(spark, {"suppliedBy": "Org", "license": "MIT", "limitations": "few", "domain": "nlp; vision", "hyperparameter": "lr=1", "autonomyType": "True", "safetyRiskAssessment": "odd", "trainedOnDatasets": "d1, D1, d2", "modelLineage": "base"})
    nodes, edges = spdx.documents(rows, "ai", NOW())
    by = {r.type: json.loads(r.payload) for r in nodes.collect() if json.loads(r.payload).get("name") not in ("base",)}
    p = by["ai_AIPackage"]
    assert (p["name"], p["ai_limitation"], p["ai_domain"], p["ai_autonomyType"]) == ("Name", "few", ["nlp", "vision"], "yes") and "ai_safetyRiskAssessment" not in p
    assert p["software_downloadLocation"] == "NOASSERTION" and by["Organization"]["name"] == "Org" and by["simplelicensing_LicenseExpression"]["simplelicensing_licenseExpression"] == "MIT"
    assert sorted(r.rel_type for r in edges.collect()) == ["dependsOn", "hasConcludedLicense", "hasDeclaredLicense", "trainedOn", "trainedOn"]
    whole = json.loads(spdx.rendered(nodes, edges).first().json)
    info = next(x["@id"] for x in whole["@graph"] if x["type"] == "CreationInfo")
    assert all(x["creationInfo"] == info for x in whole["@graph"] if x["type"] != "CreationInfo")
    assert set(whole) == {"@context", "@graph"} and len(whole["@graph"]) == 7 + 3 + 5
    ids = [r.node_id for r in nodes.collect()]
    assert ids == [r.node_id for r in spdx.documents(rows, "ai", NOW())[0].collect()] and len(set(ids)) == len(ids)
    with pytest.raises(ValueError):
        spdx.documents(rows, "other", NOW())


def test_spdx_data(spark):
    nodes, edges = spdx.documents(bom(spark, {"datasetSize": "1 KB", "datasetType": "Text, odd"}), "data", NOW())
    p = next(json.loads(r.payload) for r in nodes.collect() if r.type == "dataset_DatasetPackage")
    assert (p["dataset_datasetSize"], p["dataset_datasetType"], p["dataset_datasetAvailability"], p["dataset_confidentialityLevel"], p["dataset_intendedUse"]) == (1000, ["text", "other"], "directDownload", "clear", "")
    assert edges.count() == 2


def test_cyclonedx(spark):
    rows = bom(spark, {"trainedOnDatasets": "a, b", "modelLineage": "base, more", "license": "MIT"}).withColumn("conflicts", F.create_map(F.lit("license"), F.lit("{}")))
    d = json.loads(cyclonedx.documents(rows, "ai", NOW()).first().json)
    c = d["components"][0]
    assert d["bomFormat"] == "CycloneDX" and c["type"] == "machine-learning-model" and c["pedigree"]["ancestors"][0]["name"] == "base, more" and "supplier" not in c
    assert [x["name"] for x in c["modelCard"]["modelParameters"]["datasets"]] == ["a", "b"] and c["properties"][-1]["name"] == "bom:conflict:license"


NODES = "doc_id string, node_id string, type string, spec_version string, created string, created_by array<string>, profiles array<string>, roots array<string>"
GOOD = [
    ("d", "c", "CreationInfo", "3.0.1", "2024-01-01T00:00:00Z", ["p"], None, None),
    ("d", "s", "SpdxDocument", None, None, None, ["core", "ai"], ["b"]),
    ("d", "b", "Bom", None, None, None, ["core"], ["k"]),
    ("d", "k", "ai_AIPackage", None, None, None, None, None),
]


def errors(spark, nodes=GOOD, refs=(("d", "from", "k"),), context=True, has_graph=True, strict=True):
    n = spark.createDataFrame(nodes, NODES)
    r = spark.createDataFrame(list(refs), "doc_id string, role string, to_id string")
    d = spark.createDataFrame([("d", "ai", context, has_graph)], "doc_id string, kind string, has_context boolean, has_graph boolean")
    found = validate.violations(n, r, d, strict)
    assert validate.status(d, found).first().valid == found.isEmpty()
    return sorted(x.error for x in found.collect())


def test_validation(spark):
    change = lambda i, **k: [GOOD[j] if j != i else tuple(k.get(n.split()[0], v) for n, v in zip(NODES.split(", "), GOOD[i])) for j in range(4)]
    assert errors(spark) == []
    for i, kind in enumerate(["CreationInfo", "SpdxDocument", "Bom", "ai_AIPackage"]):
        got = errors(spark, GOOD[:i] + GOOD[i + 1 :])
        assert f"missing element {kind}" in got
    assert errors(spark, change(0, spec_version="2.3")) == ["wrong specVersion"]
    assert errors(spark, change(0, created="")) == ["missing created"] and errors(spark, change(0, created_by=None)) == ["missing createdBy"]
    assert errors(spark, change(0, created="today")) == ["malformed created"] and errors(spark, change(0, created="today"), strict=False) == []
    assert errors(spark, [*GOOD, GOOD[3]]) == ["duplicate id k"]
    assert errors(spark, change(2, profiles=["ai"])) == ["no core profile in Bom"] and errors(spark, change(1, roots=[])) == ["SpdxDocument without rootElement"]
    assert errors(spark, refs=[("d", "to", "nowhere")]) == ["unresolved to nowhere"]
    assert errors(spark, context=False) == ["missing @context"] and errors(spark, has_graph=False) == ["missing or invalid @graph"]


def test_cyclonedx_rules(spark):
    rows = [("ok", "CycloneDX", "1.7", "urn:uuid:x", "data", "n"), ("bad", "x", "2", "s", "file", None)]
    out = {r.doc_id: len(r.errors) for r in validate.cyclonedx_errors(spark.createDataFrame(rows, "doc_id string, format string, spec_version string, serial string, component_type string, component_name string")).collect()}
    assert out == {"ok": 0, "bad": 5}


def test_bundle(spark):
    nodes = spark.createDataFrame([("r", "ai_AIPackage", "root"), ("s", "dataset_DatasetPackage", "Squad")], "node_id string, type string, name string")
    edges = spark.createDataFrame([("e", "trainedOn", "r", "s")], "edge_id string, rel_type string, from_id string, to_id string")
    children = spark.createDataFrame([("k", "dataset_DatasetPackage", "squad"), ("c", "CreationInfo", None)], "node_id string, type string, name string")
    links = spark.createDataFrame([("trainedOn", "ROOT", "squad", 1), ("trainedOn", "root", "absent", 1)], "rel_type string, from_name string, to_name string, depth int")
    n, e = graph.link_bundle(nodes, edges, children, links)
    assert {r.node_id for r in n.collect()} == {"r", "k"} and [tuple(r) for r in e.collect()] == [("urn:spdx:Relationship-trainedOn-squad-d1", "trainedOn", "r", "k")]


def test_bundle_with_edges_of_children(spark):
    shared = lambda d: [(d, f"{d}-info", "CreationInfo", None, "{}"), (d, f"{d}-org", "Organization", "o", "{}")]
    schema = "doc_id string, node_id string, type string, name string, payload string"
    parent = spark.createDataFrame([*shared("p"), ("p", "r", "ai_AIPackage", "root", "{}")], schema)
    kids = spark.createDataFrame([*shared("k"), ("k", "kr", "ai_AIPackage", "kid", '{"by":"k-org","info":"k-info"}'), ("k", "kl", "License", None, "{}")], schema)
    none = spark.createDataFrame([], "edge_id string, rel_type string, from_id string, to_id string")
    edges = spark.createDataFrame([("k", "ke", "hasLicense", "kr", "kl"), ("k", "kf", "by", "kr", "k-org")], "doc_id string, edge_id string, rel_type string, from_id string, to_id string")
    links = spark.createDataFrame([("dependsOn", "nobody", "Kid", 1), ("dependsOn", "root", "absent", 1)], "rel_type string, from_name string, to_name string, depth int")
    n, e = graph.link_bundle(parent, none, kids, links, edges, "r")
    assert {r.node_id: r.payload for r in n.collect()}["kr"] == '{"by":"p-org","info":"p-info"}' and n.count() == 5
    assert {tuple(r) for r in e.collect()} == {("ke", "hasLicense", "kr", "kl"), ("kf", "by", "kr", "p-org"), ("urn:spdx:Relationship-dependsOn-Kid-d1", "dependsOn", "r", "kr")}
    walked = spark.createDataFrame([(1, True)], "deepest int, exhausted boolean")
    assert tuple(graph.bundle_summary(n, e, walked).first()) == (8, 1, 1, True)


def test_fusion(spark):
    rank = lambda ids: spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "q int, doc_id int, rank int")
    got = {r.doc_id: r.rrf for r in retrieval.fuse([rank([7, 8, 9]), rank([1, 2, 7])], ("q",)).collect()}
    assert got[7] == round(1 / 61 + 1 / 63, 6) and got[8] == round(1 / 62, 6) and len(got) == 5


def test_bm25_floor_and_zeros(spark):
    docs = spark.createDataFrame([("s", i, t) for i, t in enumerate(["a b", "a c", "a d", None])], "source string, doc_id int, text string")
    q = spark.createDataFrame([(0, "s", ["a", "b", "b"])], "query_id int, source string, terms array<string>")
    out = retrieval.bm25_top(q, docs, on=("source",)).orderBy("rank").collect()
    assert [r.doc_id for r in out][0] == 0 and {r.doc_id for r in out} == {0, 1, 2, 3} and out[-1].score == 0.0


def test_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text("repo_id,typeOfModel\na/b,x\nc/d,y\ne/f,z\n")
    rows = batch.read_batch(spark, str(tmp_path / "b.csv"), start_row=2)
    assert batch.batch_kind(rows.columns) == "ai" and [(r.row_index, r.repo_id) for r in rows.collect()] == [(2, "c/d"), (3, "e/f")]
    done = spark.createDataFrame([(2, "ok", "{}"), (3, "failed", None)], "row_index long, status string, payload string")
    batch.append_checkpoint(done, str(tmp_path / "cp"), "run")
    left = batch.remaining(rows, batch.read_checkpoint(spark, str(tmp_path / "cp"), "run"), "row_index")
    assert [r.row_index for r in left.collect()] == [3]
    (tmp_path / "m.json").write_text(json.dumps({"data": [{"id": "x:free", "context_length": 10}, {"id": "y", "context_length": "20", "pricing": {"prompt": "0", "completion": "0"}}, {"name": "no id"}]}))
    models = catalog.read_catalog(spark, str(tmp_path / "m.json"))
    assert models.count() == 2 and catalog.default_model(models, "z") == "y" and catalog.default_model(models.limit(0), "z") == "z"


def test_metadata(spark):
    card = "license string, datasets array<string>, base_model array<string>, task_categories array<string>, pipeline_tag string, source_datasets array<string>, model_index array<struct<results:array<struct<dataset:struct<name:string,type:string>>>>>"
    card = card.replace(" string", ":string").replace(" array", ":array")
    schema = f"artifact_id string, id string, author string, sha string, last_modified string, created_at string, private boolean, tags array<string>, card struct<{card}>, siblings array<struct<size:bigint>>"
    row = ("a", "org/m", "org", "0123456789", "2024-01-01", None, False, ["x", "dataset:squad", "base_model:b"], ("mit", ["squad", "mmlu"], ["b"], ["qa"], "gen", None, [([(("t1", None),)],)]), [(10**9,), (2 * 10**8,)])
    hub = spark.createDataFrame([row], schema)
    claims = {r.field: r.value for r in metadata.hub_claims(hub, "ai").collect()}
    assert claims["packageVersion"] == "01234567" and claims["primaryPurpose"] == "qa; gen; x; dataset:squad; base_model:b"
    tree = metadata.model_tree(hub).first()
    assert (tree.trained_on, tree.lineage, tree.tested_on) == (["squad", "mmlu"], ["b"], ["t1"])
    assert "estimated_total_size_bytes: 1200000000" in metadata.hub_prose(hub, "data").first().text and "estimated" not in metadata.hub_prose(hub, "ai").first().text
    repo = spark.createDataFrame([("a", "o/r", "o", None, None, "2024-02-02", None, "u", "", "v1", None, None, None, None, 4096)], "artifact_id string, full_name string, owner string, description string, license string, pushed_at string, created_at string, html_url string, latest_release string, first_tag string, head_sha string, topics array<string>, language string, default_branch string, size_kb long")
    assert {r.field: r.value for r in metadata.repository_claims(repo, "ai").collect()}["packageVersion"] == "v1"
    assert "4194304" in metadata.repository_prose(repo, "data").first().text and metadata.repository_prose(repo, "ai").first().text == ""


def test_views(spark):
    b = spark.createDataFrame([("a", "direct", "license", "MIT", "hub", ("B", "repo", "inter", None, None, None)), ("a", "direct", "domain", "", "hub", None)], f"artifact_id string, section string, field string, value string, source string, conflict {fields.CONFLICT}")
    w = fields.wide(b, ["license", "limitation"]).first()
    assert (w.license, w.license_source, w.license_conflict, w.limitation) == ("MIT", "hub", "B", None)
    assert fields.count_filled(b).first().filled == 1 and fields.conflict_report(b).count() == 1
    assert json.loads(fields.documents(b).first().json)["direct"]["domain"]["conflict"] is None
    row = batch.csv_row(fields.wide(b, ["license", "limitation"]), ["license", "limitation"]).first()
    assert (row.license, row.limitation, row.limitation_sources) == ("MIT", "Not found", "N/A")
    assert [r.field for r in fields.preset(b, "ai", "License").collect()] == ["license"]
