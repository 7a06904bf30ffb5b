"""Documents of children, bundles of rendered documents, and comparison key by key."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.json_paths import differences, document_paths
from ledgerloom.operators.validate import of_documents
from ledgerloom.plans import bundle, cyclonedx, spdx
from ledgerloom.plans.children import child_documents

NOW = "2024-01-01T00:00:00Z"
NODE = "seq long, depth int, relation string, field string, target string, kind string, parent string"


def graph_of(text):
    return json.loads(text)["@graph"]


def test_children_carry_documents_and_errors(spark):
    nodes = [(1, 1, "dependsOn", "f", "Base", "ai", "m"), (2, 1, "trainedOn", "f", "o/d", "data", "m"), (3, 2, "trainedOn", "f", "odd", "video", "base"), (4, 2, "testedOn", "f", "E", "data", "base"), (5, 2, "testedOn", "f", "e ", "data", "base"), (6, 2, "dependsOn", "f", "twice", "ai", "base")]
    metadata = [("license", "MIT"), ("trainedOnDatasets", "x, y"), ("domain", None)]
    found = [("ai", "BASE", metadata, None), ("data", "o/d", None, "no answer"), ("ai", "twice", [("license", "MIT"), ("license", "MIT")], None), ("ai", "stranger", metadata, None)]
    enriched = spark.createDataFrame(found, "kind string, target string, metadata array<struct<field:string,value:string>>, error string")
    out = {r.target: r for r in child_documents(spark.createDataFrame(nodes, NODE), F.lit(NOW), enriched).collect()}
    assert set(out) == {"Base", "o/d", "odd", "E", "twice"}  # e is E again
    assert out["Base"].enriched and out["Base"].valid and {e.get("name") for e in graph_of(out["Base"].spdx)} >= {"Base", "x", "y"}
    assert not out["o/d"].enriched and out["o/d"].enrichment_error == "no answer" and out["o/d"].valid
    assert json.loads(out["o/d"].cyclonedx)["components"][0]["description"] == "Referenced by m via trainedOn"
    assert out["odd"].spdx is None and out["odd"].cyclonedx is None and out["odd"].spdx_error == out["odd"].cyclonedx_error == "invalid kind: video"
    assert out["twice"].spdx_error == "repeated field: license" and out["twice"].valid is None
    assert child_documents(spark.createDataFrame([], NODE), F.lit(NOW)).count() == 0


@pytest.fixture(scope="module")
def linked(spark):
    rows = spark.createDataFrame([("m", "m", {"suppliedBy": "us", "trainedOnDatasets": "Squad, other", "modelLineage": "base"})], "artifact_id string, name string, fields map<string,string>")
    parents = spdx.rendered(*spdx.documents(rows, "ai", F.lit(NOW))).select(F.lit("b").alias("bundle_id"), F.lit("ai").alias("kind"), F.lit("m").alias("name"), "json")
    nodes = [(1, 1, "trainedOn", "f", "squad", "data", "m"), (2, 1, "dependsOn", "f", "base", "ai", "M"), (3, 2, "trainedOn", "f", "more", "data", "Base"), (4, 2, "trainedOn", "f", "lost", "data", "nowhere"), (5, 2, "trainedOn", "f", "bad", "video", "base")]
    found = spark.createDataFrame([("ai", "base", [("trainedOnDatasets", "more"), ("suppliedBy", "them")], None)], "kind string, target string, metadata array<struct<field:string,value:string>>, error string")
    kids = child_documents(spark.createDataFrame(nodes, NODE), F.lit(NOW), found).withColumn("bundle_id", F.lit("b")).withColumnRenamed("spdx", "json")
    return bundle.link_documents(parents, kids)


def test_a_bundle_of_rendered_documents_is_valid(spark, linked):
    out = linked.first()
    assert of_documents(linked.select(F.col("bundle_id").alias("doc_id"), F.lit("ai").alias("kind"), "json"), strict=True).first().errors == []
    elements = graph_of(out.json)
    assert set(json.loads(out.json)) == {"@context", "@graph"} and out.node_count == len(elements) and out.recursive_edge_count == 4
    kinds = [e["type"] for e in elements]
    assert [kinds.count(k) for k in ("CreationInfo", "Person", "Organization", "SpdxDocument", "Bom")] == [1] * 5
    by_id = {e.get("spdxId") or e["@id"]: e for e in elements}
    organisation = next(e for e in elements if e["type"] == "Organization")
    assert organisation["name"] == "us" and all(e["originatedBy"] == [organisation["spdxId"]] for e in elements if "originatedBy" in e)
    stubs = [e["name"] for e in elements if e["type"] == "dataset_DatasetPackage" and "originatedBy" not in e]
    assert stubs == ["other", "more"]  # the parent's Squad is covered; a child's own stub stays
    made = {e["spdxId"]: (by_id[e["from"]]["name"], by_id[e["to"][0]]["name"]) for e in elements if e.get("spdxId", "").rsplit("-d", 1)[-1].isdigit()}
    assert made == {
        "urn:spdx:Relationship-trainedOn-squad-d1": ("m", "squad"), "urn:spdx:Relationship-dependsOn-base-d1": ("m", "base"),
        "urn:spdx:Relationship-trainedOn-more-d2": ("base", "more"), "urn:spdx:Relationship-trainedOn-lost-d2": ("m", "lost"),
    }


def test_only_references_are_rebound(spark):
    text = '{"spdxId":"k","by":"old","list":["old","x"],"mixed":["old",1],"comment":"old news: \\"old\\"","inner":{"by":"old"},"n":1,"old":"v"}'
    df = spark.createDataFrame([(text,)], "j string").select(bundle.rebound(F.parse_json("j"), [(F.lit("old"), F.lit("new")), (F.lit(None).cast("string"), F.lit("z")), (F.lit("x"), F.lit(None).cast("string"))]).alias("j"))
    assert json.loads(df.first().j) == {"spdxId": "k", "by": "new", "list": ["new", "x"], "mixed": ["old", 1], "comment": 'old news: "old"', "inner": {"by": "old"}, "n": 1, "old": "v"}


def test_validation_of_texts(spark):
    rows = spark.createDataFrame([("a", "a", {})], "artifact_id string, name string, fields map<string,string>")
    good = spdx.rendered(*spdx.documents(rows, "data", F.lit(NOW))).first().json
    whole = json.loads(good)
    lost = {**whole, "@graph": [e for e in whole["@graph"] if e["type"] != "simplelicensing_LicenseExpression"]}
    docs = [("good", "data", good), ("kind", "ai", good), ("lost", "data", json.dumps(lost)), ("none", "data", '{"@context":"c","@graph":5}'), ("text", "data", "{"), ("null", "data", None)]
    out = {r.doc_id: r.errors for r in of_documents(spark.createDataFrame(docs, "doc_id string, kind string, json string")).collect()}
    assert out["good"] == [] and out["kind"] == ["missing element ai_AIPackage"] and len(out["lost"]) == 2 and out["lost"][0].startswith("unresolved to urn:spdx:License-")
    assert out["none"] == ["missing or invalid @graph"] and out["text"] == out["null"] == ["missing @context", "missing or invalid @graph"]


def test_documents_are_compared_key_by_key(spark):
    left = spark.createDataFrame([("d", '{"a":[1,{"b":"x"}],"@graph":[{"spdxId":"k","n":null,"v":true},{"@id":"i","v":"t"}],"e":[]}'), ("bad", "{"), ("gone", None)], "doc_id string, json string")
    assert sorted(map(tuple, document_paths(left.where("doc_id = 'd'")).collect())) == [("d", "", "a[0]", "1"), ("d", "", "a[1].b", "x"), ("d", "i", "@id", "i"), ("d", "i", "v", "t"), ("d", "k", "spdxId", "k"), ("d", "k", "v", "true")]
    right = spark.createDataFrame([("d", '{"a":[1],"@graph":[{"@id":"i","v":"u"},{"spdxId":"k","v":true}]}'), ("bad", "{"), ("gone", None)], "doc_id string, json string")
    assert sorted(map(tuple, differences(left, right).collect())) == [("d", "", "a[1].b", "x", None), ("d", "i", "v", "t", "u")]


def test_exports_refuse_other_kinds(spark):
    rows = spark.createDataFrame([("a", "a", {})], "artifact_id string, name string, fields map<string,string>").withColumn("conflicts", F.create_map().cast("map<string,string>"))
    with pytest.raises(ValueError):
        cyclonedx.documents(rows, "video", F.lit(NOW))
    empty = json.loads(cyclonedx.documents(rows, "ai", F.lit(NOW)).first().json)["components"][0]
    assert set(empty) == {"type", "bom-ref", "name", "description", "licenses"} and empty["licenses"] == []
