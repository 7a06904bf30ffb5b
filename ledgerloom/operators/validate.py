"""Structural validation of graph documents, as queries for what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_path, stored

# Fixed values.
PACKAGES = {"ai": "ai_AIPackage", "data": "dataset_DatasetPackage"}
SPEC = "3.0.1"


def duplicate_ids(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n) of ids that occur more than once."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of children whose reference no parent has; null references aren't any."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def violations(nodes: DataFrame, refs: DataFrame, documents: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, error) of every broken rule.

    documents (doc_id, kind, has_context, has_graph), nodes (doc_id, node_id, type, spec_version, created, created_by array,
    profiles array, roots array), refs (doc_id, role, to_id): creationInfo, from, to and rootElement references.
    """
    found = []
    found.append(documents.where("not has_context").select("doc_id", F.lit("missing @context").alias("error")))
    found.append(documents.where("not has_graph").select("doc_id", F.lit("missing or invalid @graph").alias("error")))
    whole = documents.where("has_graph")
    twice = nodes.groupBy("doc_id", "node_id").agg(F.count("*").alias("n")).where("n > 1")
    found.append(twice.select("doc_id", F.explode(F.array_repeat(F.concat(F.lit("duplicate id "), "node_id"), (F.col("n") - 1).cast("int"))).alias("error")))
    types = nodes.groupBy("doc_id").agg(F.collect_set("type").alias("types"))
    package = F.when(F.col("kind") == "ai", PACKAGES["ai"]).otherwise(PACKAGES["data"])
    needed = F.array(F.lit("CreationInfo"), F.lit("SpdxDocument"), F.lit("Bom"), package)
    have = whole.join(types, "doc_id", "left")
    lacking = F.explode(F.array_except(needed, F.coalesce("types", F.array().cast("array<string>"))))
    found.append(have.select("doc_id", lacking.alias("type")).select("doc_id", F.concat(F.lit("missing element "), "type").alias("error")))
    info = nodes.where("type = 'CreationInfo'")
    found.append(info.where(~F.col("spec_version").eqNullSafe(SPEC)).select("doc_id", F.lit("wrong specVersion").alias("error")))
    found.append(info.where("coalesce(created, '') = ''").select("doc_id", F.lit("missing created").alias("error")))
    found.append(info.where("created_by is null or size(created_by) = 0").select("doc_id", F.lit("missing createdBy").alias("error")))
    if strict:
        found.append(info.where("created <> ''").where(~F.col("created").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")).select("doc_id", F.lit("malformed created").alias("error")))
    tops = nodes.where("type in ('SpdxDocument', 'Bom')")
    found.append(tops.where("profiles is null or not array_contains(profiles, 'core')").select("doc_id", F.concat(F.lit("no core profile in "), "type").alias("error")))
    found.append(nodes.where("type = 'SpdxDocument' and (roots is null or size(roots) = 0)").select("doc_id", F.lit("SpdxDocument without rootElement").alias("error")))
    lost = refs.where("to_id is not null").join(nodes.select("doc_id", F.col("node_id").alias("to_id")), ["doc_id", "to_id"], "left_anti")
    found.append(lost.select("doc_id", F.concat(F.lit("unresolved "), "role", F.lit(" "), "to_id").alias("error")))
    return reduce(DataFrame.unionByName, found)


_ELEMENT = "struct<`@id`:string,spdxId:string,type:string,specVersion:string,created:string,createdBy:array<string>,profileConformance:array<string>,rootElement:array<string>,creationInfo:string,`from`:string,`to`:array<string>>"


def parsed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, kind, json) -> what ``violations`` takes: documents, nodes and refs, read from the documents' texts.

    A text that is no JSON object, or whose @graph is no list, has no graph; elements without an id have a null one.
    """
    read = F.from_json("json", f"struct<`@context`:string,`@graph`:array<{_ELEMENT}>>")
    whole = stored(docs.select("doc_id", "kind", read.alias("d")), fresh_path(docs.sparkSession, "parsed"))  # each rule reads it
    documents = whole.select("doc_id", "kind", (F.coalesce(F.col("d.@context"), F.lit("")) != "").alias("has_context"), F.col("d.@graph").isNotNull().alias("has_graph"))
    each = whole.select("doc_id", F.explode(F.col("d.@graph")).alias("e"))
    node_id = F.coalesce("e.spdxId", "e.@id").alias("node_id")
    nodes = each.select("doc_id", node_id, "e.type", F.col("e.specVersion").alias("spec_version"), "e.created", F.col("e.createdBy").alias("created_by"), F.col("e.profileConformance").alias("profiles"), F.col("e.rootElement").alias("roots"))
    lists = [("creationInfo", F.array("e.creationInfo")), ("from", F.array("e.from")), ("to", F.col("e.to")), ("rootElement", F.col("e.rootElement"))]
    refs = None
    for role, ids in lists:
        one = each.select("doc_id", F.lit(role).alias("role"), F.explode(ids).alias("to_id")).where("to_id is not null")
        refs = one if refs is None else refs.unionByName(one)
    return documents, nodes, refs


def of_documents(docs: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, valid, strict, validator, errors) of rendered documents (doc_id, kind, json)."""
    documents, nodes, refs = parsed(docs)
    return status(documents, violations(nodes, refs, documents, strict), strict)


def status(documents: DataFrame, errors: DataFrame, strict: bool = False, validator: str = "structural") -> DataFrame:
    """(doc_id, valid, strict, validator, errors) for each document."""
    listed = errors.groupBy("doc_id").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    none = F.array().cast("array<string>")
    return documents.join(listed, "doc_id", "left").select("doc_id", F.col("errors").isNull().alias("valid"), F.lit(strict).alias("strict"), F.lit(validator).alias("validator"), F.coalesce("errors", none).alias("errors"))


def cyclonedx_errors(docs: DataFrame) -> DataFrame:
    """docs (doc_id, format, spec_version, serial, component_type, component_name) -> (doc_id, errors)."""
    rules = [
        (F.col("format") != "CycloneDX", "wrong bomFormat"),
        (~F.col("spec_version").startswith("1."), "wrong specVersion"),
        (~F.col("serial").rlike("^urn:uuid:"), "malformed serialNumber"),
        (~F.col("component_type").isin("machine-learning-model", "data"), "wrong component type"),
        (F.coalesce("component_name", F.lit("")) == "", "component without name"),
    ]
    return docs.select("doc_id", F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(said)) for bad, said in rules))).alias("errors"))
