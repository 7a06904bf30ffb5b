"""Bundles of rendered SPDX documents: a parent and the children of its walk in one graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import slug
from ledgerloom.operators.graph import SHARED

from .children import target_key
from .spdx import as_graph

# Parts of a child's document that stay out of a bundle.
OWN = (*SHARED, "SpdxDocument", "Bom")
PACKAGES = ("ai_AIPackage", "dataset_DatasetPackage")


def elements(docs: DataFrame) -> DataFrame:
    """docs (..., json) -> (..., pos, node_id, type, name, ends, element): the elements of their graphs, as they stand (VARIANT);
    ``ends`` are those that a relationship leads to. A document without elements keeps one row of nulls."""
    graph = F.try_variant_get(F.try_parse_json("json"), "$['@graph']", "array<variant>")
    each = docs.select(*(c for c in docs.columns if c != "json"), F.posexplode_outer(graph).alias("pos", "element"))
    text = lambda k: F.try_variant_get("element", f"$['{k}']", "string")
    ends = F.when(text("type") == "Relationship", F.try_variant_get("element", "$.to", "array<string>"))
    return each.withColumns({"node_id": F.coalesce(text("spdxId"), text("@id")), "type": text("type"), "name": text("name"), "ends": ends})


def _quoted(text: Column) -> Column:
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def rebound(element: Column, swaps: list[tuple[Column, Column]]) -> Column:
    """An element's JSON with old ids swapped for new ones: strings and strings of lists right below its top, nothing else.

    So an id within a text or a nested value stays as it is. A swap whose old or new id is null does nothing.
    """

    def new(x: Column) -> Column:
        out = x
        for before, after in reversed(swaps):
            out = F.when(x == before, F.coalesce(after, x)).otherwise(out)
        return out

    def entry(e: Column) -> Column:
        value, kind = e["value"], F.schema_of_variant(e["value"])
        text, texts = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<string>")
        told = F.when(kind == "STRING", _quoted(new(text))).when(kind == "ARRAY<STRING>", F.to_json(F.transform(texts, new))).otherwise(F.to_json(value))
        return F.concat(_quoted(e["key"]), F.lit(":"), told)

    entries = F.map_entries(F.try_variant_get(element, "$", "map<string,variant>"))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, entry), ","), F.lit("}"))


def _first(types: tuple[str, ...], where: Column, over: Window) -> Column:
    """The id of the first element of a document that has one of the types."""
    return F.min(F.when(where & F.col("type").isin(*types), F.struct("pos", "node_id"))).over(over)["node_id"]


def link_documents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parents (bundle_id, kind, name, json) and children (bundle_id, seq, depth, relation, target, kind, parent, json) of many bundles ->
    (bundle_id, json, node_count, recursive_edge_count).

    A parent's dataset stubs that a child covers go, with the relationships that lead to them; a child's creation info, person and
    organisation stay out, and what refers to them refers to the parent's; an element that is there already stays out. Each child
    adds a relationship from its parent's package, from the bundle's where that isn't in the bundle, to its own; of equal ids the first
    stays. Children without a document add nothing but their name. A bundle is one row, bounded by the cap of its walk, so
    everything is worked out in windows over it, after one shuffle.
    """
    columns = ["bundle_id", "part", "seq", "depth", "relation", "target", "parent", "key", "json"]
    none = {"depth": F.lit(None).cast("int"), "relation": F.lit(None).cast("string"), "target": F.lit(None).cast("string"), "parent": F.lit(None).cast("string")}
    top = parents.withColumns({"part": F.lit(0), "seq": F.lit(0).cast("long"), "key": target_key(F.col("kind"), F.col("name")), **none}).select(columns)
    below = children.withColumns({"part": F.lit(1), "key": target_key(F.col("kind"), F.col("target"))}).select(columns)
    rows = elements(top.unionByName(below))

    bundle, document = Window.partitionBy("bundle_id"), Window.partitionBy("bundle_id", "part", "seq", "key")
    of_parent, of_child = F.col("part") == 0, F.col("part") == 1
    shared = [(_first((t,), of_child, document), _first((t,), of_parent, bundle)) for t in SHARED]
    rows = rows.withColumns({f"{x}_{i}": c for i, pair in enumerate(shared) for x, c in zip(("old", "new"), pair)})
    covered = F.collect_set(F.when(of_child, F.lower(F.trim("target")))).over(bundle)
    rows = rows.withColumns({"covered": covered, "root": _first(PACKAGES, F.lit(True), document), "top_root": _first(PACKAGES, of_parent, bundle), "nth": F.row_number().over(document.orderBy("pos"))})
    stub = of_parent & (F.col("type") == "dataset_DatasetPackage") & F.array_contains("covered", F.lower(F.trim("name")))
    known = F.when((F.col("nth") == 1) & F.col("root").isNotNull(), F.struct("part", "seq", "key", "root"))
    rows = rows.withColumns({"stubs": F.collect_set(F.when(stub, F.col("node_id"))).over(bundle), "roots": F.array_sort(F.collect_list(known).over(bundle))})

    gone = F.coalesce(of_parent & (F.array_contains("stubs", F.col("node_id")) | F.arrays_overlap("stubs", F.coalesce("ends", F.array().cast("array<string>")))), F.lit(False))
    stays = F.col("element").isNotNull() & F.when(of_parent, ~gone).otherwise(~F.coalesce(F.col("type").isin(*OWN), F.lit(False)))
    own = F.when(of_parent, F.to_json("element")).otherwise(rebound(F.col("element"), [(F.col(f"old_{i}"), F.col(f"new_{i}")) for i in range(len(SHARED))]))
    from_key = target_key(F.lit("ai"), F.col("parent"))
    named = F.get(F.filter("roots", lambda r: r["key"] == from_key), F.lit(0))["root"]
    to_id = F.get(F.filter("roots", lambda r: r["key"] == F.col("key")), F.lit(0))["root"]
    from_id = F.coalesce(named, F.col("top_root"))
    edge_id = F.concat(F.lit("urn:spdx:Relationship-"), "relation", F.lit("-"), slug(F.col("target")), F.lit("-d"), F.col("depth").cast("string"))
    told = F.concat("relation", F.lit(" relationship from "), "parent", F.lit(" to "), "target", F.lit(" (depth "), F.col("depth").cast("string"), F.lit(")"))
    made = F.struct(
        F.lit("Relationship").alias("type"), edge_id.alias("spdxId"), F.col("new_0").alias("creationInfo"), F.col("relation").alias("relationshipType"), from_id.alias("from"), F.array(to_id).alias("to"), told.alias("description"),
    )
    links = of_child & (F.col("nth") == 1) & F.col("root").isNotNull() & from_id.isNotNull() & to_id.isNotNull()
    item = lambda part, id_, payload: F.struct(F.lit(part).alias("part"), id_.alias("id"), payload.alias("payload"))
    items = F.array_compact(F.array(F.when(stays, item(0, F.col("node_id"), own)), F.when(links, item(1, edge_id, F.to_json(made)))))
    each = rows.select("bundle_id", "seq", "pos", F.explode(items).alias("i")).select("bundle_id", "seq", "pos", "i.*")
    again = F.row_number().over(Window.partitionBy("bundle_id", "id").orderBy("part", "seq", "pos"))
    each = each.withColumn("again", F.when((F.col("seq") > 0) & F.col("id").isNotNull(), again).otherwise(1)).where("again = 1")
    whole = each.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "pos", "payload"))).alias("e"), F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("part") == 1).alias("recursive_edge_count"))
    return whole.select("bundle_id", as_graph(F.transform("e", lambda x: x["payload"])).alias("json"), "node_count", "recursive_edge_count")
