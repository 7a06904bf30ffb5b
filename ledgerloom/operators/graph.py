"""Walks over dependency graphs, and bundles of linked documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import named_entities, slug

from .fields import real_conflict
from .search import search_names

# Relationship fields in order, what each means and the kind of its targets.
RELATIONS = [("trainedOnDatasets", "trainedOn", "data"), ("testedOnDatasets", "testedOn", "data"), ("modelLineage", "dependsOn", "ai")]
DEPTH, CAP = 1, 50
CAP_REASON = "safety-cap-reached"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared checkpoint folder, which cuts its lineage; from a checkpoint of Spark's own where none is set."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return df.checkpoint()


def numbered(df: DataFrame, *order: str | Column, start: int = 1) -> DataFrame:
    """df with seq, counting from ``start`` in that order: a range sort, and the counts of its partitions."""
    rows = written(df.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("seq", 33), F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    before, n = {}, start
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):
        before[r.part], n = n, n + r["count"]
    if not before:
        return rows
    return rows.withColumn("seq", at + F.try_element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), part).cast("long"))


def targets(relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relationships (parent, field, value, conflict) -> targets (parent, field_ord, pos, field, relation, kind, target) and
    skipped (parent, field, target, reason): a contested field leads nowhere."""
    rel = F.when(F.lit(False), None)
    order, kind = rel, rel
    for i, (f, r, k) in enumerate(RELATIONS):
        order = F.when(F.col("field") == f, i).otherwise(order)
        rel = F.when(F.col("field") == f, r).otherwise(rel)
        kind = F.when(F.col("field") == f, k).otherwise(kind)
    rows = relationships.where(F.col("field").isin([f for f, _, _ in RELATIONS])).withColumns({"field_ord": order.cast("int"), "relation": rel, "kind": kind, "contested": real_conflict(F.col("conflict")).isNotNull()})
    named = rows.select("parent", "field_ord", "field", "relation", "kind", "contested", F.posexplode(named_entities(F.col("value"))).alias("pos", "target"))
    skipped = named.where("contested").select("parent", "field", "target", F.lit("conflict").alias("reason"))
    return named.where("not contested").drop("contested"), skipped


class Walk(NamedTuple):
    """nodes (seq, depth, node, parent, ...), duplicates and capped (depth, node, parent, ...) of what a walk met, and whether
    nothing was left to visit."""

    nodes: DataFrame
    duplicates: DataFrame
    capped: DataFrame
    exhausted: bool


def walk(edges: DataFrame | Callable[[DataFrame, int], DataFrame], roots: DataFrame, depth: int = DEPTH, cap: int | None = CAP) -> Walk:
    """Breadth first from roots (node) along edges (parent, pos, target, ...), or along what ``edges(frontier, level)`` gives.

    One level is one join; a node's place is that of its first visit in the order of levels, parents and positions, so
    partitions don't matter. ``cap`` bounds the nodes in all: once they are found, everything met later is capped, not a
    duplicate. Each level is written, so a lost executor costs one level. Frontiers beyond ``depth`` are only looked at, to tell
    whether something was left.
    """
    frontier = numbered(roots.select("node").distinct(), "node", start=0).select("node", "seq")
    visited = [frontier.select("node")]
    found: dict[str, DataFrame] = {}
    n, exhausted = 0, True

    def keep(kind: str, rows: DataFrame) -> None:
        found[kind] = rows if kind not in found else found[kind].unionByName(rows)

    for level in range(1, depth + 2):
        own = edges if isinstance(edges, DataFrame) else edges(frontier, level)
        more = [c for c in own.columns if c not in ("parent", "pos", "target")]
        met = own.join(frontier.withColumnRenamed("node", "parent"), "parent").select(F.struct("seq", "pos", "target").alias("place"), F.lit(level).alias("depth"), F.col("target").alias("node"), "parent", *more)
        if level > depth:
            exhausted = exhausted and met.isEmpty()
            break
        met = written(met, "met")
        old = visited[0]
        for v in visited[1:]:
            old = old.unionByName(v)
        first = met.groupBy("node").agg(F.min("place").alias("place")).join(old, "node", "left_anti")
        if cap is not None:
            # A capped level numbers a bounded number of nodes; what lies behind the last of them is capped.
            first = first.orderBy("place").limit(cap - n)
        fresh = numbered(first, "place", start=n + 1)
        added = fresh.count()
        n += added
        last = fresh.agg(F.max("place").alias("last")) if cap is not None and n >= cap else None
        marked = met.join(fresh.select("node", F.col("place").alias("first"), "seq"), "node", "left")
        new = F.coalesce(F.col("place") == F.col("first"), F.lit(False))
        if last is not None:
            marked = marked.crossJoin(F.broadcast(last))
            over = F.coalesce(F.col("place") > F.col("last"), F.lit(True))
            keep("capped", marked.where(over).select("depth", "node", "parent", *more))
            exhausted = exhausted and marked.where(over).isEmpty()
            marked = marked.where(~over)
        keep("nodes", marked.where(new).dropDuplicates(["node"]).select("seq", "depth", "node", "parent", *more))
        keep("duplicates", marked.where(~new).select("depth", "node", "parent", *more))
        frontier = fresh.select("node", "seq")
        visited.append(frontier.select("node"))
        if not added:
            break
    nodes = found["nodes"] if found else roots.sparkSession.createDataFrame([], f"seq long, depth int, node {roots.schema['node'].dataType.simpleString()}, parent string")
    return Walk(nodes, found.get("duplicates", nodes.drop("seq").limit(0)), found.get("capped", nodes.drop("seq").limit(0)), exhausted)


def _key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.trim(name)))


def recursive_walk(parents: DataFrame, catalog: DataFrame, depth: int = DEPTH, cap: int = CAP, enrich: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The dependencies of parents (parent) by relationships (parent, field, value, conflict) of a catalog.

    nodes (seq, depth, relation, field, target, kind, parent, enriched); skipped (parent, field, target, relation, reason, depth) of
    contested fields of visited parents, and of what came after the cap; duplicates (parent, target, relation, kind,
    depth); visited (key); summary (generated, deepest, exhausted). Keys are kind and lower-case name, so a lineage that comes
    back to its root ends there; only AI nodes are walked on from. ``enrich`` is asked at each level for further
    relationships (parent, field, value, conflict) of its new nodes (parent); a target that neither knows isn't enriched.
    """
    known, skipped = [catalog], []

    def level_edges(frontier: DataFrame, level: int) -> DataFrame:
        names = frontier.where(F.col("node").startswith("ai:")).select(F.substring("node", 4, 1 << 20).alias("name_key"))
        own = catalog.withColumn("name_key", F.lower(F.trim("parent"))).join(names, "name_key", "left_semi").drop("name_key")
        if enrich is not None:
            fresh = enrich(names.select(F.col("name_key").alias("parent")))
            fresh = written(fresh.select(*catalog.columns).join(catalog.select(F.lower(F.trim("parent")).alias("has")).distinct(), F.lower(F.trim("parent")) == F.col("has"), "left_anti"), "enriched")
            known.append(fresh)
            own = own.unionByName(fresh)
        found, contested = targets(own)
        skipped.append(contested.withColumn("depth", F.lit(level)))
        return found.select(
            _key(F.lit("ai"), F.col("parent")).alias("parent"), (F.col("field_ord") * 1_000_000 + F.col("pos")).alias("pos"), _key(F.col("kind"), F.col("target")).alias("target"),
            "relation", "field", F.col("target").alias("name"), "kind", F.col("parent").alias("from"),
        )

    done = walk(level_edges, parents.select(_key(F.lit("ai"), F.col("parent")).alias("node")), depth, cap)
    spark = parents.sparkSession
    if "name" not in done.nodes.columns:
        empty = spark.createDataFrame([], "seq long, depth int, node string, parent string, relation string, field string, name string, kind string, from string")
        done = Walk(empty, empty.drop("seq"), empty.drop("seq"), done.exhausted)
    has = known[0].select("parent")
    for k in known[1:]:
        has = has.unionByName(k.select("parent"))
    has = has.select(F.lower(F.trim("parent")).alias("name_key"), F.lit(True).alias("enriched")).distinct()
    nodes = done.nodes.withColumn("name_key", F.lower(F.trim("name"))).join(has, "name_key", "left")
    nodes = nodes.select("seq", "depth", "relation", "field", F.col("name").alias("target"), "kind", F.col("from").alias("parent"), F.coalesce("enriched", F.lit(False)).alias("enriched"))
    over = done.capped.select(F.col("from").alias("parent"), "field", F.col("name").alias("target"), F.lit(CAP_REASON).alias("reason"), "depth")
    for s in skipped:
        over = over.unionByName(s.select("parent", "field", "target", "reason", "depth"))
    visited = done.nodes.select(F.col("node").alias("key")).unionByName(parents.select(_key(F.lit("ai"), F.col("parent")).alias("key"))).distinct()
    summary = done.nodes.agg(F.count("*").alias("generated"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest")).withColumn("exhausted", F.lit(done.exhausted))
    return {"nodes": nodes, "skipped": over, "duplicates": done.duplicates.select(F.col("from").alias("parent"), F.col("name").alias("target"), "relation", "kind", "depth"), "visited": visited.orderBy("key"), "summary": summary}


def _hinted(target: Column) -> Column:
    """Whether a target reads like ``org/name``."""
    return F.contains(target, F.lit("/")) & ~F.contains(target, F.lit(" "))


def seed_fields(kind: Column, target: Column, parent: Column, relation: Column) -> Column:
    """What is known of a target by its name and the relation that led there, as an array of (field, value)."""
    entry = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    own, none = slug(target), F.lit("NOASSERTION")
    use = F.concat(F.lit("Referenced by "), parent, F.lit(" via "), relation)
    ai = [entry("model_id", own), entry("repo_id", F.when(_hinted(target), target).otherwise(own)), entry("license", none), entry("model_name", target)]
    data = [entry("dataset_id", own), entry("name", target), entry("license", none), entry("intendedUse", use), entry("urls.huggingface", F.when(_hinted(target), F.concat(F.lit("https://huggingface.co/datasets/"), target)))]
    return F.filter(F.when(kind == "ai", F.array(*ai)).otherwise(F.array(*data)), lambda e: e["value"].isNotNull())


def seed_children(nodes: DataFrame) -> DataFrame:
    """``seed_fields`` of a walk's nodes as bom_fields."""
    source = F.concat(F.lit("recursive:"), "relation")
    entries = seed_fields(F.col("kind"), F.col("target"), F.col("parent"), F.col("relation"))
    return nodes.select(F.col("target").alias("artifact_id"), "kind", source.alias("source"), F.explode(entries).alias("e")).select("artifact_id", "kind", F.lit("direct").alias("section"), "e.field", "e.value", "source")


def resolve_names(nodes: DataFrame, catalog: DataFrame, least: float | None = None) -> DataFrame:
    """nodes (target, kind) -> with identifier: ``org/name`` itself, else the catalog's (kind, name, identifier, pos) first of that name, else null.

    With ``least`` names are searched: of the catalog's names of that kind whose similarity (see ``search_names``) is at least so, the most
    similar one, whose first entry is taken. An equal name has similarity 1.
    """
    first = catalog.groupBy("kind", F.lower(F.trim("name")).alias("name_key")).agg(F.min_by(F.struct("pos", "identifier"), "pos").alias("e"))
    keyed = nodes.withColumn("name_key", F.lower(F.trim("target")))
    if least is None:
        found = first.select("kind", "name_key", F.col("e.identifier").alias("found"))
    else:
        asked = keyed.where(~F.trim("target").rlike(IDENTIFIER)).select("kind", "name_key").distinct()
        found = search_names(asked, first.select("kind", F.col("name_key").alias("name"), "e.pos", "e.identifier"), least).select("kind", "name_key", F.col("identifier").alias("found"))
    met = keyed.join(found, ["kind", "name_key"], "left")
    return met.withColumn("identifier", F.when(F.trim("target").rlike(IDENTIFIER), F.trim("target")).otherwise(F.col("found"))).select(*nodes.columns, "identifier")


#: What reads like ``org/name``.
IDENTIFIER = r"^[^/\s]+/[^/\s]+$"


def first_of_type(nodes: DataFrame, *types: str) -> DataFrame:
    """nodes (doc_id, node_id, type) -> (doc_id, type, first): the first id of each type in a document, by its pos if there is one."""
    order = "pos" if "pos" in nodes.columns else "node_id"
    return nodes.where(F.col("type").isin(*types)).groupBy("doc_id", "type").agg(F.min_by("node_id", order).alias("first"))


SHARED = ("CreationInfo", "Person", "Organization")


def rebinding(parent_nodes: DataFrame, child_nodes: DataFrame) -> DataFrame:
    """(doc_id, type, old_id, new_id): children's creation info, person and organisation, and the parent's that take their places."""
    new = first_of_type(parent_nodes, *SHARED).select("type", F.col("first").alias("new_id"))
    old = first_of_type(child_nodes, *SHARED).select("doc_id", "type", F.col("first").alias("old_id"))
    return old.join(F.broadcast(new), "type").where("old_id <> new_id")


def link_bundle(parent_nodes: DataFrame, parent_edges: DataFrame, child_nodes: DataFrame, links: DataFrame, child_edges: DataFrame | None = None, root_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A parent's document with its children's: nodes (node_id, type, name) and edges (edge_id, rel_type, from_id, to_id).

    Stubs of the parent that a child covers go, with the edges that lead to them; shared parts of children stay out, and what
    refers to them refers to the parent's (a ``payload`` column included; children's rows have a doc_id then). Each link (rel_type,
    from_name, to_name, depth) becomes an edge whose id is made of its target's name; from a name that isn't there it begins at
    the parent's root (``root_id``), and without its target it is left out.
    """
    covered = links.select(F.lower(F.trim("to_name")).alias("covered")).distinct()
    stubs = parent_nodes.where("type = 'dataset_DatasetPackage'").join(covered, F.lower(F.trim("name")) == F.col("covered"), "left_semi").select("node_id")
    kept = parent_nodes.join(stubs, "node_id", "left_anti")
    kept_edges = parent_edges.join(stubs.withColumnRenamed("node_id", "to_id"), "to_id", "left_anti").select("edge_id", "rel_type", "from_id", "to_id")
    bound = rebinding(parent_nodes.withColumn("doc_id", F.lit("parent")), child_nodes) if "doc_id" in child_nodes.columns else None
    own = child_nodes.where(~F.col("type").isin(*SHARED, "SpdxDocument", "Bom")).join(kept.select("node_id"), "node_id", "left_anti").dropDuplicates(["node_id"])
    if bound is not None and "payload" in own.columns:
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        swaps = bound.groupBy("doc_id").agg(F.collect_list(F.struct("old_id", "new_id")).alias("swaps"))
        swapped = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<old_id:string,new_id:string>>")), F.col("payload"), lambda p, x: F.replace(p, quoted(x["old_id"]), quoted(x["new_id"])))
        own = own.join(swaps, "doc_id", "left").withColumn("payload", swapped).drop("swaps")
    nodes = kept.unionByName(own.select(*(c for c in own.columns if c in kept.columns)), allowMissingColumns=True)
    if child_edges is not None:
        moved = child_edges.join(stubs.withColumnRenamed("node_id", "to_id"), "to_id", "left_anti")
        for end in ("from_id", "to_id") if bound is not None else ():
            new = bound.select("doc_id", F.col("old_id").alias(end), F.col("new_id").alias("bound"))
            moved = moved.join(new, ["doc_id", end], "left").withColumn(end, F.coalesce("bound", end)).drop("bound")
        moved = moved.select("edge_id", "rel_type", "from_id", "to_id").dropDuplicates(["edge_id"])
        kept_edges = kept_edges.unionByName(moved.join(kept_edges.select("edge_id"), "edge_id", "left_anti"))
    by_name = nodes.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("node_id").alias("id"))
    ends = links.join(by_name.select(F.col("key").alias("from_key"), F.col("id").alias("named")), F.lower(F.trim("from_name")) == F.col("from_key"), "left").withColumn("from_id", F.coalesce("named", F.lit(root_id).cast("string")))
    ends = ends.join(by_name.select(F.col("key").alias("to_key"), F.col("id").alias("to_id")), F.lower(F.trim("to_name")) == F.col("to_key")).where("from_id is not null")
    edge = F.concat(F.lit("urn:spdx:Relationship-"), "rel_type", F.lit("-"), slug(F.col("to_name")), F.lit("-d"), F.col("depth").cast("string"))
    new = ends.select(edge.alias("edge_id"), "rel_type", "from_id", "to_id").groupBy("edge_id").agg(F.min_by(F.struct("rel_type", "from_id", "to_id"), F.struct("from_id", "to_id")).alias("e")).select("edge_id", "e.*")
    return nodes, kept_edges.unionByName(new.join(kept_edges.select("edge_id"), "edge_id", "left_anti"))


def bundle_summary(nodes: DataFrame, edges: DataFrame, walked: DataFrame) -> DataFrame:
    """(node_count, recursive_edge_count, deepest, exhausted): elements of a bundle, edges that a walk made, and how far it went."""
    made = F.col("rel_type").isin("trainedOn", "testedOn", "dependsOn") & F.col("edge_id").rlike(r"^urn:spdx:Relationship-.*-d\d+$")
    counted = edges.agg(F.count("*").alias("edges"), F.count_if(made).alias("recursive_edge_count"))
    both = nodes.agg(F.count("*").alias("nodes")).crossJoin(counted).crossJoin(walked.select("deepest", "exhausted"))
    return both.select((F.col("nodes") + F.col("edges")).alias("node_count"), "recursive_edge_count", "deepest", "exhausted")


def enriched_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("children"), F.count_if("enriched").alias("enriched"))
