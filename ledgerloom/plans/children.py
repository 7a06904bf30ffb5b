"""The nodes of a dependency walk with documents of their own: metadata or a seed, SPDX with its validation, CycloneDX, and errors by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import seed_fields
from ledgerloom.operators.scratch import fresh_path, stored
from ledgerloom.operators.validate import of_documents

from . import cyclonedx, spdx

KINDS = ("ai", "data", "dataset")
METADATA = "array<struct<field:string,value:string>>"


def target_key(kind: Column, target: Column) -> Column:
    """What tells two targets apart, and what the ids of their documents are made of."""
    return F.concat(kind, F.lit(":"), F.lower(F.trim(target)))


def _faults(kind: Column, entries: Column) -> Column:
    """Why no document can be made of a row, or null."""
    names = F.transform(entries, lambda e: e["field"])
    twice = F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda x: x == n)) > 1)
    return F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), F.concat(F.lit("invalid kind: "), F.coalesce(kind, F.lit("null")))).when(F.exists(names, lambda n: n.isNull()), F.lit("field without a name")).when(
        F.size(twice) > 0, F.concat(F.lit("repeated field: "), F.array_join(F.array_sort(twice), ", "))
    )


def child_documents(nodes: DataFrame, created: Column, enriched: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """nodes of a walk (seq, depth, relation, field, target, kind, parent) with their documents, one row for each.

    ``enriched`` (kind, target, metadata array of (field, value), error) is what an enricher found, or why it failed, one row for a
    target at most; nodes without metadata are seeded by name. -> nodes' columns, doc_id, enriched, enrichment_error, fields, spdx,
    spdx_error, valid, errors (of SPDX validation), cyclonedx, cyclonedx_error. Nothing that is wrong with one row fails the
    others: its documents are null and its errors say why. Both kinds go through one written table; nodes that occur twice
    (kind and name, whatever its case) keep the row of smallest seq.
    """
    spark = nodes.sparkSession
    own = ["seq", "depth", "relation", "field", "target", "kind", "parent"]
    first = nodes.groupBy(target_key(F.coalesce("kind", F.lit("")), F.col("target")).alias("doc_id")).agg(F.min_by(F.struct(*own), "seq").alias("n")).select("doc_id", "n.*")
    if enriched is None:
        met = first.withColumns({"metadata": F.lit(None).cast(METADATA), "enrichment_error": F.lit(None).cast("string")})
    else:
        found = enriched.select(target_key(F.col("kind"), F.col("target")).alias("doc_id"), F.col("metadata").cast(METADATA).alias("metadata"), F.col("error").alias("enrichment_error"))
        met = first.join(found, "doc_id", "left")
    has = F.coalesce(F.size("metadata") > 0, F.lit(False)) & F.col("enrichment_error").isNull()
    seeds = seed_fields(F.col("kind"), F.col("target"), F.col("parent"), F.col("relation"))
    met = met.withColumns({"enriched": has, "entries": F.when(has, F.col("metadata")).otherwise(seeds)}).withColumn("fault", _faults(F.col("kind"), F.col("entries")))
    fields = F.when(F.col("fault").isNull(), F.map_from_entries(F.when(F.col("fault").isNull(), F.filter("entries", lambda e: e["value"].isNotNull()))))
    rows = stored(met.withColumn("fields", fields).drop("metadata", "entries"), fresh_path(spark, "children"))

    good = rows.where("fault is null").select(F.col("doc_id").alias("artifact_id"), "kind", F.trim("target").alias("name"), "fields", F.create_map().cast("map<string,string>").alias("conflicts"))
    graphs, components = None, None
    for kind, some in (("ai", good.where("kind = 'ai'")), ("data", good.where("kind <> 'ai'"))):
        one = spdx.rendered(*spdx.documents(some, kind, created)).select("doc_id", F.lit(kind).alias("kind"), "json")
        other = cyclonedx.documents(some, kind, created)
        graphs, components = (one, other) if graphs is None else (graphs.unionByName(one), components.unionByName(other))
    graphs = stored(graphs, fresh_path(spark, "spdx"))
    checked = of_documents(graphs, strict).select("doc_id", "valid", "errors")
    out = rows.join(graphs.select("doc_id", F.col("json").alias("spdx")), "doc_id", "left").join(checked, "doc_id", "left").join(components.withColumnRenamed("json", "cyclonedx"), "doc_id", "left")
    return out.select(*own, "doc_id", "enriched", "enrichment_error", "fields", "spdx", F.col("fault").alias("spdx_error"), "valid", "errors", "cyclonedx", F.col("fault").alias("cyclonedx_error"))
