"""Structured metadata of hubs and code hosts, as claims and as prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import missing_to_null

# Fixed values.
MOST_TAGS = 30


def _claims(rows: DataFrame, source: str, ord_: int, fields: dict[str, Column]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()))
    long = rows.select("artifact_id", F.explode(entries).alias("e"))
    return long.select("artifact_id", "e.field", F.lit(source).alias("source"), F.lit(ord_).alias("ord"), missing_to_null(F.col("e.value")).alias("value")).where("value is not null")


def repository_claims(repos: DataFrame, kind: str) -> DataFrame:
    """repos (artifact_id, full_name, owner, description, license, pushed_at, created_at, html_url, latest_release, first_tag, head_sha)."""
    version = F.coalesce(missing_to_null(F.col("latest_release")), missing_to_null(F.col("first_tag")))
    common = {"releaseTime": F.col("pushed_at"), "downloadLocation": F.col("html_url"), "primaryPurpose": F.col("description"), "license": F.col("license")}
    own = {"suppliedBy": F.col("owner"), "packageVersion": version} if kind == "ai" else {"builtTime": F.col("created_at"), "originatedBy": F.col("owner"), "name": F.col("full_name"), "datasetAvailability": F.lit("directDownload"), "contentIdentifier": F.col("head_sha")}
    return _claims(repos, "repo", 1, common | own)


def hub_claims(hub: DataFrame, kind: str) -> DataFrame:
    """hub (artifact_id, id, author, sha, last_modified, created_at, private, tags, card struct)."""
    tags = F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 3)
    listed = F.concat_ws("; ", F.concat_ws("; ", "card.task_categories"), F.col("card.pipeline_tag"), F.concat_ws("; ", tags))
    purpose = F.coalesce(missing_to_null(F.get("card.task_categories", F.lit(0))), missing_to_null(listed)) if kind == "data" else missing_to_null(listed)
    url = F.concat(F.lit("https://huggingface.co/" if kind == "ai" else "https://huggingface.co/datasets/"), "id")
    common = {"releaseTime": F.col("last_modified"), "downloadLocation": url, "primaryPurpose": purpose, "license": F.col("card.license")}
    own = {"suppliedBy": F.col("author"), "packageVersion": F.substring("sha", 1, 8)} if kind == "ai" else {"builtTime": F.col("created_at"), "originatedBy": F.col("author"), "name": F.col("id"), "datasetAvailability": F.when(F.col("private"), "registration").otherwise("directDownload"), "contentIdentifier": F.col("sha")}
    return _claims(hub, "hub", 0, common | own)


def model_tree(hub: DataFrame) -> DataFrame:
    """(artifact_id, trained_on, lineage, tested_on): names of a model's card, tags and results, in order, the first of equals."""
    none = F.array().cast("array<string>")

    def tagged(prefix: str) -> Column:
        return F.transform(F.filter(F.coalesce("tags", none), lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, 1 << 20))

    tested = F.flatten(F.transform(F.coalesce("card.model_index", F.array().cast("array<struct<results:array<struct<dataset:struct<name:string,type:string>>>>>")), lambda m: F.transform(m["results"], lambda r: F.coalesce(r["dataset"]["name"], r["dataset"]["type"]))))
    names = {"trained_on": F.concat(F.coalesce("card.datasets", none), tagged("dataset:")), "lineage": F.concat(F.coalesce("card.base_model", none), tagged("base_model:")), "tested_on": tested}
    return hub.select("artifact_id", *(F.array_distinct(F.array_compact(c)).alias(n) for n, c in names.items()))


def _prose(title: str, lines: dict[str, Column]) -> Column:
    body = F.array_compact(F.array(*(F.when(missing_to_null(c.cast("string")).isNotNull(), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in lines.items())))
    return F.when(F.size(body) > 0, F.array_join(F.concat(F.array(F.lit(title)), body), "\n")).otherwise("")


def hub_prose(hub: DataFrame, kind: str) -> DataFrame:
    """(artifact_id, text) of what a hub's record says; '' if nothing."""
    joined = lambda c: F.concat_ws(", ", F.col(c))
    lines = {"license": F.col("card.license"), "tags": F.concat_ws(", ", F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, MOST_TAGS)), "task_categories": joined("card.task_categories"), "pipeline_tag": F.col("card.pipeline_tag"), "base_model": joined("card.base_model"), "datasets": joined("card.datasets")}
    if kind == "data":
        total = F.aggregate("siblings", F.lit(0).cast("long"), lambda s, x: s + F.when(x["size"] > 0, x["size"]).otherwise(0))
        card = hub.schema["card"].dataType.names
        lines |= {n: joined(f"card.{n}") for n in ("source_datasets", "annotations_creators", "language", "size_categories") if n in card}
        lines |= {"estimated_total_size_bytes": F.when(total > 0, total)}
    return hub.select("artifact_id", _prose("# Hub record", lines).alias("text"))


def repository_prose(repos: DataFrame, kind: str) -> DataFrame:
    lines = {"description": F.col("description"), "license": F.col("license"), "topics": F.concat_ws(", ", F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, MOST_TAGS)), "language": F.col("language"), "default_branch": F.col("default_branch")}
    if kind == "data":
        lines["repository_size_bytes"] = F.when(F.col("size_kb") > 0, F.col("size_kb") * 1024)
    return repos.select("artifact_id", _prose("# Repository record", lines).alias("text"))


def with_readme(prose: DataFrame, readmes: DataFrame) -> DataFrame:
    """(artifact_id, text): the record, a blank line and the read-me."""
    r = readmes.select("artifact_id", F.col("text").alias("readme"))
    return prose.join(r, "artifact_id", "full_outer").select("artifact_id", F.concat_ws("\n\n", missing_to_null(F.col("text")), missing_to_null(F.col("readme"))).alias("text"))


def with_sources(artifacts: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """artifacts (artifact_id, <name>_url ...) with what was fetched of each source: name -> table (url, ...) joined as a struct <name>.

    An artifact without a source's URL, or of one that wasn't fetched, has null there.
    """
    out = artifacts
    for name, rows in sources.items():
        own = rows.select(F.col("url").alias(f"{name}_url"), F.struct(*rows.columns).alias(name)).dropDuplicates([f"{name}_url"])
        out = out.join(own, f"{name}_url", "left")
    return out.select(*artifacts.columns, *sources)


def model_or_dataset(artifacts: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """artifacts (artifact_id, hub_id) with record: of the model of that id, else of the dataset; both tables have the same columns (id, ...)."""
    m, d = (x.select(F.col("id").alias("hub_id"), F.struct(*models.columns).alias(n)).dropDuplicates(["hub_id"]) for x, n in ((models, "of_model"), (datasets, "of_dataset")))
    met = artifacts.join(m, "hub_id", "left").join(d, "hub_id", "left")
    return met.select(*artifacts.columns, F.coalesce("of_model", "of_dataset").alias("record"), F.when(F.col("of_model").isNotNull(), "model").when(F.col("of_dataset").isNotNull(), "dataset").alias("found_as"))
