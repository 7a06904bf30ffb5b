"""Resolved fields as {value, source, conflict} records: conflicts as data, wide views, presets and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.licenses import normalize_license
from ledgerloom.functions.scalars import collapse_whitespace, literal_map, missing_to_null, named_entities, strip

TRACE = "struct<claims:map<string,string>,internal:map<string,string>,external:array<struct<sources:array<string>,description:string>>,selected:array<string>>"
CONFLICT = "struct<value:string,source:string,type:string,delta_days:int,internal:string,external:string>"

#: Post-processors by the name that a question bank gives.
POST_PROCESS = {
    "normalize_license": normalize_license,
    "collapse_whitespace": collapse_whitespace,
    "dedupe_named_entities": lambda c: F.array_join(named_entities(c), ", "),
}

# The fields of each preset; None means all.
PRESETS = {
    "ai": {
        "complete": None,
        "safety": ["standardCompliance", "limitation", "modelExplainability", "informationAboutApplication", "informationAboutTraining", "modelDataPreprocessing", "domain"],
        "security": ["safetyRiskAssessment", "informationAboutApplication", "domain", "useSensitivePersonalInformation", "autonomyType"],
        "lineage": ["informationAboutTraining", "modelDataPreprocessing", "hyperparameter", "metric", "metricDecisionThreshold"],
        "license": ["standardCompliance", "license"],
    },
    "data": {
        "complete": None,
        "safety": ["knownBias", "datasetNoise", "datasetUpdateMechanism", "dataPreprocessing", "dataCollectionProcess", "intendedUse"],
        "security": ["intendedUse", "primaryPurpose", "anonymizationMethodUsed"],
        "lineage": ["datasetAvailability", "dataPreprocessing", "dataCollectionProcess", "releaseTime", "originatedBy"],
        "license": ["license"],
    },
}

# What each preset is called.
PRESET_LABELS = {
    "ai": {"complete": "Complete AI BOM", "safety": "Safety & Compliance", "security": "Security & Risk", "lineage": "Model Lineage", "license": "License Compliance"},
    "data": {"complete": "Complete Data BOM", "safety": "Safety & Bias", "security": "Security & Privacy", "lineage": "Data Lineage", "license": "License & Rights"},
}


def preset_label(name: Column, kind: str) -> Column:
    """What a preset is called; an unknown one is the complete one."""
    labels = PRESET_LABELS["data" if kind == "dataset" else kind]
    return F.coalesce(F.try_element_at(literal_map(labels), F.lower(strip(F.coalesce(name, F.lit(""))))), F.lit(labels["complete"]))


def conflict(value: Column | None = None, source: Column | None = None, kind: str | Column | None = "inter", delta: Column | None = None, internal: Column | None = None, external: Column | None = None) -> Column:
    cols = {"value": value, "source": source, "type": F.lit(kind) if isinstance(kind, str) or kind is None else kind, "delta_days": delta, "internal": internal, "external": external}
    return F.struct(*((F.lit(None) if c is None else c).alias(n) for n, c in cols.items())).cast(CONFLICT)


def parse_conflict(c: Column) -> Column:
    """A conflict in words (``source: value, source: value``) as a record; null if it says that there is none."""
    text = F.lower(strip(c))
    none = c.isNull() | text.isin("", "none") | text.startswith("no conflict") | text.startswith("no cross-source")
    parts = F.filter(F.split(c, ", "), lambda x: F.contains(x, F.lit(": ")))
    sources = F.array_join(F.transform(parts, lambda x: F.substring_index(x, ": ", 1)), ", ")
    values = F.array_join(F.transform(parts, lambda x: F.substring(x, F.instr(x, ": ") + 2, F.length(x))), ", ")
    listed = F.contains(c, F.lit(": "))
    return F.when(~none, conflict(F.when(listed, values).otherwise(c), F.when(listed, sources)))


def real_conflict(c: Column) -> Column:
    """A conflict record if it records one: an internal or external finding that says yes, or a typed value or source."""
    yes = lambda x: F.coalesce(F.lower(strip(x)).startswith("yes"), F.lit(False))
    found = F.when(yes(c["external"]), "inter").when(yes(c["internal"]), "intra")
    typed = c["type"].isNotNull() & (missing_to_null(c["value"]).isNotNull() | missing_to_null(c["source"]).isNotNull())
    kind = F.coalesce(found, F.when(typed, c["type"]))
    return F.when(c.isNotNull() & kind.isNotNull(), c.withField("type", kind))


def post_process(value: Column, name: Column) -> Column:
    """The value after the post-processor of that name; unknown names change nothing."""
    out = value
    for n, f in POST_PROCESS.items():
        out = F.when(name == n, f(value)).otherwise(out)
    return out


def triplets(resolved: DataFrame, section: str) -> DataFrame:
    """resolved (artifact_id, field, value, source, conflict string) -> bom_fields with a conflict record."""
    return resolved.select("artifact_id", F.lit(section).alias("section"), "field", "value", "source", parse_conflict(F.col("conflict")).alias("conflict"))


#: What a wide view calls the parts of a trace.
TRACE_COLUMNS = {"claims": "claims", "internal": "internal_conflicts", "external": "external_conflicts", "selected": "selected_sources"}


def wide(bom_fields: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row for each artifact with the columns <f>, <f>_source and <f>_conflict of the given fields, so that no pass is needed to find them.

    Where bom_fields has raw_answer and trace, <f>_raw_answer and the trace's four columns follow.
    """
    more = [c for c in ("raw_answer", "trace") if c in bom_fields.columns]
    one = F.first(F.struct("value", "source", F.col("conflict.value").alias("conflict"), *more), ignorenulls=True)
    g = bom_fields.where(F.col("field").isin(list(fields))).groupBy("artifact_id").pivot("field", list(fields)).agg(one)
    names = [("value", ""), ("source", "_source"), ("conflict", "_conflict"), *((("raw_answer", "_raw_answer"),) if "raw_answer" in more else ())]
    names += [(f"trace.{x}", f"_{n}") for x, n in TRACE_COLUMNS.items()] if "trace" in more else []
    return g.select("artifact_id", *(F.col(f"{f}.{x}").alias(f + n) for f in fields for x, n in names))


def preset(bom_fields: DataFrame, kind: str, name: str) -> DataFrame:
    """The fields of a preset; an unknown name means all."""
    fields = PRESETS["data" if kind == "dataset" else kind].get((name or "").strip().lower())
    return bom_fields if fields is None else bom_fields.where(F.col("field").isin(fields))


def count_filled(bom_fields: DataFrame) -> DataFrame:
    filled = F.count_if(missing_to_null(F.col("value")).isNotNull())
    return bom_fields.groupBy("artifact_id").agg(filled.alias("filled"), F.count("*").alias("fields"))


def conflict_report(bom_fields: DataFrame) -> DataFrame:
    """One row for each field with a real conflict."""
    return bom_fields.withColumn("conflict", real_conflict(F.col("conflict"))).where("conflict is not null").select("artifact_id", "section", "field", "value", "source", F.col("conflict.type").alias("conflict_type"), F.col("conflict.value").alias("conflict_value"), F.col("conflict.source").alias("conflict_source"))


def documents(bom_fields: DataFrame) -> DataFrame:
    """(artifact_id, json): a provenance document for each artifact, fields by section; nulls are written.

    A field with a trace or a raw answer has them, too; others have no such key.
    """
    record = F.to_json(F.struct("value", "source", "conflict"), {"ignoreNullFields": "false"})
    for c in ("trace", "raw_answer"):
        if c in bom_fields.columns:
            told = F.concat(F.substring(record, F.lit(1), F.length(record) - 1), F.lit(","), F.substring(F.to_json(F.struct(c)), 2, 1 << 30))
            record = F.when(F.col(c).isNotNull(), told).otherwise(record)
    listed = lambda rows: F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda e: F.concat(F.substring(F.to_json(F.array(e["name"])), F.lit(2), F.length(F.to_json(F.array(e["name"]))) - 2), F.lit(":"), e["json"])), ","), F.lit("}"))
    sections = bom_fields.groupBy("artifact_id", "section").agg(listed(F.struct(F.col("field").alias("name"), record.alias("json"))).alias("json"))
    return sections.groupBy("artifact_id").agg(listed(F.struct(F.col("section").alias("name"), "json")).alias("json"))


def with_links(rows: DataFrame, links: Mapping[str, str]) -> DataFrame:
    """Drop discovered links that were rejected; keep given ones and warn. ``links``: link column -> its status column."""
    out = rows
    for link, status in links.items():
        bad = F.col(f"{status}.rejected")
        out = out.withColumn(f"{link}_warning", bad & ~F.col(f"{status}.discovered")).withColumn(link, F.when(~(bad & F.col(f"{status}.discovered")), F.col(link)))
    return out
