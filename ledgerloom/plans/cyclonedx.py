"""Resolved fields as CycloneDX 1.7 documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn

from .spdx import _value

# Fixed values.
FORMAT, VERSION = "CycloneDX", "1.7"
AI_PROPERTIES = ["energyConsumption", "autonomyType", "modelExplainability", "useSensitivePersonalInformation", "standardCompliance"]
DATA_PROPERTIES = ["datasetSize", "datasetType", "dataCollectionProcess", "knownBias", "hasSensitivePersonalInformation", "anonymizationMethodUsed"]
NOT_FOUND = ["not found", "not found."]
HUB = "https://huggingface.co/"
TOOL, TOOL_VERSION, AUTHOR = "ledgerloom", "1.0.0", "BOM Generator"


def _found(field: str) -> Column:
    """A field's value unless it says that nothing was found."""
    v = _value(field)
    return F.when(~F.lower(v).isin(NOT_FOUND), v)


def _fields(**columns: Column) -> Column:
    there = None
    for c in columns.values():
        there = c.isNotNull() if there is None else there | c.isNotNull()
    return F.when(there, F.struct(*(c.alias(n) for n, c in columns.items())))


def _some(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def _datasets(field: str, kind: str) -> Column:
    """Names between commas, repeated ones too."""
    names = F.filter(F.transform(F.split(F.coalesce(_found(field), F.lit("")), ","), fn.strip), lambda x: x != "")
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("name")))


def _properties(names: list[str], conflicts: bool) -> Column:
    listed = F.array_compact(F.array(*(F.when(_found(n).isNotNull(), F.struct(F.lit(f"bom:{n}").alias("name"), _found(n).alias("value"))) for n in names)))
    if not conflicts:
        return _some(listed)
    contested = F.transform(F.array_sort(F.map_entries(F.coalesce("conflicts", F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.concat(F.lit("bom:conflict:"), e["key"]).alias("name"), e["value"].alias("value")))
    return _some(F.concat(listed, contested))


def _references() -> Column:
    """The hub page of an ``org/name``, the repository and the paper."""
    repo = F.coalesce(_value("repo_id"), F.col("artifact_id"))
    given = [("documentation", F.when(F.contains(repo, F.lit("/")), F.concat(F.lit(HUB), repo))), ("vcs", _value("urls.github")), ("documentation", _value("urls.arxiv"))]
    return _some(F.array_compact(F.array(*(F.when(url.isNotNull(), F.struct(F.lit(kind).alias("type"), url.alias("url"))) for kind, url in given))))


def _model_card() -> Column:
    data = _some(F.concat(_datasets("trainedOnDatasets", "training"), _datasets("testedOnDatasets", "evaluation")))
    parameters = _fields(task=_value("primaryPurpose"), architectureFamily=_value("typeOfModel"), datasets=data)
    metric, limitation, safety = _value("metric"), _value("limitation"), _value("safetyRiskAssessment")
    analysis = F.when(metric.isNotNull(), F.struct(F.array(F.struct(F.lit("other").alias("type"), metric.alias("value"))).alias("performanceMetrics")))
    ethical = F.when(safety.isNotNull(), F.array(F.struct(F.lit("safetyRiskAssessment").alias("name"), safety.alias("description"))))
    considerations = _fields(technicalLimitations=F.when(limitation.isNotNull(), F.array(limitation)), ethicalConsiderations=ethical)
    return _fields(modelParameters=parameters, quantitativeAnalysis=analysis, considerations=considerations)


def documents(rows: DataFrame, kind: str, created: Column) -> DataFrame:
    """rows (artifact_id, name, fields map, conflicts map of JSON texts) of one kind (ai or data) -> (doc_id, json).

    Descriptions and licences are always written, other parts only if there is something to say. URLs are the fields ``urls.github``
    and ``urls.arxiv``. A dataset's conflicts aren't written.
    """
    if kind not in ("ai", "data", "dataset"):
        raise ValueError(kind)
    ai = kind == "ai"
    license_, supplier = _value("license"), _value("suppliedBy" if ai else "originatedBy")
    licenses = F.when(license_ != "NOASSERTION", F.array(F.struct(F.struct(license_.alias("id")).alias("license"))))
    component = [
        F.lit("machine-learning-model" if ai else "data").alias("type"),
        F.concat(F.lit("ai-model:" if ai else "dataset:"), "artifact_id").alias("bom-ref"),
        F.coalesce(*((_value("model_name"),) if ai else ()), "name", "artifact_id").alias("name"),
        *((_value("packageVersion").alias("version"),) if ai else ()),
        F.coalesce(_value("informationAboutApplication" if ai else "intendedUse"), F.lit("")).alias("description"),
        F.when(supplier.isNotNull(), F.struct(supplier.alias("name"))).alias("supplier"),
        F.coalesce(licenses, F.array().cast("array<struct<license:struct<id:string>>>")).alias("licenses"),
    ]
    if ai:
        lineage = _found("modelLineage")
        component += [_references().alias("externalReferences"), _model_card().alias("modelCard")]
        component.append(F.when(lineage.isNotNull(), F.struct(F.array(F.struct(F.lit("machine-learning-model").alias("type"), lineage.alias("name"))).alias("ancestors"))).alias("pedigree"))
    component.append(_properties(AI_PROPERTIES if ai else DATA_PROPERTIES, ai).alias("properties"))
    serial = F.regexp_replace(F.sha1(F.concat("artifact_id", F.lit("/cyclonedx"))), r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "urn:uuid:$1-$2-$3-$4-$5")
    tools = F.array(F.struct(F.lit(TOOL).alias("name"), F.lit(TOOL_VERSION).alias("version"))).alias("tools")
    metadata = F.struct(created.alias("timestamp"), tools, F.array(F.struct(F.lit(AUTHOR).alias("name"))).alias("authors")).alias("metadata")
    whole = F.struct(F.lit(FORMAT).alias("bomFormat"), F.lit(VERSION).alias("specVersion"), F.lit(1).alias("version"), serial.alias("serialNumber"), metadata, F.array(F.struct(*component)).alias("components"))
    return rows.select(F.col("artifact_id").alias("doc_id"), F.to_json(whole).alias("json"))
