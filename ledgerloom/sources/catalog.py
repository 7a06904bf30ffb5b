"""Catalogs of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.graph import numbered

MODEL = "id string, name string, context_length string, pricing struct<prompt:string,completion:string>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Models of a JSON file with a ``data`` list, those without an id left out, in the file's order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"data array<struct<{MODEL.replace(' struct', ':struct').replace(' string', ':string')}>>")["data"]).alias("pos", "m"))
    return rows.select("m.*", "pos").where("coalesce(id, '') <> ''")


def free_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("id").endswith(":free") | ((F.col("pricing.prompt") == "0") & (F.col("pricing.completion") == "0")))


def ranked(models: DataFrame) -> DataFrame:
    """With place: by context length, the longest first, no number as 0; equal ones in the catalog's order. A range sort, whose partitions are counted."""
    length = F.coalesce(F.col("context_length").try_cast("long"), F.lit(0))
    return numbered(models, length.desc(), F.asc("pos")).withColumn("place", F.col("seq").cast("int")).drop("seq")


def default_model(models: DataFrame, fallback: str) -> str:
    """The best free model's id."""
    length = F.coalesce(F.col("context_length").try_cast("long"), F.lit(0))
    best = free_models(models).agg(F.min_by("id", F.struct(-length, "pos")).alias("id")).where("id is not null").first()
    return best.id if best else fallback


def or_curated(models: DataFrame, curated: list[tuple[str, str, str]]) -> DataFrame:
    """The catalog, or the curated rows (id, name, context_length) in their order if it is empty."""
    if not models.isEmpty():
        return models
    rows = models.sparkSession.createDataFrame([(i, n, c, None, p) for p, (i, n, c) in enumerate(curated)], f"{MODEL}, pos int")
    return rows.select(*(F.col(c).cast(models.schema[c].dataType.simpleString()).alias(c) for c in models.columns))
