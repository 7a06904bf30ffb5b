"""The tables of a scale-factor folder as claims, edges, elements and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ["hub", "repo", "paper"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_of(number):
    """hub, repo or paper by the remainder of three."""
    return F.element_at(F.array(*map(F.lit, SOURCES)), (F.pmod(number, F.lit(3)) + 1).cast("int"))


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event type of each user for each source: one aggregate, no window."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    ord_ = F.pmod(F.col("event_id"), F.lit(3)).cast("int")
    g = e.groupBy("user_id", ord_.alias("ord")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))
    return g.select(F.col("user_id").cast("string").alias("artifact_id"), F.lit("activity").alias("field"), source_of(F.col("ord")).alias("source"), "ord", "value")


def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ord_ = F.pmod(F.col("event_id"), F.lit(3)).cast("int")
    g = e.groupBy("user_id", "event_type", ord_.alias("ord")).agg(F.max("ts").alias("ts"))
    return g.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("artifact_id"), F.lit("seen").alias("field"), source_of(F.col("ord")).alias("source"), "ord", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("value"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edges for each part; modulo the number of parts."""
    p = table(spark, sf_dir, "part")
    n = F.lit(p.count())
    two = F.array(F.struct(F.lit(0).alias("pos"), F.pmod(F.col("p_partkey") * 7 + F.col("p_size"), n).alias("target")), F.struct(F.lit(1).alias("pos"), F.pmod(F.col("p_partkey") * 3 + 1, n).alias("target")))
    return p.select(F.col("p_partkey").alias("parent"), F.explode(two).alias("e")).select("parent", "e.pos", "e.target")


def order_detector_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written out of event claims, as a detector would write them."""
    c = event_claims(spark, sf_dir).groupBy("artifact_id").agg(F.sort_array(F.collect_list(F.struct("ord", "source", "value"))).alias("c"))
    letter = lambda o: F.char(o + 65)
    claims = F.transform("c", lambda x: F.concat(F.lit("**CLAIM_"), letter(x["ord"]), F.lit(":** "), F.when(x["value"] == "error", "No relevant information.").otherwise(F.concat(F.lit('"'), x["value"], F.lit('."')))))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["ord"] > a["ord"]), lambda b: F.concat(F.lit("CONFLICT_"), letter(a["ord"]), F.lit("_VS_"), letter(b["ord"]), F.lit(": "), F.when(a["value"] == b["value"], "No").otherwise(F.concat(F.lit("Yes: "), a["value"], F.lit(" or "), b["value"]))))))
    within = F.transform("c", lambda x: F.concat(F.lit("CONFLICT_WITHIN_"), letter(x["ord"]), F.lit(": "), F.when(F.length(x["value"]) == 4, "Yes").otherwise("No")))
    letters = F.transform("c", lambda x: F.struct(letter(x["ord"]).alias("letter"), x["source"].alias("source")))
    return c.select("artifact_id", F.array_join(F.concat(claims, within, pairs), "\n").alias("text"), letters.alias("letters"))
