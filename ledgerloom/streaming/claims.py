"""Claims that arrive as a stream: the newest of each source, resolved as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.resolve import KEYS, resolve

LOG = "artifact_id string, field string, source string, ord int, value string, ts timestamp, batch long, bucket int"
RESOLVED = "artifact_id string, field string, value string, source string, conflict string, batch long"

#: Folders of a batch's claims, by a hash of artifact and field.
BUCKETS = 64


def newest(claims: DataFrame) -> DataFrame:
    """claims (artifact_id, field, source, ord, value, ts) -> the newest claim of each source; of equal times the largest value."""
    return claims.groupBy(*KEYS, "source", "ord").agg(F.max(F.struct("ts", "value")).alias("n")).select(*KEYS, "source", "ord", "n.value", "n.ts")


def resolve_stream(claims: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write what each batch of a stream changes: its newest claims to ``sink``/claims, and the fields they touch, resolved again, to
    ``sink``/resolved, both under the batch's number.

    The stream itself has no state: what came before is in the log of claims, of which a batch reads the buckets that it
    touches alone. A repeated batch replaces what it wrote. ``current`` gives the table as it stands.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = newest(batch).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/claims/batch={number}")
        log = spark.read.schema(LOG).parquet(f"{sink}/claims").where(F.col("batch") <= number)
        own = [r.bucket for r in log.where(F.col("batch") == number).select("bucket").distinct().collect()]
        log = log.where(F.col("bucket").isin(own))
        touched = log.where(F.col("batch") == number).select(*KEYS).distinct()
        so_far = newest(log.join(touched, list(KEYS), "left_semi"))
        resolve(so_far.select(*KEYS, "source", "ord", "value")).write.mode("overwrite").parquet(f"{sink}/resolved/batch={number}")

    writer = claims.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """Each field as the last batch that touched it left it."""
    rows = spark.read.schema(RESOLVED).parquet(f"{sink}/resolved")
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct("value", "source", "conflict"), "batch").alias("r")).select(*KEYS, "r.*")
