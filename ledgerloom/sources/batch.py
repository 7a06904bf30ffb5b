"""Batches of artifacts from CSV files: reading, resuming and writing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import missing_to_null
from ledgerloom.operators.graph import numbered

# Columns that tell the kind of a batch, and what empty cells say.
AI_COLUMNS, DATA_COLUMNS = ["autonomyType", "typeOfModel", "trainedOnDatasets"], ["datasetType", "datasetSize", "dataCollectionProcess"]
NOT_FOUND, NO_SOURCE = "Not found", "N/A"


def batch_kind(columns: Sequence[str]) -> str | None:
    """ai or data, by columns that only one kind has; None if neither or both have some."""
    ai, data = (any(c in columns for c in own) for own in (AI_COLUMNS, DATA_COLUMNS))
    return "ai" if ai and not data else "data" if data and not ai else None


def read_batch(spark: SparkSession, path: str, start_row: int = 1, limit: int | None = None) -> DataFrame:
    """A CSV file's rows with row_index from 1 in the file's order, which is that of its partitions."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("__id", F.monotonically_increasing_id())
    placed = numbered(rows, "__id").withColumn("row_index", F.col("seq").cast("int")).drop("__id", "seq").where(F.col("row_index") >= start_row)
    return placed if limit is None else placed.where(F.col("row_index") < start_row + limit)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows that no successful row of the checkpoint (key, status) has; failed ones come again."""
    return rows.join(done.where("status = 'ok'").select(key), key, "left_anti")


_ROWS = "row_index long, status string, payload string"
_COMMIT = "number long, run_key string, first long, last long, part string"


def write_part(results: DataFrame, path: str) -> str:
    """Rows as a folder of their own, which no reader knows of before it is committed; its name."""
    part = uuid.uuid4().hex
    results.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in _ROWS.split(", "))).write.parquet(f"{path}/parts/{part}")
    return part


def commit_part(spark: SparkSession, path: str, run_key: str, rows: tuple[int, int], part: str) -> None:
    """One line in the log: from now on the part holds rows first to last of the run, whatever was committed for them before.

    The line is written beside the log and moved into it as a whole under the next number; commits are made by one driver at a time.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    log, conf = hadoop.Path(f"{path}/log"), spark._jsc.hadoopConfiguration()
    files = log.getFileSystem(conf)
    files.mkdirs(log)
    taken = [int(s.getPath().getName().split(".")[0]) for s in files.listStatus(log) if s.getPath().getName().endswith(".json")]
    number = max(taken, default=0) + 1
    line = json.dumps({"number": number, "run_key": run_key, "first": rows[0], "last": rows[1], "part": part}) + "\n"
    beside, at = hadoop.Path(f"{path}/{part}.commit"), hadoop.Path(f"{path}/log/{number:012d}.json")
    out = files.create(beside, True)
    out.write(bytearray(line.encode()))
    out.close()
    if files.exists(at) or not files.rename(beside, at):
        raise RuntimeError(f"commit {number} was made by somebody else")


def append_checkpoint(results: DataFrame, path: str, run_key: str, rows: tuple[int, int] | None = None) -> None:
    """results (row_index, status, payload) of a batch of one run, which take the place of all that the run has in ``rows`` (of the
    smallest to the largest row_index, if it isn't given): so a batch that is repeated doesn't double its rows. A failure at any time leaves the
    checkpoint as it was or as it should be; other runs' rows stay."""
    spark, part = results.sparkSession, write_part(results, path)
    if rows is None:
        own = spark.read.schema(_ROWS).parquet(f"{path}/parts/{part}").agg(F.min("row_index"), F.max("row_index")).first()
        if own[0] is None:
            return
        rows = (own[0], own[1])
    commit_part(spark, path, run_key, rows, part)


def read_checkpoint(spark: SparkSession, path: str, run_key: str) -> DataFrame:
    """(row_index, status, payload, run_key) of a run as its commits say: each row from the last commit whose rows it is among.

    The log alone says which parts count. From the bounds of the run's commits come intervals, each of one part; rows meet the
    intervals of their own part, so no row is compared with all commits.
    """
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return spark.createDataFrame([], f"{_ROWS}, run_key string")
    commits = spark.read.schema(_COMMIT).json(f"{path}/log").where(F.col("run_key") == run_key)
    bounds = commits.select(F.explode(F.array("first", F.col("last") + 1)).alias("lo")).distinct()
    spans = bounds.withColumn("hi", F.lead("lo").over(Window.orderBy("lo")) - 1).where("hi is not null")  # a log is a small table
    held = spans.join(commits, (F.col("first") <= F.col("lo")) & (F.col("hi") <= F.col("last"))).groupBy("lo", "hi").agg(F.max_by("part", "number").alias("part"))
    parts = [r.part for r in held.select("part").distinct().collect()]
    if not parts:
        return spark.createDataFrame([], f"{_ROWS}, run_key string")
    rows = spark.read.schema(_ROWS).parquet(*(f"{path}/parts/{p}" for p in parts))
    rows = rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"/parts/([0-9a-f]+)/", 1))
    live = rows.join(held, (rows["part"] == held["part"]) & F.col("row_index").between(F.col("lo"), F.col("hi")))
    return live.select("row_index", "status", "payload", F.lit(run_key).alias("run_key"))


def write_documents(documents: DataFrame, path: str) -> None:
    """documents (kind, json) as text, one folder for each kind."""
    documents.select("kind", F.col("json").alias("value")).write.partitionBy("kind").text(path)


def write_combined(documents: DataFrame, path: str) -> None:
    """documents (kind, artifact_id, json) as one JSON array for each kind: its folder's files, one after the other by name, are the array, by
    artifact. Each document is a line; the first begins the array, the last ends it, so no task holds a kind."""
    placed = numbered(documents.select("kind", "artifact_id", "json"), "kind", "artifact_id", "json")
    ends = placed.groupBy("kind").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    line = F.concat(F.when(F.col("seq") == F.col("first"), "[").otherwise(","), "json", F.when(F.col("seq") == F.col("last"), "]").otherwise(""))
    rows = placed.join(F.broadcast(ends), "kind").select("kind", "seq", line.alias("value"))  # there are two kinds
    rows.repartitionByRange("kind", "seq").sortWithinPartitions("kind", "seq").select("kind", "value").write.partitionBy("kind").text(path)


def batch_records(bom_fields: DataFrame, kind: str) -> DataFrame:
    """(artifact_id, record): kind, number of filled fields and the fields by section, as a batch reports them."""
    one = F.struct("field", F.struct("value", "source", F.col("conflict.value").alias("conflict")))
    sections = bom_fields.groupBy("artifact_id", "section").agg(F.map_from_entries(F.sort_array(F.collect_list(one))).alias("fields"), F.count_if(missing_to_null(F.col("value")).isNotNull()).alias("filled"))
    whole = sections.groupBy("artifact_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "fields"))).alias("sections"), F.sum("filled").alias("filled"))
    return whole.select("artifact_id", F.struct(F.lit(kind).alias("kind"), F.lit("ok").alias("status"), "filled", "sections").alias("record"))


def csv_row(wide: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A wide view with <field> and <field>_sources in order, and words in empty cells."""
    cells = [F.coalesce(missing_to_null(F.col(f)), F.lit(NOT_FOUND)).alias(f) for f in fields]
    named = [F.coalesce(missing_to_null(F.col(f"{f}_source")), F.lit(NO_SOURCE)).alias(f"{f}_sources") for f in fields]
    return wide.select("artifact_id", *(c for pair in zip(cells, named) for c in pair))


def write_csv(wide: DataFrame, fields: Sequence[str], path: str) -> None:
    csv_row(wide, fields).write.option("header", True).csv(path)
