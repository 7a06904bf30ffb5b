"""What the operators of this subpackage share: scratch tables, ASCII word rules, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rules: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        root = _own_dir[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again. A lost executor costs nothing that was written.

    What was shuffled to make the table is deleted as soon as it is written.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    path = scratch_path(spark, name)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the scratch table that df reads, once nothing else does."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds: rows, and bytes where this Spark has that setting, of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def named(column: str) -> Column:
    """A column by its name as it stands, whatever dots and quotes are in it."""
    quoted = column.replace("`", "``")
    return F.col(f"`{quoted}`")


def crc_mod(column: str, m: int):
    """crc32(column as text) mod m; null where the column is null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def ascii_lower(col):
    """A-Z only, unlike lower()."""
    return F.translate(col, UPPER, LOWER)


#: Keys with more rows than this and than a thousandth of all rows are joined by broadcast; there are a thousand of them at most.
HUB = 256


def meet_counted(rows: DataFrame, n: int, table: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """rows (n of them) joined with a written table of one row for each of the keys, ``count`` of which says how many rows have them.

    The table's rows of frequent keys, a thousand at most, are broadcast if there are any; the others meet in a join.
    """
    frequent = F.col(count) > max(HUB, n // 1000)
    more = [c for c in table.columns if c not in (*keys, count)]
    if table.where(frequent).isEmpty():
        return rows.join(table.drop(count), keys, how).select(*rows.columns, *more)
    hubs = table.where(frequent).select(*(F.col(k).alias(f"hub_{k}") for k in keys), F.struct(*more).alias("of_hub"))
    same = [F.col(k) == F.col(f"hub_{k}") for k in keys]
    marked = rows.join(F.broadcast(hubs), same, "left").drop(*(f"hub_{k}" for k in keys))
    few = marked.where("of_hub is null").drop("of_hub").join(table.where(~frequent).drop(count), keys, how)
    return few.select(*rows.columns, *more).unionByName(marked.where("of_hub is not null").select(*rows.columns, "of_hub.*"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links -> (id, component): every linked id with the smallest id reachable from it.

    Alternates large-star and small-star steps; each step is an aggregate, partial before its shuffle, and a join with its rows,
    which carries two ids a row: no neighbourhood is gathered, and where a hub's rows fill a partition, adaptive
    execution splits it. Each round is written to the shared folder, and the one before deleted.
    Null ids and self links are ignored; an empty input gives an empty result.
    """

    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        df = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), name)
        return df, seen.get

    e, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        both = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        old = e
        e, now = written(both.where("u <> v").distinct())
        forget(old)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
