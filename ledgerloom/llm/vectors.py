"""What the two vector searches share: usable vectors, shards, query blocks and merging of shard results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors of a shard, queries of a task (so that a shard's index and the queries sent with a copy of it are of one size), and
#: of those the queries that are searched at once.
SHARD, QUERIES, TOGETHER = 8192, 8192, 256
#: Widths that are sent to every executor at most; more are joined by a shuffle.
SMALL = 10_000


def usable(vectors: DataFrame, allow_zero: bool) -> DataFrame:
    """(vec_id, v array<double>, width) of rows whose id, vector and components are there and finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    if not allow_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("width", F.size("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def search(vectors: DataFrame, is_query: Column, k: int, build: Callable, probe: Callable, index: str, allow_zero: bool, score: str, waves: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): every query against every shard's index, merged.

    build(key, table) makes one row of ``index`` columns from a shard's vectors (vec_id, v); probe(index row, query ids,
    query matrix, floors) gives arrays (query position, vec_id, score) of different vec_ids for each query, in which floors
    holds a score for each query that k candidates reach already (-inf at first). Shards are dealt by a hash of vec_id, so
    equal vectors spread evenly and rows of one vec_id meet; queries go through them in blocks. With ``waves``, 1, 3, 12,
    48 ... shards of each width are searched one lot after the other, and what a lot found is the floor of the next.
    Only vectors of a query's own width are compared with it. A candidate of the query's own vec_id is left out.
    """
    rows = materialise(usable(vectors, allow_zero), "vectors")
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    widths = materialise(widths.withColumns({"shards": F.ceil(F.col("n") / SHARD).cast("int"), "blocks": F.ceil(F.col("q") / QUERIES).cast("int")}), "widths")
    few, most = widths.agg(F.count("*"), F.max("shards")).first()
    of_width = F.broadcast(widths) if few <= SMALL else widths
    dealt = rows.join(of_width, "width")
    of_shard = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    indexed = materialise(of_shard.where("q > 0").groupBy("width", "shard").applyInArrow(lambda key, t: build(key, t), f"width int, shard int, {index}"), "index")
    queries = dealt.where(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).cast("int")).select("vec_id", "v", "width", "shards", "block")
    names, kind = ["query_id", "vec_id", "score"], pa.int64() if score == "long" else pa.float64()

    def run(key, shard: pa.Table, q: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), kind)], names=names)]
        row = shard.to_pylist()[0] if shard.num_rows and q.num_rows else None
        for lo in range(0, q.num_rows if row else 0, TOGETHER):
            part = q.slice(lo, TOGETHER)
            ids = part.column("vec_id").to_numpy()
            at, found, scores = probe(row, ids, matrix(part.column("v")), part.column("floor").to_numpy())
            out.append(pa.table([pa.array(ids[at]), pa.array(found, pa.int64()), pa.array(scores, kind)], names=names))
        return pa.concat_tables(out)

    on = ["width", "shard", "block"]
    blocks = of_width.where("blocks > 0").select("width", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")) if few > SMALL else None

    def pass_over(q: DataFrame, first: int, end: int) -> DataFrame:
        """q is sent to each of the shards from first on; a shard's index row is sent to each block of queries."""
        last = F.least(F.col("shards"), F.lit(end)) - 1
        spread = q.where(F.col("shards") > first).select("vec_id", "v", "width", "block", "floor", F.explode(F.sequence(F.lit(first), last)).alias("shard"))
        of = indexed.where((F.col("shard") >= first) & (F.col("shard") < end))
        of = of.join(blocks, "width") if blocks else of.join(of_width.select("width", "blocks"), "width").where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return of.groupBy(*on).cogroup(spread.groupBy(*on)).applyInArrow(run, f"query_id long, vec_id long, score {score}")

    def best(found: DataFrame) -> DataFrame:
        """Rows of a repeated query id are one query, which takes each candidate at its best."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    first, end, found = 0, 1 if waves else max(1, most or 1), None
    while True:
        # A repeated id's rows share no floor: one's kth score says nothing of the other's.
        q = queries.withColumn("floor", none)
        if found is not None:
            once = queries.groupBy("vec_id").agg(F.count("*").alias("n")).where("n = 1").select("vec_id")
            floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")).join(once, "vec_id", "left_semi")
            q = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
        now = pass_over(q, first, end)
        found = best(now if found is None else found.select("query_id", "vec_id", "score").unionByName(now))
        first, end = end, 4 * end
        if first >= (most or 1):
            return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found = materialise(found, "found")
