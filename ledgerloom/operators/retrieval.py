"""Hybrid retrieval: exact vector search and BM25 within each corpus, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.functions.text import useful

from .scratch import fresh_path, stored

# Candidates of each ranker and source, chunks of a question, the constant of rank fusion, BM25's parameters.
CANDIDATES, FINAL, RRF_K = 20, 10, 60
K1, B, FLOOR = 1.5, 0.75, 0.25
#: Vectors of a shard, and queries of a block, about.
SHARD, QUERIES = 8192, 256
#: Ids of an array of a class, and pairs that a task returns, about.
IDS, PAIRS = 512, 4_000_000


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def dense_top(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, on: tuple[str, ...] = ()) -> DataFrame:
    """queries (query_id, *on, embedding), vectors (*on, doc_id, embedding) -> (query_id, *on, doc_id, rank, score).

    Queries meet the vectors of their own corpus (``on``), or all vectors without one. Scores are rounded before
    ranking, ties go to smaller ids.
    """
    if on:
        q = queries.select("query_id", *on, F.col("embedding").alias("q"))
        v = vectors.select(*on, "doc_id", "embedding")
        scored = v.join(q, list(on)).select("query_id", *on, "doc_id", F.round(l2_distance(F.col("q"), F.col("embedding")), 6).alias("score"))
    else:
        scored = _nearest_of_shards(queries, vectors, k).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    w = Window.partitionBy("query_id", *on).orderBy("score", "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest_of_shards(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): of every shard of vectors, each query's k nearest and those that may tie with them once rounded.

    Every query meets every vector: blocks of queries are sent to all shards, and the shards to all blocks, so a task
    holds one of each. Null vectors, null components and vectors of another length than the query's have no distance.
    """
    q, v = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")), vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("v"))
    q, v = (x.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull())).withColumn("width", F.size("v")) for x in (q, v))
    blocks, shards = (max(1, -(-x.count() // n)) for x, n in ((q, QUERIES), (v, SHARD)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    held = v.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("block", each(blocks))
    kinds = [to_arrow_type(q.schema["query_id"].dataType), to_arrow_type(v.schema["doc_id"].dataType), pa.float64()]
    names = ["query_id", "doc_id", "score"]

    def run(of_q: pa.Table, of_v: pa.Table) -> pa.Table:
        if not of_q.num_rows or not of_v.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        a, b = (x.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1) for x in (of_q, of_v))
        at, found, scores = [], [], []
        for i, x in enumerate(a):
            # Components are added one after the other, as l2_distance does.
            squares = np.zeros(len(b))
            for j in range(b.shape[1]):
                squares += (x[j] - b[:, j]) ** 2
            d = np.sqrt(squares)
            kth = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
            near = np.flatnonzero(~(d > kth + 2e-6))
            at.append(np.full(len(near), i))
            found.append(near)
            scores.append(d[near])
        ids = of_q.column("query_id").take(pa.array(np.concatenate(at))), of_v.column("doc_id").take(pa.array(np.concatenate(found)))
        return pa.table([*ids, pa.array(np.concatenate(scores))], names=names)

    key = ["width", "shard", "block"]
    kind = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {v.schema['doc_id'].dataType.simpleString()}, score double"
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, kind)


def bm25(queries: DataFrame, docs: DataFrame, on: tuple[str, ...] = (), floor: bool = True) -> DataFrame:
    """queries (query_id, *on, terms array), docs (*on, doc_id, text) -> (query_id, *on, doc_id, score) of documents with a term.

    Statistics are those of each corpus (``on``); a repeated query term counts again. With ``floor``, a negative
    weight becomes a share of the corpus's mean weight. Only terms of queries are kept of the documents, before any shuffle.
    """
    keys = list(on)
    sized = docs.select(*on, "doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).select(*on, "doc_id", "t", F.size("t").alias("length"))
    stats = sized.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = queries.select("query_id", *on, F.explode("terms").alias("term")).groupBy("query_id", *on, "term").agg(F.count("*").alias("times"))
    words = sized.select(*on, "doc_id", "length", F.explode("t").alias("term"))
    if floor:
        # A document's word counts once, so counting is partial before the shuffle.
        df_all = sized.select(*on, F.explode(F.array_distinct("t")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("df"))
        with_n = df_all.join(stats, keys) if keys else df_all.crossJoin(F.broadcast(stats))
        raw = with_n.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean_idf = raw.groupBy(*keys).agg(F.avg("idf").alias("mean_idf"))
    tf = words.join(asked.select(*on, "term").distinct(), [*keys, "term"], "left_semi").groupBy(*keys, "doc_id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    both = tf.join(df, [*keys, "term"]).join(asked, [*keys, "term"])
    both = both.join(stats, keys) if keys else both.crossJoin(F.broadcast(stats))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    if floor:
        both = both.join(mean_idf, keys) if keys else both.crossJoin(F.broadcast(mean_idf))
        idf = F.when(idf < 0, F.col("mean_idf") * FLOOR).otherwise(idf)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return both.groupBy("query_id", *on, "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_top(queries: DataFrame, docs: DataFrame, k: int = CANDIDATES, on: tuple[str, ...] = (), floor: bool = True) -> DataFrame:
    """The k best of ``bm25`` with ranks; in a corpus (``on``), documents without a term score 0 and fill up by id. Without corpora only
    documents with a term are ranked."""
    scored = bm25(queries, docs, on, floor)
    w = Window.partitionBy("query_id", *on).orderBy(F.desc("score"), "doc_id")
    if on:
        # As many others as there are ranks could fill up; the lowest ids of those are enough.
        keys = ["query_id", *on]
        corpus = docs.select(*on, "doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
        least = Window.partitionBy(*keys).orderBy("doc_id")
        zero = corpus.join(queries.select(*keys, "terms"), list(on)).where(~F.arrays_overlap("t", "terms")).select(*keys, "doc_id")
        zero = zero.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k).select(*keys, "doc_id", F.lit(0.0).alias("score"))
        scored = scored.unionByName(zero)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], keys: tuple[str, ...], k: int = RRF_K) -> DataFrame:
    """Rankings (*keys, doc_id, rank) from 1 -> (*keys, doc_id, rrf, fused_pos): the sum of 1 / (k + rank).

    fused_pos orders as the rankings one after the other do: the first ranking's documents, then the others' own.
    """
    out = None
    for i, r in enumerate(rankings):
        one = r.select(*keys, "doc_id", "rank", F.lit(i).alias("ranking"))
        out = one if out is None else out.unionByName(one)
    pos = F.min(F.struct("ranking", "rank"))
    fused = out.groupBy(*keys, "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("rrf"), pos.alias("pos"))
    return fused.select(*keys, "doc_id", "rrf", (F.col("pos.ranking") * 1_000_000 + F.col("pos.rank")).alias("fused_pos"))


def retrieve(questions: DataFrame, chunks: DataFrame, source_order: DataFrame, sparse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best chunks of each question over all sources.

    questions (artifact_id, field, embedding, terms), chunks (artifact_id, source, chunk_index, text, embedding),
    source_order (field, source, ord). Both rankers see all chunks of an artifact's source; chunks that say nothing go
    only after ranking; ties go by source order, then fused position. ``sparse`` ranks (query_id, artifact_id, source, terms) by an
    index of the chunks that was built before; without it their words are counted here.
    """
    key = F.struct("artifact_id", "field")
    q = questions.select(key.alias("query_id"), "artifact_id", "embedding", "terms")
    docs = chunks.withColumnRenamed("chunk_index", "doc_id")
    sources = docs.select("artifact_id", "source").distinct()
    asked = q.join(sources, "artifact_id")
    on = ("artifact_id", "source")
    fused = fuse([dense_top(asked, docs, on=on), sparse(asked) if sparse else bm25_top(asked, docs, on=on)], ("query_id", *on))
    rows = fused.join(docs.select(*on, "doc_id", "text"), [*on, "doc_id"]).where(useful(F.col("text")))
    rows = rows.withColumn("field", F.col("query_id.field")).join(source_order.select("field", "source", "ord"), ["field", "source"], "left")
    w = Window.partitionBy("artifact_id", "field").orderBy(F.desc("rrf"), F.coalesce("ord", F.lit(99)), "source", "fused_pos", "doc_id")
    best = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= FINAL)
    return best.select("artifact_id", "field", "source", F.col("doc_id").alias("chunk_index"), "text", "rrf", "rank")


def sources_used(ranked: DataFrame) -> DataFrame:
    """(artifact_id, field, sources, counts) of retrieved chunks: sources by first appearance, and chunks of each."""
    each = ranked.groupBy("artifact_id", "field", "source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("first", "source", "n")))
    g = each.groupBy("artifact_id", "field").agg(rows.alias("s"))
    return g.select("artifact_id", "field", F.transform("s", lambda x: x["source"]).alias("sources"), F.map_from_arrays(F.transform("s", lambda x: x["source"]), F.transform("s", lambda x: x["n"])).alias("counts"))


def similar_sets(sets: DataFrame, least: float, on: tuple[str, ...] = ()) -> DataFrame:
    """sets (*on, id, tokens) -> (*on, a, b, similarity) of all pairs a < b of a group with a Jaccard similarity of ``least`` (above 0) at least.

    Ids are unique. Equal sets of a group are one class, and only classes are compared: in the order from the rarest token of a group's classes, two such
    sets of n tokens share one of the first n - ceil(least * n) + 1 of each; only pairs that meet there are verified. Ids of a class lie in arrays of
    bounded size, two of which meet in a row for each pair of similar classes, so pairs of ids are first made where they are returned. Empty and null sets have no pairs.
    """
    spark = sets.sparkSession
    distinct = sets.select(*on, "id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).where(F.exists("tokens", lambda x: x.isNotNull()) & F.col("id").isNotNull())
    for c in on:
        distinct = distinct.where(F.col(c).isNotNull())
    classes = distinct.groupBy(*on, "tokens").agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id())
    classes = stored(classes.withColumn("blocks", F.ceil(F.col("n") / IDS).cast("int")), fresh_path(spark, "classes"))
    each = classes.select(*on, "node", F.explode("tokens").alias("token"))
    often = each.groupBy(*on, "token").agg(F.count("*").alias("often"))
    ordered = each.join(often, [*on, "token"]).groupBy(*on, "node").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("t"))
    # A little is taken off so that rounding up never shortens a prefix.
    size = F.size("t")
    prefix = size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1
    posted = ordered.select(*on, "node", size.alias("size"), F.explode(F.slice("t", F.lit(1), prefix)).alias("p")).select(*on, "node", "size", F.col("p.token").alias("token"))
    a, b = (posted.select(*on, "token", F.col("node").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    met = a.join(b, [*on, "token"]).where("a < b").where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(least) - 1e-9).select("a", "b").distinct()
    ta, tb = (classes.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("blocks").alias(f"blocks_{x}")) for x in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    near = met.join(ta, "a").join(tb.join(classes.select(F.col("node").alias("b"), *on), "b"), "b").withColumn("similarity", both / (F.size("ta") + F.size("tb") - both)).where(F.col("similarity") >= least)
    same = classes.where("n > 1").select(*on, F.col("node").alias("a"), F.col("node").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"), F.col("blocks").alias("blocks_a"), F.col("blocks").alias("blocks_b"), F.lit(1.0).alias("similarity"))
    near = stored(near.select(*same.columns).unionByName(same.where(F.lit(least <= 1))), fresh_path(spark, "near"))

    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    ids = distinct.join(classes, [*on, "tokens"]).groupBy("node", block.alias("block")).agg(F.collect_list("id").alias("ids"))
    ids = stored(ids, fresh_path(spark, "ids"))
    each = near.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    each = each.where("a <> b or block_a <= block_b").select(*on, "a", "block_a", "b", "block_b", "similarity")
    for x in "ab":
        each = each.join(ids.select(F.col("node").alias(x), F.col("block").alias(f"block_{x}"), F.col("ids").alias(f"ids_{x}")), [x, f"block_{x}"])
    # Rows of arrays are few for the pairs that they hold, so they are dealt out by these.
    made = near.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0
    dealt = each.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), made // PAIRS), "a", "block_a", "b", "block_b")
    pairs = dealt.select(*on, F.col("a").alias("class_a"), F.col("b").alias("class_b"), "block_a", "block_b", "ids_b", "similarity", F.explode("ids_a").alias("x"))
    pairs = pairs.select(*on, "class_a", "class_b", "block_a", "block_b", "similarity", "x", F.explode("ids_b").alias("y")).where("x < y or (x > y and (class_a <> class_b or block_a <> block_b))")
    return pairs.select(*on, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
