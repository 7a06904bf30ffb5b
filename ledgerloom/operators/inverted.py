"""A written inverted index for BM25: built once, then read by the terms of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import B, CANDIDATES, FLOOR, K1
from .scratch import discard, stored

#: Levels of weight in a unit, postings of a row at most, folders of postings, and the lowest ids that a corpus keeps at hand.
LEVELS, BLOCK, BUCKETS, AT_HAND = 20, 128, 64, 1000
#: Postings of a term that a task holds at once; fewer aren't told apart by level.
FEW = 32
#: Bytes of texts that a task turns into postings at once, about.
AT_ONCE = 24 << 20
#: Terms that are given to the scan by name; with more of them their folders are.
NAMED = 1000
#: What rounding scores to six digits can move.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Where an index lies, and the columns that tell its corpora apart.

    ``corpora`` (*on, n, mean, mean_idf, first_ids), ``terms`` (bucket, *on, term, df, levels), ``postings`` (bucket, *on, term, level,
    doc_ids, weights) and ``documents`` (*on, doc_id). A posting's weight is what BM25 makes of its frequency and of its document's
    length; a level is a twentieth of that. A row's level is the least of its postings', and ``levels`` holds the number and the largest weight of the postings in each level's rows.
    """

    path: str
    on: tuple[str, ...] = ()

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name != "postings":
            return spark.read.parquet(f"{self.path}/{name}")
        # Its schema is told, as folders of an empty index hold no file to read it from.
        known = self.table(spark, "documents")
        posting = known.select(*self.on, F.lit("").alias("term"), F.lit(0).alias("level"), F.array("doc_id").alias("doc_ids"), F.array(F.lit(0.0)).alias("weights"), F.lit(0).alias("bucket"))
        return spark.read.schema(posting.schema).parquet(f"{self.path}/{name}")


def _bucket(term):
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def _with_corpus(rows: DataFrame, corpora: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """One row of corpora is broadcast where there is one corpus only."""
    return rows.join(corpora, list(on)) if on else rows.crossJoin(F.broadcast(corpora))


def _posted(keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(*keys, doc_id, mean, text of small letters in bytes) -> (*keys, term, level, n, top, doc_ids, weights): postings of what a task holds at once, by
    term and level, BLOCK to a row at most. ``mean`` is the corpus's mean length."""

    def post(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, often, each, lengths = [], [], [], []
        for text in table.column(keys + 2).to_pylist():
            words = text.split()  # of bytes: at ASCII white space, as Spark's \s
            counts = Counter(words)
            terms.extend(counts)
            often.extend(counts.values())
            each.append(len(counts))
            lengths.append(len(words))
        if not terms:
            return
        named = pa.array(terms, pa.binary()).dictionary_encode()
        row, tf, code = np.repeat(np.arange(len(each)), each), np.array(often), named.indices.to_numpy()
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.array(lengths)[row] / table.column(keys + 1).to_numpy()[row]))
        level = np.floor(weight * LEVELS).astype(np.int32)
        corpus = np.zeros(len(each), dtype=np.int64)
        for k in range(keys):
            own = table.column(k).combine_chunks().dictionary_encode()
            corpus = np.unique(corpus * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
        corpus = corpus[row]
        order = np.lexsort((level, code, corpus))
        row, code, level, corpus, weight = row[order], code[order], level[order], corpus[order], weight[order]
        new = np.concatenate(([True], (code[1:] != code[:-1]) | (corpus[1:] != corpus[:-1])))
        # A term's few postings stay together, at the lowest of their levels.
        many = np.diff(np.append(np.flatnonzero(new), len(row)))[np.cumsum(new) - 1] >= FEW
        new[1:] |= many[1:] & (level[1:] != level[:-1])
        begun = np.flatnonzero(new)
        starts = np.flatnonzero((np.arange(len(row)) - begun[np.cumsum(new) - 1]) % BLOCK == 0)
        ends = pa.array(np.append(starts, len(row)).astype(np.int32))
        own = table.select(range(keys)).take(pa.array(row[starts])) if keys else table
        columns = [own.column(k).combine_chunks() for k in range(keys)]
        columns += [named.dictionary.take(pa.array(code[starts])).cast(pa.string()), pa.array(level[starts]), pa.array(np.diff(ends.to_numpy()).astype(np.int64)), pa.array(np.maximum.reduceat(weight, starts))]
        columns += [pa.ListArray.from_arrays(ends, table.column(keys).combine_chunks().take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(weight))]
        out = pa.RecordBatch.from_arrays(columns, [*table.column_names[:keys], "term", "level", "n", "top", "doc_ids", "weights"])
        for at in range(0, out.num_rows, 50_000):
            yield out.slice(at, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) >= AT_ONCE:
                yield from post(held)
                held = []
        if held:
            yield from post(held)

    return run


def build_index(docs: DataFrame, path: str, on: tuple[str, ...] = ()) -> Index:
    """Index docs (*on, doc_id, text) under ``path``; ids are unique in a corpus.

    A task turns its own documents into postings by term and level, some 128 to a row at most, so what is moved is few rows and a stop word of a huge corpus is
    no large group; nothing is sorted within a term. Null texts are documents without words; a null corpus is no corpus.
    """
    spark, keys, index = docs.sparkSession, list(on), Index(path.rstrip("/"), on)
    docs = docs.dropna(subset=keys) if keys else docs
    text = F.coalesce("text", F.lit(""))
    sizes = stored(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(text, F.lit(r"\S+"))).alias("mean")), f"{path}/_sizes")
    given = _with_corpus(docs.select(*keys, "doc_id", F.lower(text).cast("binary").alias("text")), sizes.drop("n"), on).select(*keys, "doc_id", "mean", "text")
    schema = docs.select(*keys, F.lit("").alias("term"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("top"), F.array("doc_id").alias("doc_ids"), F.array(F.lit(0.0)).alias("weights")).schema
    parts = stored(given.mapInArrow(_posted(len(keys)), schema), f"{path}/_parts")

    parts = parts.select(_bucket(F.col("term")).alias("bucket"), "*")

    # One shuffle brings a term's rows together for both sums and the order.
    levels = parts.select("bucket", *keys, "term", "level", "n", "top").repartitionByRange("bucket", "term").groupBy("bucket", *keys, "term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    of_term = levels.groupBy("bucket", *keys, "term").agg(F.sum("n").alias("df"), F.sort_array(F.collect_list(F.struct("level", "n", "top")), asc=False).alias("levels"))
    terms = stored(of_term.sortWithinPartitions("bucket", "term"), f"{path}/terms")
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    means = _with_corpus(terms, sizes, on).groupBy(*keys).agg(F.avg(idf).alias("mean_idf"))

    lowest = Window.partitionBy(*keys).orderBy("doc_id")
    first = docs.select(*keys, "doc_id").withColumn("nth", F.row_number().over(lowest)).where(F.col("nth") <= AT_HAND)
    first = first.groupBy(*keys).agg(F.sort_array(F.collect_list("doc_id")).alias("first_ids"))
    corpora = sizes.join(means, keys, "left").join(first, keys, "left") if keys else sizes.crossJoin(F.broadcast(means)).crossJoin(F.broadcast(first))
    corpora.write.parquet(f"{path}/corpora")
    docs.select(*keys, "doc_id").write.parquet(f"{path}/documents")

    placed = parts.select("bucket", *keys, "term", "level", "doc_ids", "weights").repartitionByRange("bucket", "term", "level").sortWithinPartitions("bucket", "term", "level")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    for name in ("_sizes", "_parts"):
        discard(spark, f"{path}/{name}")
    return index


def _needed_levels(index: Index, asked: DataFrame, k: int, floor: bool) -> tuple[DataFrame, list]:
    """(query_id, *on, term, level, factor, pruned) of the levels that may hold one of the k best, and what tells the scan of them.

    The k-th largest weight of a term, by its levels, is a sure score of k documents. A level is left out if its largest weight
    and the largest of all other terms stay below the largest sure score; so no document that has a posting in it can be one of
    the k best. Where nothing above 0 is sure, all levels are read.
    """
    spark, keys = asked.sparkSession, list(index.on)
    buckets = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
    named = [r[0] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
    hints = [F.col("bucket").isin(buckets), *([F.col("term").isin(named)] if len(named) <= NAMED else [])]
    terms = index.table(spark, "terms")
    for hint in hints:
        terms = terms.where(hint)
    met = _with_corpus(terms.drop("bucket").join(asked, [*keys, "term"]), index.table(spark, "corpora").drop("first_ids", "mean"), index.on)
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = F.when(idf < 0, F.col("mean_idf") * FLOOR).otherwise(idf) if floor else idf
    met = met.withColumn("factor", F.col("times") * idf)
    largest = F.array_max(F.transform("levels", lambda x: x["top"]))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at"))
    reached = F.aggregate("levels", start, lambda s, x: F.when(s["seen"] >= k, s).otherwise(F.struct((s["seen"] + x["n"]).alias("seen"), x["level"].alias("at"))))
    sure = F.when((F.col("factor") > 0) & (F.col("df") >= k), F.col("factor") * reached["at"] / LEVELS)
    met = met.withColumns({"most": F.greatest(F.col("factor") * largest, F.lit(0.0)), "least": F.least(F.col("factor") * largest, F.lit(0.0)), "sure": sure})
    of_query = Window.partitionBy("query_id", *keys)
    bound = F.max("sure").over(of_query) + F.sum("least").over(of_query) - SLACK
    met = met.withColumns({"bound": F.when(bound > SLACK, bound), "others": F.sum("most").over(of_query) - F.col("most")})
    kept = F.filter("levels", lambda x: F.col("bound").isNull() | (F.greatest(F.col("factor") * x["top"], F.lit(0.0)) + F.col("others") >= F.col("bound")))
    each = met.select("query_id", *keys, "term", "factor", F.col("bound").isNotNull().alias("pruned"), F.explode(kept).alias("l"))
    return each.select("query_id", *keys, "term", F.col("l.level").alias("level"), "factor", "pruned"), hints


def bm25_from_index(index: Index, queries: DataFrame, k: int = CANDIDATES, floor: bool = True) -> DataFrame:
    """queries (query_id, *on, terms array) -> (query_id, *on, doc_id, score, rank): the k best, as ``bm25_top`` ranks them.

    Only postings of the queries' terms are read, and of those only levels that may hold one of the k best. In a corpus (``on``) documents
    without a term score 0 and fill up by id; without corpora they aren't ranked.
    """
    spark, keys = queries.sparkSession, list(index.on)
    asked = queries.select("query_id", *keys, F.explode("terms").alias("term")).groupBy("query_id", *keys, "term").agg(F.count(F.lit(1)).alias("times"))
    levels, hints = _needed_levels(index, asked, k, floor)
    postings = index.table(spark, "postings")
    for hint in hints:
        postings = postings.where(hint)
    parts = postings.drop("bucket").join(levels, [*keys, "term", "level"]).select("query_id", *keys, "factor", "pruned", F.explode(F.arrays_zip("doc_ids", "weights")).alias("d"))
    hits = parts.groupBy("query_id", *keys, F.col("d.doc_ids").alias("doc_id")).agg(F.round(F.sum(F.col("factor") * F.col("d.weights")), 6).alias("score"), F.first("pruned").alias("pruned"))
    scored = hits.drop("pruned")
    by_score = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "doc_id")
    if keys:
        # Where something above 0 is sure of k documents, others can't be among them; elsewhere all hits are there.
        of_query = ["query_id", *keys]
        found = hits.groupBy(*of_query).agg(F.count(F.lit(1)).alias("hits"), F.bool_or("pruned").alias("pruned"))
        open_ = queries.select(*of_query).distinct().join(found, of_query, "left").where("not coalesce(pruned, false)")
        open_ = open_.join(index.table(spark, "corpora").select(*keys, "n", "first_ids"), keys)
        enough = (F.size("first_ids") >= k + F.coalesce("hits", F.lit(0))) | (F.size("first_ids") == F.col("n"))
        near = open_.where(enough).select(*of_query, F.explode("first_ids").alias("doc_id"))
        far = open_.where(~enough).select(*of_query).join(index.table(spark, "documents"), keys)
        rest = near.unionByName(far).join(hits.select(*of_query, "doc_id"), [*of_query, "doc_id"], "left_anti")
        rest = rest.withColumn("nth", F.row_number().over(Window.partitionBy(*of_query).orderBy("doc_id"))).where(F.col("nth") <= k)
        scored = scored.unionByName(rest.select(*of_query, "doc_id", F.lit(0.0).alias("score")))
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
