"""Names searched by the trigrams that they share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_path, stored

#: Trigrams are counted by hash in so many places, so what a task knows of them is bounded.
PLACES = 1 << 16
#: How many trigrams at once bring two names together, where either side may lack so many of what it is looked up by.
TOGETHER = ((3, 3), (2, 8), (1, None))
#: Where names begin to be compared: runs (start, length) of a name's trigrams from the rarest.
RUNS = ((0, 2), (0, 4), (0, 8), (2, 4), (4, 4))


def trigrams(name: Column) -> Column:
    """The distinct runs of three letters of a name with two spaces before and one behind it."""
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def _rarest_first(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(kind, name, more, g) -> (kind, name, more, size, o, low, high): hashes g of trigrams from the rarest, without those that surely no name has, and 128 bits of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(3)
            sizes, flat = g.value_lengths().to_numpy(zero_copy_only=False), g.flatten().to_numpy(zero_copy_only=False)
            row, often = np.repeat(np.arange(len(sizes)), sizes), counts[flat & (PLACES - 1)]
            order = np.lexsort((flat, often, row))
            order = order[often[order] > 0]
            row, flat = row[order], flat[order]
            bits = np.zeros((2, len(sizes)), dtype=np.int64)
            np.bitwise_or.at(bits, ((flat >> 22) & 1, row), np.int64(1) << ((flat >> 16) & 63))
            starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes))))).astype(np.int32)
            o = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), o, pa.array(bits[0]), pa.array(bits[1])], ["kind", "name", "more", "size", "o", "low", "high"])

    return run


def _keys(together: int, lacking: Column, most: int | None) -> Column:
    """Hashes of each choice of so many of the first ``lacking`` + ``together`` of o; ``lacking`` is ``most`` at most where several are chosen, and then the size nc counts."""
    if together == 1:
        return F.transform(F.slice("o", F.lit(1), lacking + 1), lambda g: F.xxhash64(g))
    chosen = F.array(*(F.array(*map(F.lit, x)) for x in combinations(range(most + together), together)))
    chosen = F.filter(chosen, lambda x: F.element_at(x, -1) < lacking + together)
    return F.transform(chosen, lambda x: F.xxhash64("nc", *(F.get(F.col("o"), F.get(x, F.lit(i))) for i in range(together))))


def candidates(q: DataFrame, c: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(q, c) of the names that may be as like as what was reached (found: q, reached), or ``least``."""
    # What a hit of each size that names have must share; where that is more than any name of the size can, none is looked for.
    of_kind = c.groupBy("kind").agg(F.collect_set(F.size("o")).alias("all_sizes"))
    reached, p = F.coalesce("reached", F.lit(least)), F.size("o")
    shared = lambda nc: F.greatest(F.ceil(reached / (1 + reached) * (F.col("size") + nc) - 1e-9).cast("int"), F.lit(1))
    mode = lambda x: F.coalesce(*(F.when((F.greatest(p, x["nc"]) - x["shared"] <= n) & (x["shared"] >= k), k) for k, n in TOGETHER[:-1]), F.lit(1))
    sizes = F.filter(F.transform("all_sizes", lambda nc: F.struct(nc.alias("nc"), shared(nc).alias("shared"))), lambda x: x["shared"] <= F.least(p, x["nc"]))
    wanted = q.join(found, "q", "left").join(F.broadcast(of_kind), "kind").select("q", "kind", "o", "low", "high", F.transform(sizes, lambda x: F.struct(x["nc"].alias("nc"), x["shared"].alias("shared"), mode(x).alias("mode"))).alias("sizes"))
    wanted = stored(wanted.where(F.size("sizes") > 0), fresh_path(q.sparkSession, "wanted"))

    met = []
    for k, most in TOGETHER:
        mine = wanted.withColumn("sizes", F.filter("sizes", lambda x: x["mode"] == k)).where(F.size("sizes") > 0)  # noqa: B023
        each = mine.select("*", F.explode("sizes").alias("s")).select("*", F.col("s.nc").alias("nc"), (F.col("s.nc") - F.col("s.shared")).alias("lacking"))
        widest = each.groupBy("kind", "nc").agg(F.max("lacking").alias("lacking"))
        posted = c.withColumn("nc", F.size("o")).join(F.broadcast(widest), ["kind", "nc"])
        posted = posted.select("c", F.col("low").alias("low_c"), F.col("high").alias("high_c"), F.explode(_keys(k, F.col("lacking"), most)).alias("key"))
        if k > 1:
            looked = each.withColumns({"differ": p + F.col("nc") - 2 * F.col("s.shared"), "lacking": p - F.col("s.shared")})
        else:  # in one row, whatever the number of sizes
            looked = mine.withColumns({"differ": F.array_max(F.transform("sizes", lambda x: p + x["nc"] - 2 * x["shared"])), "lacking": p - F.array_min("sizes.shared")})
        apart = F.bit_count(F.col("low").bitwiseXOR(F.col("low_c"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_c")))
        looked = looked.select("q", "low", "high", "differ", F.explode(_keys(k, F.col("lacking"), most)).alias("key"))
        met.append(looked.join(posted, "key").where(apart <= F.col("differ")).select("q", "c"))
    return reduce(DataFrame.unionByName, met).distinct()


def search_names(asked: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """asked (kind, name_key) and names (kind, name, pos, identifier), each once -> (kind, name_key, name, identifier, similarity): the hit of the
    largest share of common trigrams (of all of both), of ``least`` (above 0) at least; of equal ones the smallest pos.

    Only the best hit is wanted, so each asked name first meets one name for each of a few runs of its rarest trigrams: the best of these tells how many
    trigrams a better or equal hit of a given size must share. Of the p that any name has, in the order from the rarest, it shares k of the first
    p - shared + k with that hit, and these are among the hit's first size - shared + k; so names meet by k trigrams at once, the more the fewer
    may be missing. 128 bits tell most of those apart that differ in more; the rest is compared whole.
    """
    spark = asked.sparkSession
    rows = lambda df, name, more: df.select("kind", F.col(name).alias("name"), more.alias("more")).where("name is not null and kind is not null").withColumn("g", F.transform(trigrams(F.col("name")), lambda x: F.xxhash64("kind", x)))
    c, q = rows(names, "name", F.struct("pos", "identifier")), rows(asked, "name_key", F.lit(0))
    counts = np.zeros(PLACES, dtype=np.int64)
    for place, n in c.select(F.explode("g").alias("g")).groupBy(F.col("g").bitwiseAND(F.lit(PLACES - 1)).alias("place")).count().collect():  # at most PLACES
        counts[place] = n

    def kept(df: DataFrame, of: str) -> DataFrame:
        schema = df.select("kind", "name", "more", F.lit(0).alias("size"), F.col("g").alias("o"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).schema
        return stored(df.mapInArrow(_rarest_first(counts), schema).withColumn(of, F.monotonically_increasing_id()), fresh_path(spark, f"names-{of}"))

    c, q = kept(c, "c"), kept(q, "q")

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(q.select("q", F.col("kind").alias("of"), F.col("name").alias("name_key")), "q").join(c.select("c", "kind", "name", "more"), "c").where("kind = of")
        a, b = trigrams(F.col("name_key")), trigrams(F.col("name"))
        both = both.withColumn("common", F.size(F.array_intersect(a, b))).withColumn("all", F.size(a) + F.size(b))
        return both.select("q", "kind", "name_key", "name", "more", (F.col("common") / (F.col("all") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least)

    # One name for each run, whatever the number of names that have it.
    runs = F.array(*(F.when(F.size("o") >= start + n, F.xxhash64("kind", F.lit(start), F.slice("o", start + 1, n))) for start, n in RUNS))
    first = c.select("c", F.explode(runs).alias("key")).where("key is not null").groupBy("key").agg(F.min("c").alias("c"))
    found = compared(q.select("q", F.explode(runs).alias("key")).join(first, "key").select("q", "c").distinct()).groupBy("q").agg(F.max("similarity").alias("reached"))

    hits = compared(candidates(q, c, found, least))
    best = hits.groupBy("kind", "name_key").agg(F.min_by(F.struct("name", "more", "similarity"), F.struct(-F.col("similarity"), "more.pos")).alias("b"))
    return best.select("kind", "name_key", "b.name", "b.more.identifier", "b.similarity")
