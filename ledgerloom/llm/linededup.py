"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, discard, forget, materialise, meet_counted, named, scratch_path

RUN = "h1 long, h2 long, n_docs long, last_doc long"


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """A store of immutable runs (h1, h2, n_docs, last_doc) in a folder, each sorted by its 128-bit line hash.

    A line hash is in one run only: that of the batch it came with first. What later batches add to known lines lies
    in update runs beside them. Level 0 gets a run with each batch; when a level has ``fanout`` runs, they are merged into
    one run of the next level, so that after n batches there are about log(n) levels of ``fanout`` - 1 runs at most. Updates
    are compacted with them. A store is opened again by its folder: a manifest, written last and whole, names what counts, so after a
    failure the store is as it was before the batch, and what the batch had written is nobody's.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or scratch_path(spark, "line-runs")
        self.stale: list[str] = []
        at, fs = self._at("")
        found = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("manifest-")) if fs.exists(at) else []
        self.version = int(found[-1].split("-")[1]) if found else 0
        self.names = [r.value for r in spark.read.text(f"{self.folder}/{found[-1]}").collect() if r.value] if found else []

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self) -> None:
        """The manifest of what there is now; then what it no longer names goes."""
        self.version += 1
        beside, fs = self._at(f"_next-{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray("\n".join(self.names).encode()))
        out.close()
        if not fs.rename(beside, self._at(f"manifest-{self.version:09d}")[0]):
            raise RuntimeError(f"{self.folder} was changed by somebody else")
        for x in self.stale:
            discard(self.spark, f"{self.folder}/{x}")
        self.stale = []

    def level(self, n: int, kind: str = "run") -> list[str]:
        return [x for x in self.names if x.startswith(f"{kind}-{n}-")]

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*(f"{self.folder}/{x}" for x in names)) if names else self.spark.createDataFrame([], RUN)

    def runs(self) -> DataFrame:
        return self._read([x for x in self.names if x.startswith("run-")])

    def updates(self) -> DataFrame:
        return self._read([x for x in self.names if x.startswith("update-")])

    def _write(self, rows: DataFrame, kind: str, level: int) -> None:
        name = f"{kind}-{level}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        self.names.append(name)
        old = self.level(level, kind)
        if len(old) >= self.fanout:
            merged = self._read(old)
            if kind == "update":
                merged = merged.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            self._write(merged.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), kind, level + 1)
            for x in old:
                self.names.remove(x)
                self.stale.append(x)

    def add(self, batch: DataFrame) -> None:
        """Merge-join a batch (h1, h2, doc_id), one row for each document with the line, with all runs.

        Hashes that no run has (the anti join) make the batch's own run; the others become an update. The merge join leaves its
        output sorted by hash, so neither needs a further sort.
        """
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not self.names:
            self._write(own.sortWithinPartitions("h1", "h2"), "run", 0)
            self._commit()
            return
        known = self.runs().select("h1", "h2", F.lit(True).alias("known"))
        met = materialise(own.join(known.hint("merge"), ["h1", "h2"], "left"), "met")
        self._write(met.where("known is null").drop("known"), "run", 0)
        self._write(met.where("known").drop("known"), "update", 0)
        self._commit()
        forget(met)

    def totals(self) -> DataFrame:
        """Each line hash with all its documents: as runs have it once, no hash is counted twice."""
        more = self.updates().groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        met = self.runs().join(more, ["h1", "h2"], "left")
        return met.select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))


def _marked(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(row, lines, drops): each row of docs as a struct, the lines of its text and the positions of those that go."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), "text")
    lines = rows.where("doc is not null").select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    postings = materialise(keys.select(F.col("doc").alias("doc_id"), "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64(F.lit(2), "doc"), F.lit(batches)).cast("int").alias("batch")), "postings")
    store = LineRuns(spark, fanout=fanout)
    for i in range(batches):
        store.add(postings.where(F.col("batch") == i).select("h1", "h2", "doc_id").distinct())
    frequent = materialise(store.totals().where(F.col("n_docs") >= min_docs), "frequent")
    met = meet_counted(postings, postings.count(), frequent, ["h1", "h2"], "n_docs", "inner")
    dropped = met.where("doc_id < last_doc").groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set("pos").alias("drops"))
    none = F.array().cast("array<int>")
    return rows.join(dropped, "doc", "left").select("row", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.coalesce("drops", none).alias("drops"))


def _kept_text() -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    return F.when(F.size("drops") == 0, F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_lines, n_dropped, kept_text), one row for each input row.

    A line's key is the line stripped and lower-cased (ASCII). A key of at least ``min_chars`` code
    points that ``min_docs`` documents hold loses its lines, but in the largest doc_id holding it.
    Batches of documents, dealt by a hash of doc_id, go through LineRuns one after the other; the
    result doesn't depend on how they are dealt. A null or empty text is one empty line. Rows with
    the same doc_id count as one document; a line position that goes in one of them goes in all.
    Rows with a null doc_id count for no key and lose nothing; doc_ids must be whole numbers. Very common lines are
    counted by partial aggregates, and their totals sent to their places by a broadcast of a thousand rows at most.
    Other columns may have any names; an empty table gives no rows.
    """
    whole = _marked(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    return whole.select("row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"), _kept_text().alias("kept_text"))


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with all columns, their texts without the lines that ``dedup_lines`` drops; texts that lose none stay as they are."""
    whole = _marked(docs, min_chars, min_docs, batches, fanout)
    return whole.select(*(F.when(F.size("drops") == 0, F.col("row.text")).otherwise(_kept_text()).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
