"""The corpus pipeline: language, repeated lines, near duplicates, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return
the columns of ``documents``; a stage that changes texts also sets n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, named
from ledgerloom.llm.langid import accepted, learn
from ledgerloom.llm.linededup import drop_lines
from ledgerloom.llm.neardup import one_of_each
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.pii import redact


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones, too) and those whose words are in no language clearly; several languages
    in a text are none the worse. Null and repeated ids and other columns play no part, very long texts are labelled whole;
    without any lang all texts with a letter stay; an empty table stays empty."""
    return accepted(docs, learn(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; every document stays. Null texts stay null, rows of null ids lose nothing, and rows of one id count as
    one document; of equal lines the largest id keeps its own. Other columns may have any names."""
    return _recounted(drop_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, of the smallest doc_id (of equal ones, that of the smallest text hash, then the smallest
    row); rows without words or of null id stay, and rows are told apart by id and text. An empty table stays empty."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in the place of personal data; every row stays, whatever its id. Null texts stay null; very long ones are
    searched whole."""
    return _recounted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, one row for each, with a checksum of their ids. A null or empty text is the end alone; null and
    repeated ids are packed like any other; an empty table gives no rows."""
    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: The random field, the classifier of spans and the packing heuristic are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
