"""JSON documents as rows of paths and values, so that two documents can be compared key by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _leaves(value, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    elif value is not None:
        yield path, value if isinstance(value, str) else json.dumps(value)


def _elements(text: str | None) -> Iterator[tuple[str, str, str | None]]:
    try:
        whole = json.loads(text or "")
    except ValueError:
        yield "", "", None
        return
    graph = whole.pop("@graph", None) if isinstance(whole, dict) else None
    yield from (("", p, v) for p, v in _leaves(whole, ""))
    for i, e in enumerate(graph if isinstance(graph, list) else []):
        own = str(e.get("spdxId") or e.get("@id") or f"[{i}]") if isinstance(e, dict) else f"[{i}]"
        yield from ((own, p, v) for p, v in _leaves(e, ""))


def document_paths(docs: DataFrame) -> DataFrame:
    """docs (doc_id, json) -> (doc_id, element, path, value), a row for each scalar.

    Elements of an @graph go by their ids, whatever their order; other parts have the element ''. Nulls, empty lists and empty
    objects have no row; a text that is no JSON has one row without path and value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _elements(text)]
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["doc_id", "element", "path", "value"])

    return docs.select(F.col("doc_id").cast("string"), "json").mapInArrow(run, "doc_id string, element string, path string, value string")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, element, path, left, right) of two sets of documents (doc_id, json), where they differ."""
    a, b = (document_paths(d).select("doc_id", "element", "path", F.struct("value").alias(x)) for d, x in ((left, "left"), (right, "right")))
    met = a.join(b, ["doc_id", "element", "path"], "full")
    return met.where(~F.col("left").eqNullSafe(F.col("right"))).select("doc_id", "element", "path", F.col("left.value").alias("left"), F.col("right.value").alias("right"))
