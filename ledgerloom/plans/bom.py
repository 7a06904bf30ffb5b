"""From claims and texts to bills of materials."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import NORMALISERS, strip, truncated
from ledgerloom.operators import fields, retrieval, routing
from ledgerloom.operators.resolve import resolve_fields
from ledgerloom.operators.scratch import fresh_path, stored

# The rule of each direct field.
DIRECT = {
    "ai": {"releaseTime": ("date", "latest", 7), "suppliedBy": ("value", NORMALISERS["org"]), "downloadLocation": ("value", NORMALISERS["url"]), "packageVersion": ("value", NORMALISERS["version"])},
    "data": {"builtTime": ("date", "earliest", 7), "originatedBy": ("value", NORMALISERS["org"]), "releaseTime": ("date", "latest", 7), "downloadLocation": ("value", NORMALISERS["url"]), "contentIdentifier": ("value", NORMALISERS["default"])},
}

#: Asks for a field's value in chunks: (question, chunk texts, chunk sources) -> (value, source), nulls if there is none.
Extractor = Callable[[str, list[str], list[str]], tuple[str | None, str | None]]


def sentence_extractor(question: str, texts: list[str], sources: list[str]) -> tuple[str | None, str | None]:
    """Without a model: a ``key: value`` line of the question's last word, else the first sentence that shares most words with it."""
    words = set(question.lower().split())
    key = question.lower().split()[-1].strip("?.:") if words else ""
    best: tuple[int, str | None, str | None] = (0, None, None)
    for text, source in zip(texts, sources):
        for line in text.split("\n"):
            name, colon, rest = line.partition(":")
            if colon and key and name.strip("-* ").lower() == key and rest.strip():
                return rest.strip(), source
            for sentence in line.split(". "):
                n = len(words & set(sentence.lower().split()))
                if n > best[0]:
                    best = n, sentence.strip(), source
    return best[1], best[2]


def direct_fields(claims: DataFrame, kind: str, priority: DataFrame | None = None) -> DataFrame:
    """bom_fields of the fields that records give."""
    return fields.triplets(resolve_fields(claims, DIRECT["data" if kind == "dataset" else kind], priority), "direct")


#: Reads the anonymous groups of a field's chunks: (question, [(letter, chunk texts)]) -> report with CLAIM and CONFLICT lines.
Detector = Callable[[str, list[tuple[str, list[str]]]], str]

# Tries, first wait in seconds, calls at once, what errors of passing trouble say, chunks of a second try, and answers
# without findings.
TRIES, WAIT, CALLS = 3, 2.0, 5
PASSING = ("connection reset", "connection aborted", "connectionreset", "protocol error", "broken pipe", "remotedisconnected", "econnreset", "econnrefused", "104,", "connection error", "provider returned error")
#: What errors of too long prompts say.
TOO_LONG = ("context", "too long", "max_tokens", "maximum context", "token limit", "exceeds", "length")
FEWER_CHUNKS = 6
NO_ASSERTION, NOT_FOUND = "noAssertion", "Not found."
DIRECT_LEAST, DIRECT_MOST = 50, 40_000


class Pause:
    """A pause that all calls of a task share: while a service is in trouble, none of them asks it again."""

    def __init__(self, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.sleep, self.clock, self.until, self.lock = sleep, clock, 0.0, threading.Lock()

    def wait(self) -> None:
        while (left := self.until - self.clock()) > 0:
            self.sleep(left)

    def extend(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, self.clock() + seconds)


def retried(call: Callable, *args, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep, pause: Pause | None = None):
    """call(*args), again after a pause that doubles if an error tells of passing trouble; with ``pause``, all that share it wait."""
    for n in range(TRIES):
        try:
            if pause is not None:
                pause.wait()
            return call(*args)
        except Exception as e:
            if n == TRIES - 1 or not any(x in str(e).lower() for x in PASSING):
                raise
            if pause is None:
                sleep(wait * 2**n)
            else:
                pause.extend(wait * 2**n)


def in_order(call: Callable, rows: Iterable[tuple], most: int = CALLS) -> Iterator:
    """call(*row, pause) of each row, in the order of rows, ``most`` at once; rows are taken as calls end, so nothing piles up.

    The first error ends it: calls that have begun are waited for, no other begins.
    """
    pause, begun = Pause(), deque()
    with ThreadPoolExecutor(most) as pool:
        try:
            for row in rows:
                begun.append(pool.submit(call, *row, pause))
                if len(begun) >= most:
                    yield begun.popleft().result()
            while begun:
                yield begun.popleft().result()
        finally:
            for f in begun:
                f.cancel()


def answered(extractor: Extractor, question: str, texts: list[str], sources: list[str], pause: Pause | None = None) -> tuple[str | None, str | None]:
    """An extractor's answer; of a prompt that is too long, that to fewer chunks, else no assertion."""
    try:
        return retried(extractor, question, texts, sources, pause=pause)
    except Exception as e:
        if not any(x in str(e).lower() for x in TOO_LONG):
            raise
    try:
        return retried(extractor, question, texts[:FEWER_CHUNKS], sources[:FEWER_CHUNKS], pause=pause)
    except Exception:
        return NO_ASSERTION, None


def claims_detector(question: str, groups: list[tuple[str, list[str]]]) -> str:
    """Without a model: each group claims what ``sentence_extractor`` finds in it; different claims contradict each other."""
    said = [(letter, sentence_extractor(question, texts, [letter] * len(texts))[0]) for letter, texts in groups]
    lines = [f"CLAIM_{a}: {x or 'No relevant information'}" for a, x in said] + [f"CONFLICT_WITHIN_{a}: No" for a, _ in said]
    for i, (a, x) in enumerate(said):
        lines += [f"CONFLICT_{a}_VS_{b}: " + (f"Yes: {x} or {y}" if x and y and x.lower() != y.lower() else "No") for b, y in said[i + 1 :]]
    return "\n".join(lines)


def detect(ranked: DataFrame, questions: DataFrame, priority: DataFrame, detector: Detector = claims_detector) -> DataFrame:
    """Retrieved chunks -> audits (artifact_id, field, groups, claims, internal, external, legacy strings, priority array).

    Only fields with several groups are asked about; a prompt that is too long finds nothing.
    """
    grouped = routing.groups(ranked, priority)
    rows = grouped.where(F.size("groups") > 1).join(questions.select("field", "question").distinct(), "field").select("artifact_id", "field", "question", "groups")

    def one(question: str, groups: list[dict], pause: Pause) -> str | None:
        try:
            return retried(detector, question, [(g["letter"], g["texts"]) for g in groups], pause=pause)
        except Exception as e:
            if "400" in str(e) or any(x in str(e).lower() for x in ("context", "too long")):
                return None
            raise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = list(in_order(one, zip(b.column(2).to_pylist(), b.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], ["artifact_id", "field", "text"])

    reports = rows.mapInArrow(run, f"artifact_id {rows.schema['artifact_id'].dataType.simpleString()}, field string, text string")
    order = priority.groupBy("field").agg(F.sort_array(F.collect_list(F.struct("ord", "source"))).alias("p")).select("field", F.transform("p", lambda x: x["source"]).alias("priority"))
    audits = routing.audit(grouped, reports).join(order, "field", "left")
    return audits.withColumn("priority", F.coalesce("priority", F.array().cast("array<string>")))


def trace(audits: DataFrame, routed: DataFrame) -> DataFrame:
    """(artifact_id, field, trace): what was claimed, contradicted and selected; null where nobody claimed anything."""
    chosen = routed.groupBy("artifact_id", "field").agg(F.first("selected").alias("selected"))
    spoken = F.exists(F.map_values("claims"), lambda x: x.isNotNull())
    block = F.struct("claims", "internal", "external", F.array_sort("selected").alias("selected"))
    return audits.join(chosen, ["artifact_id", "field"], "left").select("artifact_id", "field", F.when(spoken, block).alias("trace"))


def extract(ranked: DataFrame, questions: DataFrame, extractor: Extractor = sentence_extractor) -> DataFrame:
    """Retrieved chunks (artifact_id, field, source, text, rank) and questions (field, question, post_process) -> bom_fields with raw_answer.

    Fields without a chunk aren't asked; the extractor runs in Arrow batches, a row for each artifact and field. raw_answer is
    the answer before it was processed, if that changed it.
    """
    best = F.sort_array(F.collect_list(F.struct("rank", "text", "source")))
    asked = ranked.groupBy("artifact_id", "field").agg(best.alias("c")).join(questions.select("field", "question"), "field")
    rows = asked.select("artifact_id", "field", "question", F.transform("c", lambda x: x["text"]).alias("texts"), F.transform("c", lambda x: x["source"]).alias("sources"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(in_order(partial(answered, extractor), zip(*(c.to_pylist() for c in b.columns[2:]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], ["artifact_id", "field", "value", "source"])

    done = rows.mapInArrow(run, f"artifact_id {rows.schema['artifact_id'].dataType.simpleString()}, field string, value string, source string")
    named = done.join(questions.select("field", "post_process"), "field")
    value = fields.post_process(F.col("value"), F.col("post_process"))
    raw = F.when(~value.eqNullSafe(F.col("value")), F.col("value"))
    return named.select("artifact_id", F.lit("inferred").alias("section"), "field", value.alias("value"), "source", F.lit(None).cast(fields.CONFLICT).alias("conflict"), raw.alias("raw_answer"))


def inferred_fields(questions: DataFrame, chunks: DataFrame, priority: DataFrame, kind: str = "ai", extractor: Extractor = sentence_extractor, detector: Detector = claims_detector, sparse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Retrieve, detect, route and answer: bom_fields with raw_answer and, for models, a trace of the audit.

    questions (artifact_id, field, question, embedding, terms, post_process); priority (field, source, ord). The answer comes from
    the chunks of the sources that the audit leaves; what it found is the field's conflict. ``sparse`` as in ``retrieve``.
    """
    spark = questions.sparkSession
    # Routing, conflicts and traces read these two tables, so nothing is retrieved or asked twice, whatever the plan reuses.
    ranked = stored(retrieval.retrieve(questions, chunks, priority, sparse), fresh_path(spark, "ranked"))
    asked = questions.select("field", "question", "post_process").distinct()
    audits = stored(detect(ranked, asked, priority, detector), fresh_path(spark, "audits"))
    routed = routing.route(ranked, audits)
    out = extract(routed, asked, extractor).drop("conflict")
    found = fields.conflict(kind=None, internal=F.when(F.col("internal_conflict") != "No", F.col("internal_conflict")), external=F.when(F.col("external_conflict") != "No", F.col("external_conflict")))
    said = audits.select("artifact_id", "field", F.when((F.col("internal_conflict") != "No") | (F.col("external_conflict") != "No"), found).alias("conflict"))
    out = out.join(said, ["artifact_id", "field"], "left")
    return out if kind != "ai" else out.join(trace(audits, routed), ["artifact_id", "field"], "left")


# What an answer begins with, and what stands before what disagrees.
ANSWER, MARKER = "ANSWER:", "CONFLICT_STATUS:"
#: Answers from whole sources: (question, texts, sources) -> text, with ``CONFLICT_STATUS:`` before what disagrees.
Answerer = Callable[[str, list[str], list[str]], str]


def sentence_answerer(question: str, texts: list[str], sources: list[str]) -> str:
    """Without a model: what ``sentence_extractor`` finds first, and whether other sources say the same."""
    found = [x for t, s in zip(texts, sources) if (x := sentence_extractor(question, [t], [s])[0])]
    return f"{found[0] if found else NOT_FOUND} CONFLICT_STATUS: {'Yes' if len({x.lower() for x in found}) > 1 else 'No'}"


def direct_answers(texts: DataFrame, questions: DataFrame, priority: DataFrame, answerer: Answerer = sentence_answerer) -> DataFrame:
    """Without retrieval: source_text (artifact_id, source, text) and questions (artifact_id, field, question) -> bom_fields.

    Sources of 50 characters or fewer are left out, the others cut at 40,000 and put in order of priority; an artifact
    without any is answered ``Not found.`` unasked.
    """
    own = texts.where(F.length(F.trim("text")) > DIRECT_LEAST).select("artifact_id", "source", truncated(F.col("text"), DIRECT_MOST).alias("text"))
    met = questions.select("artifact_id", "field", "question").join(own, "artifact_id", "left").join(priority.select("field", "source", "ord"), ["field", "source"], "left")
    block = F.struct(F.coalesce("ord", F.lit(99)).alias("ord"), "source", "text")
    g = met.groupBy("artifact_id", "field", "question").agg(F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), block))).alias("c"))
    rows = g.select("artifact_id", "field", "question", F.transform("c", lambda x: x["text"]).alias("texts"), F.transform("c", lambda x: x["source"]).alias("sources"))

    def one(question: str, texts: list[str], sources: list[str], pause: Pause) -> str:
        return retried(answerer, question, texts, sources, pause=pause) if texts else NOT_FOUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = list(in_order(one, zip(*(c.to_pylist() for c in b.columns[2:]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(said, pa.string())], ["artifact_id", "field", "sources", "said"])

    done = rows.mapInArrow(run, f"artifact_id {rows.schema['artifact_id'].dataType.simpleString()}, field string, sources array<string>, said string")
    # One marker takes the answer and the conflict apart; without it, or with more, the text is the answer as it stands.
    parts = F.split("said", MARKER, -1)
    one_marker, first, status = F.size(parts) == 2, strip(parts[0]), strip(F.get(parts, F.lit(1)))
    answer = F.when(first.startswith(ANSWER), strip(F.substring(first, len(ANSWER) + 1, 1 << 30))).otherwise(first)
    value = F.when(one_marker, answer).otherwise(F.col("said"))
    conflict = F.when(one_marker & (F.lower(status) != "no"), fields.parse_conflict(status))
    return done.select("artifact_id", F.lit("inferred").alias("section"), "field", value.alias("value"), F.array_join("sources", ", ").alias("source"), conflict.alias("conflict"))


def build(claims: DataFrame, kind: str, priority: DataFrame | None = None, questions: DataFrame | None = None, chunks: DataFrame | None = None, source_order: DataFrame | None = None, extractor: Extractor = sentence_extractor, use_case: str = "complete", detector: Detector = claims_detector) -> DataFrame:
    """bom_fields (artifact_id, section, field, value, source, conflict, raw_answer, trace) of all artifacts at once.

    Direct fields come from claims; inferred ones from chunks, if questions (artifact_id, field, question, embedding, terms,
    post_process) are asked, those of the use case alone: see ``inferred_fields``, which also gives raw answers and traces.
    """
    none = {"raw_answer": F.lit(None).cast("string"), "trace": F.lit(None).cast(fields.TRACE)}
    out = direct_fields(claims, kind, priority).withColumns(none)
    if questions is not None:
        found = inferred_fields(fields.preset(questions, kind, use_case), chunks, source_order, kind, extractor, detector)
        found = found if "trace" in found.columns else found.withColumn("trace", none["trace"])
        out = out.unionByName(found.withColumn("trace", F.col("trace").cast(fields.TRACE)).select(*out.columns))
    return out
