"""Conflict audit: the report of a detector as data, and which sources its findings leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import strip

# Fixed values.
SILENT = ["no relevant information", "n/a", "none", ""]
LEAST_CHUNKS = 3
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def label_sources(present: DataFrame, priority: DataFrame) -> DataFrame:
    """present (artifact_id, field, source), priority (field, source, ord) -> with letter: by priority, then by name."""
    from pyspark.sql import Window

    named = present.where("source is not null and source <> 'unknown'").distinct().join(priority, ["field", "source"], "left")
    w = Window.partitionBy("artifact_id", "field").orderBy(F.coalesce("ord", F.lit(99)), "source")
    return named.select("artifact_id", "field", "source", F.char(F.row_number().over(w) + 64).alias("letter"))


def report_lines(text: Column) -> Column:
    """A report as a map of its labels to what stands behind them, in the line or, where that ends there, in the next that isn't blank;
    labels are of capitals and underscores, asterisks are left out."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\*", ""), "\n", -1), lambda x: strip(x) != "")
    form = r"(?U)^\s*([A-Z_]+)\s*:\s*(.*?)\s*$"
    own = lambda x: F.regexp_extract(x, form, 2)
    said = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, form, 1).alias("label"), F.when(own(x) != "", own(x)).otherwise(strip(F.coalesce(F.get(lines, i + 1), F.lit("")))).alias("said")))
    said = F.filter(said, lambda x: (x["label"] != "") & (x["said"] != ""))
    labels = F.transform(said, lambda x: x["label"])
    return F.map_from_entries(F.filter(said, lambda x, i: F.array_position(labels, x["label"]) == i + 1))


def _claim(said: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(said), '^"+|"+$', ""), "^'+|'+$", ""), r"\.+$", "")
    return F.when(~F.lower(strip(bare)).isin(SILENT), bare)


def _narrative(said: Column) -> Column:
    rest = strip(F.regexp_replace(said, r"(?i)^yes\s*:?", ""))
    return F.when(F.lower(said).startswith("yes"), F.when(rest == "", "Yes").otherwise(rest))


def parse_report(reports: DataFrame) -> DataFrame:
    """reports (keys..., text, letters array<struct<letter, source>>) -> with claims, internal and external.

    A report is taken apart once; labels are CLAIM_A, CONFLICT_WITHIN_A and CONFLICT_A_VS_B. claims: map of source to claim or null; internal: map of self-contradicting sources; external: array of
    (sources, description), pairs in letter order.
    """
    s, says = F.col("letters"), lambda *label: F.try_element_at("said_by_label", F.concat(*label))
    claims = F.map_from_entries(F.transform(s, lambda x: F.struct(x["source"].alias("key"), _claim(says(F.lit("CLAIM_"), x["letter"])).alias("value"))))
    within = F.transform(s, lambda x: F.struct(x["source"].alias("key"), _narrative(says(F.lit("CONFLICT_WITHIN_"), x["letter"])).alias("value")))
    pair = lambda a, b: F.struct(F.array(a["source"], b["source"]).alias("sources"), _narrative(says(F.lit("CONFLICT_"), a["letter"], F.lit("_VS_"), b["letter"])).alias("description"))
    pairs = F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b["letter"] > a["letter"]), lambda b: pair(a, b))))
    taken = reports.withColumn("said_by_label", report_lines(F.col("text")))
    return taken.withColumns({"claims": claims, "internal": F.map_from_entries(F.filter(within, lambda x: x["value"].isNotNull())), "external": F.filter(pairs, lambda x: x["description"].isNotNull())}).drop("said_by_label")


def legacy_strings(audits: DataFrame) -> DataFrame:
    """audits (internal, external) -> with internal_conflict and external_conflict: ``Yes: ...; ...`` or ``No``."""
    within = F.transform(F.map_entries("internal"), lambda e: F.concat(e["key"], F.lit(" \u2014 "), e["value"]))
    said = lambda parts: F.when(F.size(parts) > 0, F.concat(F.lit("Yes: "), F.array_join(parts, "; "))).otherwise("No")
    return audits.withColumns({"internal_conflict": said(within), "external_conflict": said(F.transform("external", lambda x: x["description"]))})


def groups(chunks: DataFrame, priority: DataFrame) -> DataFrame:
    """Retrieved chunks (artifact_id, field, source, text, rank) -> (artifact_id, field, groups array<struct<letter, source, texts>>).

    Sources get letters by priority, then by name; chunks without a source or of an unknown one are in no group.
    """
    letters = label_sources(chunks.select("artifact_id", "field", "source"), priority)
    own = chunks.join(letters, ["artifact_id", "field", "source"]).groupBy("artifact_id", "field", "letter", "source").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("c"))
    group = F.struct("letter", "source", F.transform("c", lambda x: x["text"]).alias("texts"))
    return own.groupBy("artifact_id", "field").agg(F.sort_array(F.collect_list(group)).alias("groups"))


def audit(grouped: DataFrame, reports: DataFrame) -> DataFrame:
    """groups and their detector's reports (artifact_id, field, text) -> with claims, internal, external and the legacy strings.

    One group or none has nothing to contradict: its claims are null, whatever a report says; so are those without a report
    (of a prompt that was too long).
    """
    letters = F.transform("groups", lambda g: F.struct(g["letter"].alias("letter"), g["source"].alias("source")))
    rows = grouped.join(reports.select("artifact_id", "field", "text"), ["artifact_id", "field"], "left").withColumn("letters", letters)
    return legacy_strings(parse_report(rows.withColumn("text", F.when(F.size("groups") > 1, F.col("text"))))).drop("letters", "text")


def select_sources(audits: DataFrame) -> DataFrame:
    """audits (keys..., claims, internal, external, priority array) -> with chosen: the sources to answer from; null means all.

    A source's score is the number of other speaking sources that contradict neither themselves nor it, less 2 if
    it contradicts itself. The best scores win; if two of them contradict each other, the first by priority does.
    """
    speaking = F.array_sort(F.map_keys(F.map_filter("claims", lambda k, v: v.isNotNull())))
    internal = F.map_keys("internal")
    rows = audits.withColumns({"speaking": speaking, "self": internal, "pairs": F.transform("external", lambda x: F.array_join(F.array_sort(x["sources"]), "\n"))})

    def clash(a: Column, b: Column) -> Column:
        return F.array_contains("pairs", F.array_join(F.array_sort(F.array(a, b)), "\n"))

    def score(a: Column) -> Column:
        friends = F.filter("speaking", lambda b: (b != a) & ~F.array_contains("self", b) & ~clash(a, b))
        return F.size(friends) - F.when(F.array_contains("self", a), 2).otherwise(0)

    rows = rows.withColumn("scores", F.transform("speaking", score))
    rows = rows.withColumn("best", F.array_max("scores"))
    rows = rows.withColumn("top", F.filter("speaking", lambda a, i: F.get("scores", i) == F.col("best")))
    at_odds = F.exists("top", lambda a: F.exists("top", lambda b: (a != b) & clash(a, b)))

    def place(a: Column) -> Column:
        n = F.array_position("priority", a)
        return F.struct(F.when(n == 0, 99).otherwise(n).alias("n"), F.array_position("speaking", a).alias("i"), a.alias("source"))

    first = F.array_min(F.transform("top", place))["source"]
    calm = (F.size("self") == 0) & (F.size("pairs") == 0)
    chosen = F.when(calm | (F.size("speaking") <= 1) | (F.col("best") < 0), None).when(at_odds, F.array(first)).otherwise(F.col("top"))
    return rows.withColumn("chosen", chosen).drop("self", "pairs", "scores", "best", "top")


def route(chunks: DataFrame, audits: DataFrame, least: int = LEAST_CHUNKS) -> DataFrame:
    """The chunks of the chosen sources, or all of an artifact's field if fewer than ``least`` would be left; with selected.

    chunks (artifact_id, field, source, ...); audits as for ``select_sources``, one row for each artifact and field.
    """
    a = select_sources(audits).select("artifact_id", "field", "speaking", "chosen")
    kept = F.coalesce(F.array_contains("chosen", F.col("source")), F.lit(True))
    marked = chunks.join(a, ["artifact_id", "field"]).withColumn("kept", kept)
    enough = marked.groupBy("artifact_id", "field").agg((F.count_if("kept") >= least).alias("enough"))
    rows = marked.join(enough, ["artifact_id", "field"]).where("chosen is null or kept or not enough")
    selected = F.when(F.col("chosen").isNotNull() & F.col("enough"), F.col("chosen")).otherwise(F.col("speaking"))
    return rows.select(*chunks.columns, selected.alias("selected"))


def marked_answer(text: Column, marker: str) -> Column:
    """What follows ``MARKER:`` up to the next line that begins with a label in capitals, or to the end."""
    return strip(F.regexp_extract(text, rf"(?s){marker}:\s*(.*?)(?=\n[A-Z_]{{3,}}:|\z)", 1))
