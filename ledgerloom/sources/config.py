"""Source priorities and question banks from JSON files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import strip, token_estimate
from ledgerloom.operators.graph import numbered

PRIORITY = "section string, field string, sources array<string>"
#: What holds where a section has no default of its own.
LAST_RESORT = ["hub", "paper", "repo"]
ENTRY = """question string, keywords string, summary string, description string, post_process string, priority array<string>,
retrieval struct<hypothetical_passage:string,bm25_terms:array<string>>, extraction struct<instruction:string,field_spec:string,output_guidance:string>"""


def choose_path(explicit: str | None = None, pinned: str | None = None, variable: str | None = None, bundled: str | None = None) -> str | None:
    """The first that is given: an explicit path, a pinned one, one of an environment variable, the bundled file."""
    return explicit or pinned or (os.environ.get(variable) if variable else None) or bundled


def read_priority(spark: SparkSession, path: str) -> DataFrame:
    """{section: {field: [source]}} as rows; sections that begin with $ are comments; a broken file gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    sections = raw.select(F.explode("m").alias("section", "body")).where(~F.col("section").startswith("$"))
    rows = sections.select(F.when(F.col("section") == "dataset", "data").otherwise(F.col("section")).alias("section"), F.explode(F.from_json("body", "map<string,array<string>>")).alias("field", "sources"))
    return rows.where("sources is not null")


def overlay(bundled: DataFrame, own: DataFrame) -> DataFrame:
    """The user's list for a field where there is one, else the bundled one."""
    b, o = bundled.withColumnRenamed("sources", "bundled"), own.withColumnRenamed("sources", "own")
    return b.join(o, ["section", "field"], "full_outer").select("section", "field", F.coalesce("own", "bundled").alias("sources"))


def lookup(fields: DataFrame, priority: DataFrame) -> DataFrame:
    """fields (section, field) -> with sources: of the field, else of its section's default, else the last resort."""
    default = priority.where("field = 'default'").select("section", F.col("sources").alias("default_sources"))
    joined = fields.join(priority, ["section", "field"], "left").join(default, "section", "left")
    last = F.array(*map(F.lit, LAST_RESORT))
    return joined.select(*fields.columns, F.coalesce("sources", "default_sources", last).alias("sources"))


def exploded(priority: DataFrame) -> DataFrame:
    """(section, field, source, ord)."""
    return priority.select("section", "field", F.posexplode("sources").alias("ord", "source"))


REQUIRED = ["description", "keywords", "question"]


def bank_entries(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (field, value) of JSON entries -> entries, and rejected ones (field, reason); each text is in one of the two.

    An entry is an object with question, keywords and description, if only null ones.
    """
    read = texts.withColumn("v", F.try_parse_json("value"))
    lacking = F.filter(F.array(*(F.when(F.try_variant_get("v", f"$.{k}", "variant").isNull(), F.lit(k)) for k in REQUIRED)), lambda x: x.isNotNull())
    reason = F.when(F.col("v").isNull(), "no JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "no object").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    marked = read.withColumn("reason", reason)
    kept = marked.where("reason is null").select("field", F.from_json("value", ENTRY).alias("e")).select("field", "e.*")
    return kept, marked.where("reason is not null").select("field", "reason")


def read_bank_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The entries of JSON files, named by them, and the files that hold none, with the reason: see ``bank_entries``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.json$", 1)
    return bank_entries(spark.read.text(path, wholetext=True).select(name.alias("field"), "value"))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The entries alone that have a question, keywords and a description."""
    return read_bank_files(spark, path)[0].where("question is not null and keywords is not null and description is not null")


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def queries_of(bank: DataFrame) -> DataFrame:
    """Texts that a question is searched and asked with: dense, sparse, described, and the three extraction slots."""
    described = F.concat_ws("\n\n", _filled(F.col("summary")), _filled(F.col("description")))
    terms = F.array_join("retrieval.bm25_terms", " ")
    slots = [F.coalesce(_filled(F.col(f"extraction.{s}")), other).alias(s) for s, other in (("instruction", F.col("question")), ("field_spec", described), ("output_guidance", F.lit("")))]
    return bank.select("field", "question", F.coalesce(_filled(F.col("retrieval.hypothetical_passage")), described).alias("dense"), F.coalesce(_filled(terms), F.col("keywords")).alias("sparse"), described.alias("described"), *slots)


def bank_violations(bank: DataFrame, least_terms: int = 5, most_tokens: int = 200) -> DataFrame:
    """(field, violation) of entries whose retrieval or extraction parts are too few or too long."""
    rules = [
        (F.coalesce(F.size("retrieval.bm25_terms"), F.lit(0)) < least_terms, "too few terms"),
        (F.length("retrieval.hypothetical_passage") / 3.5 > most_tokens, "passage too long"),
        *((_filled(F.col(f"extraction.{s}")).isNull(), f"no {s}") for s in ("instruction", "field_spec", "output_guidance")),
    ]
    return bank.select("field", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(said)) for bad, said in rules)))).alias("violation"))


def bank_changes(bank: DataFrame, spec: DataFrame) -> DataFrame:
    """Entries whose summary or description differ from the specification's (field, summary, description), patched."""
    s = spec.select("field", F.col("summary").alias("new_summary"), F.col("description").alias("new_description"))
    differs = ~F.col("summary").eqNullSafe(F.col("new_summary")) | ~F.col("description").eqNullSafe(F.col("new_description"))
    return bank.join(s, "field").where(differs).withColumns({"summary": F.col("new_summary"), "description": F.col("new_description")}).drop("new_summary", "new_description")


def master_bank(bank: DataFrame, priority: DataFrame, spec: DataFrame) -> DataFrame:
    """Bank entries with their priorities and specification pages; mapped tells whether there is such a page."""
    return bank.join(priority.select("field", "sources"), "field", "left").join(spec.select("field", "name", "url"), "field", "left").withColumn("mapped", F.col("name").isNotNull())


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """Markdown pages as (path, name, summary, description): the title and the second-level sections; files that begin with _ are left out."""
    v = F.col("value")
    section = lambda title: strip(F.regexp_extract(v, rf"(?s)\n## {title}\s*\n(.*?)(?=\n## |\z)", 1))
    rows = spark.read.text(path, wholetext=True).where(~F.col("_metadata.file_name").startswith("_"))
    return rows.select(F.col("_metadata.file_path").alias("path"), strip(F.regexp_extract(v, r"(?m)^# (.+)$", 1)).alias("name"), section("Summary").alias("summary"), section("Description").alias("description"))


def master_counts(master: DataFrame) -> DataFrame:
    """(entries, mapped, internal): of a master bank's entries, those with a specification page and those of our own."""
    return master.agg(F.count("*").alias("entries"), F.count_if("mapped").alias("mapped"), F.count_if(~F.col("mapped")).alias("internal"))


def spec_pages(spec: DataFrame, base: str) -> DataFrame:
    """read_spec's rows with prefixed name and page URL, from the folders namespace/kind that the file lies in."""
    parts = F.split(F.regexp_replace("path", r"\.md$", ""), "/")
    namespace, kind, page = (F.element_at(parts, i) for i in (-3, -2, -1))
    prefix = F.lower(namespace)
    return spec.withColumns({"prefixed": F.when(prefix == "core", F.col("name")).otherwise(F.concat(prefix, F.lit("_"), "name")), "url": F.concat_ws("/", F.lit(base.rstrip("/")), namespace, kind, page)})


def write_spec(spec: DataFrame, path: str) -> None:
    """Pages as JSON lines, and an index of names and URLs beside them."""
    spec.select(F.to_json(F.struct(*spec.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/pages")
    spec.select("prefixed", "url").write.json(f"{path}/index")


def with_priority(bank: DataFrame, priority: DataFrame) -> DataFrame:
    """Bank entries whose own priority gives way to the configured one (field, sources), where there is one."""
    return bank.join(priority.select("field", "sources"), "field", "left").withColumn("priority", F.coalesce("sources", "priority")).drop("sources")


def spec_owners(spec: DataFrame) -> DataFrame:
    """spec (field, properties array) -> (property, fields): the fields that own each property, by name."""
    each = spec.select("field", F.explode("properties").alias("property")).distinct()
    return each.groupBy("property").agg(F.sort_array(F.collect_list("field")).alias("fields"))


def token_rows(bank: DataFrame, most: int = 200) -> DataFrame:
    """bank (kind, field, retrieval) -> (tokens, chars, terms, kind, field, long, place) of its passages, the longest first: a range sort, whose
    partitions are counted, so the places don't come from one task."""
    passage = F.coalesce("retrieval.hypothetical_passage", F.lit(""))
    kind = F.col("kind") if "kind" in bank.columns else F.lit("")
    rows = bank.select(token_estimate(passage).alias("tokens"), F.length(passage).alias("chars"), F.coalesce(F.when(F.col("retrieval.bm25_terms").isNotNull(), F.size("retrieval.bm25_terms")), F.lit(0)).alias("terms"), kind.alias("kind"), "field")
    ordered = numbered(rows, *(F.desc(c) for c in ("tokens", "chars", "terms", "kind", "field")))
    return ordered.select("tokens", "chars", "terms", "kind", "field", (F.col("tokens") > most).alias("long"), F.col("seq").alias("place"))


def token_audit(bank: DataFrame) -> DataFrame:
    """(least, middle, most, entries) of the passages' token estimates: the last, the middle (of n, number n // 2 from 0) and the first of ``token_rows``."""
    rows = token_rows(bank)
    n = rows.count()
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("tokens")))
    return rows.agg(at(n).alias("least"), at(n // 2 + 1).alias("middle"), at(1).alias("most"), F.count(F.lit(1)).alias("entries"))
