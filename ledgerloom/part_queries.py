"""The smaller operators over the driver's tables, in groups, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.functions import text as tx
from ledgerloom.functions.licenses import license_similarity
from ledgerloom.functions.links import link_fits, link_in_text, model_name
from ledgerloom.operators import fields, graph, retrieval, routing, validate
from ledgerloom.operators.resolve import resolve
from ledgerloom.plans import bom, cyclonedx, spdx
from ledgerloom.plans import driver_tables as dt
from ledgerloom.plans.driver_tables import table
from ledgerloom.queries import _RESOLVED, _query
from ledgerloom.sources import batch, catalog, config, metadata


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", F.col("p_partkey").cast("string").alias("k"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) and not p.startswith("p_") and p != "k" else F.col(p) for p in parts))


@_query("""
select p_partkey, p_name || ' x' as collapsed, '{"k": ' || p_partkey || '}' as envelope, case when length(p_name || p_type) > 10 then substr(p_name || p_type, 1, 10) || chr(10) || chr(10) || '[... Content truncated at 10 characters ...]' else p_name || p_type end as cut,
  cast(floor(length(p_name) / 3.5) as integer) as tokens, p_name as answer, 'No' as status, '{k} of ' || p_name as filled from part""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space, JSON in answers, truncation, token estimates, marked answers and templates."""
    said = _text("ANSWER: ", "p_name", "\nCONFLICT_STATUS: No")
    return _part(spark, sf_dir).select(
        "p_partkey", fn.collapse_whitespace(_text(" \t", "p_name", " \n  x ")).alias("collapsed"), fn.json_envelope(_text('so: ```json\n{"k": ', "k", "}\n``` end")).alias("envelope"),
        fn.truncated(_text("p_name", "p_type"), 10).alias("cut"), fn.token_estimate(F.col("p_name")).alias("tokens"), routing.marked_answer(said, "ANSWER").alias("answer"),
        routing.marked_answer(said, "CONFLICT_STATUS").alias("status"), fn.rendered(F.lit("{k} of {name}"), {"name": F.col("p_name")}).alias("filled"),
    )


@_query("""
select p_partkey, case p_partkey % 3 when 0 then 'org_m' || p_partkey when 1 then 'a_b' || p_partkey else 'dated_name' end as artifact, case p_partkey % 2 when 0 then 'o_d' || p_partkey else 'u_r' || p_partkey end as dataset,
  'm' || p_partkey as last_part, 'n' || p_partkey as model, p_partkey % 2 = 0 as fits, 'https://github.com/u/r' || p_partkey as link, case when p_partkey % 2 = 0 then 'fb' else 'org' || p_partkey end as org from part""")
def id_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of artifacts and datasets, last parts, model names, links in text and aliases of organisations."""
    odd = F.col("p_partkey") % 2 == 1
    return _part(spark, sf_dir).select(
        "p_partkey", fn.artifact_key(F.when(F.col("p_partkey") % 3 == 0, _text("org/m", "k")), F.when(F.col("p_partkey") % 3 == 1, _text("https://x.org/a/b", "k", "?q=1")), F.lit("dated name")).alias("artifact"),
        fn.dataset_key(F.when(~odd, _text("https://huggingface.co/datasets/o/d", "k")), _text("https://github.com/u/r", "k", "/tree")).alias("dataset"), fn.last_segment(_text("a/b/m", "k", "/")).alias("last_part"),
        model_name(F.when(odd, _text("o/n", "k")), _text("https://x.org/o/n", "k", "#top")).alias("model"), link_fits(F.when(odd, _text("https://x.org/abs/", "k")).otherwise(_text("https://arxiv.org/abs/", "k")), "paper").alias("fits"),
        link_in_text(_text("see (github.com/u/r", "k", "), or not."), "repo").alias("link"), fn.normalize_org(F.when(odd, _text(" ORG", "k")).otherwise(F.lit("FacebookResearch ")), {"facebookresearch": "fb"}).alias("org"),
    )


@_query("""
select p_partkey, p_name || '|' || p_type as parts, 'value1=' || p_name || '|value2=' || p_type as entries, 'a=' || p_name as of_map, p_name || '|b' as of_list, p_name as of_values, 'text|other' as kinds, cast(null as double) as missing from part""")
def list_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in text, key-value entries of lists and maps, names of lists and maps, lists of enumerated values, numbers that aren't."""
    both = _text("p_name", " ;\n,", "p_type")
    pairs = lambda a: F.array_join(F.transform(a, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return _part(spark, sf_dir).select(
        "p_partkey", F.array_join(fn.split_list(both), "|").alias("parts"), pairs(fn.dictionary_entries(both)).alias("entries"), pairs(fn.map_entries(F.create_map(F.lit("a"), F.col("p_name")))).alias("of_map"),
        F.array_join(fn.named_in_list(F.array(F.concat(F.lit("- "), "p_name"), F.lit("b"), F.upper("p_name"), F.lit("N/A"))), "|").alias("of_list"), F.array_join(fn.named_in_map(F.create_map(F.lit("x"), F.col("p_name"), F.lit("y"), F.lit("unknown"))), "|").alias("of_values"),
        F.array_join(fn.normalize_enum_list(F.lit("TEXT, odd; text"), fn.DATASET_TYPES, "other"), "|").alias("kinds"), fn.clean_number(F.lit(float("nan"))).alias("missing"),
    )


@_query("""
select o_orderkey, strftime(case when o_orderkey % 4 = 3 then cast(o_orderdate as timestamp) + interval 22 hour else cast(o_orderdate as timestamp) end, '%Y-%m-%d %H:%M:%S') as at from orders""")
def dates_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of four spellings, one of them with an offset."""
    d = F.col("o_orderdate")
    said = F.element_at(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "dd-MM-yyyy"), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T20:00:00-02:00"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(fn.parse_date(said), "yyyy-MM-dd HH:mm:ss").alias("at"))


@_query("""
select p_partkey, p_name || chr(10) || chr(10) || chr(10) || 'one two (3) ok' as page, case p_partkey % 4 when 0 then '## Abstract of it' when 1 then '### ' || p_name when 2 then '*' || p_name || '*' else p_name end as block,
  '---' || chr(10) || p_name || chr(10) || '---' || chr(10) || p_type || chr(10) || '---' as context, '# Hub Source' || chr(10) || chr(10) || p_name as title, '## A|### b' as headers from part""")
def text_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of PDFs without scraps, styled blocks, contexts of answers, titles of sources, header lines."""
    n = F.col("p_partkey") % 4
    scraps = _text("p_name", "\n12\n 12 345 \n\n\n\n\nab\none  two\t(3) †ok")
    return _part(spark, sf_dir).select(
        "p_partkey", tx.pdf_lines(scraps).alias("page"), tx.block_style(F.when(n == 0, "Abstract of it").otherwise(F.col("p_name")), F.when(n == 0, 13.0).otherwise(10.0), n == 1, n == 2).alias("block"),
        tx.answer_context(F.array(F.concat(F.lit(" "), "p_name"), F.concat("p_type", F.lit("\n")))).alias("context"), tx.markdown(_text("\r\n", "p_name", " "), F.lit("hUB")).alias("title"),
        F.array_join(tx.headers(F.lit("## A\nx\n ### b\n#no")), "|").alias("headers"),
    )


@_query("""
with c as (select p_partkey, p_partkey % 3 as n from part)
select p_partkey, cast(case n when 0 then 1.0 when 1 then 0.0 else 0.909091 end as double) as similarity from c""")
def licence_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    a = F.when(n == 0, "MIT License").when(n == 1, "").otherwise("own terms 1")
    return _part(spark, sf_dir).select("p_partkey", F.round(license_similarity(a, F.when(n == 2, "own terms 2").otherwise("mit")), 6).alias("similarity"))


def _hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    results = F.array(F.struct(F.array(F.struct(F.struct(_text("t", "k").alias("name"), none.cast("string").alias("type")).alias("dataset"))).alias("results")))
    card = F.struct(F.lit("mit").alias("license"), F.array(_text("d", "k"), F.lit("squad")).alias("datasets"), F.array(F.lit("base")).alias("base_model"), F.array(F.lit("qa")).alias("task_categories"), F.lit("gen").alias("pipeline_tag"), F.array(F.lit("src")).alias("source_datasets"), F.array(F.lit("crowd")).alias("annotations_creators"), F.array(F.lit("en")).alias("language"), F.array(F.lit("1K")).alias("size_categories"), results.alias("model_index"))
    return _part(spark, sf_dir).select(
        F.col("k").alias("artifact_id"), _text("org/m", "k").alias("id"), F.lit("org").alias("author"), F.lit("0123456789").alias("sha"), F.lit("2024-01-02").alias("last_modified"), F.lit("2023-01-01").alias("created_at"), (F.col("p_partkey") % 2 == 0).alias("private"),
        F.array(F.lit("x"), F.lit("dataset:squad"), F.lit("base_model:more")).alias("tags"), card.alias("card"), F.array(F.struct(F.lit(5).cast("long").alias("size")), F.struct(F.lit(7).cast("long").alias("size"))).alias("siblings"),
    )


@_query("""
with p as (select p_partkey, cast(p_partkey as varchar) as k from part), c as (
  select k, unnest([{f: 'releaseTime', v: '2024-01-02'}, {f: 'downloadLocation', v: 'https://huggingface.co/datasets/org/m' || k}, {f: 'primaryPurpose', v: 'qa'}, {f: 'license', v: 'mit'}, {f: 'builtTime', v: '2023-01-01'}, {f: 'originatedBy', v: 'org'},
    {f: 'name', v: 'org/m' || k}, {f: 'datasetAvailability', v: case when p_partkey % 2 = 0 then 'registration' else 'directDownload' end}, {f: 'contentIdentifier', v: '0123456789'}]) as e from p)
select k as artifact_id, e.f as field, 'hub' as source, 0 as ord, e.v as value from c""")
def hub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.hub_claims(_hub(spark, sf_dir), "data")


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select(
        F.col("k").alias("artifact_id"), _text("o/r", "k").alias("full_name"), F.lit("o").alias("owner"), F.col("p_name").alias("description"), F.lit(None).cast("string").alias("license"), F.lit("2024-02-02").alias("pushed_at"), F.lit("2020-02-02").alias("created_at"),
        _text("https://x.org/r", "k").alias("html_url"), F.when(F.col("p_partkey") % 2 == 0, "v1").otherwise("").alias("latest_release"), F.lit("v0").alias("first_tag"), F.lit("abc").alias("head_sha"), F.array(F.lit("t1"), F.lit("t2")).alias("topics"), F.lit("Python").alias("language"), F.lit("main").alias("default_branch"), F.col("p_size").cast("long").alias("size_kb"),
    )


@_query("""
with p as (select p_partkey, p_name, cast(p_partkey as varchar) as k from part), c as (
  select k, unnest([{f: 'releaseTime', v: '2024-02-02'}, {f: 'downloadLocation', v: 'https://x.org/r' || k}, {f: 'primaryPurpose', v: p_name}, {f: 'suppliedBy', v: 'o'}, {f: 'packageVersion', v: case when p_partkey % 2 = 0 then 'v1' else 'v0' end}]) as e from p)
select k as artifact_id, e.f as field, 'repo' as source, 1 as ord, e.v as value from c""")
def repository_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.repository_claims(_repos(spark, sf_dir), "ai")


@_query("""
select cast(p_partkey as varchar) as artifact_id, array_to_string(['# Hub record', 'license: mit', 'tags: x, dataset:squad, base_model:more', 'task_categories: qa', 'pipeline_tag: gen', 'base_model: base', 'datasets: d' || p_partkey || ', squad', 'source_datasets: src', 'annotations_creators: crowd', 'language: en', 'size_categories: 1K', 'estimated_total_size_bytes: 12', '', p_name], chr(10)) as hub,
  array_to_string(['# Repository record', 'description: ' || p_name, 'topics: t1, t2', 'language: Python', 'default_branch: main', 'repository_size_bytes: ' || p_size * 1024], chr(10)) as repo from part""")
def record_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    readme = _part(spark, sf_dir).select(F.col("k").alias("artifact_id"), F.col("p_name").alias("text"))
    hub = metadata.with_readme(metadata.hub_prose(_hub(spark, sf_dir), "data"), readme).withColumnRenamed("text", "hub")
    return hub.join(metadata.repository_prose(_repos(spark, sf_dir), "data").withColumnRenamed("text", "repo"), "artifact_id")


@_query("select cast(p_partkey as varchar) as artifact_id, 'd' || p_partkey || '|squad' as trained_on, 'base|more' as lineage, 't' || p_partkey as tested_on from part")
def model_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = metadata.model_tree(_hub(spark, sf_dir))
    return tree.select("artifact_id", *(F.array_join(c, "|").alias(c) for c in ("trained_on", "lineage", "tested_on")))


@_query("""
select p_partkey, case when p_partkey % 3 = 0 then 'model' when p_partkey % 3 = 1 then 'dataset' end as found_as, case when p_partkey % 3 < 2 then p_name end as name, case when p_partkey % 2 = 0 then p_type end as readme from part""")
def artifact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with the records of their sources: models, else datasets, and what else was fetched."""
    p = _part(spark, sf_dir)
    artifacts = p.select(F.col("k").alias("artifact_id"), F.col("k").alias("hub_id"), _text("https://x.org/", "k").alias("repo_url"))
    record = lambda n: p.where(F.col("p_partkey") % 3 == n).select(F.col("k").alias("id"), F.col("p_name").alias("name"))
    repos = p.where("p_partkey % 2 = 0").select(_text("https://x.org/", "k").alias("url"), F.col("p_type").alias("readme"))
    met = metadata.model_or_dataset(metadata.with_sources(artifacts, {"repo": repos}), record(0), record(1))
    return met.select(F.col("artifact_id").cast("long").alias("p_partkey"), "found_as", F.col("record.name").alias("name"), F.col("repo.readme").alias("readme"))


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, text = F.col("p_partkey") % 2 == 0, lambda c: F.when(F.col("p_partkey") % 2 == 0, c)
    retrieval_ = F.struct(text(F.col("p_type")).alias("hypothetical_passage"), F.when(even, F.split(F.lit("a b c d e"), " ")).otherwise(F.array(F.lit("a"))).alias("bm25_terms"))
    extraction = F.struct(text(F.lit("do")).alias("instruction"), text(F.lit("spec")).alias("field_spec"), F.lit("guide").alias("output_guidance"))
    return _part(spark, sf_dir).select(_text("f", "k").alias("field"), _text("what is ", "k").alias("question"), F.lit("key words").alias("keywords"), F.col("p_name").alias("summary"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("post_process"), F.array(F.lit("own")).alias("priority"), retrieval_.alias("retrieval"), extraction.alias("extraction"))


@_query("""
select 'f' || p_partkey as field, case when p_partkey % 2 = 0 then p_type else p_name || chr(10) || chr(10) || p_type end as dense, case when p_partkey % 2 = 0 then 'a b c d e' else 'a' end as sparse,
  case when p_partkey % 2 = 0 then 'do' else 'what is ' || p_partkey end as instruction, case when p_partkey % 2 = 0 then 'spec' else p_name || chr(10) || chr(10) || p_type end as field_spec, 'guide' as output_guidance from part""")
def bank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.queries_of(_bank(spark, sf_dir)).drop("question", "described")


@_query("select 'f' || p_partkey as field, unnest(['too few terms', 'no instruction', 'no field_spec']) as violation from part where p_partkey % 2 = 1")
def bank_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.bank_violations(_bank(spark, sf_dir))


@_query("""
with m as (select p_partkey, p_partkey % 3 = 0 as mapped, p_partkey % 2 = 0 as given from part)
select (select count(*) from m) as entries, (select count(*) from m where mapped) as mapped, (select count(*) from m where not mapped) as internal, (select count(*) from m where p_partkey % 5 = 0) as changed, (select count(*) from m where given) as given""")
def bank_and_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a master bank, entries that differ from the specification, and entries whose priority is configured."""
    bank = _bank(spark, sf_dir)
    n = F.substring("field", 2, 20).cast("long")
    priority = bank.where(n % 2 == 0).select("field", F.array(F.lit("repo")).alias("sources"))
    spec = bank.where(n % 3 == 0).select("field", F.col("summary").alias("name"), F.lit("u").alias("url"))
    counts = config.master_counts(config.master_bank(bank, priority, spec))
    text = bank.select("field", F.when(n % 5 == 0, "new").otherwise(F.col("summary")).alias("summary"), "description")
    changed = config.bank_changes(bank, text).where("summary = 'new'").agg(F.count("*").alias("changed"))
    given = config.with_priority(bank, priority).where(F.element_at("priority", 1) == "repo").agg(F.count("*").alias("given"))
    return counts.crossJoin(F.broadcast(changed)).crossJoin(F.broadcast(given))


@_query("""
select 'f' || p_partkey as field, case p_partkey % 3 when 0 then 'paper' when 1 then 'repo,hub' else 'repo,hub' end as sources from part""")
def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the field, else of its section's default."""
    asked = _part(spark, sf_dir).select(F.lit("direct").alias("section"), _text("f", "k").alias("field"), "p_partkey")
    own = asked.where("p_partkey % 3 = 0").select("section", "field", F.array(F.lit("paper")).alias("sources"))
    default = spark.createDataFrame([("direct", "default", ["repo", "hub"])], own.schema)
    return config.lookup(asked.drop("p_partkey"), own.unionByName(default)).select("field", F.array_join("sources", ",").alias("sources"))


@_query("select p_size as property, string_agg('f' || p_partkey, ',' order by 'f' || p_partkey) as fields from part group by p_size")
def property_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _part(spark, sf_dir).select(_text("f", "k").alias("field"), F.array("p_size", "p_size").alias("properties"))
    return config.spec_owners(spec).select("property", F.array_join("fields", ",").alias("fields"))


@_query("""
with t as (select cast(floor(length(p_type) / 3.5) as integer) as n from part where p_partkey % 2 = 0)
select min(n) as least, list_sort(list(n), 'desc')[cast(count(*) // 2 as integer) + 1] as middle, max(n) as most, count(*) as entries from t""")
def passage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.token_audit(_bank(spark, sf_dir).where("retrieval.hypothetical_passage is not null"))


@_query(
    _RESOLVED
    + """ select artifact_id, coalesce(value, 'Not found') as activity, coalesce(source, 'N/A') as activity_sources, 'Not found' as absent, 'N/A' as absent_sources from resolved"""
)
def batch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.triplets(resolve(dt.event_claims(spark, sf_dir)), "direct")
    return batch.csv_row(fields.wide(rows, ["activity", "absent"]), ["activity", "absent"])


@_query(
    _RESOLVED
    + """ select artifact_id, 'ai' as kind, cast(1 as bigint) as filled, value, value as in_document, value as in_view from resolved"""
)
def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch records, provenance documents and numbers of filled fields of the same bills."""
    rows = fields.triplets(resolve(dt.event_claims(spark, sf_dir)), "direct")
    record = batch.batch_records(rows, "ai").select("artifact_id", "record.kind", F.col("record.filled").alias("filled"), F.col("record.sections")["direct"]["activity"]["value"].alias("value"))
    document = fields.documents(rows).select("artifact_id", F.get_json_object("json", "$.direct.activity.value").alias("in_document"))
    filled = fields.count_filled(rows).where("filled = 1 and fields = 1").select("artifact_id")
    view = fields.wide(rows, ["activity"]).select("artifact_id", F.col("activity").alias("in_view"))
    return record.join(document, "artifact_id").join(view, "artifact_id").join(filled, "artifact_id", "left_semi")


@_query("""
select p_partkey, case p_partkey % 4 when 0 then 'MIT' when 1 then p_name || ' x' when 2 then p_name || ', b' else ' ' || p_name end as value from part""")
def post_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    value = F.when(n == 0, "mit license").when(n == 1, _text("p_name", "  x")).when(n == 2, _text("- ", "p_name", "; b")).otherwise(_text(" ", "p_name"))
    name = F.element_at(F.array(*map(F.lit, ["normalize_license", "collapse_whitespace", "dedupe_named_entities", "none of these"])), (n + 1).cast("int"))
    return _part(spark, sf_dir).select("p_partkey", fields.post_process(value, name).alias("value"))


@_query("""
select p_partkey, ['Safety & Compliance', 'Complete AI BOM', 'License Compliance', 'Complete AI BOM'][p_partkey % 4 + 1] as ai, ['Safety & Bias', 'Complete Data BOM', 'License & Rights', 'Complete Data BOM'][p_partkey % 4 + 1] as data from part""")
def preset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit(" Safety"), F.lit("odd"), F.lit("license"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _part(spark, sf_dir).select("p_partkey", fields.preset_label(name, "ai").alias("ai"), fields.preset_label(name, "data").alias("data"))


@_query("""
select p_partkey, case when p_partkey % 3 <> 0 then 'u' || p_partkey end as link, p_partkey % 3 = 1 as link_warning from part""")
def rejected_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected links go if they were discovered, and are warned of if they were given."""
    n = F.col("p_partkey") % 3
    rows = _part(spark, sf_dir).select("p_partkey", _text("u", "k").alias("link"), F.struct((n < 2).alias("rejected"), (n == 0).alias("discovered")).alias("status"))
    return fields.with_links(rows, {"link": "status"}).drop("status")


@_query("""
select cast(c_custkey as varchar) as doc_id, 'AIPackage,Bom,CreationInfo,LicenseExpression,Organization,Person,SpdxDocument' as elements, cast(case when c_custkey % 2 = 0 then 5 else 2 end as bigint) as edges, cast(case when c_custkey % 2 = 0 then 14 else 8 end as bigint) as with_info from customer""")
def spdx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by type, edges, and references to the creation info in the rendered documents."""
    c = table(spark, sf_dir, "customer")
    some = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("trainedOnDatasets"), F.lit("d1, D1, d2"), F.lit("modelLineage"), F.lit("base"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = c.select(F.col("c_custkey").cast("string").alias("artifact_id"), F.col("c_name").alias("name"), some.alias("fields"))
    nodes, edges = spdx.documents(rows, "ai", F.lit("2024-01-01T00:00:00Z"))
    main = nodes.where(F.col("node_id").rlike("-[0-9a-f]{40}$") & ~F.get_json_object("payload", "$.name").isin("d1", "d2", "base") | F.get_json_object("payload", "$.name").isNull())
    kinds = main.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.element_at(F.split("type", "_"), -1))), ",").alias("elements"))
    counted = edges.groupBy("doc_id").agg(F.count("*").alias("edges"))
    info = spdx.rendered(nodes, edges).select("doc_id", F.regexp_count("json", F.lit('"creationInfo":"urn:spdx:CreationInfo-')).cast("long").alias("with_info"))
    return kinds.join(counted, "doc_id").join(info, "doc_id")


@_query("""
select cast(c_custkey as varchar) as doc_id, 'CycloneDX' as format, '1.7' as version, c_name as name, 'machine-learning-model' as type, 'MIT' as license, 'base' as ancestor, 'd1' as dataset, 'nlp' as description from customer""")
def cyclonedx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.create_map(*(F.lit(x) for x in ("license", "MIT", "modelLineage", "base", "trainedOnDatasets", "d1, d2", "informationAboutApplication", "nlp")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("artifact_id"), F.col("c_name").alias("name"), some.alias("fields"), F.create_map().cast("map<string,string>").alias("conflicts"))
    j = lambda p: F.get_json_object("json", p)
    c = "$.components[0]"
    return cyclonedx.documents(rows, "ai", F.lit("2024-01-01T00:00:00Z")).select(
        "doc_id", j("$.bomFormat").alias("format"), j("$.specVersion").alias("version"), j(f"{c}.name").alias("name"), j(f"{c}.type").alias("type"), j(f"{c}.licenses[0].license.id").alias("license"),
        j(f"{c}.pedigree.ancestors[0].name").alias("ancestor"), j(f"{c}.modelCard.modelParameters.datasets[0].name").alias("dataset"), j(f"{c}.description").alias("description"),
    )


@_query("""
select c_custkey, c_custkey % 7 <> 0 as valid, case c_custkey % 7 when 0 then 'wrong specVersion' else '' end as errors, cast(case when c_custkey % 5 = 0 then 1 else 0 end as integer) as of_cyclonedx from customer""")
def validated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of documents with a planted fault in every seventh, and the CycloneDX rules with one in every fifth."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), "c_custkey")
    none, text = F.lit(None).cast("array<string>"), lambda x: F.lit(x).cast("string")
    node = lambda i, kind, spec=None, created=None, by=none, profiles=none, roots=none: F.struct(F.lit(i).alias("node_id"), F.lit(kind).alias("type"), (text(spec) if not hasattr(spec, "cast") else spec).alias("spec_version"), text(created).alias("created"), by.alias("created_by"), profiles.alias("profiles"), roots.alias("roots"))
    one = lambda x: F.array(F.lit(x))
    spec = F.when(F.col("c_custkey") % 7 == 0, "2.3").otherwise("3.0.1")
    four = F.array(node("c", "CreationInfo", spec, "2024-01-01T00:00:00Z", one("p")), node("s", "SpdxDocument", profiles=one("core"), roots=one("b")), node("b", "Bom", profiles=one("core")), node("k", "ai_AIPackage"))
    nodes = c.select("doc_id", F.explode(four).alias("n")).select("doc_id", "n.*")
    refs = c.select("doc_id", F.lit("from").alias("role"), F.lit("k").alias("to_id"))
    docs = c.select("doc_id", F.lit("ai").alias("kind"), F.lit(True).alias("has_context"), F.lit(True).alias("has_graph"))
    found = validate.status(docs, validate.violations(nodes, refs, docs, True), True)
    cyclone = c.select("doc_id", F.lit("CycloneDX").alias("format"), F.when(F.col("c_custkey") % 5 == 0, "2").otherwise("1.7").alias("spec_version"), F.lit("urn:uuid:x").alias("serial"), F.lit("data").alias("component_type"), F.lit("n").alias("component_name"))
    wrong = validate.cyclonedx_errors(cyclone).select("doc_id", F.size("errors").alias("of_cyclonedx"))
    return found.join(wrong, "doc_id").select(F.col("doc_id").cast("long").alias("c_custkey"), "valid", F.array_join("errors", ",").alias("errors"), "of_cyclonedx")


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's lineage is the part of half its number; every third part was trained on a dataset, contested for every ninth."""
    p = _part(spark, sf_dir)
    conflict = F.when(F.col("p_partkey") % 9 == 0, fields.conflict(F.lit("x"), F.lit("repo"))).otherwise(F.lit(None).cast(fields.CONFLICT))
    lineage = p.where("p_partkey > 1").select(F.concat(F.lit("m"), "k").alias("parent"), F.lit("modelLineage").alias("field"), F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("value"), F.lit(None).cast(fields.CONFLICT).alias("conflict"))
    data = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("m"), "k").alias("parent"), F.lit("trainedOnDatasets").alias("field"), F.concat(F.lit("d"), "k").alias("value"), conflict.alias("conflict"))
    return lineage.unionByName(data)


_TREE = """
with recursive top as (select max(p_partkey) as n from part), up as (select n, 0 as depth from top union all select n // 2, depth + 1 from up where n > 1 and depth < 6),
models as (select 'm' || n as target, depth, 'dependsOn' as relation, 'ai' as kind, 'm' || lag(n) over (order by depth) as parent, true as enriched from up),
found as (select * from models where depth between 1 and 6 union all select 'd' || n, depth + 1, 'trainedOn', 'data', 'm' || n, false from up where n % 3 = 0 and n % 9 <> 0 and depth < 6)"""


@_query(_TREE + " select cast(depth as integer) as depth, relation, target, kind, parent, case when target = 'm1' then false else enriched end as enriched from found")
def lineage_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _part(spark, sf_dir).agg(F.concat(F.lit("m"), F.max("p_partkey").cast("string")).alias("parent"))
    return graph.recursive_walk(top, _lineage(spark, sf_dir), 6, 50)["nodes"].select("depth", "relation", "target", "kind", "parent", "enriched")


@_query(
    _TREE
    + """ select (select count(*) from found) as generated, (select cast(max(depth) as integer) from found) as deepest, (select min(n) from up) <= 1 as exhausted, (select count(*) from up where n % 9 = 0) as contested, (select count(*) from found) + 1 as visited, (select count(*) from found where enriched and target <> 'm1') as enriched,
  (select count(*) from found) * 4 as seeds, (select count(*) from found where kind = 'ai') as resolved"""
)
def walk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a walk went, what was contested and visited, how many children are enriched, seeded and resolved by name."""
    top = _part(spark, sf_dir).agg(F.concat(F.lit("m"), F.max("p_partkey").cast("string")).alias("parent"))
    out = graph.recursive_walk(top, _lineage(spark, sf_dir), 6, 50)
    known = _part(spark, sf_dir).select(F.lit("ai").alias("kind"), F.concat(F.lit("M"), "k").alias("name"), F.concat(F.lit("org/m"), "k").alias("identifier"), F.col("p_partkey").alias("pos"))
    one = [
        out["summary"], out["skipped"].agg(F.count_if(F.col("reason") == "conflict").alias("contested")), out["visited"].agg(F.count("*").alias("visited")), graph.enriched_count(out["nodes"]).select("enriched"),
        graph.seed_children(out["nodes"]).agg(F.count("*").alias("seeds")), graph.resolve_names(out["nodes"], known).agg(F.count("identifier").alias("resolved")),
    ]
    found = one[0]
    for x in one[1:]:
        found = found.crossJoin(F.broadcast(x))
    return found


def _bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A parent with a stub for every tenth customer; the children are the customers' orders' documents, each with shared parts of its own."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    shared = lambda d: F.array(*(F.struct(F.concat(d, F.lit(x)).alias("node_id"), F.lit(t).alias("type"), F.lit(None).cast("string").alias("name")) for x, t in (("/i", "CreationInfo"), ("/o", "Organization"))))
    schema = "doc_id string, node_id string, type string, name string"
    parent = spark.createDataFrame([("p", "p/i", "CreationInfo", None), ("p", "p/o", "Organization", None), ("p", "root", "ai_AIPackage", "root")], schema)
    stubs = c.where("c_custkey % 10 = 0").select(F.lit("p").alias("doc_id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("dataset_DatasetPackage").alias("type"), F.col("c_name").alias("name"))
    edges = stubs.select(F.concat(F.lit("e"), "node_id").alias("edge_id"), F.lit("trainedOn").alias("rel_type"), F.lit("root").alias("from_id"), F.col("node_id").alias("to_id"))
    d = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    package = F.array(F.struct(d.alias("node_id"), F.lit("ai_AIPackage").alias("type"), d.alias("name")))
    kids = o.select(d.alias("doc_id"), F.explode(F.concat(shared(d), package)).alias("n")).select("doc_id", "n.*")
    own = o.select(d.alias("doc_id"), F.concat(F.lit("k"), d).alias("edge_id"), F.lit("suppliedBy").alias("rel_type"), d.alias("from_id"), F.concat(d, F.lit("/o")).alias("to_id"))
    links = o.select(F.lit("dependsOn").alias("rel_type"), F.lit("unknown parent").alias("from_name"), d.alias("to_name"), F.lit(1).alias("depth")).unionByName(stubs.where("name like '%00'").select(F.lit("trainedOn").alias("rel_type"), F.lit("root").alias("from_name"), F.col("name").alias("to_name"), F.lit(1).alias("depth")))
    return graph.link_bundle(parent.unionByName(stubs), edges, kids, links, own, "root")


@_query("""
select 'es' || c_custkey as edge_id, 'trainedOn' as rel_type, 'root' as from_id, 's' || c_custkey as to_id from customer where c_custkey % 10 = 0 and c_name not like '%00'
union all select 'ko' || o_orderkey, 'suppliedBy', 'o' || o_orderkey, 'p/o' from orders
union all select 'urn:spdx:Relationship-dependsOn-o' || o_orderkey || '-d1', 'dependsOn', 'root', 'o' || o_orderkey from orders""")
def bundle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(spark, sf_dir)[1]


@_query("""
with n as (select (select count(*) from customer where c_custkey % 10 = 0 and c_name not like '%00') as s, (select count(*) from orders) as o)
select 3 + s + o + s + 2 * o as node_count, o as recursive_edge_count, 1 as deepest, true as exhausted from n""")
def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = spark.createDataFrame([(1, True)], "deepest int, exhausted boolean")
    return graph.bundle_summary(*_bundle(spark, sf_dir), walked)


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two sources for each supplier, which disagree for every third; a question about its licence."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("artifact_id"), F.col("s_suppkey"))
    other = F.when(F.col("s_suppkey") % 3 == 0, "license: GPL-3.0").otherwise("license: mit")
    texts = F.array(F.struct(F.lit("hub").alias("source"), F.lit("license: MIT").alias("text")), F.struct(F.lit("repo").alias("source"), other.alias("text")))
    chunks = s.select("artifact_id", F.explode(texts).alias("t")).select("artifact_id", "t.source", F.lit(0).alias("chunk_index"), "t.text", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    q = s.select("artifact_id", F.lit("license").alias("field"), F.lit("what is the license").alias("question"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.array(F.lit("license:")).alias("terms"), F.lit("normalize_license").alias("post_process"))
    return chunks, q, spark.createDataFrame([("license", "hub", 0), ("license", "repo", 1)], "field string, source string, ord int")


@_query("""
select cast(s_suppkey as varchar) as artifact_id, 'inferred' as section, 'license' as field, 'MIT' as value, 'hub' as source, case when s_suppkey % 3 = 0 then 'Yes: MIT or GPL-3.0' end as external, cast(null as varchar) as internal, 'MIT' as claim, cast(null as varchar) as raw_answer from supplier""")
def build_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval, detection, routing and answers; the audit's findings as conflict and trace. Few chunks are left, so all stay."""
    chunks, q, order = _chunks(spark, sf_dir)
    out = bom.inferred_fields(q, chunks, order)
    return out.select("artifact_id", "section", "field", "value", "source", "conflict.external", "conflict.internal", F.col("trace.claims")["hub"].alias("claim"), "raw_answer")


@_query("""
select cast(s_suppkey as varchar) as artifact_id, case when s_suppkey % 5 = 0 then 'Not found.' else 'MIT, and what follows makes this text longer than fifty characters' end as value, case when s_suppkey % 5 = 0 then '' else 'hub' end as source, cast(null as varchar) as conflict from supplier""")
def direct_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from whole sources; short ones are left out, and without any nothing is asked."""
    chunks, q, order = _chunks(spark, sf_dir)
    long = F.concat("text", F.lit(", and what follows makes this text longer than fifty characters"))
    texts = chunks.withColumn("text", F.when((F.col("source") == "hub") & (F.col("artifact_id").cast("long") % 5 != 0), long).otherwise(F.col("text")))
    return bom.direct_answers(texts, q, order).select("artifact_id", "value", "source", F.col("conflict.value").alias("conflict"))


@_query("""
select cast(s_suppkey as varchar) as artifact_id, 'hub,repo' as sources, cast(1 as bigint) as of_hub, 'A=hub,B=repo' as letters from supplier""")
def retrieved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources the retrieved chunks are from, and their letters."""
    chunks, q, order = _chunks(spark, sf_dir)
    ranked = retrieval.retrieve(q, chunks, order)
    used = retrieval.sources_used(ranked).select("artifact_id", F.array_join("sources", ",").alias("sources"), F.col("counts")["hub"].alias("of_hub"))
    groups = routing.groups(ranked, order).select("artifact_id", F.array_join(F.transform("groups", lambda g: F.concat(g["letter"], F.lit("="), g["source"])), ",").alias("letters"))
    return used.join(groups, "artifact_id")


@_query(
    """
with latest as (select user_id, event_id % 3 as ord, arg_max(event_type, (ts, event_id)) as value from events where user_id is not null group by all),
c as (select cast(user_id as varchar) as artifact_id, ord, value from latest), s as (select artifact_id, string_agg(['hub', 'repo', 'paper'][ord + 1] || ' — Yes', '; ' order by ord) as internal from c where length(value) = 4 group by artifact_id),
e as (select a.artifact_id, string_agg(a.value || ' or ' || b.value, '; ' order by a.ord, b.ord) as external from c a join c b on a.artifact_id = b.artifact_id and a.ord < b.ord where a.value <> b.value group by a.artifact_id)
select artifact_id, coalesce('Yes: ' || internal, 'No') as internal_conflict, coalesce('Yes: ' || external, 'No') as external_conflict from (select distinct artifact_id from c) left join s using (artifact_id) left join e using (artifact_id)"""
)
def conflict_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = routing.parse_report(dt.order_detector_reports(spark, sf_dir))
    return routing.legacy_strings(audits.withColumn("internal", F.map_from_entries(F.array_sort(F.transform(F.filter("letters", lambda x: F.map_contains_key("internal", x["source"])), lambda x: F.struct(x["source"].alias("key"), F.col("internal")[x["source"]].alias("value"))), lambda a, b: F.array_position(F.array(*map(F.lit, dt.SOURCES)), a["key"]).cast("int") - F.array_position(F.array(*map(F.lit, dt.SOURCES)), b["key"]).cast("int"))))).select("artifact_id", "internal_conflict", "external_conflict")


@_query("""
with m as (select s_suppkey as pos, case when s_suppkey % 4 = 0 then 's' || s_suppkey || ':free' else 's' || s_suppkey end as id, cast(floor(abs(s_acctbal)) as bigint) as length, s_suppkey % 4 = 0 or s_suppkey % 5 = 0 as free from supplier)
select 'whole' as catalog, pos, id, arg_min(id, (-length, pos)) filter (where free) over () as best from m union all select 'empty', 0, 'curated', 'none'""")
def catalog_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of all suppliers with its best free model, and the curated row of an empty catalog, whose default is the fallback."""
    key = F.col("s_suppkey").cast("string")
    price = F.when(F.col("s_suppkey") % 5 == 0, F.struct(F.lit("0").alias("prompt"), F.lit("0").alias("completion")))
    models = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key, F.when(F.col("s_suppkey") % 4 == 0, ":free").otherwise("")).alias("id"), F.col("s_name").alias("name"), F.floor(F.abs("s_acctbal")).cast("string").alias("context_length"), price.alias("pricing"), F.col("s_suppkey").alias("pos"))
    whole = catalog.or_curated(models, [("curated", "C", "1")]).select(F.lit("whole").alias("catalog"), "pos", "id", F.lit(catalog.default_model(models, "none")).alias("best"))
    empty = models.limit(0)
    return whole.unionByName(catalog.or_curated(empty, [("curated", "C", "1")]).select(F.lit("empty").alias("catalog"), "pos", "id", F.lit(catalog.default_model(empty, "none")).alias("best")))
