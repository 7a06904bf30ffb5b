"""Bills, searches, audits and checkpoints over the driver's tables, with inputs on which their choices matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import fields, graph
from ledgerloom.operators.scratch import fresh_path
from ledgerloom.plans import bom
from ledgerloom.plans.driver_tables import table
from ledgerloom.queries import _query
from ledgerloom.sources import batch, config


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three sources of each supplier with a heading and up to three texts. For two thirds the hub's licence is another; of half
    of these the other sources have one text each, so that fewer than three would be left without the hub."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("artifact_id"), F.col("s_suppkey").alias("k"))
    said = F.when((F.col("source") == "hub") & (F.col("k") % 3 != 1), "license: GPL-3.0").otherwise("license: MIT License")
    each = s.withColumn("source", F.explode(F.array(*map(F.lit, ("hub", "paper", "repo"))))).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    each = each.where((F.col("k") % 3 != 2) | (F.col("source") == "hub") | F.col("chunk_index").isin(0, 3))
    text = F.when(F.col("chunk_index") == 3, "# License").otherwise(F.concat(said, F.repeat(F.lit(" and more words"), F.col("chunk_index"))))
    chunks = each.select("artifact_id", "source", "chunk_index", text.alias("text"), F.array(F.lit(1.0), F.col("chunk_index").cast("double")).cast("array<float>").alias("embedding"))
    q = s.select("artifact_id", F.lit("license").alias("field"), F.lit("what is the license").alias("question"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.array(F.lit("license:")).alias("terms"), F.lit("normalize_license").alias("post_process"))
    return chunks, q, spark.createDataFrame([("license", "hub", 0), ("license", "paper", 1), ("license", "repo", 2)], "field string, source string, ord int")


@_query("""
with s as (select s_suppkey % 3 as k, cast(s_suppkey as varchar) as artifact_id from supplier)
select artifact_id, case when k = 2 then 'GPL-3.0' else 'MIT' end as value, case when k = 0 then 'paper' else 'hub' end as source, case when k <> 2 then 'MIT License' end as raw_answer,
  case when k <> 1 then 'Yes: GPL-3.0 or MIT License; GPL-3.0 or MIT License' end as external, case k when 0 then 'paper,repo' else 'hub,paper,repo' end as selected,
  case when k = 1 then 'MIT License' else 'GPL-3.0' end as hub_claim, 'Org ' || artifact_id as supplier, cast(null as varchar) as supplier_claims from s""")
def build_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills of direct and inferred fields, as a wide view: headings are ranked and then left out, the audit drops a source, unless too few
    chunks would be left."""
    chunks, q, order = _sources(spark, sf_dir)
    claims = q.select("artifact_id", F.lit("suppliedBy").alias("field"), F.lit("hub").alias("source"), F.lit(0).alias("ord"), F.concat(F.lit("Org "), "artifact_id").alias("value"))
    out = fields.wide(bom.build(claims, "ai", questions=q, chunks=chunks, source_order=order), ["license", "suppliedBy"])
    external = F.array_join(F.transform("license_external_conflicts", lambda x: x["description"]), "; ")
    return out.select(
        "artifact_id", F.col("license").alias("value"), F.col("license_source").alias("source"), F.col("license_raw_answer").alias("raw_answer"), F.when(external != "", F.concat(F.lit("Yes: "), external)).alias("external"),
        F.array_join("license_selected_sources", ",").alias("selected"), F.col("license_claims")["hub"].alias("hub_claim"), F.col("suppliedBy").alias("supplier"), F.to_json("suppliedBy_claims").alias("supplier_claims"),
    )


_NAMED = """
with c as (select 'ai' as kind, 'Model ' || p_name || ' number ' || p_partkey as name, 'org/m' || p_partkey as identifier, p_partkey as pos from part), q as (
  select p_partkey as k, case p_partkey % 5 when 0 then 'model ' || p_name || ' nunber ' || p_partkey when 1 then ' MODEL ' || p_name || ' number ' || p_partkey when 2 then 'a/b' || p_partkey when 3 then 'Modell ' || p_name || ' Number ' || p_partkey else 'unlike ' || p_partkey end as target from part)"""


@_query(
    _NAMED
    + """, grams as (select 'c' as side, identifier as id, pos, list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) as g from (select *, '  ' || lower(trim(name)) || ' ' as n from c)
  union all select 'q', cast(k as varchar), k, list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) from (select *, '  ' || lower(trim(target)) || ' ' as n from q where k % 5 <> 2)),
each as (select side, id, pos, len(g) as n, unnest(g) as gram from grams),
met as (select a.id as k, b.id as identifier, b.pos, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb from each a join each b on a.gram = b.gram where a.side = 'q' and b.side = 'c' group by a.id, b.id, b.pos),
best as (select cast(k as bigint) as k, arg_min(identifier, (-common / (na + nb - common), pos)) as identifier from met where common / (na + nb - common) >= 0.6 group by k)
select q.k, q.target, case when q.k % 5 = 2 then q.target else best.identifier end as identifier from q left join best using (k)"""
)
def identifier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name as somebody might write it, searched in the catalog of all: with a letter wrong or too many, in capitals, as an identifier, or unlike all."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    catalog = p.select(F.lit("ai").alias("kind"), F.concat(F.lit("Model "), "p_name", F.lit(" number "), key).alias("name"), F.concat(F.lit("org/m"), key).alias("identifier"), F.col("p_partkey").alias("pos"))
    forms = [F.concat(F.lit("model "), "p_name", F.lit(" nunber "), key), F.concat(F.lit(" MODEL "), "p_name", F.lit(" number "), key), F.concat(F.lit("a/b"), key), F.concat(F.lit("Modell "), "p_name", F.lit(" Number "), key), F.concat(F.lit("unlike "), key)]
    nodes = p.select(F.col("p_partkey").alias("k"), F.lit("ai").alias("kind"), F.element_at(F.array(*forms), (F.col("p_partkey") % 5 + 1).cast("int")).alias("target"))
    return graph.resolve_names(nodes, catalog, least=0.6).select("k", "target", "identifier")


@_query("""
with n as (select max(o_orderkey) as n from orders)
select o_orderkey as row_index, case when o_orderkey % 2 = 0 or o_orderkey > 2 * n // 3 then 'ok' else 'again' end as status,
  case when o_orderkey > 2 * n // 3 then 'third' when o_orderkey >= n // 3 then 'second' else 'first' end as payload from orders, n where not (o_orderkey between n // 3 and 2 * n // 3 and o_orderkey % 5 = 0)""")
def checkpoint_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's first batch holds all orders; a second takes the place of the middle third and lacks some of it, a third that of the last.
    A fourth was written but never committed, and another run's rows don't count."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"))
    path, n = fresh_path(spark, "checkpoint"), o.agg(F.max("row_index")).first()[0]
    status = F.when(F.col("row_index") % 2 == 0, "ok").otherwise("again")
    rows = lambda lo, hi, payload, status: o.where(F.col("row_index").between(lo, hi)).select("row_index", status.alias("status"), F.lit(payload).alias("payload"))
    batch.append_checkpoint(rows(0, n, "first", status), path, "run", (0, n))
    batch.append_checkpoint(rows(0, n, "other", status), path, "other")
    batch.append_checkpoint(rows(n // 3, 2 * n // 3, "second", status).where("row_index % 5 <> 0"), path, "run", (n // 3, 2 * n // 3))
    batch.append_checkpoint(rows(2 * n // 3 + 1, n, "third", F.lit("ok")), path, "run", (2 * n // 3 + 1, n))
    batch.write_part(rows(0, n, "lost", status), path)
    return batch.read_checkpoint(spark, path, "run").select("row_index", "status", "payload")


@_query("""
select 'f' || p_partkey as field, p_partkey % 5 = 0 as kept, case p_partkey % 5 when 1 then 'no JSON' when 2 then 'no object' when 3 then 'missing description, keywords' when 4 then 'missing question' end as reason,
  case when p_partkey % 5 = 0 then p_name end as summary from part""")
def bank_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in all states: whole, broken, no object, and lacking what they need; each is either kept or rejected."""
    name = F.regexp_replace("p_name", '"', "")
    whole = F.concat(F.lit('{"question":"q","keywords":"k","description":null,"summary":"'), name, F.lit('"}'))
    forms = F.array(whole, F.lit('{"question": '), F.lit('["question", "keywords"]'), F.lit('{"question":"q"}'), F.lit('{"keywords":"k","description":"d"}'))
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field"), F.element_at(forms, (F.col("p_partkey") % 5 + 1).cast("int")).alias("value"))
    kept, rejected = config.bank_entries(texts)
    return kept.select("field", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason"), "summary").unionByName(rejected.select("field", F.lit(False).alias("kept"), "reason", F.lit(None).cast("string").alias("summary")))


_AUDITED = """
with t as (select cast(floor(length(p_type || p_name) / 3.5) as integer) as tokens, length(p_type || p_name) as chars, cast(p_partkey % 4 as integer) as terms, case when p_partkey % 2 = 0 then 'ai' else 'data' end as kind, 'f' || p_partkey as field from part)"""


@_query(_AUDITED + " select *, tokens > 4 as long, row_number() over (order by tokens desc, chars desc, terms desc, kind desc, field desc) as place from t")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of a bank from the longest down."""
    return config.token_rows(_passages(spark, sf_dir), most=4)


@_query(_AUDITED + " select min(tokens) as least, list_sort(list(tokens), 'desc')[cast(count(*) // 2 as integer) + 1] as middle, max(tokens) as most, count(*) as entries from t")
def token_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.token_audit(_passages(spark, sf_dir))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    terms = F.when(F.col("p_partkey") % 4 > 0, F.array_repeat(F.lit("t"), (F.col("p_partkey") % 4).cast("int"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "ai").otherwise("data")
    return p.select(kind.alias("kind"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field"), F.struct(F.concat("p_type", "p_name").alias("hypothetical_passage"), terms.alias("bm25_terms")).alias("retrieval"))
