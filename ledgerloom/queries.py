"""Each operator over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.functions import text as tx
from ledgerloom.functions.licenses import license_in_text, normalize_license
from ledgerloom.operators import fields, graph, retrieval, routing, validate
from ledgerloom.operators.scratch import fresh_path, stored
from ledgerloom.operators.resolve import first_by_priority, prioritise, resolve, resolve_dates, resolve_fuzzy
from ledgerloom.plans import driver_tables as dt
from ledgerloom.plans.driver_tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_CLAIMS = """
with latest as (
  select user_id, event_id % 3 as ord, arg_max(event_type, (ts, event_id)) as value from events where user_id is not null group by all
), claims as (
  select cast(user_id as varchar) as artifact_id, 'activity' as field, ['hub', 'repo', 'paper'][ord + 1] as source, ord, value from latest
)"""
_RESOLVED = (
    _CLAIMS
    + """, ranked as (
  select *, lower(trim(value)) as norm, count(*) over (partition by artifact_id) as n, row_number() over (partition by artifact_id order by ord) as place,
    count(*) over (partition by artifact_id, lower(trim(value))) as same, row_number() over (partition by artifact_id, lower(trim(value)) order by ord) as nth from claims where value <> ''
), counted as (
  select *, (select count(distinct norm) from ranked r where r.artifact_id = ranked.artifact_id) as u from ranked
), marked as (
  select *, case when n = 3 and u = 2 then same = 2 and nth = 1 else place = 1 end as wins, case when u = 1 then false when n = 3 and u = 2 then same = 1 else place > 1 end as loses from counted
), resolved as (
  select artifact_id, any_value(field) as field, max(value) filter (where wins) as value, max(source) filter (where wins) as source,
    string_agg(source || ': ' || value, ', ' order by ord) filter (where loses) as conflict from marked group by artifact_id
)"""
)


@_query(_RESOLVED + " select * from resolved")
def resolve_priority_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(dt.event_claims(spark, sf_dir))


@_query(
    _CLAIMS
    + """ select artifact_id, field, arg_min(value, p) as value, arg_min(source, p) as source
from (select *, case source when 'paper' then 0 when 'hub' then 1 else 1000 + ord end as p from claims) group by all"""
)
def first_in_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = spark.createDataFrame([("activity", "paper", 0), ("activity", "hub", 1)], "field string, source string, ord int")
    return first_by_priority(prioritise(dt.event_claims(spark, sf_dir), priority))


def _dates(mode: str) -> str:
    best, gap = ("desc", "c.ts - o.ts") if mode == "latest" else ("asc", "c.ts - o.ts")
    return f"""
with d as (
  select user_id || ':' || event_type as artifact_id, 'seen' as field, event_id % 3 as ord, ['hub', 'repo', 'paper'][event_id % 3 + 1] as source, date_trunc('second', max(ts)) as ts from events group by all
), chosen as (
  select * from d qualify row_number() over (partition by artifact_id order by ts {best}, ord) = 1
), gaps as (
  select o.*, cast(abs(floor((epoch_us(c.ts) - epoch_us(o.ts)) / 86400000000.0)) as integer) as delta from chosen c join d o on c.artifact_id = o.artifact_id and c.source <> o.source
), far as (
  select * from gaps where delta > 7 qualify row_number() over (partition by artifact_id order by delta desc, ord) = 1
)
select c.artifact_id, c.field, strftime(c.ts, '%Y-%m-%d %H:%M:%S') as value, c.source, strftime(f.ts, '%Y-%m-%d %H:%M:%S') as conflict_value, f.source as conflict_source, f.delta as delta_days
from chosen c left join far f on c.artifact_id = f.artifact_id"""


@_query(_dates("latest"))
def date_window_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_dates(dt.event_dates(spark, sf_dir), "latest")


@_query(_dates("earliest"))
def date_window_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_dates(dt.event_dates(spark, sf_dir), "earliest")


@_query(r"""
with p as (select page_id, regexp_extract(trim(coalesce(url, '')), '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$', ['scheme', 'host', 'path', 'query']) as u from pages)
select page_id, case when u.scheme <> '' then lower(u.scheme) || ':' else '' end || case when regexp_replace(lower(u.host), '^www\.', '') <> '' then '//' || regexp_replace(lower(u.host), '^www\.', '') else '' end ||
  case when length(u.path) > 1 then regexp_replace(u.path, '/$', '') else u.path end || case when u.query <> '?' then u.query else '' end as url from p""")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.normalize_url(F.col("url")).alias("url"))


@_query(r"""
with p as (select page_id, list_filter(string_split(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '') as s from pages)
select page_id, case when len(s) >= 2 then s[1] || '/' || s[2] end as repo, case when len(s) >= 2 and not list_contains(s, 'datasets') then s[1] || '/' || s[2] when list_contains(s, 'datasets') and len(s) >= list_position(s, 'datasets') + 2
  then s[list_position(s, 'datasets') + 1] || '/' || s[list_position(s, 'datasets') + 2] end as hub_id, s[-1] as last_part from p""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fn.repository_path(u).alias("repo"), fn.hub_id(u).alias("hub_id"), F.try_element_at(fn.path_segments(u), F.lit(-1)).alias("last_part"))


_LICENSED = r"""
with found as (
  select doc_id, coalesce(nullif(regexp_extract(text, '(?i)licensed\s+under\s+(?:the\s+)?([A-Za-z0-9][^.\n,;(]{2,60}?)(?:\s+license)?[.\n,;]', 1), ''),
    nullif(regexp_extract(text, '(?i)released\s+under\s+(?:the\s+)?([A-Za-z0-9][^.\n,;(]{2,60}?)(?:\s+license)?[.\n,;]', 1), ''),
    nullif(regexp_extract(text, '(?i)distributed\s+under\s+(?:the\s+)?([A-Za-z0-9][^.\n,;(]{2,60}?)(?:\s+license)?(?:[.\n,;]|\z)', 1), ''),
    nullif(trim(regexp_extract(text, '(?im)^[-*\s]*license\s*[:\-]\s*([A-Za-z0-9][^\n,;(]{1,60})', 1)), '')) as stated from documents)
"""


@_query(_LICENSED + " select doc_id, trim(stated) as stated from found where stated is not null")
def license_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", license_in_text(F.col("text")).alias("stated")).where("stated is not null")


@_query("""
with n as (select p_partkey, ['MIT License', 'apache v2', 'GPLv3', 'the unlicense', 'Own Terms', 'cc by 4.0', ''][p_partkey % 7 + 1] as raw from part)
select p_partkey, case lower(raw) when 'mit license' then 'MIT' when 'apache v2' then 'Apache-2.0' when 'gplv3' then 'GPL-3.0' when 'the unlicense' then 'Unlicense' when 'cc by 4.0' then 'CC-BY-4.0' else lower(raw) end as license from n""")
def license_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["MIT License", "apache v2", "GPLv3", "the unlicense", "Own Terms", "cc by 4.0", ""]))
    return table(spark, sf_dir, "part").select("p_partkey", normalize_license(F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("license"))


@_query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) filter (where length(trim(line)) >= 5 and not regexp_full_match(line, '\s*(?:#+\s+.*|-{3,}|`{3,}.*|\|[\s\-:|]+\|)\s*')) as useful, count(*) as lines from l group by doc_id""")
def useful_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l"))
    return lines.select("doc_id", F.size(F.filter("l", lambda x: tx.useful(x))).cast("long").alias("useful"), F.size("l").cast("long").alias("lines"))


@_query()
def header_aware_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), "source", "text")
    return tx.chunks(texts).select("artifact_id", "source", "chunk_index", "chunk_size", F.sha2("text", 256).alias("sha256"))


_TERMS = ["the", "der", "mit", "license", "license", "error"]


@_query("""
with t as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as t from documents),
s as (select count(*) as n, avg(len(t)) as mean from t), q as (select term, count(*) as times from (select unnest(['the', 'der', 'mit', 'license', 'license', 'error']) as term) group by term),
w as (select doc_id, len(t) as length, unnest(t) as term from t), tf as (select doc_id, length, term, count(*) as tf from w where term in (select term from q) group by all),
d as (select term, count(*) as df from tf group by term)
select 0 as query_id, doc_id, round(sum(times * (ln(n - df + 0.5) - ln(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score from tf join d using (term) join q using (term), s group by doc_id""")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([(0, _TERMS)], "query_id int, terms array<string>")
    return retrieval.bm25(q, table(spark, sf_dir, "documents").select("doc_id", "text"), floor=False)


_BM25_TOP = """
with t as (select source, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as t from documents where source is not null),
s as (select source, count(*) as n, avg(len(t)) as mean from t group by source), q as (select term, count(*) as times from (select unnest(['the', 'der', 'mit', 'license', 'license', 'error']) as term) group by term),
w as (select source, doc_id, len(t) as length, unnest(t) as term from t), d as (select source, term, count(distinct doc_id) as df from w group by all),
i as (select source, term, ln(n - df + 0.5) - ln(df + 0.5) as idf from d join s using (source)), m as (select source, avg(idf) as mean_idf from i group by source),
tf as (select source, doc_id, length, term, count(*) as tf from w where term in (select term from q) group by all),
hit as (select source, doc_id, round(sum(times * case when idf < 0 then 0.25 * mean_idf else idf end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score from tf join i using (source, term) join m using (source) join s using (source) join q using (term) group by all),
every as (select source, doc_id, score from hit union all select source, doc_id, 0 from t where (source, doc_id) not in (select (source, doc_id) from hit))
select 0 as query_id, source, doc_id, score, cast(row_number() over (partition by source order by score desc, doc_id) as integer) as rank from every qualify rank <= 20"""


@_query(_BM25_TOP)
def bm25_top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    q = docs.select("source").distinct().withColumns({"query_id": F.lit(0), "terms": F.array(*map(F.lit, _TERMS))})
    return retrieval.bm25_top(q, docs, on=("source",))


@_query(_BM25_TOP)
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks from an inverted index that is written first and then read by the terms."""
    from ledgerloom.operators.inverted import bm25_from_index, build_index

    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    index = build_index(docs, fresh_path(spark, "index"), ("source",))
    q = docs.where("source is not null").select("source").distinct().withColumns({"query_id": F.lit(0), "terms": F.array(*map(F.lit, _TERMS))})
    return bm25_from_index(index, q).select("query_id", "source", "doc_id", "score", "rank")


_KNN = """
with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 20 = 0), d as (
  select query_id, vec_id as doc_id, round(list_distance(e, embedding::double[]), 6) as score from embeddings, q), knn as (
  select *, row_number() over (partition by query_id order by score, doc_id) as rank from d qualify rank <= 20)"""


_TOP = _KNN + " select query_id, doc_id, score, cast(rank as integer) as rank from knn"


@_query(_TOP)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector of the whole table as a query, against all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.dense_top(e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), e).select("query_id", "doc_id", "score", "rank")


_FUSED = (
    _KNN
    + """, u as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as e from embeddings),
angle as (select q.vec_id as query_id, u.vec_id as doc_id, round(list_distance(q.e, u.e), 6) as score from u q, u where q.vec_id % 20 = 0),
other as (select query_id, doc_id, row_number() over (partition by query_id order by score, doc_id) as rank from angle qualify rank <= 20)
select query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as rrf from (select query_id, doc_id, rank from knn union all select query_id, doc_id, rank from other) group by all"""
)


@_query(_FUSED)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector of the whole table as a query; ranks by distance and by angle, each over all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    # The second ranking sees unit vectors, so it orders by angle.
    # Unit vectors are written, so that a norm is worked out once a vector and not for each of its components.
    unit = lambda df: df.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("n", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).where("n > 0").withColumn("embedding", F.transform("embedding", lambda x: x / F.col("n"))).drop("n")
    units = stored(unit(e), fresh_path(spark, "units"))
    asked = units.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.fuse([retrieval.dense_top(queries, e), retrieval.dense_top(asked, units)], ("query_id",)).select("query_id", "doc_id", "rrf")


_SIMILAR = r"""
with t as (select p_partkey, p_brand, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[;,\s]+'), lambda x: x <> '')) as t from part), s as (
  select a.p_partkey as a, b.p_partkey as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as similarity from t a join t b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey)
select * from s where similarity >= 0.6"""


@_query(_SIMILAR)
def jaccard_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all parts of a brand with a similarity of 0.6 at least."""
    tags = F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), r"[;,\s]+"), lambda x: x != "")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", tags.alias("tokens"))
    return retrieval.similar_sets(p, 0.6, ("p_brand",)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query("""
select p_partkey, case when p_partkey % 3 = 0 then 1.0::double else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end as similarity from (
  select p_partkey, list_filter(string_split_regex(lower(p_name), '[;,\\s]+'), lambda x: x <> '') as a, list_filter(string_split_regex(lower(p_type || ';' || p_name), '[;,\\s]+'), lambda x: x <> '') as b from part)""")
def jaccard_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    other = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat("p_type", F.lit(";"), "p_name"))
    return p.select("p_partkey", F.round(fn.jaccard(F.col("p_name"), other), 6).alias("similarity"))


@_query(r"""
with c as (
  select cast(cast(floor(p_partkey / 4) as bigint) as varchar) as id, 's' || p_partkey % 4 as source, p_partkey % 4 as ord, p_name || ', ' || p_type as value,
    list_distinct(list_filter(string_split_regex(lower(p_name || ', ' || p_type), '[;,\s]+'), lambda x: x <> '')) as t from part
), r as (select *, row_number() over (partition by id order by ord) as n from c),
s as (select a.id, a.n as a, b.n as b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.4 as near from r a join r b on a.id = b.id and a.n < b.n),
w as (select id, bool_or(near) filter (where a = 1 and b = 2) as s12, bool_or(near) filter (where a = 1 and b = 3) as s13, bool_or(near) filter (where a = 1 and b = 4) as s14,
  bool_or(near) filter (where a = 2 and b = 3) as s23, bool_or(near) filter (where a = 2 and b = 4) as s24, bool_or(near) filter (where a = 3 and b = 4) as s34 from s group by id),
two as (select r.id, w.*, case when s12 then 1 else 2 end as g2 from (select distinct id from r) r left join w on r.id = w.id),
three as (select *, case when s13 then 1 when g2 = 2 and s23 then 2 else 3 end as g3 from two),
four as (select *, case when s14 then 1 when g2 = 2 and s24 then 2 when g3 = 3 and s34 then 3 else 4 end as g4 from three),
g as (select r.*, case n when 1 then 1 when 2 then g2 when 3 then g3 else g4 end as grp from r join four on r.id = four.id),
z as (select *, count(*) over (partition by id, grp) as size from g), best as (select id, arg_min(grp, (-size, grp)) as grp from z group by id),
lost as (select z.id, string_agg(source || ': ' || value, ', ' order by -size, z.grp, ord) as conflict from z join best on z.id = best.id where z.grp <> best.grp group by z.id)
select z.id as artifact_id, 'tags' as field, arg_min(value, ord) as value, arg_min(source, ord) as source, any_value(conflict) as conflict from z join best on z.id = best.id and z.grp = best.grp left join lost on z.id = lost.id group by z.id""")
def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ord_ = (F.col("p_partkey") % 4).cast("int")
    claims = p.select((F.col("p_partkey") / 4).cast("long").cast("string").alias("artifact_id"), F.lit("tags").alias("field"), F.concat(F.lit("s"), ord_.cast("string")).alias("source"), ord_.alias("ord"), F.concat_ws(", ", "p_name", "p_type").alias("value"))
    return resolve_fuzzy(claims, 0.4)


@_query(
    _CLAIMS
    + """ select artifact_id, source, case when value = 'error' then null else value end as claim, length(value) = 4 as contradicts from claims"""
)
def detector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = routing.parse_report(dt.order_detector_reports(spark, sf_dir))
    each = parsed.select("artifact_id", "internal", F.explode("claims").alias("source", "claim"))
    return each.select("artifact_id", "source", "claim", F.map_contains_key("internal", F.col("source")).alias("contradicts"))


_ROUTED = (
    _CLAIMS
    + """, s as (select artifact_id, source, ord, value, length(value) = 4 as self from claims where value <> 'error'),
score as (select a.artifact_id, a.source, any_value(a.ord) as ord, any_value(a.value) as value, count(b.source) filter (where not b.self and a.value = b.value) - case when any_value(a.self) then 2 else 0 end as score
  from s a left join s b on a.artifact_id = b.artifact_id and a.source <> b.source group by all),
facts as (select artifact_id, count(*) as speaking, max(score) as best from score group by artifact_id),
calm as (select artifact_id, count(distinct value) = 1 and not bool_or(length(value) = 4) as calm from claims group by artifact_id),
top as (select score.*, speaking, best, calm from score join facts using (artifact_id) join calm using (artifact_id) where score = best),
chosen as (select artifact_id, case when any_value(calm) or any_value(speaking) <= 1 or any_value(best) < 0 then null
  when count(distinct value) > 1 then arg_min(source, ord) else string_agg(source, ',' order by source) end as chosen from top group by artifact_id)
select artifact_id, chosen from (select distinct artifact_id from claims) left join chosen using (artifact_id)"""
)


@_query(_ROUTED)
def consensus_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = routing.parse_report(dt.order_detector_reports(spark, sf_dir)).withColumn("priority", F.array(*map(F.lit, dt.SOURCES)))
    return routing.select_sources(audits).select("artifact_id", F.array_join(F.array_sort("chosen"), ",").alias("chosen"))


def _bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.triplets(resolve(dt.event_claims(spark, sf_dir)), "direct")


@_query(
    _RESOLVED
    + """ select artifact_id, value as activity, source as activity_source, case when conflict is not null then list_aggregate(list_transform(string_split(conflict, ', '), lambda x: split_part(x, ': ', 2)), 'string_agg', ', ') end as activity_conflict from resolved"""
)
def triplet_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.wide(_bom(spark, sf_dir), ["activity"])


@_query(
    _RESOLVED
    + """ select artifact_id, 'direct' as section, field, value, source, 'inter' as conflict_type, list_aggregate(list_transform(string_split(conflict, ', '), lambda x: split_part(x, ': ', 2)), 'string_agg', ', ') as conflict_value,
  list_aggregate(list_transform(string_split(conflict, ', '), lambda x: split_part(x, ': ', 1)), 'string_agg', ', ') as conflict_source from resolved where conflict is not null"""
)
def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.conflict_report(_bom(spark, sf_dir))


@_query("""select o_custkey, o_orderkey, ['license', 'domain', 'limitation', 'metric'][o_orderkey % 4 + 1] as field from orders where o_orderkey % 4 in (1, 2)""")
def preset_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["license", "domain", "limitation", "metric"]))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("field"))
    return fields.preset(rows, "ai", "Safety")


_WALK = """
with recursive n as (select count(*) as n from part), e as (select p_partkey as parent, (p_partkey * 7 + p_size) % n as target from part, n union all select p_partkey, (p_partkey * 3 + 1) % n from part, n),
w as (select 1::bigint as node, 0 as depth union select e.target, w.depth + 1 from w join e on e.parent = w.node where w.depth < {depth})
select cast(min(depth) as integer) as depth, node from w group by node having min(depth) > 0"""


@_query(_WALK.format(depth=5))
def dependency_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([(1,)], "node long")
    return graph.walk(dt.part_edges(spark, sf_dir), roots, depth=5, cap=None).nodes.select("depth", "node")


@_query("""
with n as (select count(*) as n from part), e as (select p_partkey as parent, 0 as pos, (p_partkey * 7 + p_size) % n as target from part, n union all select p_partkey, 1, (p_partkey * 3 + 1) % n from part, n),
l1 as (select target as node, min(pos) as pos from e where parent = 1 and target <> 1 group by target), s1 as (select node, row_number() over (order by pos) as seq from l1),
m2 as (select e.target as node, s1.seq as turn, e.pos, e.parent from e join s1 on e.parent = s1.node where e.target <> 1 and e.target not in (select node from l1)),
f2 as (select node, arg_min(parent, (turn, pos)) as parent, min((turn, pos)) as place from m2 group by node), s2 as (select node, parent, (select count(*) from s1) + row_number() over (order by place) as seq from f2),
m3 as (select e.target as node, s2.seq as turn, e.pos, e.parent from e join s2 on e.parent = s2.node where e.target <> 1 and e.target not in (select node from l1 union all select node from f2)),
f3 as (select node, arg_min(parent, (turn, pos)) as parent, min((turn, pos)) as place from m3 group by node), s3 as (select node, parent, (select count(*) from s1) + (select count(*) from s2) + row_number() over (order by place) as seq from f3)
select * from (select seq, 1 as depth, node, 1::bigint as parent from s1 union all select seq, 2, node, parent from s2 union all select seq, 3, node, parent from s3) where seq <= 5""")
def bfs_safety_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(dt.part_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), depth=5, cap=5).nodes


@_query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dangling(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@_query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@_query("""
select 'c' || c_custkey as node_id, 'Customer' as type, c_name as name from customer where c_custkey % 10 <> 0
union all select 'c' || c_custkey, 'dataset_DatasetPackage', c_name from customer where c_custkey % 10 = 0 and c_custkey % 20 <> 0
union all select 'o' || o_orderkey, 'Order', 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') from orders""")
def linked_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(spark, sf_dir, table(spark, sf_dir, "orders"))


def _bundle(spark: SparkSession, sf_dir: str, o: DataFrame) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 10 == 0, "dataset_DatasetPackage").otherwise("Customer")
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), kind.alias("type"), F.col("c_name").alias("name"))
    edges = nodes.select(F.concat(F.lit("e"), "node_id").alias("edge_id"), F.lit("contains").alias("rel_type"), F.lit("root").alias("from_id"), F.col("node_id").alias("to_id"))
    children = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("Order").alias("type"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    links = c.where("c_custkey % 20 = 0").select(F.lit("dependsOn").alias("rel_type"), F.lit("Customer#000000001").alias("from_name"), F.col("c_name").alias("to_name"), F.lit(1).alias("depth"))
    return graph.link_bundle(nodes, edges, children, links)[0]


@_query("""
select section, field, string_agg(source, ',' order by ord) as sources from (
  select case when s_suppkey % 2 = 0 then 'direct' else 'data' end as section, 'f' || s_suppkey as field, unnest(case when s_suppkey % 3 = 0 then ['paper', 'hub'] when s_suppkey % 3 = 1 then ['hub', 'repo'] else ['repo'] end) as source,
    generate_subscripts(case when s_suppkey % 3 = 0 then ['paper', 'hub'] when s_suppkey % 3 = 1 then ['hub', 'repo'] else ['repo'] end, 1) as ord from supplier) group by all""")
def priority_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the suppliers' lists is both bundled and the user's, a third bundled alone, a third the user's alone."""
    from ledgerloom.sources.config import overlay

    k = F.col("s_suppkey")
    named = table(spark, sf_dir, "supplier").select(k, F.when(k % 2 == 0, "direct").otherwise("data").alias("section"), F.concat(F.lit("f"), k.cast("string")).alias("field"))
    bundled = named.where("s_suppkey % 3 < 2").select("section", "field", F.array(F.lit("hub"), F.lit("repo")).alias("sources"))
    own = named.where("s_suppkey % 3 <> 1").select("section", "field", F.when(k % 3 == 0, F.array(F.lit("paper"), F.lit("hub"))).otherwise(F.array(F.lit("repo"))).alias("sources"))
    return overlay(bundled, own).select("section", "field", F.array_join("sources", ",").alias("sources"))


@_query("""
select o_orderkey, case lower(substr(o_orderpriority, 3)) when 'high' then 'high' when 'medium' then 'medium' when 'low' then 'low' else 'serious' end as safety,
  case o_orderstatus when 'F' then 'no' when 'O' then 'noAssertion' else 'yes' end as presence from orders""")
def enum_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = F.when(F.col("o_orderstatus") == "F", " False").when(F.col("o_orderstatus") == "O", "something").otherwise("YES")
    level = F.substring("o_orderpriority", 3, 20)
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.normalize_enum(level, fn.SAFETY, "serious").alias("safety"), fn.normalize_enum(presence, fn.PRESENCE, "noAssertion").alias("presence"))


@_query("""
select p_partkey, case p_partkey % 6 when 0 then p_size * 1000 when 1 then p_size * 1048576 when 2 then cast(floor((p_size + 0.5) * 1000000000) as bigint) when 3 then null when 4 then p_size * 1000 + 7 else null end as bytes from part""")
def size_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    text = F.element_at(F.array(F.concat(n, F.lit(" KB")), F.concat(n, F.lit("MiB")), F.concat(n, F.lit(".5 GB")), F.concat(n, F.lit(" examples")), F.concat(n, F.lit(",007")), F.lit("-1 MB")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.size_to_bytes(text).alias("bytes"))


@_query("select p_partkey, p_size || '.' || p_partkey % 10 || case when p_partkey % 2 = 0 then '-rc1' else '' end as version from part")
def version_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit(" V"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-RC1").otherwise("+sha.1a"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.normalize_version(v).alias("version"))


@_query("""
with p as (select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, p_type as c from part)
select p_partkey, array_to_string(list_filter([a, case when lower(b) <> lower(a) then b end, case when lower(c) not in (lower(a), lower(b)) then c end], lambda x: coalesce(x, '') <> ''), '|') as entities from p""")
def dedupe_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.split("p_name", " ")[0], F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("")))
    text = F.concat(F.lit("- "), a, F.lit("; "), b, F.lit("\n* N/A, "), F.upper(a), F.lit(","), F.col("p_type"), F.lit(", unknown"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.named_entities(text), "|").alias("entities"))


@_query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' as stamp, 'never' as other from orders")
def timestamp_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.normalize_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("never")).alias("stamp"), fn.normalize_timestamp(F.lit("5 May"), F.lit("never")).alias("other"))


@_query("select c_custkey, replace(c_name, '#', '-') as slug, 'related-artifact' as nothing from customer")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fn.slug(F.concat(F.lit(" /"), "c_name", F.lit("# "))).alias("slug"), fn.slug(F.lit("//")).alias("nothing"))


@_query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@_query("""
select s_suppkey, cast(row_number() over (order by cast(floor(s_acctbal) as bigint) desc, s_suppkey) as integer) as place from supplier where s_name like '%0' or s_acctbal < 0""")
def catalog_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.sources.catalog import free_models, ranked

    price = F.when(F.col("s_acctbal") < 0, "0").otherwise("1")
    ident = F.concat("s_name", F.when(F.col("s_name").endswith("0"), ":free").otherwise(""))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", ident.alias("id"), F.floor("s_acctbal").cast("string").alias("context_length"), F.struct(price.alias("prompt"), price.alias("completion")).alias("pricing"), F.col("s_suppkey").alias("pos"))
    return ranked(free_models(rows)).select("s_suppkey", "place")


@_query("select o_orderkey from orders where o_orderkey % 7 <> 3")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.sources.batch import remaining

    todo = table(spark, sf_dir, "orders").select("o_orderkey")
    return remaining(todo, todo.where("o_orderkey % 7 = 3").withColumn("status", F.lit("ok")), "o_orderkey")


@_query("""select c_custkey, c_name as name, 'NOASSERTION' as location, 'model' as purpose, 'urn:spdx:AIPackage-' || sha1(cast(c_custkey as varchar) || '/package') as id from customer""")
def element_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.plans.spdx import ai_packages

    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("artifact_id"), F.col("c_name").alias("name"), F.create_map().cast("map<string,string>").alias("fields"))
    body = F.from_json("payload", "name string, software_downloadLocation string, software_primaryPurpose string")
    return ai_packages(rows, F.lit("2024-01-01T00:00:00Z")).select(F.col("doc_id").cast("long").alias("c_custkey"), body.alias("b"), "node_id").select("c_custkey", "b.name", F.col("b.software_downloadLocation").alias("location"), F.col("b.software_primaryPurpose").alias("purpose"), F.col("node_id").alias("id"))


from ledgerloom import bill_queries, document_queries, part_queries  # noqa: E402, F401  (they register their queries here)
