"""The numbered queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .automaton import encode_words
from .balltree import exact_top_k
from .bpe import encode_decode
from .common import crc_mod
from .divergence import source_divergence
from .hnsw import nearest
from .langid import identify, learn
from .linededup import dedup_lines
from .lm import score_texts
from .merkle import merkle_manifest
from .neardup import near_duplicates
from .packing import pack_documents
from .pii import KINDS, find_personal_data, spans_text
from .quality import score_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hpyp_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the base spans; spans lists all."""
    out = find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    out = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    out = identify(docs, learn(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_words(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle_manifest(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 2) == 0)
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hpyp_lm, op2_line_dedup, op3_ball_tree, op4_weak_pii, op5_compression_quality, op6_byte_bpe, op7_hnsw, op8_minhash_join, op9_packing, op10_language_id, op11_merge_automaton, op12_merkle_manifest, op13_source_divergence)}

ORACLE_SQL = {
    "op3_ball_tree": """
with good as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v, len(embedding) as width from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from good q join good c on q.width = c.width and q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5""",
    "op2_line_dedup": """
with lines as (
  select doc_id, pos, line, lower_ascii as key from (
    select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii
    from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos
          from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)))
), frequent as (
  select key, max(doc_id) as last_doc from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select l.doc_id, l.pos, l.line, f.key is not null and l.doc_id < f.last_doc as gone from lines l left join frequent f on l.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op8_minhash_join": """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words
), each as (
  select doc_id, len(s) as n, hash(unnest(s)) as shingle from sets
), links as (
  select a.doc_id as a, b.doc_id as b from each a join each b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached as (
  select a as doc_id, a as node from links union select reached.doc_id, links.b from reached join links on reached.node = links.a
), components as (
  select doc_id, min(node) as component_id from reached group by doc_id
)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept from sets left join components using (doc_id)""",
    "op12_merkle_manifest": """
with recursive fields as (
  select doc_id, coalesce('+' || source, '') as tree, text, HEAD as head, case when text is null then '-' else strlen(text) || ':' || text end as whole,
         case when text is null then '-' else strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') end as cut
  from documents
), bits as (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i)
), crc_table as (
  select list(c order by i) as t from bits
), crcs as (
  select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(doc_id::varchar) + 1), lambda k: ascii(cast(doc_id as varchar)[k])::bigint)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from documents, crc_table
), leaves as (
  select doc_id, tree, sha256(head || whole) as leaf, sha256(head || case when crc % 2 = 0 then cut else whole end) as changed,
         row_number() over (partition by tree order by doc_id) - 1 as pos, count(*) over (partition by tree) as n
  from fields join crcs using (doc_id)
), nodes as (
  select 0 as level, tree, pos, n, leaf as h from leaves
  union all
  select level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by level, tree, pos // 3, n
), tops as (
  select 0 as level, row_number() over (order by tree) - 1 as pos, count(*) over () as n, h, tree from nodes where n = 1
), over_all as (
  select level, pos, n, h from tops
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from over_all where n > 1 group by level, pos // 3, n
), climbed as (
  select doc_id, tree, 0 as level, pos, n, changed as acc, '' as proof from leaves
  union all
  select c.doc_id, c.tree, c.level + 1, c.pos // 3, (c.n + 2) // 3, sha256(string_agg(case when s.pos = c.pos then c.acc else s.h end, '' order by s.pos)),
         c.proof || coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos <> c.pos), '')
  from climbed c join nodes s on s.tree = c.tree and s.level = c.level and s.pos // 3 = c.pos // 3 where c.n > 1
  group by c.doc_id, c.tree, c.level, c.pos, c.n, c.proof, c.acc
), climbed_all as (
  select c.doc_id, t.level, t.pos, t.n, c.acc, c.proof from climbed c join tops t using (tree) where c.n = 1
  union all
  select c.doc_id, c.level + 1, c.pos // 3, (c.n + 2) // 3, sha256(string_agg(case when s.pos = c.pos then c.acc else s.h end, '' order by s.pos)),
         c.proof || coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos <> c.pos), '')
  from climbed_all c join over_all s on s.level = c.level and s.pos // 3 = c.pos // 3 where c.n > 1
  group by c.doc_id, c.level, c.pos, c.n, c.proof, c.acc
)
select l.doc_id, l.leaf, t.h as subroot, r.h as root, sha256(c.proof) as proof_sha256, c.acc as folded_root, c.acc = r.h as verified
from leaves l join climbed_all c using (doc_id) join tops t on t.tree = l.tree cross join (select h from over_all where n = 1) r where c.n = 1""".replace("HEAD", " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end" for c in ("doc_id", "source", "lang", "n_chars"))),
    "op13_source_divergence": r"""
with texts as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), groups as (
  select distinct lang, source from texts
), words as (
  select r, lang, source, unnest(terms) as term from texts
), kept as (
  select lang, term from (select distinct r, lang, term from words) group by lang, term having count(*) >= 3
), sizes as (
  select lang, count(*) as v from kept group by lang
), counted as (
  select lang, source, term, count(*) as c from words join kept using (lang, term) group by lang, source, term
), dense as (
  select lang, source, term, coalesce(c, 0) as c from groups join kept using (lang) left join counted using (lang, source, term)
), shares as (
  select lang, source, term, c, 1 + (1000000000 * (c + 1)::hugeint) // (sum(c) over (partition by lang, source) + v)::hugeint as p from dense join sizes using (lang)
), totals as (
  select lang, term, sum(c) as c from dense group by lang, term
), of_lang as (
  select lang, term, 1 + (1000000000 * (c + 1)::hugeint) // (sum(c) over (partition by lang) + v)::hugeint as q from totals join sizes using (lang)
), distances as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join distances d on d.lang = a.lang and d.source = a.source and d.item = b.source
), telling as (
  select lang, source, term as item, (p - q) * (p - q) // q as value from shares join of_lang using (lang, term) where c > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from telling
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 200""",
}
