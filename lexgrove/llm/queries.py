"""The queries of the operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, chat, covertree, hardneg, hilbert, packing, pii, prefixtrie, rules, setsketch, urlfilter, weak
from .common import table

#: Packing: tokens of a sequence, id after each document. Sharding: shards. Surrogates: the key (a secret in production).
CAPACITY, END_ID, SHARDS, KEY = 2048, 0, 40, "lexgrove"
#: A dated list: key, category, action, since.
URL_LIST = (
    ("casino-win.example.com", "gambling", "add", "2024-02-01"),
    ("casino-win.example.com", "gambling", "remove", "2024-06-01"),
    ("casino-win.example.com", "gambling", "add", "2024-09-15"),
    ("free-bets.example.com", "gambling", "add", "2024-01-01"),
    ("cheap-pills.example.com", "pharmacy", "add", "2024-04-10"),
    ("cheap-pills.example.com", "pharmacy", "remove", "2024-11-01"),
    ("ads-track.example.com", "tracking", "add", "2024-03-05"),
    ("m.ads-track.example.com", "tracking", "add", "2023-12-01"),
    ("tiontion.example.net", "spam", "add", "2024-07-01"),
    ("tiontion.example.net", "spam", "remove", "2024-08-01"),
    ("blog.tionsh.example.com/de", "copied", "add", "2024-05-01"),
    ("blog.tionsh.example.com/en", "copied", "add", "2024-10-01"),
    ("blog.tionsh.example.com/en", "copied", "remove", "2024-10-20"),
    ("ththst.example.com", "spam", "add", "2024-02-29"),
)
_FIRST_DAY = "2024-01-01"


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: What both turns of conversation -1 say.
SAID = "<|im_end|><|im_start|>assistant ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.formatted(rows))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), SHARDS, "rows")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(table(spark, sf_dir, "documents"), KEY)
    others = lambda kind: F.size(F.array_remove("kinds", kind))
    return out.select("doc_id", "text", F.size("kinds").alias("n_entities"), *((F.size("kinds") - others(k)).alias(f"n_{k}") for k in pii.KINDS))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), CAPACITY, END_ID).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit(_FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))
    rows = ", ".join(f"('{k}', '{c}', '{a}', '{d}')" for k, c, a, d in URL_LIST)
    out = urlfilter.filtered(pages, spark.sql(f"select * from values {rows} as t(key, category, action, since)"))
    return out.withColumn("fetched", F.col("fetched").cast("string"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.judged(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(finite).select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return hardneg.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return brown.scored(docs.select("doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0).alias("held_out")))


#: Turns, at most, that a rebuilt conversation takes from the one it begins with, less one.
HEAD = 6


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    head = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEAD))
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"), head, conv - conv % 100, HEAD)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_embedding_dedup, op3_bpe, op4_chat, op5_hilbert_shards, op6_pii, op7_packing, op8_url_filter, op9_quality_rules, op10_quality_classifier, op11_hard_negatives, op12_class_lm, op13_prefix_trie)}

_VALUES = ", ".join(f"('{k}', '{c}', '{a}', '{d}')" for k, c, a, d in URL_LIST)
_OP2 = """
with recursive ok as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as materialized (
  select a.vec_id a, b.vec_id b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a, min(b) b from reach group by a),
n as (select a, count(*) c from link group by a)
select e.vec_id, coalesce(n.c, 0)::bigint n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) component_id, e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) kept
from embeddings e left join n on n.a = e.vec_id left join least on least.a = e.vec_id
"""
_OP8 = f"""
with entry(key, category, action, since) as (values {_VALUES}),
listed as (
  select distinct e.key, e.category, e.since::date since, (
    select min(x.since::date) from entry x where x.key = e.key and x.category = e.category and x.action = 'remove' and x.since > e.since) until
  from entry e where e.action = 'add'),
cap as (select page_id, url, date '{_FIRST_DAY}' + (page_id % 366)::int fetched, string_split(regexp_extract(url, '^[^/?#]*://([^?#]*)', 1), '/') part,
  regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') fit from pages),
named as (select page_id, url, fetched, case when fit then nullif(rtrim(lower(regexp_extract(regexp_extract(part[1], '([^@]*)$', 1), '^(\\[[^\\]]*\\]|[^:\\[\\]]+)', 1)), '.'), '') end host,
  list_filter(part[2:], lambda x: x <> '') steps from cap),
hit as (select page_id, fetched, url, category, key, row_number() over (partition by page_id, url, fetched order by length(key) desc, key, category) k
  from (select distinct page_id, url, fetched, host, steps from named) join listed on fetched >= since and (until is null or fetched < until)
  and (host = key or (ends_with(host, '.' || key) and not regexp_matches(host, '^(\\[.*|[0-9]+(\\.[0-9]+){{3}})$'))
    or (contains(key, '/') and host = split_part(key, '/', 1) and lower(array_to_string(steps[:len(string_split(key, '/')) - 1], '/')) = substr(key, length(split_part(key, '/', 1)) + 2))))
select n.page_id, n.host, n.fetched::varchar fetched, h.key is not null blocked, h.category, h.key matched
from named n left join hit h on h.page_id = n.page_id and h.url is not distinct from n.url and h.fetched = n.fetched and h.k = 1
"""
_ESCAPES = "(length({0}) - length(replace({0}, '\\', '')) + (length({0}) - length(replace({0}, '<|', ''))) // 2)"
_OP4 = f"""
with said as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all values (-1, 0, 'user', '{SAID}'), (-1, 1, 'assistant', '{SAID}'))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(12 + length(role) + {_ESCAPES.format('role')} + length(role) - length(replace(role, chr(10), '')) + 1 + length(text) + {_ESCAPES.format('text')} + 11)::bigint formatted_chars
from said group by conv_id
"""
_OP1 = r"""
with recursive word as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents where text is not null),
item as materialized (
  select distinct doc_id, case when len(w) < 5 then w else w[i:i + 4] end s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from word where len(w) > 0)),
n as materialized (select doc_id, count(*) n from item group by doc_id),
class as materialized (select min(doc_id) over (partition by sets) rep, doc_id from (select doc_id, list(s order by s) sets from item group by doc_id)),
rare as materialized (select s, doc_id from item semi join (select rep doc_id from class) using (doc_id)),
share as materialized (select a.doc_id a, b.doc_id b, count(*) k from rare a join rare b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as materialized (
  select a, b from share join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)
  union select rep, doc_id from class where rep < doc_id),
edge as materialized (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
least as (select a, min(b) b from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) kept
from documents d left join n using (doc_id) left join least l on l.a = d.doc_id
"""
_OP11 = """
with ok as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as materialized (
  select a.vec_id a, b.vec_id b, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score from ok a join ok b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positive as (select a, b, score from (select *, row_number() over (partition by a order by score desc, b) k from pair where same) where k <= 5),
negative as (
  select p.a, p.b, p.score, n.b nb, n.score ns, row_number() over (partition by p.a, p.b order by n.score desc, n.b) k
  from positive p join pair n on n.a = p.a and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score)
select a anchor_id, b positive_id, k::int as rank, nb negative_id, score positive_score, ns negative_score from negative where k <= 5
"""
_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295::bigint)"
_OP13 = f"""
with recursive said as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 i
  from conversations where conv_id is not null),
conv as (select conv_id, conv_id - conv_id % 100 base, {_CRC32.format('conv_id::varchar')} % {HEAD} h from (select distinct conv_id from said)),
built as (
  select c.conv_id, 0 own, i, role, text from conv c join said s on s.conv_id = c.base where i < h
  union all select c.conv_id, 1, i, role, text from conv c join said s on s.conv_id = c.conv_id where i >= h),
seq as materialized (
  select conv_id, coalesce(list({{'r': b.role, 't': b.text}} order by own, i) filter (b.conv_id is not null), []) s from conv left join built b using (conv_id) group by conv_id),
pre as (select conv_id, len(s) size, unnest(range(0, len(s) + 1)) d, s from seq),
node as materialized (
  select d, s[:d] p, min(conv_id) conv_id, count(*) n, coalesce(sum(length(s[d].t)) // count(*), 0) chars, string_agg(conv_id::varchar, ',' order by conv_id) filter (size = d) ends
  from pre group by d, s[:d]),
child as (select d - 1 d, p[:d - 1] p, count(*) k from node where d > 0 group by 1, 2),
up as (select u.d, n.p[:u.d] p, n.d depth, n.n, n.chars, c.k is null leaf from node n left join child c on c.d = n.d and c.p = n.p, unnest(range(0, n.d + 1)) u(d)),
below as (select d, p, count(*) filter (leaf) leaves, sum((n - 1) * chars) saved from up group by d, p)
select n.conv_id, n.d depth, parent.conv_id parent_conv_id, n.n n_convs, coalesce(k, 0) n_children, leaves n_leaves, saved::bigint saved_tokens, sha256(coalesce(n.ends, '')) ends_sha256
from node n join below b on b.d = n.d and b.p = n.p left join child c on c.d = n.d and c.p = n.p left join node parent on parent.d = n.d - 1 and parent.p = n.p[:n.d - 1]
"""
ORACLE = {"op1_minhash_dedup": _OP1, "op2_embedding_dedup": _OP2, "op4_chat": _OP4, "op8_url_filter": _OP8, "op11_hard_negatives": _OP11, "op13_prefix_trie": _OP13}
