"""One query for each corpus operator, over whole tables and with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, embed_dedup, lang_id, line_dedup, minhash_dedup, mixing, pii, suffix_dedup, topk_search
from .common import table

#: A conversation that holds every control string of the template.
TRICKY = "\\### Assistant: </turn> ok"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat_format.chat_digests(c.unionByName(extra))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(e, e.where("vec_id % 50 = 0"), 5)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked(table(spark, sf_dir, "embeddings"), 0.9)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_removed(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("did", "rid")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "source"])
    return m.select("row_.doc_id", "row_.source", "n_tokens", "posterior", "rate", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_chat_format": op2_chat_format, "op3_topk_search": op3_topk_search, "op4_bpe": op4_bpe, "op5_embed_dedup": op5_embed_dedup, "op6_suffix_dedup": op6_suffix_dedup, "op7_minhash_dedup": op7_minhash_dedup, "op8_language_id": op8_language_id, "op9_pii": op9_pii, "op10_mixing": op10_mixing}


OP1_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, ls, unnest(range(len(ls))) as i, unnest(ls) as line from d),
n as (select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n from l),
c as (select *, sum(n) over (partition by doc_id order by i) as c from n),
ends as (select a.doc_id, a.i, b.i as j, b.c - b.n < a.c - a.n + 10 as least from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.c >= a.c - a.n + 10 and (b.c - b.n < a.c - a.n + 10 or b.c - a.c < 10) where a.n > 0),
prev as (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i), -1) as p from c where n > 0),
w as (select doc_id, i, j from ends union select e.doc_id, unnest(range(p + 1, e.i)), e.j from ends e join prev using (doc_id, i) where least union select doc_id, i, i from c where n between 3 and 9),
k as (select w.*, array_to_string(ls[i + 1 : j + 1], chr(10)) as content from w join d using (doc_id)),
later as (select doc_id, i, j from (select *, row_number() over (partition by content order by doc_id, i) as r from k) where r > 1),
gone as (select distinct doc_id, unnest(range(i, j + 1)) as i from later),
m as (select l.doc_id, l.i, l.line, gone.i is not null as gone, lag(gone.i is not null, 1, false) over (partition by l.doc_id order by l.i) as before from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed, count(*) filter (gone and not before)::bigint as n_runs,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as text
from m group by doc_id"""

OP2_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
n as (select *, length(text) - length(replace(text, '\\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) as extra,
    length(role) - length(replace(role, '\\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 + length(role) - length(replace(role, ':', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0) as more from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(text) + extra + more + 14)::bigint as formatted_chars
from n group by conv_id"""

OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op3_topk_search": OP3_SQL}
