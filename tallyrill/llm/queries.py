"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, toxicity
from .bpe import encode_documents
from .chat import format_conversations, read_back
from .decontaminate import find
from .jaccard import join
from .neighbours import near_duplicates
from .reshard import reshard, rewrite, shards
from .substring_index import remove_repeats
from .suffixes import dedup_substrings
from .tables import new_folder, table


def fold(doc_id: Column) -> Column:
    """Fold 0 is held out: crc32 of the id's decimal digits modulo 5."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 6 old shards by the text's CRC-32 to 8 new ones of equal bytes; read back from the files of the shards that were rewritten, others as they are."""
    docs = table(spark, sf_dir, "documents")
    utf8 = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    plan = reshard(docs, F.pmod(F.crc32(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")), F.lit(6)), n_old=6, n_new=8)
    path = new_folder(spark)
    affected = rewrite(plan, path)
    back = shards(spark, path, docs.schema).select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), "shard", "slot")
    if len(affected) < 8:
        others = plan.rows.where(~F.col("shard").isin(affected))
        back = back.unionByName(others.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "text_crc32", "shard", "slot"))
    return back.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels.where(fold(labels["doc_id"]) != 0)))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs.where(fold(docs["doc_id"]) != 0)))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(items, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_resharding, op2_toxicity, op3_embedding_dedup, op4_chat, op5_jaccard_join, op6_substring_dedup, op7_language_id, op8_bpe, op9_decontamination, op10_suffix_dedup)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes reachable by the links of a table ``link`` (a, b both ways), from each row of ``node`` (id): the smallest.
_COMPONENTS = """reach(id, other) as (select id, id from node union select r.id, l.b from reach r join link l on l.a = r.other),
comp as (select id, min(other) as component_id from reach group by id)"""

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": f"""with recursive v as (select vec_id as id, embedding::double[] as e from embeddings), node as (select id from v),
link as (select x.id as a, y.id as b from v x join v y on x.id <> y.id where list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.9), {_COMPONENTS}
select id as vec_id, (select count(*) from link where a = comp.id) as n_links, component_id, id = component_id as kept from comp""",
    "op4_chat": r"""with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, length(text) - length(replace(text, '\', '')) + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###'))
  + (length(text) - length(replace(text, '</turn>', ''))) // 7 as added from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(5 + length(role) + length(text) + added + 8)::bigint as formatted_chars from n group by conv_id""",
    "op5_jaccard_join": rf"""with recursive w as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct id, case when len(w) >= 3 then w[i:i + 2] else w end as s from w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) t(i)),
size as (select id, count(*) as n from s group by id), node as (select id from w),
both_ as (select x.id as a, y.id as b, count(*) as n from s x join s y on x.s = y.s and x.id <> y.id group by 1, 2),
link as (select a, b from both_ m join size x on x.id = m.a join size y on y.id = m.b where 100 * m.n >= 90 * (x.n + y.n - m.n)), {_COMPONENTS}
select id as doc_id, coalesce(n, 0) as n_shingles, component_id from comp left join size using (id)""",
    "op6_substring_dedup": r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, i, w[i] as word, case when i + 34 <= len(w) then array_to_string(w[i:i + 34], ' ') end as win from w, unnest(range(1, len(w) + 1)) t(i)),
c as (select *, win is not null and count(*) over (partition by win) > 1 as again from p),
g as (select *, bool_or(again) over (partition by doc_id order by i rows between 34 preceding and current row) as gone from c)
select w.doc_id, max(len(w.w)) as n_words, count(*) filter (gone) as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) as kept_sha256
from w left join g using (doc_id) group by w.doc_id""",
    "op9_decontamination": rf"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win from b, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) t(i)),
sizes as (select distinct n from bw),
hit as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from d, sizes, unnest(range(1, len(w) - n + 2)) t(i) where win in (select win from bw)),
gone as (select doc_id, count(distinct j) as n_hit from hit, unnest(range(i, i + n)) u(j) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit join bw using (n, win) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join gone using (doc_id) left join items using (doc_id)""",
    "op10_suffix_dedup": r"""with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
p as (select doc_id, i, substr(h, 2 * i - 1, 2) as byte, case when i + 99 <= n then unhex(substr(h, 2 * i - 1, 200)) end as win from d, unnest(range(1, n + 1)) t(i)),
c as (select doc_id, i, byte, win is not null and row_number() over (partition by win order by doc_id, i) > 1 as again from p),
g as (select *, bool_or(again) over (partition by doc_id order by i rows between 99 preceding and current row) as gone from c),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as first from g)
select d.doc_id, any_value(n) as n_bytes, count(*) filter (gone) as n_removed, count(*) filter (first) as n_spans, sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (not gone), ''))) as kept_sha256
from d left join e using (doc_id) group by d.doc_id""",
}
