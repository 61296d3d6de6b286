"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import (decontaminate, embed_dedup, filter_audit, language_id, licenses, line_dedup, packing, preferences,
                           prefix_trie, quality, secrets, simhash, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = [k for k, _ in secrets.KINDS]
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(secrets.span_text(F.col("base"), kinds), 256).alias("base_sha256"),
        secrets.span_text(F.concat("base", "random"), [*kinds, "random"]).alias("spans"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_neighbours(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "llr")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_embedding_dedup, op3_line_dedup, op4_simhash_dedup, op5_preference_format, op6_decontamination,
    op7_toxicity, op8_packing, op9_quality, op10_license_scan, op11_filter_audit, op12_prefix_trie,
    op13_language_id, pipeline)}

ORACLES = {
    "op2_embedding_dedup": """
with recursive v as (
  select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e,
         coalesce(vec_id is not null and label is not null and len(embedding) > 0
           and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
           and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as good
  from embeddings),
link as (
  select a.r as ar, b.r as br, a.vec_id as av, b.vec_id as bv
  from v a join v b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
  where a.good and b.good
    and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach as (
  select vec_id, vec_id as node from v where good
  union
  select reach.vec_id, link.bv from reach join link on link.av = reach.node),
comp as (select vec_id, min(node) as component_id from reach group by 1),
cnt as (select ar, count(*) as n from link group by 1)
select v.vec_id, coalesce(cnt.n, 0) as n_links, coalesce(comp.component_id, v.vec_id) as component_id,
       coalesce(v.vec_id = coalesce(comp.component_id, v.vec_id), false) as kept
from v left join cnt on cnt.ar = v.r left join comp on v.good and comp.vec_id = v.vec_id
""",
    "op5_preference_format": """
with t as (
  select conv_id, conv_id >> 1 as pair_id, conv_id & 1 as side, coalesce(role, '') as role, role as r0, coalesce(text, '') as text, text as t0,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos
  from conversations where conv_id is not null),
cmp as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.pos, b.pos) as pos,
         a.pos is not null and b.pos is not null and a.r0 is not distinct from b.r0 and a.t0 is not distinct from b.t0 as same
  from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.pos = b.pos),
pre as (select pair_id, coalesce(min(pos) filter (not same) - 1, max(pos)) as n from cmp group by 1),
w as (
  select t.*, pre.n, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as s
  from t join pre using (pair_id)),
o as (select *, coalesce(sum(length(s)) filter (pos > n) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as off from w),
g as (
  select pair_id, any_value(n) as n, count(*) filter (side = 0) as na, count(*) filter (side = 1) as nb,
         string_agg(s, '' order by pos) filter (side = 0 and pos <= n) as prompt,
         string_agg(s, '' order by pos) filter (side = 0 and pos > n) as chosen,
         string_agg(s, '' order by pos) filter (side = 1 and pos > n) as rejected,
         string_agg((off + length(role) + 5)::bigint || ':' || (off + length(s) - 1)::bigint, ',' order by pos) filter (side = 0 and pos > n and r0 = 'assistant') as chosen_loss,
         string_agg((off + length(role) + 5)::bigint || ':' || (off + length(s) - 1)::bigint, ',' order by pos) filter (side = 1 and pos > n and r0 = 'assistant') as rejected_loss
  from o group by pair_id)
select pair_id, pair_id * 2 as chosen_id, pair_id * 2 + 1 as rejected_id, n as n_prompt_turns, coalesce(prompt, '') as prompt,
       coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected, coalesce(chosen_loss, '') as chosen_loss,
       coalesce(rejected_loss, '') as rejected_loss,
       case when na = 0 or nb = 0 then 'unpaired' when chosen is null and rejected is null then 'identical'
            when chosen is null then 'chosen_prefix' when rejected is null then 'rejected_prefix' else 'pair' end as status
from g
""",
    "op11_filter_audit": r"""
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
m as (
  select doc_id, part,
         case when len(w) < 100 then 1 else 0 end
         + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
         + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end
         + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
         + case when coalesce(doc_id > min(doc_id) over (partition by t), false) then 16 else 0 end as mask
  from d),
l as (select doc_id, coalesce(max(quality), 0) as good, coalesce(max(toxic), 0) as toxic from labels group by 1),
cell as (
  select part, mask, count(*) as n, count(*) filter (good = 1) as good, count(*) filter (toxic = 1) as toxic
  from m left join l using (doc_id) group by 1, 2),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
  where length(regexp_replace(a.f || b.f || c.f || d.f || e.f, '[^A]', '', 'g')) = 1 and len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (
  select filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) as own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::int, 1)) - 65))), 0)::int as before
  from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (mask & (before | own) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
         coalesce(sum(n) filter (mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost
  from cell, s group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from r
""",
    "op12_prefix_trie": """
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first,
           md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null),
ids as (
  select c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 9 as h
  from (select distinct c from t)),
r as (
  select c, row_number() over (partition by c order by pos) as d, role, text from (
    select i.c, t.pos, t.role, t.text from ids i join t on t.c = i.c - i.c % 5 and t.pos < i.h
    union all
    select t.c, t.pos, t.role, t.text from ids i join t on t.c = i.c and t.pos >= i.h)),
p as (
  select c, d, strlen(text) as size,
         string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') over (partition by c order by d rows unbounded preceding) as prefix
  from r
  union all select c, 0, 0, '' from ids),
node as (select d, prefix, min(c) as rep, count(*) as n, any_value(size) as size from p group by 1, 2),
m as (select p.c, p.d, node.rep from p join node using (d, prefix)),
tree as (
  select node.d, node.prefix, node.rep, node.n, node.size, m.rep as parent
  from node left join m on m.c = node.rep and m.d = node.d - 1),
kids as (select d - 1 as d, parent as rep, count(*) as n_children from tree where d > 0 group by 1, 2),
leaves as (
  select m.d, m.rep, count(*) as n_leaves
  from tree left join kids using (d, rep) join m on m.c = tree.rep and m.d <= tree.d where n_children is null group by 1, 2),
saved as (select m.d, m.rep, sum((n - 1) * size) as saved from tree join m on m.c = tree.rep and m.d <= tree.d group by 1, 2),
ends as (
  select d, rep, sha256(string_agg(c::varchar, ',' order by c)) as sha
  from (select c, d, rep, max(d) over (partition by c) as top from m) where d = top group by 1, 2)
select rep as conv_id, d::bigint as depth, parent as parent_conv_id, n as n_convs, coalesce(n_children, 0) as n_children, n_leaves,
       saved::bigint as saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from tree left join kids using (d, rep) left join leaves using (d, rep) left join saved using (d, rep) left join ends using (d, rep)
""",
}
