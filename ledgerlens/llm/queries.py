"""Queries of this package by name: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, minhash, quality_rank, quality_rules, ranked_search, toxicity
from .chat import perspectives
from .decontaminate import contaminated
from .frames import read
from .line_dedup import line_dedup
from .language_model import language_model_scores
from .pack import pack
from .simhash import near_duplicates
from .token_counts import token_counts

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(read(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    trained = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])
    return out.select("conv_id", "perspective", "part", "n_turns", "text", F.array_join(spans, ",").alias("spans"), trained.alias("n_trained"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model)


def op5_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_rank.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rank.quality_scores(docs, model)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_rank": op5_quality_rank,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_language_model": op8_language_model,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_perspectives": """
with t as (
    select distinct conv_id, turn, coalesce(nullif(role, ''), 'unknown') as role, coalesce(text, '') as body from conversations
),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, body) - 1 as place from t),
opening as (select conv_id, min(place) as place, arg_min(body, place) as body from n where role = 'system' group by conv_id),
who as (select distinct conv_id, role as perspective from t where role <> 'system'),
x as (
    select n.*, n.place // 256 as part, perspective,
           case when opening.place < 256 * (n.place // 256)
                then '<|im_start|>system' || chr(10) || opening.body || '<|im_end|>' || chr(10) else '' end as lead,
           '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system'
                                  else 'user name=' || role end || chr(10) as head
    from n join who on n.conv_id is not distinct from who.conv_id
           left join opening on n.conv_id is not distinct from opening.conv_id
),
y as (
    select *, length(lead) + sum(length(head) + length(body) + 11) over (partition by conv_id, part, perspective order by place) as ends
    from x
)
select conv_id, perspective, part, count(*) as n_turns,
       any_value(lead) || string_agg(head || body || '<|im_end|>' || chr(10), '' order by place) as text,
       coalesce(string_agg(case when role = perspective
                                then cast(ends - 11 - length(body) as varchar) || '-' || cast(ends - 1 as varchar) end,
                           ',' order by place), '') as spans,
       cast(sum(case when role = perspective then length(body) + 10 else 0 end) as bigint) as n_trained
from y group by conv_id, perspective, part
""",
    # all pairs of different sets that share a shingle, and what can be reached by links
    "op11_minhash_near_dedup": r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as words
    from documents
),
d as (
    select doc_id, list_sort(list_distinct(case when words is null or len(words) = 0 then []
                                      when len(words) < 4 then [array_to_string(words, ' ')]
                                      else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end)) as s
    from w
),
c as (select s, min(doc_id) as node, len(s) as n from d where len(s) > 0 group by s),
e as (select node, n, unnest(s) as x from c),
pair as (
    select a.node as a, b.node as b, a.n as na, b.n as nb, count(*) as shared
    from e a join e b on a.x = b.x and a.node < b.node group by all
),
link as (select a, b from pair where 100 * shared >= 80 * (na + nb - shared)),
edge as (select a, b from link union all select b, a from link),
reach as (select node, node as to_ from c union select r.node, edge.b from reach r join edge on edge.a = r.to_),
least as (select node, min(to_) as component_id from reach group by node)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(least.component_id, d.doc_id) as component_id,
       d.doc_id = coalesce(least.component_id, d.doc_id) as kept
from d left join c on c.s = d.s left join least on least.node = c.node
""",
    # every document scored for every item
    "op12_ranked_search": r"""
with t as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
),
d as (select row_number() over (order by doc_id) as row, doc_id, terms, len(terms) as n from t where len(terms) > 0),
s as (select count(*) as total, cast(sum(n) as bigint) as length from d),
i as (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
),
q as (select item_id, term, count(*) as times from i group by item_id, term),
p as (select row, doc_id, n, unnest(terms) as term from d),
f as (select row, doc_id, n, term, count(*) as tf from p where term in (select term from q) group by all),
w as (
    select term, cast(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) as bigint) as weight
    from (select term, count(*) as df from f group by term), s
),
x as (
    select item_id, row, doc_id,
           cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * total) // length))))) as bigint) as score
    from q join f using (term) join w using (term), s
    group by item_id, row, doc_id
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from x where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
""",
    # every anchor against every row
    "op13_hard_negatives": """
with r as (
    select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
           list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
           cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
    from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
""",
    # every window that begins with a shingle of the item, compared outright
    "op7_decontamination": r"""
with d as (
    select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
),
ds as (
    select doc_id, len(w) as n, unnest(range(0, len(w) - 4)) as pos,
           unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) as s
    from d where len(w) >= 5
),
i as (
    select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark
),
shingle as (
    select item_id, len(w) as m, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) as s
    from i where len(w) >= 5
),
counted as (select item_id, m, s, count(*) as c from shingle group by item_id, m, s),
starts as (
    select distinct doc_id, item_id, m, least(pos, n - m) as start from ds join counted using (s) where n >= m
),
shared as (
    select a.doc_id, a.item_id, a.m, a.start, ds.s, count(*) as c
    from starts a join ds on ds.doc_id = a.doc_id and ds.pos between a.start and a.start + a.m - 5
    group by all
),
alike as (
    select x.doc_id, x.item_id, x.m, x.start, sum(least(x.c, counted.c)) as n_both
    from shared x join counted on counted.item_id = x.item_id and counted.s = x.s group by all
),
scored as (select *, cast(n_both as double) / cast(2 * (m - 4) - n_both as double) as similarity from alike)
select doc_id, item_id, cast(start as integer) as start_word, cast(m as integer) as n_words, similarity
from scored where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1
""",
}
