"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import collocations, decontam, lines, mixing, passages, quality, rules, shards, simhash, suffixes, tokens, tries, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontam.find_items(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op2_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("passage").alias("repeats_passage"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_fuzzy_passages, op3_quality_classifier, op4_line_dedup, op5_sharding, op6_simhash, op7_suffix_dedup, op8_mixing, op9_quality_rules, op10_token_counts]
    own += [op11_near_vectors, op12_conversation_trie, op13_collocations, pipeline]
    return {f.__name__: f for f in own}


#: Lines as in lines.py: ends trimmed, blank ones out; every window of three lines that occurs earlier marks its lines.
OP4 = """
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
t as (select doc_id, pos, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) as t from l),
f as (select doc_id, pos, t, row_number() over (partition by doc_id order by pos) as k from t where t <> ''),
w as (select doc_id, k, t as a, lead(t) over o as b, lead(t, 2) over o as c from f window o as (partition by doc_id order by k)),
r as (select doc_id, k, row_number() over (partition by a, b, c order by doc_id, k) as n from w where c is not null),
hit as (select distinct doc_id, k + i as k from r, (select unnest([0, 1, 2]) as i) where n > 1),
gone as (select hit.doc_id, hit.k, f.pos, hit.k - row_number() over (partition by hit.doc_id order by hit.k) as run from hit join f on f.doc_id = hit.doc_id and f.k = hit.k),
s as (select doc_id, count(*) as n_removed, count(distinct run) as n_runs from gone group by doc_id),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as kept from l left join gone on gone.doc_id = l.doc_id and gone.pos = l.pos where gone.pos is null group by l.doc_id)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join s on s.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
"""

#: All pairs of a label; components by what each vector reaches.
OP11 = """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
g as (select * from e where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as u, b.vec_id as v from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select u, u as m from p union select r.u, p.v from r join p on p.u = r.m),
c as (select u, min(m) as least from r group by u),
n as (select u, count(*) as n from p group by u)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.least, e.vec_id) as component_id, e.vec_id = coalesce(c.least, e.vec_id) as kept
from e left join n on n.u = e.vec_id left join c on c.u = e.vec_id
"""

#: CRC-32 bit by bit; every prefix of every rebuilt conversation, each node under all its ancestors.
OP12 = """
with o as (select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first) as t from conversations where conv_id is not null group by conv_id),
c as (select conv_id, t, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)) as b from o),
k as (select conv_id, t, cast(xor(list_reduce(list_concat([cast(4294967295 as bigint)], b), lambda x, y: list_reduce(list_concat([xor(x, y)], cast(range(8) as bigint[])), lambda z, i: case when z & 1 = 1 then xor(z >> 1, cast(3988292384 as bigint)) else z >> 1 end)), cast(4294967295 as bigint)) % 9 as int) as h from c),
s as (select k.conv_id, list_concat(coalesce(base.t[1:k.h], []), k.t[k.h + 1:]) as s from k left join o base on base.conv_id = k.conv_id - k.conv_id % 5),
m as (select conv_id, s[1:d] as p, d, d = len(s) as is_end from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from s)),
n as (select p, max(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (is_end), '')) as ends_sha256 from m group by p),
f as (select p[1:depth - 1] as p, count(*) as n_children from n where depth > 0 group by 1),
w as (select n.*, coalesce(f.n_children, 0) as n_children, case when depth > 0 then (n_convs - 1) * strlen(n.p[depth].text) else 0 end as saved from n left join f on f.p = n.p),
a as (select p[1:d] as p, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from (select p, n_children, saved, unnest(range(0, depth + 1)) as d from w) group by 1)
select w.conv_id, w.depth, up.conv_id as parent_conv_id, w.n_convs, w.n_children, a.n_leaves, cast(a.saved_tokens as bigint) as saved_tokens, w.ends_sha256
from w join a on a.p = w.p left join n up on w.depth > 0 and up.p = w.p[1:w.depth - 1]
"""

#: All n-grams of all pieces, every longer candidate against all phrases in it.
OP13 = """
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as p from d),
w as (select lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') as w from p),
m as (select lang, w, unnest([1, 2, 3, 4]) as m from w),
i as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from m where len(w) >= m),
g as (select lang, w[i:i + m - 1] as g, count(*) as f from i group by all),
n as (select lang, cast(sum(f) as bigint) as n from g where len(g) = 1 group by lang),
c as (select lang, g, f as a from g where len(g) > 1 and f >= 30),
z as (select lang, g, a, unnest(range(2, len(g))) as m from c where len(g) > 2),
y as (select lang, g, a, m, unnest(range(1, len(g) - m + 2)) as i from z),
x as (select lang, g[i:i + m - 1] as g, max(a) as most from y group by all),
q as (select c.lang, c.g, c.a from c left join x on x.lang = c.lang and x.g = c.g where x.most is null or cast(100 as hugeint) * x.most < cast(80 as hugeint) * c.a),
k as (select lang, g, a, unnest(range(1, len(g))) as k from q),
b as (select k.*, l.f as l, r.f as r, cast(2000000 * cast(k.a as hugeint) // (cast(l.f as hugeint) + r.f) as bigint) as score from k join g l on l.lang = k.lang and l.g = k.g[1:k] join g r on r.lang = k.lang and r.g = k.g[k + 1:]),
t as (select *, row_number() over (partition by lang, g order by score, k) as nth from b),
o as (select lang, array_to_string(g, ' ') as phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from t where nth = 1)
select o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score from o join n on n.lang = o.lang where o.rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4, "op11_near_vectors": OP11, "op12_conversation_trie": OP12, "op13_collocations": OP13}
