"""The registered queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from d join g using (h)
"""

def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_KINDS, secret_scan

    out = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate, n_hit

    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.withColumn("n_hit", n_hit())
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_codec import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import html_extract

    out = html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_score

    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import quality

    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


OP6_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_windows as (
  select distinct cast(item_id as varchar) as item_id, n, array_to_string(w[p:p + n - 1], ' ') as g
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, greatest(1, len(w) - 12) + 1)) as p from items where len(w) > 0)),
lengths as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from words, lengths where len(w) >= n)),
hits as (select doc_id, n, p, item_id from doc_windows join item_windows using (n, g)),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join covered using (doc_id) left join found using (doc_id)
"""

def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) end) as s from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
  where 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by all),
links as (select a, b from common where 100 * c >= 80 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, other) as (select distinct a, a from both_ways union select r.node, e.b from reach r join both_ways e on r.other = e.a),
least_of as (select node, min(other) as component from reach group by node),
degrees as (select a as node, count(*) as n from both_ways group by a)
select doc_id, len(s) as n_shingles, coalesce(component, doc_id) as component_id, coalesce(degrees.n, 0) as n_links
from sets left join least_of on doc_id = least_of.node left join degrees on doc_id = degrees.node
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, p, array_to_string(w[p:p + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as p from words where len(w) >= 13)),
firsts as (select g, min(doc_id) as least from windows group by g),
gone as (select distinct doc_id, unnest(range(p, p + 13)) as p from windows join firsts using (g) where doc_id > least),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from each anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from words left join kept using (doc_id)
"""


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


OP10_SQL = """
with rules(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
a as (select page_id, url, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select *, regexp_extract(rest, '^[^/?#]*') as h from a),
c as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path, row_number() over () as rn from b),
d as (select c.*, rh || rp as rule, verdict, row_number() over (partition by rn order by length(rh || rp) desc) as k
      from c left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from d where k = 1
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    out = filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP11_SQL = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from texts),
flags as (
  select part, quality, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(words.doc_id > least, false)] as f
  from words left join labels on words.doc_id = labels.doc_id),
cases as (select part, f, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as bad from flags group by all),
k as (select unnest(range(1, 6)) as i),
orders as (select [a.i, b.i, c.i, d.i, e.i] as o from k a, k b, k c, k d, k e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select o, step, o[step] as i, o[1:step - 1] as earlier, list_filter([1, 2, 3, 4, 5], lambda x: x <> o[step]) as others from orders, (select unnest(range(1, 6)) as step)),
told as (
  select part, o, step, i, cast(sum(n) filter (where not f[i] and not list_has_any(earlier, bad_at)) as bigint) as kept,
    cast(sum(n) filter (where f[i] and not list_has_any(earlier, bad_at)) as bigint) as removed,
    cast(sum(n) filter (where f[i] and list_has_any(earlier, bad_at)) as bigint) as redundant,
    cast(sum(n) filter (where f[i] and not list_has_any(others, bad_at)) as bigint) as unique_fails,
    cast(sum(good) filter (where f[i] and not list_has_any(earlier, bad_at)) as bigint) as good_lost,
    cast(sum(bad) filter (where f[i] and not list_has_any(earlier, bad_at)) as bigint) as toxic_lost
  from (select *, list_filter([1, 2, 3, 4, 5], lambda x: f[x]) as bad_at from cases), steps group by all)
select part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') as filter_order, cast(step as integer) as step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed,
  coalesce(redundant, 0) as redundant, coalesce(unique_fails, 0) as unique_fails, coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost,
  cast(sum(coalesce(removed, 0)) over (partition by part, i) as bigint) as shapley
from told
"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import conversations_of, read_back

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = read_back(conversations_of(rows.unionByName(more)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP12_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
escaped as (
  select *, replace(replace(replace(role, '\', '\\'), '<turn>', '\b'), '</turn>', '\e') as r,
    replace(replace(replace(text, '\', '\\'), '<turn>', '\b'), '</turn>', '\e') as t from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<turn>' || replace(r, chr(10), '\r') || chr(10) || t || '</turn>')) as bigint) as formatted_chars
from escaped group by conv_id
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_middle, rebuilt

    out = rebuilt(fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP13_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
units as (
  select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, cast(('0x' || h[1:8]) as ubigint) as h1, cast(('0x' || h[9:16]) as ubigint) as h2,
    cast(('0x' || h[17:24]) as ubigint) as h3, cast(('0x' || h[25:32]) as ubigint) as h4 from texts),
cuts as (select *, len(u) as n, cast(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as bigint) as a, cast(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as bigint) as b from units),
parts as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(p || m || s) as restored_sha256
from parts
"""

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_html_extract": op2_html_extract, "op3_piece_codec": op3_piece_codec, "op4_lm_score": op4_lm_score, "op5_quality_gam": op5_quality_gam, "op6_decontaminate": op6_decontaminate, "op7_exact_dedup": op7_exact_dedup, "op8_ngram_join": op8_ngram_join, "op9_substring_dedup": op9_substring_dedup, "op10_url_filter": op10_url_filter, "op11_filter_audit": op11_filter_audit, "op12_chat_format": op12_chat_format, "op13_fill_middle": op13_fill_middle}
ORACLES = {"op6_decontaminate": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_fill_middle": OP13_SQL}
