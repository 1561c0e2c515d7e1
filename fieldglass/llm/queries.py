"""The operators' queries with production parameters over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, brown, decontaminate, embeddings, mixing, phrases, quality, secrets, sharding, simhash, toxicity, urls, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain: low quality first, then toxic. toxic is the verdict at a probability of 0.3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = ["low_quality", "toxic"]
    rows = toxicity.score(docs, toxicity.train(docs, labels, chain), chain)
    return rows.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in chain], (F.col("p_toxic") >= 0.3).alias("toxic"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.allot(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    rows = rows.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return rows.orderBy("position", "doc_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.weak_labels(pages))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.judge(docs, table(spark, sf_dir, "labels"))
    base = [f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc.doc_id", *base, "base_failed", "kept", F.round("score", 6).alias("score"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", "found.n_assign", "found.n_access", "found.n_hex", F.sha2(F.col("found.base"), 256).alias("base_sha256"), "found.spans")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc.doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.learn_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select("row.vec_id", "component", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "whitened", "explained", "identity_error")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule columns of op5_url_filter, from the same operator, for SQL to check."""
    return op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7_quality_rules, from the same operator, for SQL to check."""
    return op7_quality_rules(spark, sf_dir).drop("kept", "score")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op8_secret_scan, from the same operator, for SQL to check."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op12_whiten, from the same operator, for SQL to check."""
    return op12_whiten(spark, sf_dir).select("vec_id", "component", "n", "deviation")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embedding_near_dedup, op3_simhash_near_dedup, op4_mix_sources, op5_url_filter, op6_shards, op7_quality_rules, op8_secret_scan, op9_bpe, op10_brown_lm, op11_decontaminate, op12_whiten, op13_phrases, url_rules, quality_base, secret_base, whitening_base)}

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": """
with recursive good as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select vec_id as v, vec_id as r from embeddings union select reach.v, links.b from reach join links on links.a = reach.r),
parts as (select v, min(r) as component_id from reach group by v),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join parts on v = vec_id left join counts on a = vec_id
""",
    "url_rules": """
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
sites as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') as path from hosts),
rules as (select unnest(['com/', 'example.com/en/', 'www.example.com/en/', 'net/es/', 'net/fr/']) as rule),
fits as (
  select page_id, arg_max(rule, len(rule)) as rule from sites join rules on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, instr(rule, '/'))) group by page_id)
select page_id, host, path, rule from sites left join fits using (page_id)
""",
    "quality_base": r"""
with words as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from words),
starts as (select doc_id, unnest(range(1, len(w) - 6)) as s, w from words),
windows as (select doc_id, s, array_to_string(w[s:s + 7], ' ') as x from starts),
twice as (select doc_id, s, count(*) over (partition by doc_id, x) as n from windows),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + 8)) as p from twice where n > 1) group by doc_id),
base as (
  select doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars, (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
  from words join lines using (doc_id) left join covered using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base
""",
    "secret_base": r"""
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id,
  len(list_filter(regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 8))::bigint as n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16))::bigint as n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 32))::bigint as n_hex
from t
""",
    "op4_mix_sources": r"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))) as digest from documents),
sources as (select source, sum(size)::bigint as source_size from rows group by source),
ranked as (select *, row_number() over (order by source nulls last) as r from sources),
weighted as (select *, (r - 1) % 3 + 1.0::double as weight, ((r - 1) % 3 - 1) * 0.5::double as lean, 3.0::double * source_size as cap from ranked),
leveled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, r rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, r rows between current row and unbounded following) as level from weighted),
topped as (select *, max(case when level * weight <= cap then level end) over () as reached from leveled),
aimed as (select source, source_size, lean, case when level * weight > cap then cap else least(cap, reached * weight) end as target from topped),
aims as (select *, sum(target * lean) over () / sum(target) over () as tilt from aimed),
placed as (
  select doc_id, size, source_size, target, lean, tilt, coalesce(sum(size) over (partition by rows.source order by digest, size rows between unbounded preceding and 1 preceding), 0) as before
  from rows join aims on rows.source is not distinct from aims.source),
passed as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as passes from placed),
done as (select *, (passes * size + greatest(0, least(size, round(target - passes * source_size) - before)))::bigint as taken, before / target as demand from passed),
timed as (select *, case when demand <= 0 then 0 else 2 * demand / ((1 - lean) + sqrt((1 - lean) * (1 - lean) + 4 * lean * demand)) end as t from done)
select doc_id, size, source_size, target, taken, case when taken > 0 then round(t + tilt * (t * t - t), 6) end as position
from timed
""",
    "op11_decontaminate": r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
starts as (select item, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from items where len(w) > 0),
windows as (select distinct item, size, array_to_string(w[s:s + size - 1], ' ') as x from starts),
places as (select r, w, size, unnest(range(1, len(w) - size + 2)) as s from docs, (select distinct size from windows) where len(w) >= size),
hits as (select r, s, size, item from (select r, s, size, array_to_string(w[s:s + size - 1], ' ') as x from places) join windows using (size, x)),
covered as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(s, s + size)) as p from hits) group by r),
met as (select r, list_sort(list(distinct item)) as items from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join met using (r)
""",
    "whitening_base": """
with good as (select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
fit as (select distinct x from good),
entries as (select len(x) as d, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from fit),
sums as (select d, i, sum(v)::hugeint as s, count(*)::hugeint as n from entries group by d, i),
rows as (select row_number() over () as r, vec_id, x from good),
apart as (select r, vec_id, len(x) as d, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from rows),
done as (select r, vec_id, d, any_value(n)::bigint as n, sum((n * v - s) * (n * v - s))::bigint as deviation from apart join sums using (d, i) group by r, vec_id, d)
select vec_id, component::integer as component, n, deviation from done, range(1, 5) as k(component) where component <= d
""",
    "op13_phrases": r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
placed as (select lang, w, unnest(range(1, len(w) + 1)) as s from cut),
f1 as (select lang, w[s] as p, count(*)::hugeint as f from placed group by all),
f2 as (select lang, w[s] || ' ' || w[s + 1] as p, count(*)::hugeint as f from placed where s < len(w) group by all having f >= 10),
f3 as (select lang, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] as p, count(*)::hugeint as f from placed where s + 1 < len(w) group by all having f >= 10),
totals as (select lang, sum(f)::bigint as n from f1 group by lang),
long as (select lang, p, f, string_split(p, ' ') as w from f3),
cuts as (
  select f2.lang, f2.p, f2.f as a, 1 as k, x.f as l, y.f as r from f2 join f1 x on x.lang = f2.lang and x.p = split_part(f2.p, ' ', 1) join f1 y on y.lang = f2.lang and y.p = split_part(f2.p, ' ', 2)
  union all select long.lang, long.p, long.f, 1, x.f, y.f from long join f1 x on x.lang = long.lang and x.p = w[1] join f2 y on y.lang = long.lang and y.p = w[2] || ' ' || w[3]
  union all select long.lang, long.p, long.f, 2, x.f, y.f from long join f2 x on x.lang = long.lang and x.p = w[1] || ' ' || w[2] join f1 y on y.lang = long.lang and y.p = w[3]),
scores as (select *, a * a * 1000000 // (l * r) as score, row_number() over (partition by lang, p order by a * a * 1000000 // (l * r), k) as c from cuts),
inner_ as (select lang, w[1] || ' ' || w[2] as p, f from long union all select lang, w[2] || ' ' || w[3] as p, f from long),
most as (select lang, p, max(f) as f from inner_ group by lang, p),
left_ as (select scores.* from scores left join most using (lang, p) where c = 1 and (most.f is null or 100 * most.f < 50 * a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from left_)
select lang, rank::bigint as rank, p as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
""",
}
