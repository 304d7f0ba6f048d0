"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, hard_negatives, html_text, lexical_search, line_dedup, mixing, pii, quality, sharding, simhash, tokens, url_filter, warc
from textloom.llm.common import load

TOKENIZER = "piece_bpe_32k.model"


def op1_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(load(spark, sf_dir, "documents"))


def op2_warc_zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(load(spark, sf_dir, "pages"))


def op3_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(load(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(load(spark, sf_dir, "documents"))


def op5_decontamination_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_mixture_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture as ids: each document once for each epoch that takes it."""
    docs = load(spark, sf_dir, "documents")
    return mixing.mixed(docs, epoch_col="epoch").select("doc_id", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", "epoch")


def op7_sharding_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


#: The rule-made list log of op9: per host, per parent domain and per one and two leading path segments, dated by a digest of the
#: key: listed, removed after 90 days, listed again with the other action after 150, and at the same instant removed
#: and listed where the digest says so. Keys are written in other forms than the captures have.
LIST_START = "2024-01-01"


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list log over the hosts of pages: list_name, kind, key, action, listed_at."""
    host, path = url_filter.host_of(F.col("url")), url_filter.segments_of(url_filter.path_of(F.col("url")))
    hosts = pages.select(host.alias("host"), F.array_join(F.slice(path, 1, 1), "/").alias("one"), F.array_join(F.slice(path, 1, 2), "/").alias("two")).filter("host != ''").distinct()
    keys = hosts.select(
        F.explode(
            F.array(
                F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")),
                F.struct(F.lit("domain").alias("kind"), F.substring_index("host", ".", -2).alias("key")),
                F.struct(F.lit("prefix").alias("kind"), F.when(F.col("one") != "", F.concat("host", F.lit("/"), "one")).alias("key")),
                F.struct(F.lit("prefix").alias("kind"), F.when(F.col("two") != "", F.concat("host", F.lit("/"), "two")).alias("key")),
            )
        ).alias("k")
    ).select("k.kind", "k.key").filter("key is not null").distinct()
    dated = keys.withColumn("x", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")).filter("x % 3 = 0")
    start = F.date_add(F.lit(LIST_START).cast("date"), F.col("x") % 300)

    def event(action, days: int):
        return F.struct(action.alias("action"), F.date_add(start, days).cast("timestamp").alias("at"))

    first, second = (F.when(F.col("x") % 2 == k, "block").otherwise("allow") for k in (0, 1))
    same = F.when(F.col("x") % 5 == 0, F.lit("remove")).otherwise(second)  # an action beside a removal wins
    log = F.array(event(first, 0), event(F.lit("remove"), 90), event(second, 150), event(same, 150))
    events = dated.select("kind", "x", "key", F.explode(log).alias("e"))
    written = F.when(F.col("kind") == "prefix", F.concat(F.lit("https://www."), "key", F.lit("/"))).when(F.col("x") % 4 == 0, F.concat(F.lit("WWW."), F.upper("key"), F.lit("."))).otherwise(F.col("key"))
    return events.select(F.concat(F.lit("by_"), "kind").alias("list_name"), "kind", written.alias("key"), F.col("e.action").alias("action"), F.col("e.at").alias("listed_at"))


def op9_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active on its (rule-made) fetch day."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit(LIST_START).cast("date"), (F.col("page_id") * 37 % 365).cast("int")).cast("timestamp")
    found = url_filter.filter_urls(pages.withColumn("fetched_at", fetched), list_entries(pages))
    return found.select("page_id", "url", "blocked", "list_name", "kind", "key", F.to_date("listed_at").cast("string").alias("listed_on"))


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op11_lexical_search_sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_line_dedup_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_hard_negatives_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row as anchor; labels of every seventh row are one further."""
    rows = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0, scale=256)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_anchor_expansion, op2_warc_zstd_roundtrip, op3_html_text_density, op4_quality_rules, op5_decontamination_spaced_seeds,
        op6_mixture_budgets, op7_sharding_by_bytes, op8_token_counts, op9_url_temporal_lists, op10_simhash_pigeonring,
        op11_lexical_search_sparse_product, op12_line_dedup_perfect_hash, op13_hard_negatives_distance_keys,
    )
}

#: op6 to op8, op1, op3 and op10 cannot be expressed in SQL with the same functions; they are tested against brute force.
ORACLES: dict[str, str] = {}
ORACLES["op2_warc_zstd_roundtrip"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as n, sha256(html) as h from p),
f as (select h, min(page_id) as first from d where n >= 100 group by h)
select d.page_id, d.n as payload_bytes, d.h as payload_digest,
  case when f.first <> d.page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> d.page_id then f.first end as refers_to
from d left join f on f.h = d.h and d.n >= 100
"""
_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
ORACLES["op4_quality_rules"] = rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
win as (select doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l)::bigint as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda x: lower(x) in ({_STOP})))::bigint as n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::bigint as n_alpha
  from d left join cov c on c.doc_id = d.doc_id),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words <= 10000000 and word_chars / greatest(n_words, 1) between 2.0 and 20.0 and n_symbols / greatest(n_words, 1) <= 0.25
  and n_stop >= 2 and n_stop / greatest(n_words, 1) >= 0.02 and n_dup_lines / greatest(n_lines, 1) <= 0.5 and n_alpha / greatest(n_words, 1) >= 0.6 as kept
from b
"""
#: All alignments with three equal tokens in a row, which every overlap that counts has; no masks and no hashes.
ORACLES["op5_decontamination_spaced_seeds"] = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
dg as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
bg as (select item_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select item_id, w, unnest(range(1, len(w) - 1)) as i from b)),
dia as (select distinct dg.doc_id, bg.item_id, dg.i - bg.i as shift from dg join bg using (g)),
pos as (
  select dia.doc_id, dia.item_id, dia.shift, least(20, len(b.w)) as need, len(b.w) as n, len(d.w) as nd, unnest(range(greatest(1, 1 - shift), least(len(b.w), len(d.w) - shift) + 1)) as j, b.w as bw, d.w as dw
  from dia join d using (doc_id) join b using (item_id)),
agree as (select doc_id, item_id, shift, need, n, nd, j, (bw[j] = dw[j + shift])::int as m from pos),
win as (
  select *, sum(m) over (partition by doc_id, item_id, shift order by j rows between current row and 19 following) as s20, count(*) over (partition by doc_id, item_id, shift order by j rows between current row and 19 following) as c20,
    sum(m) over (partition by doc_id, item_id, shift) as s_all, count(*) over (partition by doc_id, item_id, shift) as c_all
  from agree),
ok as (
  select doc_id, item_id, need, j + shift - 1 as start, case when need = 20 then s20 else s_all end as s from win
  where case when need = 20 then c20 = 20 and s20 >= 16 else j = 1 and c_all = n and s_all >= case when n < 12 then n else ceil(0.8 * n) end and (n >= 6 or nd = n) end)
select doc_id, item_id, max(s)::int as n_match, min(need)::int as n_window, min(start)::int as first_token from ok group by doc_id, item_id
"""
ORACLES["op9_url_temporal_lists"] = r"""
with p as (
  select page_id, url, date '2024-01-01' + (page_id * 37 % 365)::int as day,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '\.+$', ''), '^www\.', '') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') as segs
  from pages),
hosts as (select distinct host, array_to_string(segs[1:1], '/') as one, array_to_string(segs[1:2], '/') as two from p where host <> ''),
keys as (
  select 'host' as kind, host as key from hosts
  union select 'domain', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') from hosts
  union select 'prefix', host || '/' || one from hosts where one <> ''
  union select 'prefix', host || '/' || two from hosts where two <> ''),
dated as (select kind, key, x, date '2024-01-01' + x % 300 as start from (select kind, key, ('0x' || substr(md5(key), 1, 6))::int as x from keys) where x % 3 = 0),
e as (
  select kind, key, case when x % 2 = 0 then 'block' else 'allow' end as action, start as since, start + 90 as until from dated
  union all select kind, key, case when x % 2 = 1 then 'block' else 'allow' end, start + 150, null from dated),
c as (
  select page_id, day, 'host' as kind, host as key from p where host <> ''
  union all select page_id, day, 'domain', array_to_string(list_slice(labels, i, len(labels)), '.')
    from (select page_id, day, string_split(host, '.') as labels, unnest(range(1, len(string_split(host, '.')) + 1)) as i from p where host <> '')
  union all select page_id, day, 'prefix', host || '/' || array_to_string(segs[1:i], '/')
    from (select page_id, day, host, segs, unnest(range(1, len(segs) + 1)) as i from p where host <> '')),
best as (
  select c.page_id, e.kind, e.key, e.action, e.since,
    row_number() over (partition by c.page_id order by length(e.key) desc, case when e.action = 'block' then 1 else 0 end desc, e.kind desc) as rn
  from c join e on c.kind = e.kind and c.key = e.key and e.since <= c.day and (e.until is null or c.day < e.until))
select p.page_id, p.url, coalesce(b.action = 'block', false) as blocked, 'by_' || b.kind as list_name, b.kind, b.key, b.since::varchar as listed_on
from p left join best b on b.page_id = p.page_id and b.rn = 1
"""
ORACLES["op11_lexical_search_sparse_product"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
g as (select count(*) filter (len(t) > 0)::bigint as n_docs, sum(len(t))::bigint as n_terms from d),
tf as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, len(t)::bigint as n, unnest(t) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, g where term in (select term from q) group by term),
s as (
  select q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + ((90 * tf.n * g.n_docs) // g.n_terms)))))::bigint as score
  from q join w using (term) join tf using (term), g group by q.item_id, tf.doc_id),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
ORACLES["op12_line_dedup_perfect_hash"] = r"""
with l as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
k as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
bad as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, k.key in (select key from bad) as gone from k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id
"""
ORACLES["op13_hard_negatives_distance_keys"] = r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id, score from (select *, row_number() over (partition by anchor_id order by score desc, id) as r from s where same) where r <= 5),
n as (
  select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as r, s.id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from n where r <= 10
"""
