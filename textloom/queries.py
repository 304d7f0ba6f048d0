"""Registered queries over the driver tables, each with an equivalent DuckDB statement where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import match, text
from textloom.operators import classification, encoders, ranking, sequence, slices, splits, stats
from textloom.operators.tokens import gazetteer_labels, labels_of_any, overlap_labels, token_rows
from textloom.plans import datasets
from textloom.registry import query, table
from textloom.sinks.writers import rolling_shard
from textloom.streaming.sliced import tumbling_counts

CATEGORIES = {"func": ["with", "of the"], "neg": ["worthless", "pathetic"], "legal": ["License", "license"]}
PREFIXES = {"re": ["reê*", "the*"], "th": ["tion*"]}
EXPRESSIONS = {"an": ["of the*", "in the"], "de": ["de la*", "The er*"]}


def _sql_words(p: str, lower: bool = False) -> str:
    """A word-bounded pattern for an engine whose \\b knows ASCII only."""
    return f"{'(?i)' if lower else ''}(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])"


def _sql_any(kws: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches(text, '{_sql_words(k, k.islower())}')" for k in kws) + ")"


_SQL_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')"


# ---- matching


@query("select lang, category, count(*) as n from (" + " union all ".join(f"select lang, '{c}' as category from documents where {_sql_any(k)}" for c, k in CATEGORIES.items()) + ") group by all")
def kw_category_counts(spark, sf):
    df = table(spark, sf, "documents").select("lang", F.explode(match.matched_categories(F.col("text"), CATEGORIES)).alias("category"))
    return df.groupBy("lang", "category").agg(F.count("*").alias("n"))


@query(f"select doc_id from documents where {_sql_any(['with', 'of the'])}")
def kw_any_match(spark, sf):
    return table(spark, sf, "documents").filter(match.contains_any(F.col("text"), ["with", "of the"])).select("doc_id")


@query("select doc_id, list_filter([" + ", ".join(f"case when {_sql_any(k)} then '{c}' end" for c, k in CATEGORIES.items()) + "], lambda x: x is not null) as categories from documents where " + " or ".join(_sql_any(k) for k in CATEGORIES.values()))
def kw_category_collect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", match.matched_categories(F.col("text"), CATEGORIES).alias("categories")).filter(F.size("categories") > 0)


def _sql_prefix(k: str, flag: str = "(?i)") -> str:
    return f"{flag}(^|[^\\p{{L}}\\p{{N}}_])" + k.removesuffix("*")


@query("select doc_id, list_filter([" + ", ".join(f"case when regexp_matches(text, '{_sql_prefix(k)}') then '{k.removesuffix('*')}' end" for ks in PREFIXES.values() for k in ks) + "], lambda x: x is not null) as matches from documents where " + " or ".join(f"regexp_matches(text, '{_sql_prefix(k)}')" for ks in PREFIXES.values() for k in ks))
def kw_prefix_match(spark, sf):
    found = match.keyword_matches(F.col("text"), PREFIXES)
    return table(spark, sf, "documents").select("doc_id", F.transform(found, lambda x: x["match"]).alias("matches")).filter(F.size("matches") > 0)


def _sql_expression(e: str) -> str:
    ws = e.split()
    flag = "(?i)" if all(w.islower() for w in ws) else ""
    inner = "\\s+".join(w[:-1] + "[\\p{L}\\p{N}_]*" if w.endswith("*") else w for w in ws)
    return f"{flag}(^|[^\\p{{L}}\\p{{N}}_]){inner}($|[^\\p{{L}}\\p{{N}}_])"


@query("select doc_id, list_filter([" + ", ".join(f"case when regexp_matches(text, '{_sql_expression(e)}') then '{e}' end" for es in EXPRESSIONS.values() for e in es) + "], lambda x: x is not null) as matches from documents where " + " or ".join(f"regexp_matches(text, '{_sql_expression(e)}')" for es in EXPRESSIONS.values() for e in es))
def expr_phrase_match(spark, sf):
    found = match.expression_matches(F.col("text"), EXPRESSIONS)
    return table(spark, sf, "documents").select("doc_id", F.transform(found, lambda x: x["match"]).alias("matches")).filter(F.size("matches") > 0)


@query(f"select lang, count(*) as n from documents where {_sql_any(['License', 'worthless'])} group by lang")
def coarse_then_exact(spark, sf):
    kws, t = ["License", "worthless"], F.col("text")
    return table(spark, sf, "documents").filter(match.coarse_any(t, kws)).filter(match.contains_any(t, kws)).groupBy("lang").agg(F.count("*").alias("n"))


_KW, _EX = {"a": ["worthless"], "b": ["License"]}, {"a": ["of the*"], "c": ["the er*"]}


@query(
    "with h as (select doc_id, list_filter([case when regexp_matches(text, '" + _sql_words("worthless", True) + "') then 'a' end, case when regexp_matches(text, '" + _sql_words("License", True) + "') then 'b' end], lambda x: x is not null) as k, "
    "list_filter([case when regexp_matches(text, '" + _sql_expression("of the*") + "') then 'a' end, case when regexp_matches(text, '" + _sql_expression("the er*") + "') then 'c' end], lambda x: x is not null) as e from documents) "
    "select doc_id, list_sort(list_distinct(list_concat(k, e))) as matched, len(k) + len(e) as n_matches from h where len(k) + len(e) > 0"
)
def kw_expr_merge(spark, sf):
    d, t = table(spark, sf, "documents"), F.col("text")
    frames = []
    for o, found in enumerate((match.keyword_matches(t, _KW), match.expression_matches(t, _EX))):
        hits = d.select(F.col("doc_id").alias("uuid"), F.lit(o).alias("ord"), found.alias("f")).filter(F.size("f") > 0)
        frames.append(hits.select("uuid", "ord", F.transform("f", lambda x: x["category"]).alias("categories"), F.transform("f", lambda x: x["match"]).alias("matches")))
    return datasets.merge_hits(frames).select(F.col("uuid").alias("doc_id"), F.array_sort("matched").alias("matched"), F.size("matches").cast("long").alias("n_matches"))


# ---- slices

_START, _END = "1995-01-01", "2001-08-01"


@query(
    "with b as (select min(o_orderdate)::date as s, max(o_orderdate)::date + 1 as e from orders), t as (select s, e, unnest(range(0, date_diff('day', s, e) // 10 + 1)) as i from b), "
    "c as (select (date_diff('day', s, o_orderdate::date) // 10) as i, count(*) as n from orders, b group by 1) "
    "select t.i::int as slice_id, (s + (t.i * 10)::int)::varchar as step_start, least(s + ((t.i + 1) * 10)::int, e)::varchar as step_end, round(t.i * 10.0 / date_diff('day', s, e), 9) as progress, coalesce(n, 0) as n from t left join c using (i)"
)
def time_slices(spark, sf):
    """The slices of the orders' own range, with their rows."""
    s = slices.slices_of(table(spark, sf, "orders"), "o_orderdate")
    return s.select("slice_id", F.to_date("step_start").cast("string").alias("step_start"), F.to_date("step_end").cast("string").alias("step_end"), F.round("progress", 9).alias("progress"), "n")


@query(f"select (date_diff('day', date '{_START}', o_orderdate::date) // 10)::int as slice, count(*) as n, sum(o_totalprice)::decimal(20,2)::double as total from orders where o_orderdate >= '{_START}' and o_orderdate < '{_END}' group by 1")
def slice_totals(spark, sf):
    o = table(spark, sf, "orders").filter(slices.in_range(F.col("o_orderdate"), _START, _END))
    g = o.groupBy(slices.slice_id(F.col("o_orderdate"), _START).alias("slice"))
    return g.agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"select slice, o_orderkey, rn from (select (date_diff('day', date '{_START}', o_orderdate::date) // 10)::int as slice, o_orderkey, row_number() over (partition by (date_diff('day', date '{_START}', o_orderdate::date) // 10) order by o_orderdate, o_orderkey)::int as rn from orders) where rn > 2 and rn <= 7")
def slice_topn(spark, sf):
    o = table(spark, sf, "orders").withColumn("slice", slices.slice_id(F.col("o_orderdate"), _START))
    top = slices.first_per_slice(o, ["slice"], ["o_orderdate", "o_orderkey"], 5, 2)
    rn = F.row_number().over(Window.partitionBy("slice").orderBy("o_orderdate", "o_orderkey")) + 2
    return top.select("slice", "o_orderkey", rn.alias("rn"))


@query("select event_type, (date_trunc('day', ts))::date::varchar as day, count(*) as n from events group by 1, 2")
def tumbling_counts_daily(spark, sf):
    w = tumbling_counts(table(spark, sf, "events"), "ts", ["event_type"], "1 day")
    return w.select("event_type", F.to_date("window_start").cast("string").alias("day"), "n")


@query("select user_id, max(event_id) as event_id from events e join (select user_id, max(ts) as ts from events group by user_id) m using (user_id, ts) group by user_id")
def dedup_by_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return slices.last_per_key(e, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id")


# ---- text functions


@query("select doc_id, case when starts_with(text, source) then text else source || chr(10) || chr(10) || text end as joined from documents")
def title_text_concat(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.join_title(F.col("source"), F.col("text")).alias("joined"))


@query("select conv_id, turn, case when starts_with(text, substr(text, 1, 5)) then trim(substr(text, 6), ' ' || chr(9) || chr(10) || chr(13)) else text end as rest from conversations")
def strip_prefix(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.without_prefix(F.col("text"), F.substring("text", 1, 5)).alias("rest"))


@query("select page_id, regexp_extract(regexp_replace(split_part(url, '?', 1), '/+$', ''), '([^/]*)$', 1) as name from pages")
def url_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_file_name(F.col("url")).alias("name"))


@query("select event_id, event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


# ---- joins


@query("select s_suppkey, coalesce(r_name, 'none') as region from supplier left join (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA') on n_nationkey = s_nationkey")
def broadcast_dim_lookup(spark, sf):
    dim = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'ASIA'")  # 25 rows by definition
    s = table(spark, sf, "supplier").join(F.broadcast(dim), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("select d.doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)")
def semi_join_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_join_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


# ---- tokens and annotation

_SQL_TOKENS = r"""
tok as (select doc_id, unnest(range(1, len(w) + 1)) as pos, w from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from short)),
gap as (select doc_id, regexp_split_to_array(text, '\S+') as g from short),
rows_ as (select t.doc_id, t.pos, t.w[t.pos] as token, length(g.g[t.pos]) as gl from tok t join gap g using (doc_id)),
off as (select doc_id, (pos - 1)::int as pos, token, (sum(gl + length(token)) over (partition by doc_id order by pos))::int as end_ from rows_)"""


@query("with short as (select doc_id, text from documents)," + _SQL_TOKENS + " select doc_id, pos, token, end_ - length(token)::int as start, end_ as \"end\" from off")
def token_offsets(spark, sf):
    return token_rows(table(spark, sf, "documents"), ["doc_id"], "text")


_SQL_OVERLAP = (
    "with short as (select doc_id, text from documents)," + _SQL_TOKENS + ", sp as (select doc_id, i as ord, i * 40 as s, i * 40 + 12 as e, case when i % 3 = 0 then 'PERS' when i % 3 = 1 then 'DATE' else 'LOC' end as l from (select doc_id, unnest(range(0, length(text) // 40 + 1)) as i from documents)), "
    "hit as (select o.doc_id, o.pos, arg_min(sp.l, sp.s) as l from off o left join sp on sp.doc_id = o.doc_id and o.end_ - length(o.token) < sp.e and o.end_ > sp.s group by o.doc_id, o.pos) "
    "select doc_id, pos, case when l = 'PERS' then 'B-PER' when l = 'LOC' then 'B-LOC' else 'O' end as label from hit"
)


def _spans(d: DataFrame) -> DataFrame:
    """Every 40 characters one of 12."""
    i = F.col("ord")
    return d.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("length(text) div 40"))).alias("ord")).select("doc_id", "ord", (i * 40).alias("start"), (i * 40 + 12).alias("end"), F.when(i % 3 == 0, "PERS").when(i % 3 == 1, "DATE").otherwise("LOC").alias("label"))


@query(_SQL_OVERLAP)
def interval_overlap(spark, sf):
    """Spans over the whole of every text."""
    d = table(spark, sf, "documents")
    return overlap_labels(d, _spans(d), ["doc_id"], "text", {"PERS": "PER", "DATE": "O"}).select("doc_id", "pos", "label")


@query(_SQL_OVERLAP)
def interval_overlap_binned(spark, sf):
    """The same, with texts of more than 64 spans taken bin by bin."""
    d = table(spark, sf, "documents")
    return labels_of_any(d, _spans(d), ["doc_id"], "text", {"PERS": "PER", "DATE": "O"}, row_spans=64).select("doc_id", "pos", "label")


@query(r"select doc_id, (i - 1)::int as ord, l[i] as sentence from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as l from documents))")
def sentences_from_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.array_remove(F.split("text", "\n"), "")).alias("ord", "sentence"))


@query(
    r"""with c as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from conversations), l as (select conv_id, turn, w, list_transform(w, lambda x: lower(x)) as t from c)
select conv_id, turn, array_to_string(list_transform(w, lambda x, i: case when contains(x, '@') then 'O' when t[i] = 'the' and t[i + 1] = 'er' then 'B-PER' when i > 1 and t[i] = 'er' and t[i - 1] = 'the' then 'I-PER'
  when t[i] = 'of' and t[i + 1] = 'the' and coalesce(t[i + 2], '') <> 'er' then 'B-ORG' when i > 1 and t[i] = 'the' and t[i - 1] = 'of' then 'I-ORG' when t[i] = 'the' then 'B-LOC' else 'O' end), ' ') as labels from l"""
)
def gazetteer_tag(spark, sf):
    names = [(["the", "er"], "PER"), (["of", "the"], "ORG"), (["the"], "LOC")]
    ents = F.array(*[F.struct(F.array(*[F.lit(x) for x in t]).alias("t"), F.lit(f"B-{y}").alias("b"), F.lit(f"I-{y}").alias("i")) for t, y in names])
    c = table(spark, sf, "conversations").select("conv_id", "turn", text.split_space(F.col("text")).alias("toks"), ents.alias("ents"))
    return c.select("conv_id", "turn", F.array_join(gazetteer_labels("toks", "ents"), " ").alias("labels"))


# ---- splits and statistics


@query(
    "select doc_id, lang, case when rn <= floor(n * 0.8::double) then 'train' when rn <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'eval' else 'test' end as split from "
    "(select doc_id, lang, row_number() over (partition by lang order by md5(doc_id::varchar || '-2611'), doc_id) as rn, count(*) over (partition by lang) as n from documents)"
)
def stratified_split(spark, sf):
    return splits.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


def _tagged(spark, sf) -> DataFrame:
    """Sentences with rule-made BIO labels: by the length of the token and of the one before it."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", text.once(text.split_space(F.col("text"))).alias("tokens"))
    lab = F.transform("tokens", lambda x: F.when(F.length(x) % 5 == 0, "B-PER").when(F.length(x) % 5 == 1, "I-PER").when(F.length(x) % 7 == 0, "B-LOC").otherwise("O"))
    return d.withColumn("labels", text.once(lab)).withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test"))


_SQL_TAGGED = r"""
tagged as (select doc_id, lang, case when doc_id % 10 < 8 then 'train' else 'test' end as split, w,
  list_transform(w, lambda x: case when length(x) % 5 = 0 then 'B-PER' when length(x) % 5 = 1 then 'I-PER' when length(x) % 7 = 0 then 'B-LOC' else 'O' end) as l
  from (select doc_id, lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents))"""
_SQL_COUNTS = ", ".join(f"coalesce(sum(len(list_filter(l, lambda x: x = '{t}'))), 0)::bigint as \"{t}\"" for t in ("B-LOC", "B-PER", "I-PER"))


@query(f"with {_SQL_TAGGED} select lang, count(*) as sentences, sum(len(w))::bigint as tokens, {_SQL_COUNTS} from tagged group by lang")
def stats_pivot(spark, sf):
    return stats.label_stats(_tagged(spark, sf), ["lang"])  # the columns are the labels there are


@query(f"with {_SQL_TAGGED} select lang, split, count(*) as sentences, sum(len(w))::bigint as tokens, {_SQL_COUNTS}, grouping(split)::bigint as level from tagged group by grouping sets ((lang), (lang, split))")
def stats_grouping_sets(spark, sf):
    return stats.two_level_stats(_tagged(spark, sf), ["B-LOC", "B-PER", "I-PER"])


@query(f"with {_SQL_TAGGED} select lang, label, count(*) as n from (select lang, unnest(l) as label from tagged) where label <> 'O' group by lang, label")
def label_counts(spark, sf):
    return stats.label_counts(_tagged(spark, sf), ["lang"])


# ---- label encoding


@query("select label, (row_number() over (order by label) - 1)::int as id from (select distinct event_type as label from events)")
def label_index(spark, sf):
    return encoders.numbered(table(spark, sf, "events"), "event_type")


@query(f"with {_SQL_TAGGED}, a as (select distinct unnest(l) as label from tagged union select 'O') select label, (row_number() over (order by case when label = 'O' then '' else substr(label, 3) end, label) - 1)::int as id from a")
def ner_label_ids(spark, sf):
    return encoders.label_list(_tagged(spark, sf))


@query("with v as (select list_sort(list(distinct event_type)) as v from events) select user_id, list_transform(v, lambda x: (list_contains(t, x))::int) as hot from (select user_id, list(distinct event_type) as t from events group by user_id), v")
def multi_hot(spark, sf):
    e = table(spark, sf, "events")
    enc = encoders.MultilabelEncoder.fit(e, "event_type")
    return e.groupBy("user_id").agg(F.collect_set("event_type").alias("t")).select("user_id", enc.vectorize(F.col("t")).alias("hot"))


@query("select user_id, list_sort(list(distinct event_type)) as labels from events group by user_id")
def inverse_hot(spark, sf):
    e = table(spark, sf, "events")
    enc = encoders.MultilabelEncoder.fit(e, "event_type")
    hot = e.groupBy("user_id").agg(F.collect_set("event_type").alias("t")).select("user_id", enc.vectorize(F.col("t")).alias("hot"))
    return hot.select("user_id", enc.unvectorize(F.col("hot")).alias("labels"))


# ---- metrics


def _scores(spark, sf, digits: int | None = None) -> DataFrame:
    """The dimensions of the embeddings as scores, the label and another one as relevance."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("label_idx", "p"))
    p = F.col("p").cast("double")
    return e.select(F.col("vec_id").alias("sample_id"), "label_idx", ((F.col("label") == F.col("label_idx")) | ((F.col("label") + 3) % 10 == F.col("label_idx"))).cast("double").alias("y_true"), (F.round(p, digits) if digits is not None else p).alias("y_prob"))


def _sql_scores(digits: int | None = None) -> str:
    p = "embedding[i]::double"
    p = f"round({p}, {digits})" if digits is not None else p
    return f"s as (select vec_id as sample_id, (i - 1) as idx, case when label = i - 1 or (label + 3) % 10 = i - 1 then 1.0::double else 0.0::double end as y, {p} as p from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)), "


_SQL_RANKED = "r as (select *, row_number() over (partition by sample_id order by p desc, idx desc) as rn, row_number() over (partition by sample_id order by y desc) as ideal, avg(y) over (partition by sample_id, p) as yt, sum(y) over (partition by sample_id) as tot from s) "


def _sql_at_k(ks) -> str:
    per, out = [], []
    for k in ks:
        per.append(f"sum(case when rn <= {k} then y else 0 end) as h{k}, sum(case when rn <= {k} then yt / log2(rn + 1) else 0 end) as d{k}, sum(case when ideal <= {k} then y / log2(ideal + 1) else 0 end) as i{k}")
        out.append(f'round(avg(case when tot > 0 then h{k} / least(tot, {k}) else 0 end), 9) as "r-p@{k}", round(avg(h{k} / {k}), 9) as "p@{k}", round(avg(case when tot > 0 then h{k} / tot else 0 end), 9) as "r@{k}", round(avg(case when i{k} > 0 then d{k} / i{k} else 0 end), 9) as "ndcg@{k}"')
    return f", q as (select sample_id, max(tot) as tot, {', '.join(per)} from r group by sample_id) select {', '.join(out)} from q"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", 9).alias(c) for c in df.columns])


@query("with " + _sql_scores() + _SQL_RANKED + _sql_at_k((1, 3, 5, 7, 9)))
def metrics_at_k(spark, sf):
    return _rounded(ranking.metrics_at_k(_scores(spark, sf)))


@query("with " + _sql_scores(1) + _SQL_RANKED + ", q as (select sample_id, sum(case when rn <= 5 then yt / log2(rn + 1) else 0 end) / sum(case when ideal <= 5 then y / log2(ideal + 1) else 0 end) as v from r group by sample_id) select sample_id, round(v, 9) as ndcg from q")
def ndcg_ties(spark, sf):
    return ranking.per_sample(_scores(spark, sf, 1), (5,)).select("sample_id", F.round("`ndcg@5`", 9).alias("ndcg"))


@query("with " + _sql_scores() + _SQL_RANKED + ", q as (select sample_id, max(tot) as tot, sum(case when rn <= tot then y else 0 end) as h from r group by sample_id) select sample_id, round(case when tot > 0 then h / tot else 0 end, 9) as r_precision from q")
def r_precision(spark, sf):
    return ranking.r_precision_at_k(_scores(spark, sf), None).select("sample_id", F.round("r_precision", 9).alias("r_precision"))


_SQL_PRF = """c as (select sample_id, idx, y::int as t, (p > 0.1)::int as p from s),
l as (select idx, sum((t = 1 and p = 1)::int)::double as tp, sum((t = 0 and p = 1)::int)::double as fp, sum((t = 1 and p = 0)::int)::double as fn from c group by idx),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as lp, case when tp + fn > 0 then tp / (tp + fn) else 0 end as lr, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as lf, tp + fn as sup from l),
e as (select avg(ok) as acc, avg(wrong) as ham from (select sample_id, min((t = p)::int) as ok, avg((t <> p)::int) as wrong from c group by sample_id)) """


@query(
    "with " + _sql_scores() + _SQL_PRF + 'select round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) as "micro.f1", round(sum(tp) / (sum(tp) + sum(fp)), 9) as "micro.p", round(sum(tp) / (sum(tp) + sum(fn)), 9) as "micro.r", '
    'round(avg(lf), 9) as "macro.f1", round(avg(lp), 9) as "macro.p", round(avg(lr), 9) as "macro.r", round(sum(lf * sup) / sum(sup), 9) as "weighted.f1", round(sum(lp * sup) / sum(sup), 9) as "weighted.p", round(sum(lr * sup) / sum(sup), 9) as "weighted.r", '
    'round(max(acc), 9) as acc, round(max(ham), 9) as hamming_loss from m, e'
)
def prf_multilabel(spark, sf):
    return _rounded(classification.prf(classification.decide(_scores(spark, sf), "multilabel", 0.1)))


@query("select 0.0::double as \"macro.f1\", 0.0::double as \"macro.p\", 0.0::double as \"macro.r\", 0.0::double as \"micro.f1\", 0.0::double as \"micro.p\", 0.0::double as \"micro.r\", 0.0::double as \"weighted.f1\", 0.0::double as \"weighted.p\", 0.0::double as \"weighted.r\", 0.0::double as acc, round(sum((quality = 1)::int) - 1.0, 9) / count(*) as hamming_loss from labels")
def degenerate_guard(spark, sf):
    """One true prediction among all labelled documents counts for nothing."""
    lab = table(spark, sf, "labels")
    first = lab.filter("quality = 1").agg(F.min("doc_id").alias("f"))
    s = lab.crossJoin(F.broadcast(first)).select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("label_idx"), F.col("quality").alias("y_true"), (F.col("doc_id") == F.col("f")).cast("double").alias("y_prob"))
    return classification.prf(classification.decide(s, "multilabel"))


_SQL_BIO = _SQL_TAGGED + r""",
pos as (select doc_id, i as pos, l[i] as label, split_part(l[i], '-', 1) as t, case when l[i] = 'O' then '' else substr(l[i], 3) end as y from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from tagged)),
st as (select *, case when t <> 'O' and (t = 'B' or lag(t) over w is null or lag(t) over w = 'O' or lag(y) over w <> y) then 1 else 0 end as s from pos window w as (partition by doc_id order by pos)),
ch as (select *, sum(s) over (partition by doc_id order by pos) as c from st),
ent as (select doc_id, arg_min(y, pos) as type, min(pos)::int - 1 as first, max(pos)::int - 1 as last from ch where t <> 'O' group by doc_id, c)"""


@query(f"with {_SQL_BIO} select doc_id, type, first, last from ent")
def bio_chunks(spark, sf):
    return sequence.chunks(_tagged(spark, sf), ["doc_id"]).select("doc_id", "type", "first", "last")


@query(
    f"with {_SQL_BIO}, pr as (select doc_id, pos, case when pos % 4 = 0 then 'O' else label end as label, case when pos % 4 = 0 then 'O' else t end as t, case when pos % 4 = 0 then '' else y end as y from pos), "
    "st2 as (select *, case when t <> 'O' and (t = 'B' or lag(t) over w is null or lag(t) over w = 'O' or lag(y) over w <> y) then 1 else 0 end as s from pr window w as (partition by doc_id order by pos)), "
    "ch2 as (select *, sum(s) over (partition by doc_id order by pos) as c from st2), ent2 as (select doc_id, arg_min(y, pos) as type, min(pos)::int - 1 as first, max(pos)::int - 1 as last from ch2 where t <> 'O' group by doc_id, c), "
    "n as (select (select count(*) from ent) as g, (select count(*) from ent2) as p, (select count(*) from (select doc_id, type, first, last from ent intersect select doc_id, type, first, last from ent2)) as tp), "
    "acc as (select avg((a.label = b.label)::int) as accuracy from pos a join pr b using (doc_id, pos)) select round(tp / p, 9) as precision, round(tp / g, 9) as recall, round(2 * tp / (p + g), 9) as f1, round(accuracy, 9) as accuracy from n, acc"
)
def entity_prf(spark, sf):
    pred = F.transform("labels", lambda x, i: F.when((i + 1) % 4 == 0, "O").otherwise(x))
    return _rounded(sequence.entity_prf(_tagged(spark, sf).select(F.col("labels").alias("gold"), pred.alias("pred"))))


# ---- sinks


@query("select doc_id, ((row_number() over (order by doc_id) - 1) // 300)::int as shard from documents")
def file_rollup(spark, sf):
    return rolling_shard(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 300)


# ---- whole plans


_SQL_SPACE = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    f"with a as (select doc_id, text, trim(text, {_SQL_SPACE}) as b, source from documents) select doc_id::varchar as uuid, strftime(date '2010-01-01' + (doc_id % 400)::int, '%Y-%m-%dT00:00:00Z') as created, "
    "list_filter([" + ", ".join(f"case when {_sql_any(k)} then '{c}' end" for c, k in CATEGORIES.items()) + "], lambda x: x is not null) as categories, 'print' as media_type, 'News' as section_name, "
    f"length(case when starts_with(b, source) then trim(substr(b, length(source) + 1), {_SQL_SPACE}) else b end)::int as n_body from a where " + " or ".join(_sql_any(k) for k in CATEGORIES.values())
)
def keyword_dataset(spark, sf):
    """The keyword plan over documents shaped as index articles."""
    d = table(spark, sf, "documents")
    body = F.map_from_arrays(F.array("lang"), F.array(F.struct(F.col("source").alias("title"), F.col("text").alias("body"))))
    created = F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    art = d.select(
        F.col("doc_id").cast("string").alias("uuid"), created.alias("created"), created.alias("published"), F.col("lang").alias("language"), F.lit("").alias("url"),
        F.struct(F.lit("m1").alias("uuid"), F.lit("Medium").alias("name"), F.array(F.struct(F.lit("x.MediaType").alias("class"), F.lit("print").alias("name"))).alias("tags")).alias("media"),
        F.struct(F.lit("SI").alias("name")).alias("country"), F.struct(F.lit("r1").alias("uuid"), F.lit("News").alias("name")).alias("rubric"),
        F.array(F.struct(F.lit("t1").alias("uuid"), F.lit("a.CustomerTopicGroup").alias("class"))).alias("tags"), body.alias("translations"),
    )
    out = datasets.keyword_articles(art, datasets.ScanSpec("2010-01-01", "2011-03-01"), CATEGORIES)
    return out.select("uuid", "created", "categories", "media_type", "section_name", F.length("body").alias("n_body"))


