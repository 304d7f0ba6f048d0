"""Registered queries of sources, sinks, plans and streams, over inputs built from the driver tables by stated rules."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import dates, labels, text
from textloom.operators import classification, encoders, ranking, sequence, stats
from textloom.operators.articles import sanitize
from textloom.plans import corpus, datasets
from textloom.queries import _rounded, _sql_expression, _sql_scores, _SQL_RANKED, _SQL_TAGGED, _sql_at_k, _sql_words, _tagged, _scores
from textloom.registry import query, table
from textloom.scratch import folder
from textloom.sinks import runs, writers
from textloom.sources import annotated, records
from textloom.streaming import sliced

_W = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))"
#: One row per line of text: doc_id, ord, w (its tokens).
_SQL_SENTENCES = f"s as (select doc_id, (i - 1)::int as ord, {_W.format('ls[i]')} as w from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, {_LINES} as ls from documents)))"


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x: ~text.blank(x))


def _block(line: Column, row) -> Column:
    """The rows of a line's tokens, joined by line ends."""
    return F.array_join(F.transform(text.split_space(line), row), "\n")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "ord", F.array_join("tokens", " ").alias("sentence"), F.array_join("labels", " ").alias("labels"))


# ---- corpora


def _conll(spark, sf) -> DataFrame:
    """Column files: a comment, token in column 1, label in column 10; a quarter of the files are all outside."""
    d = table(spark, sf, "documents")
    n = lambda x: F.length(x) % 5
    label = lambda x: F.when(F.col("doc_id") % 4 == 0, "o").when(n(x) == 0, "B-per").when(n(x) == 1, "I-loc").otherwise(" O ")
    row = lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x, F.lit("_\t_\t_\t_\t_\t_\t_\t_"), label(x))
    value = F.concat(F.lit("# a comment\n"), F.array_join(F.transform(_lines(), lambda x: _block(x, row)), "\n\n"))
    return annotated.conll(d.select("doc_id", value.alias("value")), 1, annotated.column_or_outside(10), corpus.REMAP["hr500k"], keys=("doc_id",))


_SQL_CONLL = f"""{_SQL_SENTENCES},
c as (select doc_id, ord, w, list_transform(w, lambda x: case when doc_id % 4 = 0 then 'O' when length(x) % 5 = 0 then 'B-PER' when length(x) % 5 = 1 then 'I-LOC' else 'O' end) as l from s),
k as (select doc_id from c group by doc_id having bool_or(len(list_filter(l, lambda x: x <> 'O')) > 0)), conll as (select c.* from c join k using (doc_id))"""


@query(f"with {_SQL_CONLL} select doc_id, ord, array_to_string(w, ' ') as sentence, array_to_string(l, ' ') as labels from conll")
def conll_sentences(spark, sf):
    return _shown(_conll(spark, sf))


@query(
    f"with {_SQL_SENTENCES}, c as (select doc_id, ord, w, list_transform(w, lambda x: case when length(x) % 5 = 0 then 'B-PER' when length(x) % 5 = 1 then 'I-ORG' else 'O' end) as l from s where doc_id % 7 <> 0), "
    "k as (select doc_id from c group by doc_id having bool_or(len(list_filter(l, lambda x: x <> 'O')) > 0)) select doc_id, ord, array_to_string(w, ' ') as sentence, array_to_string(l, ' ') as labels from c join k using (doc_id)"
)
def conllu_misc_labels(spark, sf):
    """Labels as a key of the MISC column, wherever it stands there; files of some names are left out."""
    d = table(spark, sf, "documents").withColumn("file", F.concat(F.when(F.col("doc_id") % 7 == 0, "ambiga").otherwise("doc"), "doc_id")).filter(~F.col("file").rlike("^(ssj500k-tag|ambiga)"))
    n = lambda x: F.length(x) % 5
    misc = lambda x: F.when(n(x) == 0, "SpaceAfter=No|NER=B-per").when(n(x) == 1, "NER=I-org|Gloss=x").when(n(x) == 2, "SpaceAfter=No").otherwise("_")
    row = lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x, F.lit("_\t_\t_\t_\t_\t_\t_"), misc(x))
    value = F.array_join(F.transform(_lines(), lambda x: _block(x, row)), "\n\n")
    return _shown(annotated.conll(d.select("doc_id", value.alias("value")), 1, annotated.misc_column(9), corpus.REMAP["suk"], keys=("doc_id",)))


def _wann(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    row = lambda x: F.concat(F.col("lang"), F.lit(":"), x, F.lit("  "), F.when(F.length(x) % 3 == 0, "B-LOC").otherwise("O"))
    value = F.concat(F.array_join(F.transform(_lines(), lambda x: _block(x, row)), "\n\n"), F.lit("\nlonely\n"))
    return annotated.wann(d.select("doc_id", value.alias("value")), keys=("doc_id",))


_SQL_WANN = "wann as (select doc_id, ord, w, list_transform(w, lambda x: case when length(x) % 3 = 0 then 'B-LOC' else 'O' end) as l from s)"


@query(f"with {_SQL_SENTENCES}, {_SQL_WANN} select doc_id, ord, array_to_string(w, ' ') as sentence, array_to_string(l, ' ') as labels from wann")
def wann_sentences(spark, sf):
    return _shown(_wann(spark, sf))


@query(
    f"with {_SQL_CONLL}, {_SQL_WANN}, u as (select 'conll' as corpus, w, l from conll union all select 'wann', w, l from wann) "
    "select corpus, count(*) as sentences, sum(len(w))::bigint as tokens, sum(len(list_filter(l, lambda x: x <> 'O')))::bigint as labelled, list_sort(list_distinct(list_filter(flatten(list(l)), lambda x: x <> 'O'))) as tags from u group by corpus"
)
def corpus_union(spark, sf):
    parts = [df.select(F.lit(n).alias("corpus"), "tokens", "labels") for n, df in (("conll", _conll(spark, sf)), ("wann", _wann(spark, sf)))]
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.filter("labels", lambda x: x != "O"))))))
    return annotated.union_corpora(parts).groupBy("corpus").agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size(F.filter("labels", lambda x: x != "O"))).cast("long").alias("labelled"), tags.alias("tags"))


@query(
    f"with {_SQL_SENTENCES}, d as (select doc_id, lang, {_W.format('text')} as t from documents where doc_id % 5 <> 0 and doc_id % 3 <> 0), k as (select doc_id, lang, lower(t[1]) as a, lower(t[3]) as b from d where len(t) >= 3) "
    "select doc_id, lang, ord, array_to_string(w, ' ') as sentence, array_to_string(list_transform(w, lambda x: case when contains(x, '@') then 'O' when lower(x) = a then 'B-PER' when lower(x) = b then 'B-MISC' else 'O' end), ' ') as labels from s join k using (doc_id)"
)
def annotated_documents(spark, sf):
    """Raw documents with a header of four lines, and their annotations: the first token a person, the third an event."""
    d = table(spark, sf, "documents").withColumn("t", text.split_space(F.col("text")))
    name = F.concat(F.lit("d"), "doc_id")
    head = F.when(F.col("doc_id") % 5 == 0, F.concat(name, F.lit("\ntoo short"))).otherwise(F.concat(name, F.lit(" \nxx\n2020-01-01\nhttp://u\n"), "text"))
    raw = annotated.raw_documents(d.select("lang", head.alias("value")), ["lang"])
    entity = F.when(F.size("t") >= 3, F.concat(name, F.lit("\n"), F.col("t")[0], F.lit("\tx\tper\nonly\ttwo\n"), F.col("t")[2], F.lit("\tx\tEVT\t1\n")))
    ann = annotated.annotation_entities(d.filter("doc_id % 3 <> 0").filter(entity.isNotNull()).select("lang", F.lit("a.out").alias("file"), entity.alias("value")), ["lang"], corpus.REMAP["bsnlp"])
    found = annotated.tagged_documents(raw, ann, ["lang"], lambda c: F.filter(F.split(c, "\n"), lambda x: ~text.blank(x)), text.split_space)
    return found.select(F.substring("doc_id", 2, 30).cast("long").alias("doc_id"), "lang", "ord", F.array_join("tokens", " ").alias("sentence"), F.array_join("labels", " ").alias("labels"))


@query(
    r"""with g as (select doc_id, regexp_split_to_array(text, '\S+') as g, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents where doc_id % 9 <> 0),
t as (select doc_id, i as pos, w[i] as token, g[i] as gap from (select doc_id, g, w, unnest(range(1, len(w) + 1)) as i from g)),
o as (select doc_id, pos, token, sum(length(gap) + length(token)) over (partition by doc_id order by pos) as e, sum(length(gap) - length(replace(gap, chr(10), ''))) over (partition by doc_id order by pos) as line from t),
sp as (select doc_id, i, i * 40 as s, i * 40 + 12 as f, case i % 3 when 0 then 'PER' when 1 then 'O' else 'LOC' end as l from (select doc_id, unnest(range(0, length(text) // 40 + 1)) as i from documents)),
hit as (select o.doc_id, o.pos, o.line, any_value(o.token) as token, arg_min(sp.l, sp.i) as l from o left join sp on sp.doc_id = o.doc_id and o.e - length(o.token) < sp.f and o.e > sp.s group by o.doc_id, o.pos, o.line)
select doc_id, line::int as ord, string_agg(token, ' ' order by pos) as sentence, string_agg(case when l is null or l = 'O' then 'O' else 'B-' || l end, ' ' order by pos) as labels from hit group by doc_id, line"""
)
def standoff_lines(spark, sf):
    """Texts and files of standoff spans in two layouts, paired by name; a text without spans file is left out."""
    d = table(spark, sf, "documents").withColumn("stem", F.col("doc_id").cast("string"))
    kind = lambda i: F.when(i % 3 == 0, "PERS").when(i % 3 == 1, "DATE").otherwise("LOC")
    number = lambda c: c.cast("string")
    three = lambda i: F.concat_ws("\t", F.concat(F.lit("T"), number(i)), F.concat_ws(" ", kind(i), number(i * 40), number(i * 40 + 12)), F.lit("x"))
    four = lambda i: F.concat_ws("\t", F.concat(F.lit("T"), number(i)), kind(i), number(i * 40), number(i * 40 + 12), F.lit("x"))
    ann = F.array_join(F.transform(F.sequence(F.lit(0), F.expr("length(text) div 40")), lambda i: F.when(i % 2 == 0, three(i)).otherwise(four(i))), "\n")
    files = d.filter("doc_id % 9 <> 0").select("stem", F.concat(F.lit("T0\tBAD a b\tx\n\n"), ann).alias("value"))
    texts = d.join(files.select("stem"), "stem", "left_semi").select("stem", F.col("text").alias("value"))
    found = annotated.standoff_sentences(texts, annotated.standoff_spans(files, ["stem"]), "stem", corpus.REMAP["ner-uk"])
    return _shown(found.withColumn("doc_id", F.col("stem").cast("long")))


# ---- labels, encoders and metrics

@query(
    "with r as (select doc_id, case doc_id % 6 when 0 then ' NER=B-' || lang || '|SpaceAfter=' || source || ' ' when 1 then 'o' when 2 then 'O|' || lang when 3 then 'I-loc' when 4 then 'B-deriv-per' else lang || '-' || source || '|NER=' || lang end as raw from documents), "
    "a as (select *, split_part(trim(raw), '|', 1) as s from r), b as (select *, case when starts_with(s, 'NER=') then substr(s, 5) else s end as n from a), "
    "c as (select *, case when lower(n) = 'o' then 'O' when n = 'B-deriv-per' then 'B-PER' when n = 'I-loc' then 'I-LOC' else n end as label from b) "
    "select doc_id, label, case when contains(label, '-') then substr(label, instr(label, '-') + 1) else '' end as type, split_part(label, '-', 1) as prefix, coalesce(nullif(regexp_extract(trim(raw), '(?:^|\\|)NER=([^|]*)', 1), ''), 'O') as key from c"
)
def label_forms(spark, sf):
    """Labels in six written forms, made of the language and source of each document."""
    forms = [F.concat(F.lit(" NER=B-"), "lang", F.lit("|SpaceAfter="), "source", F.lit(" ")), F.lit("o"), F.concat(F.lit("O|"), "lang"), F.lit("I-loc"), F.lit("B-deriv-per"), F.concat("lang", F.lit("-"), "source", F.lit("|NER="), "lang")]
    d = table(spark, sf, "documents").select("doc_id", F.get(F.array(*forms), (F.col("doc_id") % 6).cast("int")).alias("raw"))
    found = d.withColumn("label", labels.remap(labels.normalize(F.col("raw")), corpus.REMAP["suk"]))
    return found.select("doc_id", "label", labels.bio_type(F.col("label")).alias("type"), labels.bio_prefix(F.col("label")).alias("prefix"), labels.ner_key(text.strip(F.col("raw"))).alias("key"))


@query(
    f"with {_SQL_TAGGED}, i as (select doc_id, list_concat([-100], flatten(list_transform(w, lambda x, k: list_transform(range(length(x) // 4 + 1), lambda j: case l[k] when 'B-PER' then 1 when 'I-PER' then 2 else 0 end))), [-100]) as ids from tagged) "
    "select doc_id, len(ids)::int as n, md5(array_to_string(ids[1:512], ',')) as first, list_sum(ids)::bigint as total from i"
)
def subword_labels(spark, sf):
    """Every piece of four characters of a word gets its label's id, unknown labels that of O, both ends the ignored one."""
    ids = F.create_map(*[F.lit(x) for kv in {"O": 0, "B-PER": 1, "I-PER": 2}.items() for x in kv])
    pieces = F.flatten(F.transform("tokens", lambda x, i: F.array_repeat(i, (F.floor(F.length(x) / 4) + 1).cast("int"))))
    none = F.array(F.lit(None).cast("int"))
    d = _tagged(spark, sf).select("doc_id", text.once(labels.align_subwords(F.concat(none, pieces, none), F.col("labels"), ids)).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.transform(labels.truncate(F.col("ids"), 512), lambda x: x.cast("string")), ",").cast("binary")).alias("first"), total.alias("total"))


@query("select l.doc_id, q.id::int as id, l.quality as back, 'binary' as code from labels l join (select quality, row_number() over (order by quality) - 1 as id from (select distinct quality from labels)) q using (quality)")
def encode_binary(spark, sf):
    lab = table(spark, sf, "labels")
    enc = encoders.ENCODERS["binary"].fit(lab, "quality")
    return lab.select("doc_id", enc.vectorize(F.col("quality")).alias("id")).select("doc_id", "id", enc.unvectorize(F.col("id")).alias("back"), F.lit(enc.code).alias("code"))


@query("select label, (row_number() over (order by ts, event_id) - 1)::int as id from (select event_type as label, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from events group by event_type)")
def first_seen_labels(spark, sf):
    return encoders.first_seen(table(spark, sf, "events"), "event_type", ["ts", "event_id"])


def _one_label(spark, sf, n: int) -> DataFrame:
    """The largest of every n-th dimension as the score of a class, one of n classes true."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "p"))
    e = e.groupBy("vec_id", "label", (F.col("dim") % n).alias("label_idx")).agg(F.max(F.col("p").cast("double")).alias("y_prob"))
    return e.select(F.col("vec_id").alias("sample_id"), "label_idx", (F.col("label") % n == F.col("label_idx")).cast("double").alias("y_true"), "y_prob")


def _sql_one_label(n: int, averages: tuple[str, ...]) -> str:
    macro = {"f1": "avg(case when used then lf end)", "p": "avg(case when used then lp end)", "r": "avg(case when used then lr end)"}
    micro = {"f1": "2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))", "p": "sum(tp) / (sum(tp) + sum(fp))", "r": "sum(tp) / (sum(tp) + sum(fn))"}
    weighted = {k: f"sum(l{k[0]} * sup) / sum(sup)" for k in ("f1", "p", "r")}
    columns = ", ".join(f'round({e}, 9) as "{a}.{m}"' for a in averages for m, e in {"micro": micro, "macro": macro, "weighted": weighted}[a].items())
    return f"""with s as (select vec_id as id, idx, any_value(label) % {n} = idx as t, max(p) as p from (select vec_id, label, (i - 1) % {n} as idx, embedding[i]::double as p from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)) group by vec_id, idx),
b as (select id, arg_max(idx, (p, -idx)) as best from s group by id), c as (select s.id, idx, t, idx = best as y from s join b using (id)),
l as (select idx, sum((t and y)::int)::double as tp, sum((not t and y)::int)::double as fp, sum((t and not y)::int)::double as fn from c group by idx),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as lp, case when tp + fn > 0 then tp / (tp + fn) else 0 end as lr, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as lf, tp + fn as sup, tp + fn > 0 or fp > 0 as used from l),
a as (select avg(ok) as acc from (select id, min((t = y)::int) as ok from c group by id)) select {columns}, round(max(acc), 9) as acc from m, a"""


@query(_sql_one_label(10, ("micro", "macro", "weighted")))
def prf_multiclass(spark, sf):
    return _rounded(classification.prf(classification.decide(_one_label(spark, sf, 10), "multiclass"), "multiclass"))


@query(_sql_one_label(2, ("macro",)))
def prf_binary(spark, sf):
    return _rounded(classification.prf(classification.decide(_one_label(spark, sf, 2), "binary"), "binary"))


@query("with " + _sql_scores().replace("embedding[i]::double as p", "case when (vec_id + i) % 5 = 0 then 0.0::double else embedding[i]::double end as p") + _SQL_RANKED + _sql_at_k((1, 3, 5)))
def metrics_with_nan(spark, sf):
    """Scores that are not numbers, and missing ones, count as zero."""
    s = _scores(spark, sf)
    odd = (F.col("sample_id") + F.col("label_idx") + 1) % 5 == 0
    return _rounded(ranking.metrics_at_k(s.withColumn("y_prob", F.when(odd & (F.col("label_idx") % 2 == 0), float("nan")).when(odd, F.lit(None)).otherwise(F.col("y_prob"))), (1, 3, 5)))


_IDS = {0: "O", 1: "B-X", 2: "I-X"}


@query(
    "with e as (select vec_id, label, list_filter(range(0, 21), lambda k: k % 4 <> 1) as ks, embedding from embeddings) "
    "select vec_id, list_transform(ks, lambda k: ['O', 'B-X', 'I-X'][(label + k) % 3 + 1]) as gold, list_transform(list_transform(ks, lambda k: embedding[k * 3 + 1 : k * 3 + 3]), lambda x: ['O', 'B-X', 'I-X'][list_position(x, list_max(x))]) as pred from e"
)
def aligned_predictions(spark, sf):
    """All positions of three logits each; every fourth is to be ignored."""
    e, places = table(spark, sf, "embeddings"), F.sequence(F.lit(0), F.lit(20))
    logits = F.transform(places, lambda k: F.slice("embedding", k * 3 + 1, 3))
    ids = F.transform(places, lambda k: F.when(k % 4 == 1, -100).otherwise((F.col("label").cast("int") + k) % 3))
    return sequence.aligned(e.select("vec_id", logits.alias("z"), ids.alias("ids")), ["vec_id"], "z", "ids", _IDS)


# ---- articles


def _articles(spark, sf) -> DataFrame:
    """Documents as nested index articles, with the gaps and headers that cleaning has to deal with."""
    i = F.col("doc_id")
    title, url = F.concat(F.lit(" T"), i, F.lit(" ")), F.concat(F.lit("http://u"), i)
    radio = i % 3 == 0
    body = F.when(radio & (i % 2 == 0), F.concat(F.lit("RADIO 1, 12. 3. 2020 JUTRO 8:00\n"), "text")).when(radio, F.concat(F.lit("radio 1 zjutraj\n"), "text")).otherwise(F.concat(F.trim(title), F.lit(" "), url, F.lit(" "), "text"))
    created = F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (i % 400).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    kinds = F.array(F.struct(F.lit("a.MediaType").alias("class"), F.lit("print").alias("name")), F.struct(F.lit("b.MediaType").alias("class"), F.when(radio, "radio").otherwise("web").alias("name")), F.struct(F.lit("c").alias("class"), F.lit("z").alias("name")))
    tags = F.array(F.struct(F.concat(F.lit("t"), i % 4).alias("uuid"), F.lit("a.CustomerTopicGroup").alias("class")), F.struct(F.lit("t1").alias("uuid"), F.lit("other").alias("class")))
    return table(spark, sf, "documents").select(
        i.cast("string").alias("uuid"), created.alias("created"), created.alias("published"), F.col("lang").alias("language"), url.alias("url"),
        F.when(i % 11 != 0, F.struct(F.concat(F.lit("m"), i % 6).alias("uuid"), F.lit("Medium").alias("name"), kinds.alias("tags"))).alias("media"),
        F.when(i % 13 != 0, F.struct(F.lit("SI").alias("name"))).alias("country"), F.when(i % 2 == 0, F.struct(F.lit("r1").alias("uuid"), F.lit("News").alias("name"))).alias("rubric"),
        F.when(i % 5 != 0, tags).alias("tags"), F.map_from_arrays(F.array(F.when(i % 7 == 0, "xx").otherwise(F.col("lang"))), F.array(F.struct(title.alias("title"), body.alias("body")))).alias("translations"),
    )


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
_SQL_ARTICLES = f"""a as (select doc_id, doc_id::varchar as uuid, date '2010-01-01' + (doc_id % 400)::int as day, text, lang,
  case when doc_id % 3 = 0 and doc_id % 2 = 1 then trim('radio 1 zjutraj' || chr(10) || text, {_SPACE}) else trim(text, {_SPACE}) end as body
  from documents where doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 7 <> 0)"""


@query(f"with {_SQL_ARTICLES} select uuid, 'm' || doc_id % 6 as media_uuid, case when doc_id % 3 = 0 then 'radio' else 'web' end as media_type, case when doc_id % 2 = 0 then 'r1' else '' end as section_uuid, case when doc_id % 2 = 0 then 'News' else '' end as section_name, 'SI' as country, 'T' || doc_id as title, length(body)::int as n_body, md5(body) as body from a")
def clean_articles(spark, sf):
    c = sanitize(_articles(spark, sf))
    return c.select("uuid", "media_uuid", "media_type", "section_uuid", "section_name", "country", "title", F.length("body").alias("n_body"), F.md5(F.col("body").cast("binary")).alias("body"))


_START, _END = "2010-02-01", "2010-12-01"


@query(f"with {_SQL_ARTICLES} select uuid, (date_diff('day', date '{_START}', day) // 10)::int as slice from a where day >= '{_START}' and day < '{_END}' and doc_id % 6 in (1, 2)")
def media_scan(spark, sf):
    spec = datasets.ScanSpec(_START, _END, media=("m1", "m2"))
    return sanitize(datasets.scan(_articles(spark, sf), spec), keep=["slice"]).select("uuid", "slice")


_COMPANY = datasets.CompanySpec({"t1": "One", "t3": "Three"}, {"a": ["worthless"], "b": ["License"]}, {"a": ["of the*"], "c": ["the er*"]})


@query(
    f"with {_SQL_ARTICLES}, h as (select uuid, doc_id, list_filter([case when regexp_matches(text, '{_sql_words('worthless', True)}') then 'a' end, case when regexp_matches(text, '{_sql_words('License', True)}') then 'b' end, "
    f"case when regexp_matches(text, '{_sql_expression('of the*')}') then 'a' end, case when regexp_matches(text, '{_sql_expression('the er*')}') then 'c' end], lambda x: x is not null) as m from a where doc_id % 5 <> 0 and day >= '{_START}' and day < '{_END}') "
    "select uuid, list_sort(list_distinct(m)) as matched, len(m)::int as n_matches, case doc_id % 4 when 1 then ['One'] when 3 then ['Three'] else [] end as monitored from h where len(m) > 0"
)
def company_dataset(spark, sf):
    c = datasets.company_articles(_articles(spark, sf), datasets.ScanSpec(_START, _END), _COMPANY)
    return c.select("uuid", F.array_sort("matched").alias("matched"), F.size("matches").alias("n_matches"), "monitored")


# ---- sinks and other sources


@query("select shard, count(*) as n, count(*) as n_csv, sum(doc_id)::bigint as ids, min(doc_id) as first from (select doc_id, ((row_number() over (order by doc_id) - 1) // 70)::int as shard from documents) group by shard")
def article_files(spark, sf):
    """Rolling files of 70 rows written as JSON lines and CSV by a committed run, and read back by the log, beside what a broken run has left."""
    path, d = folder(spark), table(spark, sf, "documents").select("doc_id", "lang", F.array("source").alias("categories"))
    d.write.json(f"{path}/run=broken/jsonl")
    runs.commit_articles(d, path, "first", 70, ["doc_id"])
    runs.commit_articles(d, path, "first", 70, ["doc_id"])  # done already
    found = runs.read_articles(spark, path, "doc_id long, lang string, categories array<string>")
    lines = runs.read_articles(spark, path, "doc_id long, lang string, categories string", "csv")
    return found.groupBy("shard").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.min("doc_id").alias("first")).join(lines.groupBy("shard").agg(F.count("*").alias("n_csv")), "shard")


@query(f"with {_SQL_TAGGED} select lang, split, count(*) as n, sum(len(w))::bigint as tokens, sum(len(list_filter(l, lambda x: x = 'B-PER')))::bigint as persons, sum(length(array_to_string(w, ' ')))::bigint as chars from tagged where len(w) > 0 group by lang, split")
def sentence_files(spark, sf):
    """Sentences written per language and split, and read back."""
    path = folder(spark)
    writers.write_sentences(_tagged(spark, sf), path)
    back = records.prepared_sentences(spark, path, lines=True)
    return back.groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size(F.filter("labels", lambda x: x == "B-PER"))).cast("long").alias("persons"), F.sum(F.length(F.array_join("tokens", " "))).cast("long").alias("chars"))


@query("select case when (doc_id // 50) % 10 = 0 then 'one' || doc_id else (doc_id // 50)::varchar end as file, case when (doc_id // 50) % 10 = 0 then 0 else (row_number() over (partition by doc_id // 50 order by doc_id) - 1)::int end as pos, doc_id, lang from documents")
def json_record_files(spark, sf):
    """Whole JSON texts, most an array of records, some one record, as rows."""
    d = table(spark, sf, "documents").withColumn("n", F.expr("doc_id div 50"))
    single = F.col("n") % 10 == 0
    many = d.filter(~single).groupBy(F.col("n").cast("string").alias("file")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("doc_id", "lang")))).alias("value"))  # 50 each
    one = d.filter(single).select(F.concat(F.lit("one"), "doc_id").alias("file"), F.to_json(F.struct("doc_id", "lang")).alias("value"))
    found = records.records_of(many.unionByName(one))
    return found.select("file", F.col("pos").cast("int").alias("pos"), F.variant_get("record", "$.doc_id", "bigint").alias("doc_id"), F.variant_get("record", "$.lang", "string").alias("lang"))


@query("select doc_id::varchar as docid, source as title, length(text)::bigint as n, lang as query, (doc_id % 3)::int as rel from documents")
def retrieval_files(spark, sf):
    """Topics and judgements as tab-separated files and passages as gzipped JSON lines, read back and joined."""
    d, path = table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string")), folder(spark)
    d.select("id", "lang").write.option("sep", "\t").csv(f"{path}/topics")
    d.select("id", F.lit("Q0"), F.col("id").alias("docid"), (F.col("doc_id") % 3).alias("rel")).write.option("sep", "\t").csv(f"{path}/qrels")
    d.select(F.col("id").alias("docid"), F.col("source").alias("title"), "text").write.option("compression", "gzip").json(f"{path}/passages")
    p = records.passages(spark, f"{path}/passages", 4).select("docid", "title", F.length("text").cast("long").alias("n"))
    q = records.topics(spark, f"{path}/topics").join(records.qrels(spark, f"{path}/qrels"), "qid").select("docid", "query", "rel")
    return p.join(q, "docid").select("docid", "title", "n", "query", "rel")


@query(
    f"with {_SQL_TAGGED}, t as (select lang, count(*)::varchar as n, sum(len(w))::varchar as k from tagged group by lang), r as (select 0 as ord, 'lang' as a, 'sentences' as b, 'tokens' as c union all select row_number() over (order by lang), lang, n, k from t), "
    "m as (select max(length(a)) as a, max(length(b)) as b, max(length(c)) as c from r) select r.ord::int as ord, rpad(r.a, m.a::int, ' ') || '  ' || lpad(r.b, m.b::int, ' ') || '  ' || lpad(r.c, m.c::int, ' ') as line from r, m"
)
def stats_report(spark, sf):
    return stats.report_lines(stats.label_stats(_tagged(spark, sf), ["lang"], []), ["lang"])


@query("select lang, source, count(distinct doc_id) as files, count(*) as rows from documents group by lang, source union all select null, null, count(distinct doc_id), count(*) from documents")
def run_counters(spark, sf):
    return stats.counters(table(spark, sf, "documents"), ["lang", "source"], "doc_id").select("lang", "source", "files", "rows")


@query(f"with {_SQL_TAGGED} select lang, bool_or(len(list_filter(l, lambda x: x <> 'O')) > 0) as has_labels, list_sort(list_distinct(flatten(list(list_filter(l, lambda x: x <> 'O'))))) as tags from tagged group by lang")
def label_sets(spark, sf):
    t = _tagged(spark, sf).withColumn("tags", F.array_distinct(F.filter("labels", lambda x: x != "O")))
    return t.groupBy("lang").agg(F.bool_or(F.size("tags") > 0).alias("has_labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))


@query("select lang, 'wanted' as kind from (select unnest(['en', 'zz', 'qq']) as lang) where lang not in (select lang from documents) union all select lang, 'rows' || count(*) from documents where lang in ('en', 'zz', 'qq') group by lang")
def wanted_languages(spark, sf):
    d = table(spark, sf, "documents")
    rows = corpus.training_rows(d.select("lang", "doc_id"), ["en", "zz", "qq"]).groupBy("lang").agg(F.concat(F.lit("rows"), F.count("*")).alias("kind"))
    return corpus.missing_langs(d, ["en", "zz", "qq"]).select("lang", F.lit("wanted").alias("kind")).unionByName(rows)


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when extract('microsecond' from ts)::int % 1000000 > 0 then '.' || lpad((extract('microsecond' from ts)::int % 1000000)::varchar, 6, '0') else '' end || 'Z' as at, strftime(ts + interval 24 hour, '%Y-%m-%dT%H:%M') as until from events")
def date_forms(spark, sf):
    """Times read with an offset of two hours and written in UTC; a missing end is a day later."""
    e = table(spark, sf, "events").select("event_id", F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("v"))
    t = dates.to_time(F.concat("v", F.lit("+02:00")))
    end = dates.end_or_day(t, F.lit(None).cast("timestamp"))
    return e.select("event_id", dates.zulu(t).alias("at"), F.substring(dates.zulu(end), 1, 16).alias("until"))


@query("select doc_id, 'set-' || lpad(((row_number() over (order by doc_id) - 1) // 40)::varchar, greatest(2, length(((row_number() over (order by doc_id) - 1) // 40)::varchar))::int, '0') as name from documents")
def file_names(spark, sf):
    d = writers.rolling_shard(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 40)
    return d.select("doc_id", text.shard_name("set", F.col("shard")).alias("name"))


# ---- streams


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("select distinct user_id from events")
def stream_dedup(spark, sf):
    """Each key once, by the state of a stream that takes all there is and stops."""
    path = folder(spark)
    stream = sliced.dedup(_event_stream(spark, sf).select("user_id", "ts"), "ts", ["user_id"], "10000 days")
    sliced.each_batch(stream, lambda df, i: df.select("user_id").write.mode("overwrite").parquet(f"{path}/out/batch={i}"), f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{path}/out/*")


@query("select event_type, (date '1970-01-01' + (date_diff('day', date '1970-01-01', ts::date) // 10 * 10)::int)::varchar as day, count(*) as n from events group by 1, 2")
def stream_windows(spark, sf):
    """Counts of ten-day windows as a stream's complete result."""
    path = folder(spark)
    w = sliced.tumbling_counts(_event_stream(spark, sf), "ts", ["event_type"], "10 days")
    q = w.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query("select count(*) as rows, sum(event_id)::bigint as ids, ceil(count(*) / 1000)::int as files from events")
def stream_files(spark, sf):
    """Batches rolled into files of at most 1000 rows, with the state that goes from batch to batch."""
    path, state = folder(spark), sliced.RunState(rows_per_file=1000)
    sliced.rolling_batches(_event_stream(spark, sf).select("event_id"), f"{path}/out", f"{path}/checkpoint", state).awaitTermination()
    return spark.read.schema("event_id long").json(f"{path}/out").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids")).withColumn("files", F.lit(state.file_number))


@query("select count(*) as rows, sum(event_id)::bigint as ids, (select sum(ceil(n / 500))::bigint from (select count(*) as n from events group by event_id % 4)) as files, true as gapless from events")
def stream_restart(spark, sf):
    """A stream of four batches, stopped after two and taken up by a run that knows nothing of the first: files numbered on, no row twice."""
    path, e = folder(spark), table(spark, sf, "events")
    for k in range(4):
        e.filter(F.col("event_id") % 4 == k).select("event_id").coalesce(1).write.parquet(f"{path}/in/part={k}")
    start = lambda control, hook: sliced.rolling_batches(spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*"), f"{path}/out", f"{path}/checkpoint", sliced.RunState(rows_per_file=500), control, hook, ["event_id"])
    control = sliced.Control()

    def second(batch, state):
        control.stop = state.rows_written > 0 and len(state.values) == 1
        state.values[str(len(state.values))] = state.file_number

    try:
        start(control, second).awaitTermination()
    except StreamingQueryException as stopped:
        if "stopped before batch" not in str(stopped):
            raise
    start(None, None).awaitTermination()
    found = sliced.read_batches(spark, f"{path}/out", f"{path}/checkpoint", "event_id long, shard int, batch int")
    return found.agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"), F.count_distinct("shard").alias("files"), (F.count_distinct("shard") == F.max("shard") + 1).alias("gapless"))
