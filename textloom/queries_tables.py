"""Registered queries of operators over large dimension tables, split files, and segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import sql
from textloom.functions import segment, subwords, text
from textloom.operators import pattern_index, stats
from textloom.plans import corpus, datasets
from textloom.queries import _SQL_TAGGED, _tagged
from textloom.queries_plans import _END, _SQL_ARTICLES, _SQL_SENTENCES, _START, _articles
from textloom.registry import query, table
from textloom.scratch import folder, stored
from textloom.sinks import observed, writers
from textloom.sinks.writers import rolling_shard
from textloom.sources import annotated, records, splits, store

# ---- patterns as a table


def _patterns(spark, sf) -> DataFrame:
    """Some thousand patterns made of the documents' own words: from each document, at five places, a word, the
    beginning of a word, two neighbours, and a word before the beginning of another. Even lengths ignore case."""
    d = table(spark, sf, "documents").select(text.once(text.split_space(F.col("text"))).alias("w"))
    w = lambda k: F.get("w", k)
    pure = lambda c: c.rlike("^\\p{L}+$")
    begin = lambda c, n: F.when(pure(c) & (F.length(c) >= n), F.concat(F.substring(c, 1, n), F.lit("*")))
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("pattern"))
    made = []
    for k in range(0, 50, 10):
        a, b, c, e, f, g = (w(k + i) for i in range(1, 7))
        made += [one("keyword", F.when(pure(a), a)), one("keyword", begin(b, 4)), one("expression", F.when(pure(c) & pure(e), F.concat_ws(" ", c, e))), one("expression", F.when(pure(f), F.concat(f, F.lit(" "), begin(g, 3))))]
    rows = d.select(F.explode(F.array(*made)).alias("p")).select("p.kind", "p.pattern").filter("pattern is not null").distinct()
    n = F.length("pattern")
    return rows.select(F.concat(F.lit("c"), n % 7).alias("category"), "kind", F.lit(0).alias("ord"), "pattern", (n % 2 == 0).alias("case_insensitive"))


_RUN = "[\\p{L}\\p{N}_]+"
_SQL_PATTERNS = rf"""
w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents),
spot as (select w, unnest(range(0, 50, 10)) as k from w),
g as (select w[k + 2] as a, w[k + 3] as b, w[k + 4] as c, w[k + 5] as e, w[k + 6] as f, w[k + 7] as g from spot),
made as (
  select 'keyword' as kind, a as x, null as y, false as open from g where regexp_full_match(a, '\p{{L}}+')
  union select 'keyword', substr(b, 1, 4), null, true from g where regexp_full_match(b, '\p{{L}}+') and length(b) >= 4
  union select 'expression', c, e, false from g where regexp_full_match(c, '\p{{L}}+') and regexp_full_match(e, '\p{{L}}+')
  union select 'expression', f, substr(g, 1, 3), true from g where regexp_full_match(f, '\p{{L}}+') and regexp_full_match(g, '\p{{L}}+') and length(g) >= 3),
pat as (select *, case when kind = 'keyword' then x || case when open then '*' else '' end else x || ' ' || y || case when open then '*' else '' end end as pattern from made),
p as (select *, 'c' || length(pattern) % 7 as category, length(pattern) % 2 = 0 as ci, case when length(pattern) % 2 = 0 then lower(x) else x end as kx, case when length(pattern) % 2 = 0 then lower(y) else y end as ky from pat),
t as (select distinct doc_id, unnest(regexp_extract_all(text, '{_RUN}')) as t from documents),
tt as (select doc_id, t, false as ci from t union all select doc_id, lower(t), true from t),
ch as (select doc_id, regexp_extract(w[i], '{_RUN}$') as a, regexp_extract(w[i + 1], '^{_RUN}') as b from (select doc_id, w, unnest(range(1, len(w))) as i from w)),
cc as (select distinct doc_id, a, b, false as ci from ch where a <> '' and b <> '' union select distinct doc_id, lower(a), lower(b), true from ch where a <> '' and b <> ''),
hit as (
  select distinct tt.doc_id, p.kind, p.category, p.pattern from tt join p on p.kind = 'keyword' and not p.open and p.ci = tt.ci and p.kx = tt.t
  union select distinct tt.doc_id, p.kind, p.category, p.pattern from tt join p on p.kind = 'keyword' and p.open and p.ci = tt.ci and p.kx = substr(tt.t, 1, 4)
  union select distinct cc.doc_id, p.kind, p.category, p.pattern from cc join p on p.kind = 'expression' and not p.open and p.ci = cc.ci and p.kx = cc.a and p.ky = cc.b
  union select distinct cc.doc_id, p.kind, p.category, p.pattern from cc join p on p.kind = 'expression' and p.open and p.ci = cc.ci and p.kx = cc.a and p.ky = substr(cc.b, 1, 3))"""


@query(f"with {_SQL_PATTERNS} select doc_id, category, kind, case when kind = 'keyword' then rtrim(pattern, '*') else pattern end as match from hit")
def pattern_table_hits(spark, sf):
    """Every occurrence of a table of patterns that grows with the documents."""
    return pattern_index.pattern_hits(table(spark, sf, "documents"), ["doc_id"], "text", _patterns(spark, sf)).select("doc_id", "category", "kind", "match")


@query(f"with {_SQL_ARTICLES}, {_SQL_PATTERNS} select a.uuid, list_sort(list(distinct h.category)) as categories, count(distinct case when h.kind = 'keyword' then rtrim(h.pattern, '*') else h.pattern end)::int as n_matches from a join hit h using (doc_id) where a.day >= '{_START}' and a.day < '{_END}' group by a.uuid")
def pattern_table_articles(spark, sf):
    """The article plan under the same table."""
    found = datasets.articles_by_table(_articles(spark, sf), datasets.ScanSpec(_START, _END), _patterns(spark, sf))
    return found.select("uuid", F.array_sort("categories").alias("categories"), F.size("matches").alias("n_matches"))


# ---- files read in splits


@query(f"with {_SQL_SENTENCES}, c as (select doc_id, ord, w, list_transform(w, lambda x: case when length(x) % 5 = 0 then 'B-PER' when length(x) % 5 = 1 then 'I-LOC' else 'O' end) as l from s) select doc_id, ord, array_to_string(w, ' ') as sentence, array_to_string(l, ' ') as labels, true as gapless from c")
def conll_split_files(spark, sf):
    """All documents in column files of many documents each, read in splits; each token carries its document and line."""
    n = lambda x: F.length(x) % 5
    label = lambda x: F.when(n(x) == 0, "B-per").when(n(x) == 1, "I-loc").otherwise(" O ")
    lines = F.filter(F.split("text", "\n"), lambda x: ~text.blank(x))
    row = lambda x, i: F.concat_ws("\t", F.concat_ws("|", "doc_id", i.cast("string"), x), F.lit("_\t_\t_\t_\t_\t_\t_\t_\t_"), label(x))
    block = lambda x, i: F.array_join(F.transform(text.split_space(x), lambda t: row(t, i)), "\n")
    path = folder(spark)
    table(spark, sf, "documents").filter(F.size(lines) > 0).select(F.concat(F.lit("# a comment\n"), F.array_join(F.transform(lines, block), "\n\n")).alias("value")).write.option("lineSep", "\n\n").text(path)
    found = annotated.conll_files(spark, path, 0, annotated.column_or_outside(10), corpus.REMAP["hr500k"], glob="part-*")
    files = found.groupBy("path").agg((F.count_distinct("ord") == F.max("ord") + 1).alias("gapless"))
    key = F.split(F.col("tokens")[0], "\\|")
    plain = F.transform("tokens", lambda t: F.regexp_replace(t, "^[0-9]+\\|[0-9]+\\|", ""))
    # a row for each task that wrote: it goes to the sentences, which are not shuffled
    return found.join(F.broadcast(files), "path").select(key[0].cast("long").alias("doc_id"), key[1].cast("int").alias("ord"), F.array_join(plain, " ").alias("sentence"), F.array_join("labels", " ").alias("labels"), "gapless")


@query("select (doc_id // 1000)::varchar || '.json' as file, (row_number() over (partition by doc_id // 1000 order by doc_id) - 1)::bigint as pos, doc_id, lang, md5(text) as text from documents")
def json_array_files(spark, sf):
    """Array files of a thousand whole documents each, texts with brackets, quotes and escapes, read in pieces."""
    d, path = table(spark, sf, "documents"), folder(spark)
    group = F.expr("cast(doc_id div 1000 as string)")
    records = F.array_sort(F.collect_list(F.struct("doc_id", "lang", F.struct("text", F.array(F.lit('}{"'), F.lit("\\\"}]")).alias("odd")).alias("body"))))
    made = d.groupBy(group.alias("g")).agg(F.to_json(records).alias("value"))  # a thousand each
    made.repartition("g").write.partitionBy("g").option("lineSep", "\n").text(path)
    found = splits.json_array_items(spark, path, "part-*")
    get = lambda k, t: F.variant_get("record", k, t)
    return found.select(F.concat(F.regexp_extract("path", "g=([0-9]+)/", 1), F.lit(".json")).alias("file"), "pos", get("$.doc_id", "bigint").alias("doc_id"), get("$.lang", "string").alias("lang"), F.md5(get("$.body.text", "string").cast("binary")).alias("text"))


# ---- sentences and sub-words

_ABBREVIATIONS = sorted({a for known in segment.ABBREVIATIONS.values() for a in known})
_SQL_ABBREVIATIONS = "|".join(a.replace(".", "\\.") for a in _ABBREVIATIONS)
_TAIL = r"""\.[)\]}"''»”’]{0,3}\s*$"""


@query(
    r"with l as (select doc_id, li, ls[li] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as li from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) as ls from documents))), "
    r"""p as (select doc_id, li, string_split(regexp_replace(line, '([.!?…][)\]}"''»”’]{0,3}\s+)', '\1' || chr(1), 'g'), chr(1)) as p, case when contains(line, '„') then '”' else '«' end as low from l), """
    r"""b as (select *, list_transform(p, lambda x: length(regexp_replace(replace(x, '“', low), '[)\]}»”]', '', 'g')) - length(regexp_replace(replace(x, '“', low), '[(\[{„«]', '', 'g'))) as d from p), """
    r"j as (select doc_id, li, array_to_string(list_transform(p, lambda x, i: x || case when "
    rf"regexp_matches(lower(x), '(^|[^\p{{L}}\p{{N}}_.])({_SQL_ABBREVIATIONS}){_TAIL}') or regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_.])\p{{L}}{_TAIL}') "
    rf"or (regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_.])[0-9]+{_TAIL}') and regexp_matches(coalesce(p[i + 1], ''), '^[0-9\p{{Ll}}]')) "
    r"""or regexp_matches(coalesce(p[i + 1], ''), '^[(\[{„«“"''‘]*\p{Ll}') or list_sum(d[1:i]) > 0 then '' else chr(1) end), '') as s from b), """
    rf"s as (select doc_id, li, list_filter(list_transform(string_split(s, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') as s from j), "
    r"f as (select doc_id, flatten(list(s order by li)) as s from s group by doc_id) "
    r"select doc_id, (i - 1)::int as ord, s[i] as sentence, len(regexp_extract_all(s[i], '[0-9]+(?:[.,:][0-9]+)+|[\p{L}\p{N}_@]+(?:[-''’.@][\p{L}\p{N}_@]+)*|\.{2,}|[^\p{L}\p{N}_\s]'))::int as n_words from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from f)"
)
def segmented_sentences(spark, sf):
    """Sentences of all documents by the rule table, and the number of words in each."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("ord", "sentence"))
    return d.select("doc_id", "ord", "sentence", F.size(segment.words(F.col("sentence"))).alias("n_words"))


@query(
    r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from documents), v as (select distinct unnest(ws) as w from w),
chars as (select distinct unnest(string_split(w, '')) as c from v),
three as (select distinct substr(w, 1, 3) as p from v where length(w) >= 3 and md5(substr(w, 1, 3)) < '8'), two as (select distinct substr(w, length(w) - 1) as p from v where length(w) >= 4 and md5(substr(w, length(w) - 1)) < '8'),
r as (
  select w, 1 as pos, []::varchar[] as p from v
  union all
  select r.w, r.pos + case when three.p is not null then 3 when two.p is not null then 2 else 1 end,
    list_append(r.p, case when three.p is not null then three.p when r.pos = 1 then substr(r.w, 1, 1) else '##' || coalesce(two.p, substr(r.w, r.pos, 1)) end)
  from r left join three on r.pos = 1 and substr(r.w, 1, 3) = three.p left join two on r.pos > 1 and substr(r.w, r.pos, 2) = two.p and r.pos + 1 <= length(r.w) where r.pos <= length(r.w)),
done as (select w, p from r where pos > length(w)),
d as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w),
x as (select doc_id, flatten(list(p order by i)) as pieces, flatten(list(list_transform(p, lambda x: i - 1) order by i)) as places from d join done on done.w = d.ws[i] group by doc_id)
select doc_id, len(pieces)::int as n, md5(array_to_string(pieces, ' ')) as pieces, md5(array_to_string(places, ' ')) as words, greatest(1, ceil((len(pieces) - 32) / 480.0))::int as windows, (list_aggregate(list_transform(range(0, greatest(1, ceil((len(pieces) - 32) / 480.0))::bigint), lambda k: len(pieces[k * 480 + 1 : k * 480 + 512])), 'sum'))::int as in_windows from x"""
)
def subword_pieces(spark, sf):
    """Every word cut into the longest pieces of a vocabulary: all characters, and beginnings and ends of words chosen by digest."""
    d = table(spark, sf, "documents").select("doc_id", text.once(text.split_space(F.col("text"))).alias("tokens"))
    w = d.select(F.explode("tokens").alias("w")).distinct()
    chosen = lambda c: F.md5(c.cast("binary")) < "8"
    three, two = F.substring("w", 1, 3), F.expr("substring(w, length(w) - 1)")
    letters = w.select(F.explode(F.array_remove(F.split("w", ""), "")).alias("c")).distinct()
    pieces = letters.select(F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece"))
    pieces = pieces.unionByName(w.filter(F.length("w") >= 3).filter(chosen(three)).select(three.alias("piece"))).unionByName(w.filter(F.length("w") >= 4).filter(chosen(two)).select(F.concat(F.lit("##"), two).alias("piece"))).distinct()
    vocabulary = stored(rolling_shard(pieces, ["piece"], 1).select("piece", (F.col("shard") + 1).alias("id")))
    cut = subwords.with_subwords(d, "tokens", vocabulary, pieces="pieces")
    wins = subwords.windows(F.col("piece_ids"), 512, 32)
    digest = lambda c: F.md5(F.array_join(c, " ").cast("binary"))
    total = F.aggregate(F.transform("wins", lambda x: F.size(x)), F.lit(0), lambda a, x: a + x)
    shown = cut.select("doc_id", F.size("piece_ids").alias("n"), digest("pieces").alias("pieces"), digest(F.transform("word_ids", lambda x: x.cast("string"))).alias("words"), text.once(wins).alias("wins"))
    return shown.filter("n > 0").select("doc_id", "n", "pieces", "words", F.size("wins").alias("windows"), total.alias("in_windows"))


# ---- operators in SQL alone, counters, and small sources and sinks by files


@query(f"with {_SQL_SENTENCES} select doc_id, ord, array_to_string(w, ' ') as sentence, array_to_string(list_transform(w, lambda x: case when length(x) % 5 = 0 then 'per' when length(x) % 5 = 1 then 'loc' else '' end), ' ') as types from s")
def sql_functions(spark, sf):
    """Column files read and their labels selected by a statement of SQL."""
    sql.register(spark)
    d = table(spark, sf, "documents")
    label = lambda x: F.when(F.length(x) % 5 == 0, "B-per|x=1").when(F.length(x) % 5 == 1, " NER=I-loc ").otherwise(" o ")
    row = lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x, label(x))
    lines = F.filter(F.split("text", "\n"), lambda x: ~text.blank(x))
    block = lambda x: F.array_join(F.transform(text.split_space(x), row), "\n")
    files = d.select("doc_id", F.concat(F.lit("# a comment\n"), F.array_join(F.transform(lines, block), "\n\n")).alias("value"))
    return spark.sql(
        "SELECT f.doc_id, s.ord, array_join(s.tokens, ' ') AS sentence, array_join(loom_bio_types(loom_labels(s.raw)), ' ') AS types FROM {files} f, LATERAL loom_conll(f.value, 1, 2) s",
        files=files,
    )


@query(f"with {_SQL_SENTENCES}, c as (select doc_id, w, len(list_filter(w, lambda x: length(x) % 5 < 2)) as k, ord from s) select count(*) as rows, count(distinct doc_id) as files, sum(len(w))::bigint as tokens, sum(k)::bigint as labelled from c")
def observed_counters(spark, sf):
    """What a run reports, counted by the job that writes its sentences."""
    lines = F.filter(F.split("text", "\n"), lambda x: ~text.blank(x))
    d = table(spark, sf, "documents").select("lang", F.posexplode(lines).alias("ord", "line")).select("lang", "ord", text.once(text.split_space(F.col("line"))).alias("tokens"))
    d = d.withColumn("labels", text.once(F.transform("tokens", lambda x: F.when(F.length(x) % 5 < 2, "B-PER").otherwise("O"))))
    path = folder(spark)
    found = observed.observed(d, observed.sentence_counters(), lambda df: writers.write_sentences(df.drop("ord"), path))
    return spark.createDataFrame([found], "rows long, files long, tokens long, labelled long")  # the one row of counters


@query(f"with {_SQL_SENTENCES}, c as (select doc_id, ord, w, list_transform(w, lambda x: case when length(x) % 3 = 0 then 'B-LOC' else 'O' end) as l from s), k as (select doc_id from c group by doc_id having bool_or(len(list_filter(l, lambda x: x <> 'O')) > 0)) select doc_id, ord, array_to_string(w, ' ') as sentence, array_to_string(l, ' ') as labels from c join k using (doc_id)")
def conll_last_column(spark, sf):
    """Token in the first column and label in the last, of lines of two or of three columns."""
    lines = F.filter(F.split("text", "\n"), lambda x: ~text.blank(x))
    row = lambda x: F.concat_ws("\t", x, F.when(F.length(x) % 2 == 0, "extra"), F.when(F.length(x) % 3 == 0, "B-LOC").otherwise("o"))
    block = lambda x: F.array_join(F.transform(text.split_space(x), row), "\n")
    files = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(lines, block), "\n\n").alias("value"))
    found = annotated.conll(files, 0, annotated.last_column, {}, keys=("doc_id",))
    return found.select("doc_id", "ord", F.array_join("tokens", " ").alias("sentence"), F.array_join("labels", " ").alias("labels"))


_SPLITS = ("dev", "test", "train")


@query("select case when doc_id % 10 = 0 then 'dev' when doc_id % 10 = 1 then 'test' else 'train' end as split, doc_id, lang, md5(text) as text from documents")
def split_folders(spark, sf):
    """Split folders of JSON files found, merged, written as JSON lines and read back."""
    d, path = table(spark, sf, "documents"), folder(spark)
    split = F.when(F.col("doc_id") % 10 == 0, "dev").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    made = d.groupBy(split.alias("split"), F.expr("doc_id div 500").alias("g")).agg(F.collect_list(F.struct("doc_id", "lang", "text")).alias("items"))  # 500 at most
    for s in _SPLITS:
        if records.missing_splits(spark, path, (s,)):
            made.filter(F.col("split") == s).select("items").write.option("maxRecordsPerFile", 1).json(f"{path}/dataset/{s}")
    merged = records.merged_splits(spark, path, _SPLITS).select("split", F.explode(F.variant_get("record", "$.items", "array<struct<doc_id:bigint,lang:string,text:string>>")).alias("x"))
    writers.write_json_lines(merged.select("split", "x.*"), f"{path}/merged")
    return spark.read.schema("split string, doc_id long, lang string, text string").json(f"{path}/merged").withColumn("text", F.md5(F.col("text").cast("binary")))


@query(f"with {_SQL_TAGGED} select lang, split, count(*)::varchar as sentences, sum(len(w))::varchar as tokens from tagged where len(w) > 0 and lang in (select min(lang) from documents union select max(lang) from documents) group by lang, split")
def split_reports(spark, sf):
    """Prepared files written per split, the splits found in them, the rows of two languages for training, and their statistics as a CSV file read back."""
    path = folder(spark)
    writers.write_sentences(_tagged(spark, sf), path)
    sentences = records.prepared_sentences(spark, path, lines=True)
    wanted = list(table(spark, sf, "documents").agg(F.min("lang"), F.max("lang")).first())
    found = records.found_splits(sentences)
    rows = reduce(DataFrame.unionByName, corpus.training_splits(sentences, wanted, tuple(found)).values())
    writers.write_stats(stats.label_stats(rows, ["lang", "split"], []), f"{path}-stats")
    return spark.read.option("header", True).csv(f"{path}-stats")


@query("select 'docs-' || (doc_id // 250) || '.zip' as archive, doc_id || '.txt' as member, md5(coalesce(text, '')) as text from documents")
def fetched_archives(spark, sf):
    """All documents packed in archives of 250 files, fetched by their URLs into the shared store and read from there."""
    d, path = table(spark, sf, "documents"), folder(spark)
    rows = d.select(F.concat(F.lit("docs-"), F.expr("doc_id div 250"), F.lit(".zip")).alias("archive"), F.concat("doc_id", F.lit(".txt")).alias("member"), F.col("text").alias("content"))
    fetched = store.fetch(store.pack(rows, f"{path}/offered"), f"{path}/staged")
    found = records.zip_members(spark, f"{path}/staged").withColumn("archive", F.substring_index("archive", "/", -1))
    return found.join(fetched.select(F.col("file").alias("archive")), "archive").select("archive", "member", F.md5("content").alias("text"))
