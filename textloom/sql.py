"""The operators as functions of SQL: native expressions and table functions of the session, without Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textloom.functions.text import LINE_END, WHITE

_LINE_END = LINE_END.replace("\\", "\\\\")

FUNCTIONS = {
    # stripped, before the first |, without NER=; any o is O
    "loom_label": (
        "(raw STRING) RETURNS STRING",
        "(SELECT if(lower(s) = 'o', 'O', s) FROM (SELECT if(startswith(p, 'NER='), substring(p, 5), p) AS s FROM (SELECT substring_index(regexp_replace(raw, '(?U)^\\\\s+|\\\\s+$', ''), '|', 1) AS p)))",
    ),
    "loom_ner_key": ("(misc STRING) RETURNS STRING", "coalesce(nullif(regexp_extract(misc, '(?:^|\\\\|)NER=([^|]*)', 1), ''), 'O')"),
    "loom_bio_type": ("(label STRING) RETURNS STRING", "if(instr(label, '-') > 0, substring(label, instr(label, '-') + 1), '')"),
    "loom_bio_prefix": ("(label STRING) RETURNS STRING", "substring_index(label, '-', 1)"),
    # the same of whole arrays, which stay in their rows
    "loom_labels": (
        "(raw ARRAY<STRING>) RETURNS ARRAY<STRING>",
        "transform(transform(transform(raw, r -> substring_index(trim(BOTH '%s' FROM r), '|', 1)), p -> if(startswith(p, 'NER='), substring(p, 5), p)), s -> if(lower(s) = 'o', 'O', s))" % WHITE,
    ),
    "loom_bio_types": ("(labels ARRAY<STRING>) RETURNS ARRAY<STRING>", "transform(labels, x -> if(instr(x, '-') > 0, substring(x, instr(x, '-') + 1), ''))"),
    # the sentences of a whole column file; cells are given from 0
    "loom_conll": (
        "(value STRING, token_at INT, label_at INT) RETURNS TABLE (ord INT, tokens ARRAY<STRING>, raw ARRAY<STRING>)",
        f"""SELECT ord, transform(x, c -> c[token_at]), transform(x, c -> coalesce(get(c, label_at), 'O'))
  FROM (SELECT posexplode(filter(transform(
    split(array_join(filter(transform(split(value, '{_LINE_END}'), l -> if(trim(LEADING '{WHITE}' FROM l) = '', '', l)), l -> NOT startswith(l, '#')), '\\n'), '\\n{{2,}}|^\\n|\\n$'),
    p -> filter(transform(array_remove(split(p, '\\n'), ''), l -> split(l, '\\t')), c -> size(c) > token_at)), s -> size(s) > 0)) AS (ord, x))""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary ones of the session; their names."""
    for name, (signature, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    return list(FUNCTIONS)
