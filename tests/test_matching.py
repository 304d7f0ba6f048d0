import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import match, text


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("t", "kw", "want"),
    [("nato NATO-m", "NATO", True), ("nato", "NATO", False), ("Globalno segrevanje", "globalno segrevanje", True), ("the U.S.A. is", "U.S.A.", False), ("U.S.A.x", "U.S.A.", True), ("čaj", "aj", False), ("a\\Eb \\Qx", "\\Qx", False)],
)
def test_contains_any(spark, t, kw, want):
    assert one(spark, t, lambda c: match.contains_any(c, [kw])) is want


def test_keyword_modes(spark):
    table = {"petrol": ["Petrol*", "PETROL*"], "sdh": ["SDH"]}
    t = "petrolejska nafta in SDH"
    ref = one(spark, t, lambda c: match.keyword_matches(c, table))
    assert [(x.category, x["match"]) for x in ref] == [("petrol", "Petrol"), ("petrol", "PETROL"), ("sdh", "SDH")]
    doc = one(spark, t, lambda c: match.keyword_matches(c, table, "documented"))
    assert [x["match"] for x in doc] == ["SDH"]


def test_expression(spark):
    got = one(spark, "Slovenske   železnice", lambda c: match.expression_matches(c, {"sz": ["slovensk* železnic*"]}))
    assert [x["match"] for x in got] == ["slovensk* železnic*"]


def test_regex_parity(spark):
    """Spark's patterns decide as Python's do."""
    words = ["pošt*", "EU", "re-use", "U.S.", "naïve", "Š*"]
    texts = ["Pošta dela", "EU in eu", "re-use; reuse", "the U.S. x", "NAÏVE naïve", "Šola", "poštar", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for w in words:
        pattern = rf"\b{re.escape(w[:-1])}\w*\b" if w.endswith("*") else rf"\b{re.escape(w)}\b"
        got = [r.x for r in df.select(F.col("t").rlike(match.keyword_regex(w)).alias("x")).collect()]
        assert got == [re.search(pattern, t, re.I) is not None for t in texts], w


def test_text_functions(spark):
    assert one(spark, "  a b\t", text.strip) == "a b"
    assert one(spark, "T rest", lambda c: text.without_prefix(c, F.lit("T"))) == "rest"
    header = "POP TV, 1. 2. 2010, DNEVNIK 19:00\nText"
    assert one(spark, header, lambda c: text.without_broadcast_header(F.lit("tv"), c)) == "Text"
    assert one(spark, header, lambda c: text.without_broadcast_header(F.lit("print"), c)) == header
    assert one(spark, "http://x/a/b.gz?q=1", text.url_file_name) == "b.gz"
