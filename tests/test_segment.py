import pytest
from pyspark.sql import functions as F

from textloom import queries_tables  # noqa: F401  registers all queries
from textloom import registry as Q
from textloom.functions import segment, subwords

CASES = {
    "en": ("Dr. Smith met J. R. Brown. He left (it was late. Very late.) at 3 p.m. today. “Stop! Now.” she said. Done… Really?! Yes.", ["Dr. Smith met J. R. Brown.", "He left (it was late. Very late.) at 3 p.m. today.", "“Stop! Now.” she said.", "Done…", "Really?!", "Yes."]),
    "de": ("Am 3. Mai kam Hr. Meier. Er sagte: „Komm. Geh.“ Dann ging er, z.B. nach Wien. Ende", ["Am 3.", "Mai kam Hr. Meier.", "Er sagte: „Komm. Geh.“ Dann ging er, z.B. nach Wien.", "Ende"]),
    "sl": ("Sestanek je 12. marca 2020. Prišel je g. Novak, npr. zjutraj. Res.\n\nNova vrstica", ["Sestanek je 12. marca 2020.", "Prišel je g. Novak, npr. zjutraj.", "Res.", "Nova vrstica"]),
    "fr": ("M. Dupont dit : «Oui. Non.» Puis il part. Voilà.", ["M. Dupont dit : «Oui. Non.»", "Puis il part.", "Voilà."]),
    "odd": (" \n ", []),
    "none": (None, []),
    "open": ("Never (closed. So one. Line\nBut the next. Two.", ["Never (closed. So one. Line", "But the next.", "Two."]),
}


def test_sentences(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "k string, t string").select("k", segment.sentences(F.col("t")).alias("s"))
    got = {r.k: r.s for r in df.collect()}
    want = {k: s for k, (_, s) in CASES.items()}
    assert got == want
    own = spark.createDataFrame([("See fig. 3. Then it ends. X",)], "t string").select(segment.sentences(F.col("t"), ()).alias("s")).first().s
    assert own == ["See fig.", "3.", "Then it ends.", "X"]


def test_words(spark):
    df = spark.createDataFrame([("It's 3,14 or 12:30... a-b a.b@c.d (x)",)], "t string")
    assert df.select(segment.words(F.col("t")).alias("w")).first().w == ["It's", "3,14", "or", "12:30", "...", "a-b", "a.b@c.d", "(", "x", ")"]


def test_subwords(spark, monkeypatch):
    vocabulary = spark.createDataFrame([("un", 1), ("##happi", 2), ("##ness", 3), ("##h", 4), ("##a", 5), ("a", 6), (None, 7)], "piece string, id int")
    df = spark.createDataFrame([(1, ["unhappiness", "a", "", None, "unhx", "aha"]), (2, []), (3, None)], "i int, w array<string>")
    got = {r.i: (r.piece_ids, r.word_ids) for r in subwords.with_subwords(df, "w", vocabulary, unknown=9).collect()}
    assert got == {1: ([1, 2, 3, 6, 9, 6, 4, 5], [0, 0, 0, 1, 4, 5, 5, 5]), 2: ([], []), 3: ([], [])}
    monkeypatch.setattr(subwords, "MAX_PIECES", 3)
    with pytest.raises(ValueError, match="pieces"):
        subwords.with_subwords(df, "w", vocabulary)


def test_subwords_rows_of_a_batch_in_parts(spark, monkeypatch):
    """The pieces as written, and no worker that turns a whole batch into Python's strings."""
    vocabulary = spark.createDataFrame([("a", 1), ("##b", 2), ("c", 3)], "piece string, id int")
    words = [["ab", "c"], None, [], ["abb", "x"]] * 50
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>").coalesce(1)
    assert subwords.ROWS < len(words) <= 10_000
    cut = subwords.with_subwords(df, "w", vocabulary, pieces="p")
    want = [([1, 2, 3], [0, 0, 1], ["a", "##b", "c"]), ([], [], []), ([], [], []), ([1, 2, 2, 0], [0, 0, 0, 1], ["a", "##b", "##b", None])] * 50
    assert [(r.piece_ids, r.word_ids, r.p) for r in cut.orderBy("i").collect()] == want
    plan = Q.QUERIES["subword_pieces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_windows(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 3, 4, 5, 10)], "a array<int>")
    got = [r.w for r in df.select(subwords.windows(F.col("a"), 4, 1).alias("w")).collect()]
    assert got == [[[]], [[0, 1, 2]], [[0, 1, 2, 3]], [[0, 1, 2, 3], [3, 4]], [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]]
    with pytest.raises(ValueError, match="go on"):
        subwords.windows(F.col("a"), 4, 4)
