import pytest

LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, fp string, shard int, hash string, kept string, component_id string, t string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeats, and columns with clashing names."""
    rows = [
        (1, "The cat sat on the mat and the dog ran to the house of the king", "en", "src1"),
        (1, "The cat sat on the mat and the dog ran to the house of the king", "en", "src1"),
        (2, None, "en", None),
        (3, "", None, "src2"),
        (4, " \t\n\x0b\x0c\r ", "de", "src3"),
        (None, "The cat sat on the mat and the dog ran to the house of the king", "fr", "src4"),
        (5, LONG, "en", "src5"),
        (6, "日本語 🦄 é x", "xx", "odd"),
        (7, "+1 555 0100 9999 a@b.co 10.0.0.1", "en", "src0"),
        (8, "one", "en", "src1"),
        (9, "one two", "en", "src1"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "a", "b", 1, "c", "d", "e", "f") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
