import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()
PROSE = " ".join(WORDS)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"{w}{i % 977}" for i, w in enumerate(WORDS * 3000))
    rows = [(None, PROSE, "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "xx", None), (4, long, "en", "t"), (5, PROSE, "en", "s"), (5, PROSE, "en", "s"), (6, PROSE, None, "t"), (7, "ÄÖ é 1 日本", "de", "é"), (8, "x", "en", "s"), (None, None, None, None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
