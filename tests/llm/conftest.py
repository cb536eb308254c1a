import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of ``documents`` from (doc_id, text, lang, source) rows, with columns that clash with those of results."""

    def build(rows):
        frame = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCUMENT)
        return frame.withColumns({c: F.lit("own") for c in ("score", "k", "t", "size", "c", "n", "h", "component_id", "predicted")})

    return build


EDGE_TEXTS = [None, "", " \t\n", "12 34 !!", "one", "one two three", "\x1c\x85 é́ ß İ", "word " * 30000, "x" * 20000, "same text twice over here", "same text twice over here"]


@pytest.fixture(scope="session")
def edges(documents):
    """Null, blank, tiny, very long, repeated and odd texts; null keys, languages and sources."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "web") for i, t in enumerate(EDGE_TEXTS)]
    return documents([*rows, (None, "no key here at all", "en", "web"), (9, "same text twice over here", "de", None)])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
