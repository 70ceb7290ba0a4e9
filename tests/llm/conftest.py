import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents (doc_id, text, lang, source, n_chars) from (doc_id, text[, source]) tuples."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)

    return make


#: Nulls, empty and repeated rows, ties, case, other scripts, one very long text.
EDGES = [
    (1, None), (2, ""), (3, "a"), (4, "A"), (4, "A"), (None, "a"), (None, None), (5, " \t\n"), (6, "ÀÉ é 한국 😀"), (7, "word " * 200_000),
    (8, "word " * 199_999 + "word!"), (9, "the quick brown fox jumps over the lazy dog"), (10, "The QUICK brown fox jumps over the lazy dog"),
    (11, None, None), (12, "released under the mit license", "é"),
]


@pytest.fixture(scope="session")
def edges(frame):
    return frame(EDGES)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
