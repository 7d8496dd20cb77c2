import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, id long, fp long, key string, "
        "batch int, h1 long, size long, n_lines long, words int, label int, block int")


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing column names."""
    line = "a line that several documents share"
    rows = [(1, "one two three four five\n" + line), (2, None), (3, ""), (4, line.upper() + " \nshort\nshort"),
            (4, line.upper() + " \nshort\nshort"), (None, line + "\nof nobody"), (None, None),
            (5, "word " * 30000), (6, "ß É ñandú 12,5 don't!?\n\n" + line), (7, "  \t "), (1, "one two three four five")]
    return spark.createDataFrame([(i, t, *[None] * 13) for i, t in rows], DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
