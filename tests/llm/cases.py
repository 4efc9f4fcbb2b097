"""Rows with every awkward case: nulls, empty and long texts, repeats, a clashing column."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, n_words string"


def documents(spark, texts, langs=None):
    langs = langs or [None] * len(texts)
    rows = [(k, t, lang, "s", 0, "x", "y") for k, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
