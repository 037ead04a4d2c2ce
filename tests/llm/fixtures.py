"""Small tables with the awkward cases every operator has to take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0, **extra):
    rows = [(start + i, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [
        (None, "no id here", "en", None, None, 1, "x"),
        (1, None, None, None, None, None, None),
        (2, "", "en", "s", 0, 2, "y"),
        (3, "a b c d e f g", "en", "s", 13, 2, "y"),
        (3, "a b c d e f g", "en", "s", 13, 2, "y"),
        (4, "long words " * 30_000, "en", "s", 330_000, 3, "z"),
        (5, "x" * 50_000, "de", "s", 50_000, 3, "z"),
        (6, "Zeile eins\nZeile zwei\n\nÄÖÜ ß 日本語 \u0000 <|endoftext|>", "de", "s", 40, 3, "z"),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA + ", score int, features string")


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
