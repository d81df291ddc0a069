"""Documents with every kind of trouble."""

LONG = "lorem ipsum dolor sit amet " * 8000

DOCUMENTS = [
    (1, "a b c d e f g h", "en", "s0", 15),
    (2, None, None, None, None),
    (3, "", "en", "s0", 0),
    (4, "a b c d e f g h", "de", "s1", 15),
    (4, "a b c d e f g h", "de", "s1", 15),
    (5, LONG, "en", "s2", len(LONG)),
    (6, LONG + "end", "en", "s2", len(LONG) + 3),
    (None, "null id", "en", "s1", 7),
    (None, "null id", "en", "s1", 7),
    (7, "é ü 🙂 \x00 tab\tnew\nline", "fr", "s1", 20),
    (8, "one", "en", "s0", 3),
    (9, "   \n\t ", "en", "s0", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use themselves.
CLASHING = ("id", "node", "digest", "row_key", "score", "kept", "hash", "start", "key", "n", "batch", "block", "_spans", "label", "component", "_digest")


def documents(spark, rows=DOCUMENTS):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def rows(df):
    """All rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
