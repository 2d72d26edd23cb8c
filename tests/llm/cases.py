"""Small awkward inputs that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "src1", 44),
    (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "src2", 44),
    (3, None, None, None, None),
    (4, "", "en", "src1", 0),
    (5, " \t\n ", "en", None, 4),
    (6, "one", "en", "src1", 3),
    (7, "one", "en", "src1", 3),
    (7, "one", "en", "src1", 3),
    (8, LONG, "de", "src2", len(LONG)),
    (9, "äöü ß 漢字 \U0001f600 ÀB", "fr", "src3", 15),
    (None, "no id at all", "en", "src3", 12),
    (10, LONG + " tail", "de", "src2", len(LONG) + 5),
    (11, "x" * 5000, None, "src4", 5000),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    names = ["hash", "size", "bucket", "row", "cell", "depth", "load", "_id", "_hash", "_nth", "skey", "key", "value", "n", "keep_id"]
    return df.withColumns({n: F.lit("extra") for n in names})
