"""Rows with nulls, empty and long texts, ties, repeats, and extra columns whose names operators use inside."""

from pyspark.sql import functions as F

CLASHING = ("name", "sha", "m", "h", "key", "ring", "k", "pos", "seq", "rid", "score", "fp", "w", "n", "hash", "spans", "keep_id", "keep_sha", "own_sha", "goes", "kept")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text)"""
    data = [(i, t, None if n % 3 == 0 else "en", None if n % 5 == 0 else f"src{n % 2}", None) for n, (i, t) in enumerate(rows)]
    out = spark.createDataFrame(data, SCHEMA)
    return out.withColumns({c: F.lit(1) for c in CLASHING})


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "a b c"), (2, "a  b\tc"), (3, None), (4, ""), (5, " \n"), (6, "A b c"), (7, LONG), (8, LONG.replace(" ", "\n")), (9, LONG + " tail"),
    (10, "a b c"), (10, "a b c"), (10, "other text here"), (None, "a b c"), (None, None), (None, "alone ü 漢字 \U0001F600"), (11, "one"), (12, "two words"), (13, "x" * 70_000),
]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
