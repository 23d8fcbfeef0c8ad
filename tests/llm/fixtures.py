"""Small documents that hold what operators must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nShared line of the corpus\nend one"),
    (2, "  shared LINE of the corpus  \nanother text here\nend two"),
    (3, ""),
    (4, None),
    (5, "naïve café — “quotes” 東京 🙂 don't we'll 12345\t\n\n   x  "),
    (6, "a" * 5000),
    (7, "The quick brown fox jumps over the lazy dog.\nShared line of the corpus\nend one"),
    (7, "The quick brown fox jumps over the lazy dog.\nShared line of the corpus\nend one"),
    (None, "text without an id\nShared line of the corpus"),
    (8, " \t\r\n\x0b\x0c "),
    (9, "repeat these eight words again and again now " * 40),
    (10, "word " * 30 + "  no-break   separators \x1c control"),
    (11, "".join(chr(97 + k * 7 % 26) * (k % 9 + 1) + " \n"[k % 5 == 0] * (k % 3 + 1) for k in range(900))),
]


def documents(spark, clash=True):
    """With columns whose names operators use themselves."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    if clash:
        for name in ("ids", "bytes", "kept", "r", "t", "key", "node", "id", "tile", "found", "score", "part", "size", "group", "bin", "m", "fingerprint"):
            df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return documents(spark).limit(0)
