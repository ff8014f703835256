"""Rows that every operator must take: nulls, empty, blank and repeated rows,
and columns whose names an operator might use itself."""

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "key", "kept", "size", "n", "digest", "run", "rep", "gid", "copies", "ids", "score", "target", "component")

EDGE_DOCS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \t\n ", "en", "a", 5),
    (4, "one", "en", "b", 3),
    (4, "one", "en", "b", 3),
    (5, "one", None, "b", 3),
    (None, "one", "en", None, 3),
    (None, None, None, None, None),
    (6, "the quick brown fox jumps over the lazy dog again and again " * 30, "en", "b", None),
    (7, "the quick brown fox jumps over the lazy dog again and again " * 30, "en", "b", None),
    (8, "x" * 5000, "en", "c", None),
    (9, "ÄÖÜ ß 日本語 👍 \x00 nul", "de", "c", None),
]


def edge_docs(spark):
    df = spark.createDataFrame(EDGE_DOCS, DOC_SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
