"""The corpus pipeline: five stages over the whole of ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``; the last returns the encoded corpus.
A stage's helper columns start with two underscores, so columns of the input
never clash with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simpairs.llm.bpe import digests, encode_decode
from simpairs.llm.common import staged, table
from simpairs.llm.exact_dedup import exact_dedup
from simpairs.llm.mixing import mix
from simpairs.llm.near_dup import near_duplicates
from simpairs.llm.quality import THRESHOLD, fit_quality, quality_column
from simpairs.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_column(docs, model, F.col("text")) >= THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts: that of the largest id.

    Only ids and digests of rows that go, or that repeat an id and text, meet
    the texts in a join.
    """
    rows = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    fates = staged(
        exact_dedup(docs, keep="max").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
        .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")).where("not __kept or __rows > 1"), "fates")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest"))
    out = rows.join(fates, same, "left_anti").select(*docs.columns)
    repeated = fates.where("__kept")
    if repeated.isEmpty():
        return out
    one = rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__sha"])
    return out.unionByName(one.select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five words, 0.8): that
    of the smallest id.  The id is paired with a hash of the text, so rows
    that repeat an id with other texts are judged apart."""
    rows = docs.withColumn("__id", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    judged = near_duplicates(rows, words=5, percent=80, id_col="__id")
    gone = judged.where(~F.col("kept")).select(F.col("__id").alias("__gone")).distinct()
    return rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target words."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return digests(encode_decode(docs, tokenizer_path(), forget=True))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("mixing", mixing),
    ("bpe", encode),
]

#: The classifier, the sketches and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
