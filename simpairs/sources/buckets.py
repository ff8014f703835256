"""Bucketed tables: written once by a key, joined on that key without moving
them again (G5-G7, A17).

Encoded vectors are the widest rows of the library.  A pair table names them
twice and a triplet table three times, so joins over a plain table exchange
all vectors two or three times per scoring job.  Written in buckets by id they
are exchanged once, when they are written; every later join moves only the
pairs.  Splits and texts that are bucketed alike join without any exchange.

A table has ``spark.sql.shuffle.partitions`` buckets by default: with fewer,
Spark may prefer to exchange both sides for more parallel tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators.losses import triplet_terms
from ..operators.text import Encoder, hashed_bag
from ..session import delete_folder, scratch_dir


def write_bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> str:
    """Write ``df`` bucketed by ``key`` into the shared scratch folder and
    return the table's name in the session catalog (``name`` and a unique end).
    Rows are dealt out by the key first, so a bucket is one file."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", scratch_dir(spark, table)).format("parquet").saveAsTable(table)
    return table


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Forget the table and remove its files."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").select("data_type").collect()
    spark.sql(f"DROP TABLE {table}")
    for r in rows:
        delete_folder(spark, r.data_type)


def encode_bucketed(docs: DataFrame, id_col: str, text_col: str, encoder: Encoder = hashed_bag, buckets: int | None = None) -> str:
    """Encode every document once; the vectors ``(id, vec)`` as a bucketed table."""
    return write_bucketed(encoder(docs, id_col, text_col).select(id_col, "vec"), id_col, "vectors", buckets)


def score_stored_pairs(vectors: DataFrame, pairs: DataFrame, id_col: str, a_id: str, b_id: str) -> DataFrame:
    """``score_pairs`` (G6) over a bucketed vector table: the columns of
    ``pairs`` and ``cos``; ids without a vector count as zero vectors."""
    u = vectors.select(F.col(id_col).alias(a_id), F.col("vec").alias("_u"))
    v = vectors.select(F.col(id_col).alias(b_id), F.col("vec").alias("_v"))
    j = pairs.join(u, a_id, "left").join(v, b_id, "left")
    return j.select(*pairs.columns, F.coalesce(cosine("_u", "_v"), F.lit(0.0)).alias("cos"))


def score_stored_triplets(vectors: DataFrame, triplets: DataFrame, id_col: str, anchor: str, positive: str, negative: str,
                          margin: float = 1.0, p: float = 2.0) -> DataFrame:
    """``score_triplets`` (G7) over a bucketed vector table."""
    j = triplets
    for k, c in enumerate((anchor, positive, negative)):
        j = j.join(vectors.select(F.col(id_col).alias(c), F.col("vec").alias(f"_x{k}")), c)
    return triplet_terms(j, "_x0", "_x1", "_x2", margin, p).drop("_x0", "_x1", "_x2")
