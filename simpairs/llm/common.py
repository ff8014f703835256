"""Helpers shared by the training-data operators: staged tables, links to
components, and text-batch iteration.

Staged tables go to the folder named by ``spark.checkpoint.dir``, which a
cluster shares between driver and executors.  A lost executor then re-reads a
written table instead of recomputing the steps before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

# The word rule of the contracts (everything but ASCII space and
# the control characters 0x09-0x0D) and the letters that A-Z lower-casing maps.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null id: fold 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def text_slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` whose characters add up to about ``limit``;
    one text longer than that is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


EDGES_PER_FILE = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node
    reachable.  Null ends and loops are ignored.

    Alternating large-star and small-star rounds on the edge table: every
    round is two grouped minimum aggregates, so a hub with millions of links
    is combined before its shuffle and no component is gathered anywhere.
    Each round is staged, which cuts lineage and survives lost executors.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v"))
    e, total = staged(e.distinct(), "edges"), None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == total:
            break
        total = now
        # Large star: larger neighbours of u link to u's smallest neighbour.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where(F.col("u") > F.col("v"))
        # Small star: u and its smaller neighbours link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
            )).alias("s")).select("s.u", "s.v").where(F.col("u") > F.col("v")).distinct()
        )
        # Few edges need few files.
        e = staged(small.coalesce(1 + now[0] // EDGES_PER_FILE), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
