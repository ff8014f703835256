"""Mini-batches and augmentation routing.

A batch is a range of positions in some order: a seeded permutation for the
shuffled training loader, the id order for the sequential ones.  Positions
come from ranges of ids and their counts, so no task sees all rows.  Augmentation
draws are hashes of (seed, epoch, batch_id): the same value for a whole
batch, reproducible, independent of partitioning.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from .negatives import permutation
from .rank import value_rank

# The pivot languages of the augmentation step, in order.
PIVOT_LANGUAGES = ["en", "fr", "de", "es", "it"]
# Route thresholds, sentence 1 below 0.3, sentence 2 below 0.7.
ROUTE_THRESHOLDS = (0.3, 0.7)


def _batch_cols(df: DataFrame, pos: str, batch_size: int, prefix: str) -> DataFrame:
    return df.withColumn(f"{prefix}batch_id", F.expr(f"({pos} - 1) div {int(batch_size)}")).withColumn(
        f"{prefix}batch_idx", F.expr(f"({pos} - 1) % {int(batch_size)}")
    )


def _numbered(df: DataFrame, ranked: DataFrame, id_col: str, batch_size: int, prefix: str) -> DataFrame:
    """``df`` with the batch of every id; only ids went through the windows."""
    numbers = _batch_cols(ranked, "_bpos", batch_size, prefix).drop("_bpos")
    return numbers if df.columns == [id_col] else df.join(numbers, id_col)


def shuffled_batches(df: DataFrame, id_col: str, batch_size: int, seed="42", epoch: int = 0, prefix: str = "") -> DataFrame:
    """Shuffled batches of ``batch_size`` (E4); the last batch may be short.
    Ids are unique."""
    d = permutation(df.select(id_col), id_col, seed, f"epoch-{epoch}", out="_bpos")
    return _numbered(df, d, id_col, batch_size, prefix)


def sequential_batches(df: DataFrame, id_col: str, batch_size: int, prefix: str = "") -> DataFrame:
    """Batches in id order (E5).  Ids are unique."""
    return _numbered(df, value_rank(df.select(id_col), id_col, out="_bpos"), id_col, batch_size, prefix)


def prepare_batches(df: DataFrame, id_col: str, batch_size: int, collate: Callable[[DataFrame], DataFrame] | None = None,
                    shuffle: bool = False, seed="42", epoch: int = 0) -> DataFrame:
    """Batches with the caller's own transform applied to them (K1): ``collate``
    takes the batched frame (``batch_id``, ``batch_idx``) and gives any frame."""
    batched = shuffled_batches(df, id_col, batch_size, seed, epoch) if shuffle else sequential_batches(df, id_col, batch_size)
    return batched.transform(collate) if collate is not None else batched


def route_augmentation(df: DataFrame, batch_col: str = "batch_id", seed="42", epoch: int = 0) -> DataFrame:
    """Per batch: ``route`` 1, 2 or 3 (30/40/30, G3) and a pivot ``lang``."""
    r = hash_unit(F.lit(seed), F.lit("route"), F.lit(epoch), F.col(batch_col))
    lo, hi = ROUTE_THRESHOLDS
    route = F.when(r < lo, 1).when(r < hi, 2).otherwise(3)
    langs = F.array(*[F.lit(x) for x in PIVOT_LANGUAGES])
    li = F.floor(hash_unit(F.lit(seed), F.lit("lang"), F.lit(epoch), F.col(batch_col)) * len(PIVOT_LANGUAGES)) + 1
    return df.withColumn("route", route.cast("int")).withColumn("lang", F.element_at(langs, li.cast("int")))


def routed_text(cols) -> Column:
    """The sentence that ``route`` names."""
    routed = F.col(cols[0])
    for i, c in enumerate(cols[1:], start=2):
        routed = F.when(F.col("route") == i, F.col(c)).otherwise(routed)
    return routed


def apply_translation(df: DataFrame, tm: DataFrame, cols=("sentence1", "sentence2", "sentence3")) -> DataFrame:
    """Replace the routed sentence by its translation-memory entry.

    A left join on (md5(text), lang); a missing entry keeps the text, as the
    reference keeps it when the remote call fails.  Adds ``translated``.
    """
    d = df.withColumn("_tkey", F.md5(routed_text(cols)))
    t = tm.select(F.col("text_key").alias("_tkey"), F.col("lang").alias("_tlang"), F.col("replacement").alias("_rep"))
    j = d.join(t, (d["_tkey"] == t["_tkey"]) & (d["lang"] == t["_tlang"]), "left").drop(t["_tkey"]).drop("_tlang")
    for i, c in enumerate(cols, start=1):
        j = j.withColumn(c, F.when(F.col("route") == i, F.coalesce(F.col("_rep"), F.col(c))).otherwise(F.col(c)))
    return j.withColumn("translated", F.col("_rep").isNotNull()).drop("_tkey", "_rep")
