"""Exact, rare-safe stratified splits (E1, E2, H2) and key-frequency filters
(D1, D2, B7).

The split is exact, not sampled: class quotas are computed in integer
arithmetic (largest remainder, ties by a seeded hash of the class), rows are
ranked inside their class by a seeded hash of their id, and a row goes to the
first part when its rank is within the quota.  ``sampleBy`` would only be
approximately stratified and could not reproduce the quotas.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from .rank import _null_safe_join, hash_rank, value_rank


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Frequency per key (D1), partial aggregation."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def rare_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys seen exactly once."""
    return key_counts(df, key).where(F.col("n") == 1).select(key)


def keep_keys(df: DataFrame, keys: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (``keep``) or is not in ``keys`` (B7): left semi / anti
    join.  The key set is an aggregate; Spark broadcasts it when it is small."""
    return _null_safe_join_semi(df, keys, key, "left_semi" if keep else "left_anti")


def _null_safe_join_semi(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    r = keys.select(F.col(key).alias("__k"))
    return df.join(r, df[key].eqNullSafe(r["__k"]), how)


def _refuse_small_parts(df: DataFrame, key: str, test_size: float) -> None:
    common = key_counts(df, key).where(F.col("n") > 1)
    classes, rows = common.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    test = math.ceil(test_size * rows)
    if classes and min(test, rows - test) < classes:
        raise ValueError(f"parts of {rows - test} and {test} rows cannot hold {classes} classes each")


def stratified_split(
    df: DataFrame,
    id_col: str,
    key: str,
    test_size: float,
    seed="42",
    out: str = "part",
    first: str = "train",
    second: str = "test",
    strict: bool = False,
) -> DataFrame:
    """Assign every row to ``first`` or ``second``.

    * keys seen once go to ``second`` (H2 as a CASE, no union);
    * of the other ``n`` rows, ``n_test = ceil(test_size * n)`` go to
      ``second``; class ``c`` keeps ``floor(n_c * n_train / n)`` rows in
      ``first`` plus one for the classes with the largest remainders
      ``n_c * n_train % n`` (ties by ``md5(seed|class)``);
    * inside a class, rows are ordered by ``md5(seed|id)``.

    Ids are unique.  Only ids and keys are counted and ranked; other columns
    are joined back once.  ``strict`` refuses a part that could not hold every
    class (fewer rows than classes), as a stratified split must.
    """
    if strict:
        _refuse_small_parts(df, key, test_size)
    rows = df.select(id_col, key)
    cls = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_nc")).where(F.col("_nc") > 1)
    # Totals are scalar subqueries: computed once, attached to every class row.
    n = cls.agg(F.coalesce(F.sum("_nc"), F.lit(0)).cast("bigint")).scalar()
    q = cls.withColumn("_n", n).withColumn("_ntest", F.ceil(F.lit(float(test_size)) * F.col("_n")).cast("bigint"))
    q = q.withColumn("_ntrain", F.col("_n") - F.col("_ntest"))
    share = "CAST(_nc AS DECIMAL(38,0)) * _ntrain"
    q = q.withColumn("_floor", F.expr(f"({share}) div _n").cast("bigint")).withColumn("_negrem", -F.expr(f"({share}) % _n").cast("bigint"))
    # Classes that get one more row: the largest remainders first.  Classes
    # seen once need no place and are not ranked; equal remainders are split
    # over buckets by the hash of the class.
    q = value_rank(q.withColumn("_chash", hash_key(F.lit(seed), F.col(key))), "_negrem", tie_cols=["_chash"], out="_rpos")
    short = q.agg(F.sum("_floor")).scalar()
    q = q.select(key, (F.col("_floor") + F.when(F.col("_rpos") <= F.col("_ntrain") - short, 1).otherwise(0)).alias("_quota"))
    ranked = hash_rank(rows, hash_key(F.lit(seed), F.col(id_col)), [id_col], group_cols=[key], out="_kpos")
    part = F.when(F.col("_kpos") <= F.col("_quota"), F.lit(first)).otherwise(F.lit(second))
    parts = _null_safe_join(ranked, q, [key], "left").select(id_col, key, part.alias(out))
    if set(df.columns) == {id_col, key}:
        return parts
    return df.join(parts.select(id_col, out), id_col)


def split_chain(
    df: DataFrame,
    id_col: str,
    key: str,
    seed="42",
    keep_size: float = 0.1,
    temp_size: float = 0.3,
    test_size: float = 0.5,
    materialize=None,
) -> DataFrame:
    """Three-step split (E2): keep ``keep_size`` of the corpus (the rest is
    ``discard``), send ``temp_size`` of that to temp, halve temp into dev and
    test.  Class counts are taken afresh at every step, as in the reference,
    so a key rare in the kept part never reaches train.

    Each step reads its input several times, so without a cut the plan of
    step three would hold step one many times over.  ``materialize`` cuts
    the lineage between steps; by default a reliable ``checkpoint`` in the
    session's checkpoint folder (``spark.checkpoint.dir``).
    """
    if materialize is None:
        from ..session import checkpoint_root

        checkpoint_root(df.sparkSession)
        materialize = lambda d: d.checkpoint(eager=True)
    m = materialize
    ids = df.select(id_col, key)
    s1 = m(stratified_split(ids, id_col, key, keep_size, f"{seed}-1", "part", "discard", "keep"))
    kept = s1.where(F.col("part") == "keep").drop("part")
    s2 = m(stratified_split(kept, id_col, key, temp_size, f"{seed}-2", "part", "train", "temp"))
    temp = s2.where(F.col("part") == "temp").drop("part")
    s3 = stratified_split(temp, id_col, key, test_size, f"{seed}-3", "part", "dev", "test")
    parts = s1.where(F.col("part") == "discard").unionByName(s2.where(F.col("part") == "train")).unionByName(s3)
    return parts if set(df.columns) == {id_col, key} else df.join(parts.select(id_col, "part"), id_col)
