"""Evaluation metrics.

All are aggregations with partial (map-side) combine; Spearman adds the
average ranks of ``rank.rank_table`` over rows collapsed by value, so
a stage holding a third of the rows is still spread over many tasks.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..session import scratch_dir, shuffles_for
from .rank import _cols, _null_safe_join, rank_table, spread_join


def pearson(x, y) -> Column:
    """Pearson correlation as an aggregate; null (not an error) when either
    side is constant or there is one row."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(
    df: DataFrame,
    y: str,
    y_hat: str,
    group_cols: Iterable[str] = (),
    spearman: bool = True,
    digits: int | None = 6,
    extra_aggs=(),
) -> DataFrame:
    """Per group: ``n``, ``pearson`` and (optionally) ``spearman`` of y, y_hat.

    Rows with a null y or y_hat are left out, as the reference never sees
    them.  A NaN in either variable makes both correlations of its group NaN;
    a constant side or a single row makes them null.  Null groups are groups.

    Spearman collapses equal (group, y, y_hat) rows to one weighted row before
    any ranking or join; its moments are weighted double sums of the ranks.
    """
    g = _cols(group_cols)
    d = df.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull())
    out = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), pearson(y, y_hat).alias("pearson"), *extra_aggs)
    if spearman:
        ranked = rank_correlation(d, y, y_hat, g)
        if g:
            out = _null_safe_join(out, ranked, g, "left")
        else:
            out = out.withColumn("spearman", ranked.select("spearman").scalar())
    if digits is not None:
        for c in ("pearson", "spearman"):
            if c in out.columns:
                out = out.withColumn(c, rnd(c, digits))
    return out


def rank_correlation(df: DataFrame, y: str, y_hat: str, group_cols: Iterable[str] = ()) -> DataFrame:
    """Per group: ``spearman``, the Pearson correlation of average ranks.

    ``df`` may carry a ``weight`` column, the number of rows that each of its
    rows stands for.  The combined rows are written to the scratch folder once;
    ranks and moments read them there.  Shuffles get partitions by the number of
    those rows, and rows of one score or group are spread, so what a task holds
    does not grow with the table; the result is written for the same reason."""
    g = _cols(group_cols)
    weight = F.col("weight") if "weight" in df.columns else F.lit(1).cast("bigint")
    pairs = df.select(*g, F.col(y).cast("double").alias("_y"), F.col(y_hat).cast("double").alias("_p"), weight.alias("_w"))
    pairs = pairs.where(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "rank-pairs")
    pairs = pairs.groupBy(*g, "_y", "_p").agg(F.sum("_w").alias("_w"))
    pairs.write.parquet(path)
    pairs = spark.read.schema(pairs.schema).parquet(path)
    long = pairs.select(*g, "_w", F.expr("stack(2, 'y', _y, 'p', _p) AS (_which, _v)"))
    with shuffles_for(spark, 2 * pairs.count()):
        ranks = rank_table(long, "_v", [*g, "_which"], out="_r2", weight="_w", total="_n")
        # Deviation from the known mean rank (n + 1) / 2, doubled.
        off = ranks.select(*g, "_which", "_v", (F.col("_r2") - F.col("_n") - 1).alias("_off"))
        ry = off.where(F.col("_which") == "y").select(*g, F.col("_v").alias("_y"), F.col("_off").alias("_ry"))
        rp = off.where(F.col("_which") == "p").select(*g, F.col("_v").alias("_p"), F.col("_off").alias("_rp"))
        # A score has many rows; a prediction has no more than there are scores.
        both = _null_safe_join(spread_join(pairs, ry, [*g, "_y"], ["_p"]), rp, [*g, "_p"])
        a, b, w = F.col("_ry"), F.col("_rp"), F.col("_w").cast("double")
        sums = both.groupBy(*g).agg(
            F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"),
            F.max((F.isnan("_y") | F.isnan("_p")).cast("int")).alias("_bad"))
        value = F.when(F.col("_bad") == 1, F.lit(float("nan"))).otherwise(
            F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))))
        out = sums.select(*g, value.alias("spearman"))
        out.write.parquet(f"{path}-values")
    return spark.read.schema(out.schema).parquet(f"{path}-values")


def mean_batch_loss(
    df: DataFrame,
    loss: str | Column,
    batch_col: str,
    group_cols: Iterable[str] = (),
    out: str = "avg_loss",
) -> DataFrame:
    """Mean of per-batch mean losses (D5): every batch weighs the same,
    a short last batch too.  Two aggregations, both partial."""
    g = _cols(group_cols)
    loss_c = F.col(loss) if isinstance(loss, str) else loss
    per_batch = df.groupBy(*g, batch_col).agg(F.avg(loss_c).alias("_batch_loss"))
    return per_batch.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg("_batch_loss").alias(out)
    )


def epoch_metrics(
    df: DataFrame,
    y: str,
    y_hat: str,
    loss: str,
    batch_col: str,
    group_cols: Iterable[str] = ("run_id", "stage", "epoch"),
    digits: int = 6,
) -> DataFrame:
    """Per (run, stage, epoch): avg loss of batches, Pearson, Spearman.

    One query for all stages, instead of one accumulator per stage."""
    g = _cols(group_cols)
    corr = correlations(df, y, y_hat, g, spearman=True, digits=digits)
    losses = mean_batch_loss(df, loss, batch_col, g).withColumn("avg_loss", rnd("avg_loss", digits))
    return _null_safe_join(corr, losses, g) if g else corr.withColumn("avg_loss", losses.select("avg_loss").scalar())


def batch_accuracy(df: DataFrame, correct: Column, batch_col: str, group_cols: Iterable[str] = ()) -> DataFrame:
    """Share of correct rows per batch, then the mean over batches.
    Groups without any batch produce no row, as the reference logs nothing."""
    g = _cols(group_cols)
    per_batch = df.groupBy(*g, batch_col).agg(F.avg(correct.cast("double")).alias("_acc"))
    return per_batch.groupBy(*g).agg(F.avg("_acc").alias("accuracy"), F.count(F.lit(1)).alias("n_batches"))
