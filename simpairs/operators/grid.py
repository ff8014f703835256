"""Experiment grids, repeats and configuration checks.

A grid is the product of literal value lists (last key varies fastest).  It
is attached to each input row with one ``posexplode`` per key, so the
product needs no join; its size is the product of the list lengths, fixed
by the caller and independent of the data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed order of the pad-symbol fallback.
PAD_ORDER = ("pad", "sep", "eos", "bos", "cls")


def expand_grid(df: DataFrame, grid: dict, pos_col: str = "grid_pos") -> DataFrame:
    """Every row of ``df`` times every configuration of ``grid`` (C5), with the
    configuration's position in ``itertools.product`` order."""
    out = df.withColumn(pos_col, F.lit(0).cast("bigint"))
    for key, values in grid.items():
        arr = F.array(*[F.lit(v) for v in values])
        out = out.select("*", F.posexplode(arr).alias(f"_{key}_pos", key))
        out = out.withColumn(pos_col, F.col(pos_col) * F.lit(len(values)) + F.col(f"_{key}_pos")).drop(f"_{key}_pos")
    return out


def effective_batch_size(batch_size, accumulate) -> Column:
    """``batch_size * accumulate_grad_batches`` as BIGINT."""
    b = F.col(batch_size) if isinstance(batch_size, str) else batch_size
    a = F.col(accumulate) if isinstance(accumulate, str) else accumulate
    return b.cast("bigint") * a.cast("bigint")


def resolve_pad(df: DataFrame, prefix_cols: Sequence[str] = PAD_ORDER) -> DataFrame:
    """``pad`` = first present of ``<k>_token`` in pad, sep, eos, bos, cls order,
    with ``pad_source`` naming it; none present raises at run time (B20)."""
    cols = [f"{k}_token" for k in prefix_cols]
    source = F.lit(None).cast("string")
    for k, c in reversed(list(zip(prefix_cols, cols))):
        source = F.when(F.col(c).isNotNull(), F.lit(k)).otherwise(source)
    pad = F.coalesce(*[F.col(c) for c in cols])
    checked = F.when(pad.isNull(), F.raise_error(F.lit("no padding symbol: pad, sep, eos, bos and cls are all missing"))).otherwise(pad)
    return df.withColumn("pad", checked).withColumn("pad_source", source)


def mean_over_seeds(df: DataFrame, config_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Average of each metric over the repeated runs of a configuration."""
    return df.groupBy(*config_cols).agg(
        F.count(F.lit(1)).alias("n_repeats"), *[F.avg(m).alias(m) for m in metrics]
    )
