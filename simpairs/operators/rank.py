"""Positions and ranks without a single-partition window.

``Window.orderBy(..)`` with no partition moves every row to one task, and a
window partitioned by a heavy key does the same for that key.

An order over all rows takes its positions from ranges and their counts
(``permute.numbered``), at every size.  An order inside groups is cut into
*buckets* whose order agrees with the row order:

* hash orders use a prefix of the md5 key (uniform by construction);
* value orders are cut at values of a sorted sample of the order key, ties
  included, so neither an outlier nor a value shared by many rows fills one
  bucket.  The sample is drawn by a hash of the key: every evaluation of the
  plan cuts at the same values.

Rows are counted per (group, bucket); a prefix sum over those counts gives each
bucket its offset, and the final ``row_number`` runs per (group, bucket), so no
task sees more than one bucket of one group.  Groups up to ``ROWS_PER_BUCKET``
rows are one bucket, which a window over the group ranks; one count per group,
run when the rank is built, tells whether any is larger.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket
from .permute import numbered, sums_before

BUCKET = "_bucket"
#: Rows of a group that may share a bucket; smaller groups are one bucket.
ROWS_PER_BUCKET = 20_000
#: Sampled keys per group, and the most buckets of a group (a power of two).
SAMPLE_KEYS = 20_000
MOST_BUCKETS = 4096


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (group keys may be null)."""
    if not keys:
        raise ValueError("join keys required")
    renamed = {k: f"__r_{k}" for k in keys}
    r = right.select(*[F.col(c).alias(renamed[c]) if c in renamed else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[renamed[k]]) for k in keys])
    keep = [left[c] for c in left.columns] + [r[c] for c in r.columns if c not in renamed.values()]
    return left.join(r, cond, how).select(*keep)


def spread_join(df: DataFrame, small: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``small``, which has one row per key (nulls match).

    A key may hold most of the rows: its rows are dealt over cells by a hash of
    ``by``, and every cell in use gets the key's row, so no task sees more than
    some cells.  ``df`` is read twice."""
    cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.xxhash64(*by), F.lit(cells)).alias("_cell")
    used = df.select(*keys, cell).distinct()
    return _null_safe_join(df.select("*", cell), _null_safe_join(used, small, keys), [*keys, "_cell"]).drop("_cell")


def _largest_group(df: DataFrame, g: Sequence[str]) -> int:
    """Rows of the largest group: one combined count, one number to the driver."""
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("_gn")).agg(F.max("_gn")).first()[0] or 0


def with_hash_bucket(df: DataFrame, hex_key: str, digits: int = 4) -> DataFrame:
    """Bucket = first ``digits`` hex digits of an md5 column (16**digits buckets)."""
    return df.withColumn(BUCKET, hash_bucket(F.col(hex_key), digits))


def with_value_bucket(
    df: DataFrame,
    group_cols: Iterable[str],
    key: str,
    tie_cols: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Bucket = number of the group's cut points at or below (key, ties).

    The order of buckets is the order of (key, ties): nulls first, NaN after
    infinity.  Groups up to ``rows_per_bucket`` rows have no cuts.  Larger
    groups get about one cut per ``rows_per_bucket`` rows, taken at even steps
    from at most about ``SAMPLE_KEYS`` sampled keys; a row finds its bucket by
    binary search.  Rows equal in key and all ties share a bucket.
    """
    g = _cols(group_cols)
    limit = rows_per_bucket or ROWS_PER_BUCKET
    order = F.struct(*[F.col(c) for c in (key, *tie_cols)])
    counts = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_gn")).where(F.col("_gn") > limit)
    unit = F.pmod(F.xxhash64(order), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keys = df.select(*g, order.alias("_order"), unit.alias("_unit"))
    if g:
        keys = _null_safe_join(keys, counts, g)
    else:
        keys = keys.withColumn("_gn", counts.select("_gn").scalar())
    drawn = keys.where(F.col("_unit") < F.lit(float(SAMPLE_KEYS)) / F.col("_gn"))
    sampled = drawn.groupBy(*g).agg(F.array_sort(F.collect_list("_order")).alias("_s"), F.max("_gn").alias("_gn"))
    # An even number of steps through the sample: 2^depth - 1 cuts for the search.
    wanted = F.least(F.ceil(F.col("_gn") / F.lit(limit)), F.size("_s"), F.lit(MOST_BUCKETS)).cast("int")
    depth = F.greatest(F.ceil(F.log2(wanted.cast("double"))), F.lit(0)).cast("int")
    cuts = sampled.select(*g, F.col("_s"), depth.alias("_depth")).select(
        *g, F.expr("transform(sequence(1, shiftleft(1, _depth)), k -> get(_s, least(size(_s) - 1, cast(k * size(_s) div shiftleft(1, _depth) as int))))").alias("_cuts"),
        F.expr("transform(sequence(_depth, 0, -1), k -> cast(shiftleft(1, k) div 2 as int))").alias("_steps"))
    d = df.withColumn("_order", order)
    if g:
        d = _null_safe_join(d, cuts, g, "left")
    else:
        one = cuts.select(F.struct("_cuts", "_steps").alias("c")).scalar()
        d = d.withColumn("_cuts", one["_cuts"]).withColumn("_steps", one["_steps"])
    found = F.aggregate("_steps", F.lit(0), lambda at, step: F.when(
        (step > 0) & (F.element_at(F.col("_cuts"), F.greatest(at + step, F.lit(1))) <= F.col("_order")), at + step).otherwise(at))
    return d.select(*df.columns, F.coalesce(found, F.lit(0)).cast("bigint").alias(BUCKET))


def ordered_index(
    df: DataFrame,
    order_cols: Sequence,
    group_cols: Iterable[str] = (),
    out: str = "pos",
) -> DataFrame:
    """1-based position by ``order_cols`` within the group; ``df`` carries ``BUCKET``."""
    g = _cols(group_cols)
    counts = df.groupBy(*g, BUCKET).agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*g).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, BUCKET, F.coalesce(F.sum("_bn").over(wb), F.lit(0).cast("bigint")).alias("_boff"))
    if not g:
        offsets = F.broadcast(offsets)
    joined = _null_safe_join(df, offsets, [*g, BUCKET])
    wr = Window.partitionBy(*g, BUCKET).orderBy(*order_cols)
    rest = [c for c in joined.columns if c not in ("_boff", BUCKET)]
    return joined.select(*rest, (F.col("_boff") + F.row_number().over(wr)).alias(out))


def hash_rank(
    df: DataFrame,
    hex_key: Column,
    tie_cols: Sequence[str],
    group_cols: Iterable[str] = (),
    out: str = "pos",
    digits: int = 4,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """1-based position by an md5 key (ties by ``tie_cols``): a seeded shuffle."""
    tmp, g = "_hkey", _cols(group_cols)
    d = df.withColumn(tmp, hex_key)
    if not g:
        return numbered(d, [tmp, *tie_cols], out)[0].drop(tmp)
    if _largest_group(df, g) <= (rows_per_bucket or ROWS_PER_BUCKET):
        whole = Window.partitionBy(*g).orderBy(F.col(tmp), *[F.col(c) for c in tie_cols])
        return d.withColumn(out, F.row_number().over(whole)).drop(tmp)
    d = with_hash_bucket(d, tmp, digits)
    return ordered_index(d, [F.col(tmp), *[F.col(c) for c in tie_cols]], group_cols, out).drop(tmp)


def value_rank(
    df: DataFrame,
    key: str,
    tie_cols: Sequence[str] = (),
    group_cols: Iterable[str] = (),
    out: str = "pos",
    rows_per_bucket: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """1-based position by ``key`` ascending, ties by ``tie_cols``.

    ``largest`` is a bound that the caller has for the rows of a group; one
    within ``rows_per_bucket`` spares the count."""
    if not _cols(group_cols):
        return numbered(df, [key, *tie_cols], out)[0]
    limit = rows_per_bucket or ROWS_PER_BUCKET
    if (largest is not None and largest <= limit) or _largest_group(df, _cols(group_cols)) <= limit:
        whole = Window.partitionBy(*_cols(group_cols)).orderBy(F.col(key), *[F.col(c) for c in tie_cols])
        return df.withColumn(out, F.row_number().over(whole))
    d = with_value_bucket(df, group_cols, key, tie_cols, rows_per_bucket)
    return ordered_index(d, [F.col(key), *[F.col(c) for c in tie_cols]], group_cols, out)


def rank_table(
    df: DataFrame,
    value: str,
    group_cols: Iterable[str] = (),
    out: str = "rank2",
    weight: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Distinct (group, value) with the doubled average rank of the value.

    ``2 * avg_rank = 2 * before + count + 1`` with ``before`` the rows with a
    strictly smaller value.  Ties are collapsed first, so one value held by a
    third of the rows is a single row here.  Null values are left out; NaN
    ranks above infinity.  ``weight`` counts each row that many times;
    ``total`` names a column for the group's number of rows.

    All groups share one order by (group, value), cut into even ranges: the
    sum before a row less the sum before its group's first row is ``before``,
    so neither a large group nor many small ones change the work.  That first
    row is found from one row per group and range, and joined back by both.
    """
    g = _cols(group_cols)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = df.where(F.col(value).isNotNull()).groupBy(*g, value).agg(n.alias("_tc"))
    summed = sums_before(distinct, [*g, value], "_tc", "_tb", "_range")
    pieces = summed.groupBy(*g, "_range").agg(F.min("_tb").alias("_first"), F.sum("_tc").alias("_tn"))
    if g:
        group = Window.partitionBy(*g)
        pieces = pieces.select(*g, "_range", F.min("_first").over(group).alias("_first"), F.sum("_tn").over(group).cast("bigint").alias("_tn"))
        summed = _null_safe_join(summed, pieces, [*g, "_range"])
    else:
        summed = summed.withColumn("_first", F.lit(0)).withColumn("_tn", pieces.agg(F.sum("_tn").cast("bigint")).scalar())
    return summed.select(*g, value, ((F.col("_tb") - F.col("_first")) * 2 + F.col("_tc") + 1).cast("bigint").alias(out),
                         *([F.col("_tn").alias(total)] if total else []))
