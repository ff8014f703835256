"""Row numbers and seeded permutations without a ranking window.

Numbers come from partitions, not from a window: rows are dealt out by ranges
of their order, sorted inside their partition and numbered there; the driver
gets one count per partition and every row adds the counts before its own.  No
task sees more than its range, whatever the size.

A permutation of n rows is then a keyed bijection of their numbers.  Numbers
are written with two digits in mixed base (a, b), a * b the smallest such
product at or above n; in each of four rounds one digit is shifted by a hash
of the other, which can be undone, so every round is a bijection of [0, a * b).
The fewer than a numbers at or above n are walked on until they fall below n
(cycle walking), which makes it a bijection of [0, n).  Any number of
permutations (epochs, draws) share one numbering, and none of them sorts.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import checkpoint_root

#: Ranges of an order: the session's shuffle partitions, at least these.
LEAST_RANGES = 8
ROUNDS = 4
#: Steps of a walk that are tried; more than WALK outside numbers in a row
#: have a chance below 2^-64 (none at all up to WALK^2 rows).
WALK = 64


def _ranged(df: DataFrame, order_cols: Sequence) -> DataFrame:
    """``df`` dealt out by ranges and sorted inside them, with ``__part`` and
    ``__at`` (the place inside the range), checkpointed."""
    spark = df.sparkSession
    checkpoint_root(spark)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranges = max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return d.select(*df.columns, F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).checkpoint()


def _with_starts(d: DataFrame, amount: Column) -> tuple[DataFrame, int]:
    """``__start``: the amount in the ranges before the row's own, and the
    whole amount.  One number per range goes to the driver."""
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in d.groupBy("__part").agg(F.sum(amount).cast("bigint").alias("n")).collect()):
        starts.append((part, total))
        total += n
    offsets = F.broadcast(d.sparkSession.createDataFrame(starts, "__p long, __start long"))
    return d.join(offsets, F.col("__part") == F.col("__p")).drop("__p"), total


def numbered(df: DataFrame, order_cols: Sequence, out: str = "pos") -> tuple[DataFrame, int]:
    """``df`` with 1-based positions in the order of ``order_cols`` (nulls
    first, NaN last), and the number of rows.

    The rows are checkpointed, so give ids and keys rather than texts.
    ``order_cols`` must order rows totally if positions are to be repeatable.
    """
    d, total = _with_starts(_ranged(df, order_cols), F.lit(1))
    return d.select(*df.columns, (F.col("__start") + F.col("__at") + 1).alias(out)), total


def sums_before(df: DataFrame, order_cols: Sequence, weight: str, out: str, part: str | None = None) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before each row;
    ``part`` names a column for the row's range."""
    d, _ = _with_starts(_ranged(df, order_cols), F.col(weight))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return d.select(*df.columns, (F.col("__start") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).alias(out),
                    *([F.col("__part").alias(part)] if part else []))


def bases(n: int) -> tuple[int, int]:
    """The two bases of a number below ``n``."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _round_trip(x: Column, a: int, b: int, key: Sequence) -> Column:
    """The four rounds: odd ones shift the first digit, even ones the second."""
    def hashed(i: Column, digit: Column) -> Column:
        return F.conv(F.substring(hash_key(*key, i, digit), 1, 8), 16, 10).cast("bigint")

    # v - v % b is a multiple of b, and quotients below 2^53 are exact doubles.
    digit = lambda v: ((v - v % b) / b).cast("bigint")
    step = lambda v, i: F.when(
        i % 2 == 1, F.pmod(digit(v) + hashed(i, v % b), F.lit(a)) * b + v % b).otherwise(
        digit(v) * b + F.pmod(v % b + hashed(i, digit(v)), F.lit(b)))
    return F.aggregate(F.array(*[F.lit(i) for i in range(1, ROUNDS + 1)]), x.cast("bigint"), step)


def with_permutation(df: DataFrame, pos: str, n: int, key: Sequence, out: str = "perm_pos") -> DataFrame:
    """``df`` with ``out``: the 1-based image of the 1-based ``pos`` under the
    bijection of [1, n] that ``key`` (columns or literals) selects."""
    a, b = bases(n)
    key = [k if isinstance(k, Column) else F.lit(k) for k in key]
    d = df.withColumn(out, _round_trip(F.col(pos) - 1, a, b, key))
    if a * b > n:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, a))), F.col(out),
                             lambda x, _: F.when(x < n, x).otherwise(_round_trip(x, a, b, key)))
        d = d.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walked))
        lost = F.raise_error(F.lit("a permutation's walk did not end")).cast("bigint")
        d = d.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(lost))
    return d.withColumn(out, F.col(out) + 1)
