"""Deterministic draws: every random choice is a hash of a seed and a stable id.

``md5`` is used because DuckDB computes the same digest, so the same SQL gives
the same draws in both engines.  ``rand()`` and ``monotonically_increasing_id``
change with partitioning and are never used for identity or order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 2^32, the divisor that maps 8 hex digits to [0, 1).
TWO_POW_32 = 4294967296.0


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def hash_key(*parts) -> Column:
    """Hex md5 of the parts joined by ``|``; orders rows uniformly at random."""
    return F.md5(F.concat_ws("|", *[_as_col(p).cast("string") for p in parts]))


def hash_unit(*parts) -> Column:
    """A number in [0, 1) from the first 8 hex digits of ``hash_key``.

    DuckDB form: ``('0x' || substr(md5(x), 1, 8))::UBIGINT / 4294967296.0``.
    """
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def hash_bucket(hex_key: Column, digits: int) -> Column:
    """The first ``digits`` hex digits of an md5 key: a bucket that preserves
    the key's order, so ranks computed per bucket add up to a global order."""
    return F.substring(hex_key, 1, digits)
