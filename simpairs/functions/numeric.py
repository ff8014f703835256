"""Rounding that gives the same double in Spark and DuckDB.

``round(x, d)`` is half-up on the decimal text in Spark but computed on the
binary product in DuckDB, so the two can disagree on exact halves (which
averages of 2-decimal values do produce).  ``floor(x * 10^d + 0.5) / 10^d``
is the same IEEE arithmetic in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x, digits: int = 6) -> Column:
    """Half-up rounding by the rule above.  NaN, infinities and magnitudes
    that have no digits left to cut (2^53 / 10^digits and more) pass through."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    scale = float(10 ** digits)
    whole = F.isnan(c) | (F.abs(c) >= F.lit(2.0 ** 53 / scale))
    return F.when(whole, c).otherwise(F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def rnd_sql(expr: str, digits: int = 6) -> str:
    scale = f"{float(10 ** digits)!r}::DOUBLE"
    x = f"({expr})::DOUBLE"
    return (
        f"(CASE WHEN isnan({x}) OR abs({x}) >= {2.0 ** 53 / 10 ** digits!r}::DOUBLE THEN {x} "
        f"ELSE floor({x} * {scale} + 0.5::DOUBLE) / {scale} END)"
    )


def fixed4(x) -> Column:
    """Text with 4 decimals (B18) from the same integer arithmetic as SQL."""
    c = F.col(x) if isinstance(x, str) else x
    q = F.floor(F.abs(c) * F.lit(10000.0) + F.lit(0.5))
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string("%d.%04d", (q / 10000).cast("bigint"), (q % 10000).cast("bigint")))


def fixed4_sql(expr: str) -> str:
    q = f"floor(abs({expr}) * 10000.0::DOUBLE + 0.5::DOUBLE)::BIGINT"
    return (
        f"((CASE WHEN ({expr}) < 0 THEN '-' ELSE '' END) || "
        f"printf('%d.%04d', {q} // 10000, {q} % 10000))"
    )
