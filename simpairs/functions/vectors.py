"""Vector expressions on ``array<double>`` columns.

All are built-in higher-order functions, evaluated in the JVM next to the
data; FLOAT arrays are cast to DOUBLE first so both engines do the same
arithmetic.  Divisors are bounded below by an epsilon or wrapped in
``try_divide`` so ANSI mode never raises on a zero vector.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's vector functions.
COSINE_EPS = 1e-6       # cosine similarity: each norm is at least this
NORMALIZE_EPS = 1e-12   # L2 normalisation: norm is at least this
DISTANCE_EPS = 1e-6     # pairwise distance: added to every difference


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(x) -> Column:
    return _c(x).cast("array<double>")


def dot(u, v) -> Column:
    """Row-wise dot product."""
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a * b), F.lit(0.0).cast("double"), lambda acc, e: acc + e)


def sq_norm(u) -> Column:
    return F.aggregate(_c(u), F.lit(0.0).cast("double"), lambda acc, e: acc + e * e)


def norm(u) -> Column:
    return F.sqrt(sq_norm(u))


def cosine(u, v, eps: float = COSINE_EPS) -> Column:
    """Cosine similarity (F1): ``u.v / (max(|u|, eps) * max(|v|, eps))``; a zero vector gives 0."""
    return dot(u, v) / (F.greatest(norm(u), F.lit(eps)) * F.greatest(norm(v), F.lit(eps)))


def l2_normalize(u, eps: float = NORMALIZE_EPS) -> Column:
    """``u / max(|u|, eps)`` element-wise (F2)."""
    n = F.greatest(norm(u), F.lit(eps))
    return F.transform(_c(u), lambda e: e / n)


def pairwise_distance(u, v, p: float = 2.0, eps: float = DISTANCE_EPS) -> Column:
    """p-norm of ``u - v + eps``."""
    diffs = F.zip_with(_c(u), _c(v), lambda a, b: a - b + F.lit(eps))
    if p == 2.0:
        return F.sqrt(F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, e: acc + e * e))
    if p == 1.0:
        return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, e: acc + F.abs(e))
    s = F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, e: acc + F.pow(F.abs(e), F.lit(p)))
    return F.pow(s, F.lit(1.0 / p))


def halves(u) -> tuple[Column, Column]:
    """First and second half of a vector (F6); an odd length raises at run time."""
    c = _c(u)
    n = F.size(c)
    half = F.when(n % 2 == 0, (n / 2).cast("int")).otherwise(
        F.raise_error(F.lit("vector length must be even to split into halves")).cast("int")
    )
    return F.slice(c, F.lit(1), half), F.slice(c, half + 1, half)


def angle_score(u, v, tau: float = 20.0, pooling: str = "sum") -> Column:
    """Angle score (F5): ``u`` and ``v`` read as complex vectors (first half
    real, second half imaginary); the pooled quotient ``u / v`` scaled back by
    ``|v| / |u|``, absolute value times ``tau``.

    Closed form for sum pooling: ``|a.c + b.d + b.c - a.d| / (|u| |v|)``.
    """
    if pooling not in ("sum", "mean"):
        raise ValueError(f"Unsupported pooling strategy: {pooling}")
    a, b = halves(u)
    c, d = halves(v)
    num = dot(a, c) + dot(b, d) + dot(b, c) - dot(a, d)
    pooled = F.try_divide(num, norm(u) * norm(v))
    if pooling == "mean":
        pooled = pooled / F.size(_c(u))
    return F.abs(pooled) * F.lit(tau)
