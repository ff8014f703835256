"""Negative sampling (C1) and seeded permutations.

Row ``i`` receives the sentence of row ``p(i)`` for a seeded permutation
``p``: ids are numbered once, and a keyed bijection of the numbers names each
recipient's donor, who is found by an equi-join.  Each row donates exactly
once; the result depends on seed and ids only, not on partitions, and is the
same in DuckDB.  As in the reference, a row may draw itself or its partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from .permute import numbered, with_permutation
from .rank import value_rank


def permutation(df: DataFrame, id_col: str, seed="42", salt: str = "p", out: str = "perm_pos") -> DataFrame:
    """1-based position of every row in a seeded random order (E3); ids are unique."""
    rows, n = numbered(df, [id_col], "_at")
    return with_permutation(rows, "_at", n, (seed, salt), out).drop("_at")


def coin(seed, id_col: str, sides: int = 2) -> Column:
    """A fair draw in 1..sides per row: ``1 + first 8 hex digits mod sides``."""
    h = F.conv(F.substring(hash_key(F.lit(seed), F.lit("c"), F.col(id_col)), 1, 8), 16, 10).cast("bigint")
    return (F.lit(1) + h % sides).cast("int")


def draw_donors(ids: DataFrame, id_col: str, seed="42", avoid_self: bool = False) -> DataFrame:
    """(id, donor_id, side) for a table of unique ids: one shuffle join of the
    numbered ids with themselves, on the number drawn."""
    rows, n = numbered(ids.select(id_col), [id_col], "_ra")
    recipients = with_permutation(rows, "_ra", n, (seed, "a"), "_from")
    donors = rows.select(F.col("_ra").alias("_rb"), F.col(id_col).alias("donor_id"))
    j = recipients.join(donors, recipients["_from"] == donors["_rb"], "inner").drop("_rb", "_from")
    if avoid_self:
        j = _rotate_fixed_points(j, id_col)
    return j.select(id_col, "donor_id", coin(seed, id_col).alias("side"))


def draw_negatives(
    df: DataFrame,
    id_col: str,
    text_cols=("text1", "text2"),
    seed="42",
    out: str = "sentence3",
    avoid_self: bool = False,
) -> DataFrame:
    """Adds ``donor_id``, ``side`` (1 or 2) and ``out``: the donor row's
    sentence ``side``.  Sentences meet in one join per side of the draw, after
    the numbering.  ``avoid_self`` re-deals the donors of rows that drew
    themselves (off by default, as in the reference)."""
    drawn = draw_donors(df.select(id_col), id_col, seed, avoid_self)
    given = df.select(F.col(id_col).alias("donor_id"), *[F.col(c).alias(f"_d{i + 1}") for i, c in enumerate(text_cols)])
    pick = F.when(F.col("side") == 1, F.col("_d1")).otherwise(F.col("_d2"))
    sentence = drawn.join(given, "donor_id").select(id_col, "donor_id", "side", pick.alias(out))
    return df.join(sentence, id_col)


def _rotate_fixed_points(j: DataFrame, id_col: str) -> DataFrame:
    """Give every row that drew itself another donor, keeping a bijection.

    The cycle members are the fixed points; when there is exactly one, it is
    joined by the next recipient in ``_ra`` order.  Members are ordered by
    ``_ra`` and member ``k`` takes the donor of member ``k + 1`` (cyclic), so
    nobody in the cycle keeps its own id.  A permutation of a hash order has
    about one fixed point on average, so the cycle is tiny; it is still
    handled with distributed operators and scalar subqueries."""
    is_fixed = F.col(id_col) == F.col("donor_id")
    n_fixed = j.where(is_fixed).agg(F.count(F.lit(1))).scalar()
    n_all = j.agg(F.count(F.lit(1))).scalar()
    f_ra = j.where(is_fixed).agg(F.min("_ra")).scalar()
    partner = (n_fixed == 1) & (n_all > 1) & (F.col("_ra") == f_ra % n_all + 1)
    cyc = value_rank(j.where(is_fixed | partner), "_ra", out="_cp")
    m = cyc.agg(F.count(F.lit(1))).scalar()
    taken = cyc.select(F.col(id_col).alias("_recv"), ((F.col("_cp") % m) + 1).alias("_take")) \
        .join(cyc.select(F.col("_cp").alias("_take"), F.col("donor_id").alias("_new")), "_take").select("_recv", "_new")
    return j.join(taken, j[id_col] == taken["_recv"], "left").select(
        id_col, "_ra", F.coalesce("_new", "donor_id").alias("donor_id"))
