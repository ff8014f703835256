"""Mixing sources to target weights by systematic sampling.

Inside a source the documents stand in order of size.  Their expected copies
are summed up from the left, one offset in [0, 1) is added, and a document is
emitted once for every whole number that its stretch of the line crosses.
Order by size keeps the words taken close to the target: the error of a
source is about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from .common import WORD_PATTERN, staged

#: Fixed values of the mix: weights in turn over the sources in code-point order.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Every source's share of all words follows its weight, but stops at
    ``max_repeat`` times its own words; the excess is reshared by weight.
    That fixed point is a water level: with sources in order of cap / weight,
    the sources below some rank are full and the others hold weight * level.
    The windows run over one row per source, which the mix's recipe bounds.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(max_repeat))).alias("cap"))
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.select("*", F.sum("source_size").over(every).alias("total"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"), F.sum("w").over(after).alias("w_left"))
    level = (F.col("total") - F.col("full")) / F.col("w_left")
    # The first source that its level does not fill sets the level for all.
    s = s.select("*", F.min(F.when(F.col("cap") >= level * F.col("w"), F.struct("full", level.alias("level")))).over(every).alias("at"))
    return s.select("source", "source_size", F.least("cap", F.col("at.level") * F.col("w")).alias("target"))


def systematic_copies(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """(id, source, size, copies, source_size, target) per distinct (id, source, size).

    The position in the source is a sum of counts over sizes, then over 256
    hash cells inside one size, then a row number inside a cell, so neither a
    hot source nor a size shared by many documents is sorted in one task.
    """
    units = sized.distinct().withColumn("cell", F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 2))
    cells = units.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lower = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "size", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("smaller"))
    left = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "size", "cell", F.coalesce(F.sum("n").over(left), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source", "size", "cell").orderBy("id")
    u = units.withColumn("k", F.row_number().over(inside) - 1).alias("u")
    c, n, t = cells.alias("c"), counts.alias("n"), targets.alias("t")
    u = u.join(c, F.col("u.source").eqNullSafe(F.col("c.source")) & (F.col("u.size") == F.col("c.size")) & (F.col("u.cell") == F.col("c.cell")))
    u = u.join(n, F.col("u.source").eqNullSafe(F.col("n.source")) & (F.col("u.size") == F.col("n.size")))
    u = u.join(t, F.col("u.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    at = F.col("u.k") + F.col("c.earlier") + F.col("n.smaller")
    offset = hash_unit(F.lit(seed), F.coalesce(F.col("u.source"), F.lit("")), F.col("u.source").isNull())
    copies = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    return u.select(F.col("u.id").alias("id"), F.col("u.source").alias("source"), F.col("u.size").alias("size"),
                    F.least(copies, F.lit(MAX_REPEAT)).cast("long").alias("copies"), "t.source_size", "t.target")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row.

    ``size`` counts words (null text: 0), ``taken`` = copies * size.  Null
    sources are one source, last in order.  A source without words has target
    0 and takes nothing.  Rows that repeat an id with the same source and size
    are drawn together and get the same copies.  Draws depend on the seed and
    the ids alone, so reruns agree whatever the partitions.  An empty table
    gives an empty result; other columns are not read.
    """
    sized = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size")), "sizes")
    drawn = systematic_copies(sized, source_targets(sized), seed).alias("x")
    d = sized.alias("d")
    same = F.col("d.id").eqNullSafe(F.col("x.id")) & F.col("d.source").eqNullSafe(F.col("x.source")) & (F.col("d.size") == F.col("x.size"))
    return d.join(drawn, same).select(
        F.col("d.id").alias(id_col), F.col("d.source").alias(source_col), "d.size", "x.source_size", "x.target", "x.copies",
        (F.col("x.copies") * F.col("d.size")).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` with each document repeated as often as it is drawn."""
    drawn = mix_counts(docs, id_col, text_col, source_col, seed).where("copies > 0").select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__size"),
        F.col("copies").alias("__copies")).distinct()
    rows = docs.withColumn("__words", word_count(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    out = rows.join(drawn, same)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
