"""global_rank equals the plain window, is partition-independent, and
average ranks follow the tie rule."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from simpairs.functions.hashing import hash_key
from simpairs.operators.rank import hash_rank, rank_table, spread_join, value_rank, with_value_bucket


def test_value_rank_matches_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 97).alias("g"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"), "id")
    mine = value_rank(df, "v", tie_cols=["id"], group_cols=["g"], out="pos", rows_per_bucket=20).select("id", "pos")
    ref = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).alias("ref"))
    bad = mine.join(ref, "id").where(F.col("pos") != F.col("ref")).count()
    assert bad == 0


def test_hash_rank_is_a_permutation_and_partition_free(spark):
    df = spark.range(0, 2000)
    key = hash_key(F.lit("42"), F.col("id"))
    a = hash_rank(df.repartition(1), key, ["id"]).select("id", F.col("pos").alias("a"))
    b = hash_rank(df.repartition(7), key, ["id"], rows_per_bucket=10).select("id", F.col("pos").alias("b"))
    j = a.join(b, "id")
    assert j.where(F.col("a") != F.col("b")).count() == 0
    stats = j.agg(F.min("a"), F.max("a"), F.countDistinct("a")).first()
    assert tuple(stats) == (1, 2000, 2000)


def test_average_ranks(spark):
    df = spark.createDataFrame([(0.1,), (0.1,), (0.5,), (0.9,)], "v double")
    got = sorted(((r.v, r.rank2 / 2) for r in rank_table(df, "v").collect()))
    assert got == [(0.1, 1.5), (0.5, 3.0), (0.9, 4.0)]
    weighted = spark.createDataFrame([(0.1, 2), (0.5, 1), (0.9, 1)], "v double, w long")
    assert sorted((r.v, r.rank2 / 2) for r in rank_table(weighted, "v", weight="w").collect()) == got


def _sizes(df):
    return sorted(r["count"] for r in df.groupBy("_bucket").count().collect())


def test_one_outlier_does_not_fill_a_bucket(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.range(0, 10000).select("id", F.when(F.col("id") == 5, inf).when(F.col("id") == 6, nan).when(F.col("id") == 7, None)
                                      .otherwise(F.col("id").cast("double")).alias("v"))
    d = with_value_bucket(df, [], "v", ["id"], rows_per_bucket=500)
    assert max(_sizes(d)) < 1200
    pos = {r.id: r.pos for r in value_rank(df, "v", ["id"], rows_per_bucket=500).collect()}
    assert (pos[7], pos[5], pos[6]) == (1, 9999, 10000) and sorted(pos.values()) == list(range(1, 10001))


def test_equal_values_are_split_by_their_ties(spark):
    df = spark.range(0, 9000).select("id", (F.col("id") % 2).alias("g"), F.lit(3.0).alias("v"))
    d = with_value_bucket(df, ["g"], "v", ["id"], rows_per_bucket=300)
    assert max(r["count"] for r in d.groupBy("g", "_bucket").count().collect()) < 900
    got = value_rank(df, "v", ["id"], ["g"], rows_per_bucket=300)
    assert got.where(F.col("pos") != F.expr("id div 2") + 1).count() == 0


def test_groups_with_and_without_cuts_together(spark):
    df = spark.range(0, 6000).select(F.when(F.col("id") < 5000, F.lit(None)).otherwise(F.col("id") % 50).alias("g"),
                                     ((F.col("id") * 7919) % 1000).cast("double").alias("v"), "id")
    mine = value_rank(df, "v", ["id"], ["g"], rows_per_bucket=400).select("id", "pos")
    ref = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).alias("ref"))
    assert mine.join(ref, "id").where(F.col("pos") != F.col("ref")).count() == 0


def test_bijection_of_every_size(spark):
    """Every n up to 70, odd ones too, and some larger: each number once."""
    from simpairs.operators.permute import bases, with_permutation

    for n in [*range(1, 71), 997, 1024, 5003]:
        a, b = bases(n)
        assert a * b >= n and a * b - n < a and a >= b
    fixed = 0
    for n in (1, 2, 3, 5, 7, 11, 64, 65, 997, 5003):
        d = spark.range(1, n + 1)
        got = [r.p for r in with_permutation(d, "id", n, ("s", "a"), "p").orderBy("id").collect()]
        assert sorted(got) == list(range(1, n + 1))
        other = [r.p for r in with_permutation(d, "id", n, ("s", "b"), "p").orderBy("id").collect()]
        assert n < 60 or got != other
        fixed += sum(i + 1 == p for i, p in enumerate(got)) if n == 5003 else 0
    assert fixed < 12


def test_numbers_follow_any_order(spark):
    from simpairs.operators.permute import numbered

    inf, nan = float("inf"), float("nan")
    df = spark.range(0, 4000).select("id", F.when(F.col("id") == 5, inf).when(F.col("id") == 6, nan).when(F.col("id") == 7, None)
                                     .when(F.col("id") < 3000, 2.0).otherwise(F.col("id").cast("double")).alias("v"))
    rows, n = numbered(df.repartition(5), ["v", "id"])
    mine = {r.id: r.pos for r in rows.collect()}
    want = {r.id: r.p for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("p")).collect()}
    assert n == 4000 and mine == want
    empty, none = numbered(df.where("id < 0"), ["id"])
    assert none == 0 and empty.count() == 0


def test_average_ranks_in_groups(spark):
    """One group of most rows, many small ones, a null group, NaN and infinity."""
    df = spark.range(0, 5000).select(F.when(F.col("id") < 4000, F.lit(1)).when(F.col("id") < 4100, None).otherwise(F.col("id") % 90).alias("g"),
                                     F.when(F.col("id") % 100 == 3, float("inf")).when(F.col("id") % 100 == 4, float("nan"))
                                     .otherwise((F.col("id") * 7919 % 60).cast("double")).alias("v"))
    got = {(r.g, repr(r.v)): r.rank2 for r in rank_table(df, "v", ["g"]).collect()}
    w = Window.partitionBy("g")
    want = df.select("g", "v", (2 * F.rank().over(w.orderBy("v")) + F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1).alias("r")).distinct()
    assert got == {(r.g, repr(r.v)): r.r for r in want.collect()}


@pytest.fixture()
def plain_plans(spark):
    """No plan is changed while it runs, so joins stay as they are written."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_ranks_of_one_group_are_spread_over_tasks(spark, plain_plans):
    df = spark.range(4000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    ranks = rank_table(df, "v", ["g"], total="n")
    assert _largest_share(ranks) < 0.7
    assert sorted((r.v, r.rank2, r.n) for r in ranks.collect()) == [(float(i), 2 * i + 2, 4000) for i in range(4000)]


def test_join_with_one_key_is_spread_over_tasks(spark, plain_plans):
    df = spark.range(4000).select(F.when(F.col("id") < 3990, F.lit("a")).alias("g"), F.col("id").alias("v"))
    small = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "g string, w int")
    got = spread_join(df, small, ["g"], ["v"])
    assert _largest_share(got) < 0.5
    assert sorted((r.v, r.w) for r in got.collect()) == [(i, 1 if i < 3990 else 2) for i in range(4000)]
