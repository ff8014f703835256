"""Exact stratified split and negative sampling: hand cases and properties."""

from pyspark.sql import functions as F

from simpairs.operators.negatives import draw_negatives
from simpairs.operators.split import split_chain, stratified_split


def _split_counts(spark, keys, test_size):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    out = stratified_split(df, "id", "k", test_size)
    return {(r.part, r.k): r.n for r in out.groupBy("part", "k").agg(F.count("*").alias("n")).collect()}


def test_rare_keys_go_to_second_part(spark):
    c = _split_counts(spark, ["a"] * 4 + ["b"] * 4 + ["c"], 0.5)
    assert c == {("train", "a"): 2, ("train", "b"): 2, ("test", "a"): 2, ("test", "b"): 2, ("test", "c"): 1}


def test_remainder_goes_by_class_hash(spark):
    c = _split_counts(spark, ["a"] * 3 + ["b"] * 3, 0.5)
    train = {k: n for (p, k), n in c.items() if p == "train"}
    assert sum(train.values()) == 3 and sorted(train.values()) == [1, 2]


def test_split_is_partition_independent_and_complete(spark):
    from tests.conftest import SF01
    from simpairs.plans import fixtures as fx

    s = fx.strata(spark, SF01, 50)
    a = stratified_split(s.repartition(1), "doc_id", "skey", 0.3).select("doc_id", F.col("part").alias("a"))
    b = stratified_split(s.repartition(13), "doc_id", "skey", 0.3).select("doc_id", F.col("part").alias("b"))
    j = a.join(b, "doc_id")
    assert j.count() == s.count()
    assert j.where(F.col("a") != F.col("b")).count() == 0


def test_split_chain_parts_are_disjoint(spark):
    from tests.conftest import SF01
    from simpairs.plans import fixtures as fx

    s = fx.strata(spark, SF01, 50)
    out = split_chain(s, "doc_id", "skey")
    assert out.count() == s.count()
    assert out.select("doc_id").distinct().count() == s.count()


def test_negatives_are_a_bijection(spark):
    df = spark.range(0, 500).select(F.col("id").alias("pid"), F.concat(F.lit("x"), F.col("id")).alias("t1"),
                                    F.concat(F.lit("y"), F.col("id")).alias("t2"))
    n = draw_negatives(df, "pid", ("t1", "t2"), seed="42")
    assert n.count() == 500
    assert n.select("donor_id").distinct().count() == 500
    n2 = draw_negatives(df.repartition(5), "pid", ("t1", "t2"), seed="42")
    j = n.select("pid", "donor_id", "sentence3").join(n2.select("pid", F.col("donor_id").alias("d2"), F.col("sentence3").alias("s2")), "pid")
    assert j.where((F.col("donor_id") != F.col("d2")) | (F.col("sentence3") != F.col("s2"))).count() == 0


def test_avoid_self_keeps_a_bijection_without_fixed_points(spark):
    df = spark.range(0, 40).select(F.col("id").alias("pid"), F.concat(F.lit("x"), F.col("id")).alias("t1"),
                                   F.concat(F.lit("y"), F.col("id")).alias("t2"))
    had_fixed = 0
    for seed in ["1", "2", "3", "4", "5", "6"]:
        plain = draw_negatives(df, "pid", ("t1", "t2"), seed=seed)
        had_fixed += plain.where(F.col("pid") == F.col("donor_id")).count()
        n = draw_negatives(df, "pid", ("t1", "t2"), seed=seed, avoid_self=True)
        rows = n.select("pid", "donor_id").collect()
        assert sorted(r.pid for r in rows) == list(range(40))
        assert sorted(r.donor_id for r in rows) == list(range(40))
        assert all(r.pid != r.donor_id for r in rows)
    assert had_fixed > 0
