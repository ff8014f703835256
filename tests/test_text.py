"""Encoders: the default bag, an encoder of the caller's own, repeated pairs,
triplets from text; padding of batches by a given transform."""

import math

from pyspark.sql import functions as F

from simpairs.operators.batching import prepare_batches
from simpairs.operators.text import hashed_bag, pad_batches, score_pairs, score_triplets, token_ids, vocabulary


def _docs(spark):
    return spark.createDataFrame([(1, "a b b"), (2, "a b"), (3, "z"), (4, ""), (5, None)], "id long, text string")


def lengths(docs, id_col, text_col):
    """An encoder as a caller would write it: letters and words."""
    t = F.coalesce(text_col, F.lit(""))
    return docs.select(id_col, F.array(F.length(t).cast("double"), F.size(F.split(t, " ")).cast("double")).alias("vec"))


def test_default_bag_counts_tokens(spark):
    vec = {r.id: r.vec for r in hashed_bag(_docs(spark), "id", "text").collect()}
    assert set(vec) == {1, 2, 3, 4, 5} and all(len(v) == 256 for v in vec.values())
    assert sorted(x for x in vec[1] if x) == [1.0, 2.0] and sum(vec[4]) == sum(vec[5]) == 0.0


def test_a_pair_listed_twice_is_scored_twice(spark):
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 2), (9, 2, 1), (10, 1, 3), (11, 4, 1), (12, 1, 99)], "p long, a long, b long")
    got = {r.p: r.cos for r in score_pairs(_docs(spark), pairs, "id", "text", "a", "b").collect()}
    want = 3 / (math.sqrt(5) * math.sqrt(2))
    assert all(abs(got[p] - want) < 1e-12 for p in (7, 8, 9)) and got[10] == got[11] == got[12] == 0.0


def test_encoder_of_the_caller(spark):
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    got = score_pairs(_docs(spark), pairs, "id", "text", "a", "b", encoder=lengths).first().cos
    u, v = (5.0, 3.0), (3.0, 2.0)
    assert abs(got - (u[0] * v[0] + u[1] * v[1]) / (math.hypot(*u) * math.hypot(*v))) < 1e-12


def test_triplets_from_text(spark):
    trip = spark.createDataFrame([(1, 2, 3)], "a long, p long, n long")
    r = score_triplets(_docs(spark), trip, "id", "text", "a", "p", "n", encoder=lengths).first()
    assert abs(r.d_ap - math.hypot(2, 1)) < 1e-5 and abs(r.d_an - math.hypot(4, 2)) < 1e-5 and r.correct and r.hinge == 0.0


def test_batches_take_a_transform(spark):
    docs = _docs(spark)
    ids = token_ids(docs, "id", "text", vocabulary(docs, "id", "text"), max_length=2)
    rows = {r.id: r for r in prepare_batches(docs.select("id"), "id", 2, lambda b: pad_batches(b.join(ids, "id"))).collect()}
    assert [rows[i].batch_id for i in (1, 2, 3, 4, 5)] == [0, 0, 1, 1, 2]
    assert len(rows[1].input_ids) == 2 and rows[4].input_ids == [0] and rows[4].attention_mask == [0] and rows[5].input_ids == []


def test_bags_hold_no_table_of_tokens(spark, capsys):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a"), (None, "b"), (None, None), (2, None), (3, "")], "id long, text string")
    bags = hashed_bag(docs, "id", "text")
    bags.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Generate" not in plan and "explode" not in plan
    got = {r.id: sorted((x for x in r.vec if x), reverse=True) for r in bags.collect()}
    assert got == {1: [3.0, 1.0], None: [1.0], 2: [], 3: []} and bags.count() == 4


def test_a_long_text_is_counted_whole(spark):
    docs = spark.range(1).select("id", F.repeat(F.lit("a b "), 50_000).alias("text"))
    assert sorted(x for x in hashed_bag(docs, "id", "text").first().vec if x) == [50_000.0, 50_000.0]
