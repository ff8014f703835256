"""Filtered lookups: same rows as the plain joins, no lost match, filters that
merge, the size bound, and what the exchange is spared."""

import re

import pytest
from pyspark.sql import functions as F

from simpairs.operators import lookup
from simpairs.operators.batching import apply_translation
from simpairs.operators.lookup import apply_translation_filtered, drop_keys, key_filter, merge_filters, split_by_filter, words_for
from simpairs.operators.split import keep_keys


def keys_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_size_follows_the_keys():
    assert [words_for(n) for n in (0, 1, 4, 5, 8, 9, 1000)] == [1, 1, 1, 2, 2, 4, 256]


def test_no_match_is_ruled_out_and_few_others_pass(spark):
    keys = spark.range(0, 20000).select((F.col("id") * 7).alias("k"), F.col("id").cast("string").alias("s"))
    flt = key_filter(keys, ["k", "s"])
    maybe, surely = split_by_filter(keys, ["k", "s"], flt)
    assert (maybe.count(), surely.count()) == (20000, 0)
    others = spark.range(0, 20000).select((F.col("id") * 7 + 1).alias("k"), F.col("id").cast("string").alias("s"))
    maybe, surely = split_by_filter(others, ["k", "s"], flt)
    assert maybe.count() + surely.count() == 20000 and maybe.count() < 600


def test_anti_join_equals_the_plain_one(spark):
    rows = [(i, None if i % 10 == 0 else f"k{i % 37}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key string")
    for listed in (["k1", "k5", "k5", "none"], [None, "k2"], []):
        keys = spark.createDataFrame([(k,) for k in listed], "key string")
        assert keys_of(drop_keys(df, keys, "key"), "id", "key") == keys_of(keep_keys(df, keys, "key", keep=False), "id", "key")
    empty = spark.createDataFrame([], "id long, key string")
    assert drop_keys(empty, spark.createDataFrame([("k1",)], "key string"), "key").count() == 0


def test_too_many_keys_mean_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MAX_WORDS", 4)
    df = spark.range(100)
    keys = spark.range(50)
    assert key_filter(keys, ["id"]) is None
    assert keys_of(drop_keys(df, keys, "id"), "id") == [(i,) for i in sorted(range(50, 100), key=lambda i: repr((i,)))]


def test_filters_merge(spark):
    a, b = spark.range(0, 300), spark.range(300, 600)
    both = merge_filters(key_filter(a, ["id"], 600), key_filter(b, ["id"], 600))
    whole = key_filter(a.union(b), ["id"], 600)
    assert keys_of(both.table, "word", "bits") == keys_of(whole.table, "word", "bits")
    with pytest.raises(ValueError):
        merge_filters(both, key_filter(a, ["id"], 10))


def test_key_types_must_agree(spark):
    flt = key_filter(spark.range(5), ["id"])
    with pytest.raises(TypeError):
        split_by_filter(spark.range(5).select(F.col("id").cast("int")), ["id"], flt)


def test_translation_equals_the_plain_join(spark):
    rows = [(i, f"one {i}", None if i % 9 == 0 else f"two {i}", f"three {i}", 1 + i % 3, ["de", "fr"][i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, sentence1 string, sentence2 string, sentence3 string, route int, lang string")
    tm = spark.createDataFrame([(f"one {i}", "de", f"eins {i}") for i in range(0, 200, 6)] + [("two 1", "fr", "deux"), ("two 1", "de", "zwei")],
                               "t string, lang string, replacement string").select(F.md5("t").alias("text_key"), "lang", "replacement")
    plain, filtered = apply_translation(df, tm), apply_translation_filtered(df, tm)
    assert sorted(plain.columns) == sorted(filtered.columns)
    cols = sorted(plain.columns)
    assert keys_of(plain, *cols) == keys_of(filtered, *cols)
    assert plain.where("translated").count() > 30


def rows_exchanged(df):
    """Rows written to exchanges by a run of the plan."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan().executedPlan()]
    while stack:
        node = stack.pop()
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        stack.extend(node.children().apply(i) for i in range(node.children().size()))
    return total


def test_the_exchange_is_spared(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    keys = spark.createDataFrame([(str(i),) for i in range(19990, 20300)], "key string")
    plain, filtered = keep_keys(df, keys, "key", keep=False), drop_keys(df, keys, "key")
    assert plain.count() == filtered.count() == 19990
    assert rows_exchanged(plain) >= 20000
    assert rows_exchanged(filtered) < 1500


def test_the_filter_is_broadcast(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("key"))
    plan = drop_keys(df, df.limit(3), "key")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("BroadcastHashJoin", plan)) >= 2 and "NestedLoop" not in plan
