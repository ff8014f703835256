"""Bucketed tables: joins that move no vector, the same scores as over plain
tables, splits that join without an exchange, removal."""

from pyspark.sql import functions as F

from simpairs.operators.text import score_pairs, score_triplets
from simpairs.session import child_names
from simpairs.sources.buckets import drop_bucketed, encode_bucketed, score_stored_pairs, score_stored_triplets, write_bucketed


def docs_of(spark):
    return spark.createDataFrame([(i, f"a{i % 3} b{i % 5} c c") for i in range(60)] + [(60, ""), (61, None)], "id long, text string")


def exchanges_above_vectors(plan: str) -> list[str]:
    """Exchange lines of the plan whose subtree scans the vector table first."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = [x for x, d in zip(lines[i + 1:], depth[i + 1:])]
            inside = []
            for x, d in zip(below, depth[i + 1:]):
                if d <= depth[i]:
                    break
                inside.append(x)
            if inside and not any("Join" in x for x in inside) and any("vec" in x and "FileScan" in x for x in inside):
                found.append(line)
    return found


def test_no_vector_is_exchanged_by_the_joins(spark):
    vectors = spark.table(encode_bucketed(docs_of(spark), "id", "text"))
    pairs = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    plan = score_stored_pairs(vectors, pairs, "id", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
    assert exchanges_above_vectors(plan) == []
    plain = score_pairs(docs_of(spark), pairs, "id", "text", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert len(exchanges_above_vectors(plain)) == 2


def test_scores_equal_those_over_plain_tables(spark):
    docs = docs_of(spark)
    vectors = spark.table(encode_bucketed(docs, "id", "text"))
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 99), (60, 61), (5, 5)], "a long, b long")
    got = sorted((r.a, r.b, r.cos) for r in score_stored_pairs(vectors, pairs, "id", "a", "b").collect())
    assert got == sorted((r.a, r.b, r.cos) for r in score_pairs(docs, pairs, "id", "text", "a", "b").collect())
    trip = spark.createDataFrame([(1, 2, 3), (4, 5, 6), (7, 7, 8)], "x long, y long, z long")
    cols = ["x", "y", "z", "hinge"]
    got = sorted(tuple(r[c] for c in cols) for r in score_stored_triplets(vectors, trip, "id", "x", "y", "z").collect())
    assert got == sorted(tuple(r[c] for c in cols) for r in score_triplets(docs, trip, "id", "text", "x", "y", "z").collect())


def test_tables_bucketed_alike_join_without_an_exchange(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    left = spark.table(write_bucketed(rows, "id", "left"))
    right = spark.table(write_bucketed(rows.withColumnRenamed("v", "w").where("id % 3 = 0"), "id", "right"))
    j = left.join(right, "id")
    assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
    assert j.count() == 334


def test_a_dropped_table_leaves_no_files(spark):
    name = write_bucketed(spark.range(10), "id", "gone")
    path = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first().data_type
    assert child_names(spark, path)
    drop_bucketed(spark, name)
    assert child_names(spark, path) == [] and not spark.catalog.tableExists(name)
