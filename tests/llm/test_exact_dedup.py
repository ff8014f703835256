import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from simpairs.llm import exact_dedup as module
from simpairs.llm.exact_dedup import digest_runs, exact_dedup, merge_level, merge_runs, sorted_runs
from tests.conftest import SF001
from tests.llm.helpers import EDGE_DOCS, edge_docs, empty_docs


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        k = keep(ids) if ids else None
        out.append((i, k, len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in EDGE_DOCS]
    assert rows_of(exact_dedup(edge_docs(spark))) == brute(rows, max)
    assert rows_of(exact_dedup(edge_docs(spark), keep="min")) == brute(rows, min)
    assert exact_dedup(empty_docs(spark)).count() == 0


def test_many_runs_merge_over_several_levels(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").repartition(40)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(exact_dedup(docs)) == brute(rows, max)
    runs = digest_runs(docs, "doc_id", "text")
    assert runs.select("run").distinct().count() > 16  # more than one level of merging
    assert merge_runs(runs).count() == len({t or "" for _, t in rows})


def test_small_blocks_and_both_rules(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 2)
    rows = [(i if i % 11 else None, f"text {i * i % 23}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(19)
    assert rows_of(exact_dedup(docs)) == brute(rows, max)
    assert rows_of(exact_dedup(docs, keep="min")) == brute(rows, min)


def test_one_text_in_every_run_and_string_ids(spark):
    rows = [(f"id{i:04d}", "same" if i % 3 else f"other {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(33)
    assert rows_of(exact_dedup(docs)) == brute(rows, max)


def test_every_level_stays_sorted_in_disjoint_blocks(spark):
    rows = [(i, f"text {i % 70}") for i in range(500)]
    runs = digest_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), "doc_id", "text")
    level, bits = sorted_runs(runs, F.max, 1), 1
    for left in (2, 1):
        level, bits = merge_level(level, F.array_max, bits), bits + 4
        got = level.collect()
        assert len({r.run for r in got}) == left
        for run in {r.run for r in got}:
            blocks = sorted((r for r in got if r.run == run), key=lambda r: r.block)
            keys = [bytes(e.digest) for r in blocks for e in r.entries]
            assert keys == sorted(set(keys))
            assert all(e.pos >> (56 - bits) == r.block for r in blocks for e in r.entries)
    assert sum(e.n for r in got for e in r.entries) == 500


def test_rows_are_sorted_inside_arrays_only(spark):
    docs = spark.createDataFrame([(i, str(i % 5)) for i in range(100)], "doc_id long, text string").repartition(20)
    plan = merge_runs(digest_runs(docs, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "Python" not in plan
