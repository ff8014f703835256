"""Plan checks: no Cartesian product or nested-loop join in any registered
query (the grid is exploded, scalars are subqueries), and filters and column
pruning reach the parquet scans."""

import pytest

import __spark_entry__ as entry
from simpairs.plans.queries import QUERIES
from tests.conftest import SF001

# Queries whose construction runs jobs (writes, checkpoints, fits); their
# plans read the written tables and are checked by the oracle tests.
SIDE_EFFECTS = {"split_chain", "split_counts", "tsv_roundtrip", "regressor_eval", "staged_fit", "grid_fit", "stream_metrics", "stream_stop",
                "stream_spearman", "stream_spearman_steps", "stream_epochs", "metric_log_replay", "regressor_features", "staged_features", "results_roundtrip", "encode_custom", "augment_filtered", "key_filtered", "encode_stored", "parts_bucketed", "curves", "encode_score", "triplet_text", "runlog_metrics", "runlog_lines", "runlog_results", "runlog_hparams", "runlog_report"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECTS))
def test_no_cartesian_product(spark, name):
    df = entry.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    df = entry.queries()["pearson_by_stage"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan


def test_text_scan_reads_only_id_and_text(spark):
    df = entry.queries()["tokenise_pad"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "n_chars" not in plan.split("ReadSchema: struct<doc_id:bigint,text:string>")[0][-200:]


def test_no_ranking_carries_texts_or_vectors(spark):
    """Sorts and windows of the negatives see ids and hashes only."""
    from simpairs.operators.negatives import draw_donors

    ids = entry.queries()["negatives_pair"](spark, SF001)
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "text" not in line and "_d1" not in line
    narrow = draw_donors(spark.range(100).withColumnRenamed("id", "pair_id"), "pair_id")
    assert narrow.columns == ["pair_id", "donor_id", "side"]


@pytest.mark.parametrize("name", ["row_lookup", "batches", "negatives_pair", "negatives_triplet", "tokenise_pad", "triplet_text", "augment_lookup",
                                  "pair_loss", "triplet_eval", "spearman_by_stage"])
def test_no_window_without_a_key(spark, name):
    """No order goes through one task, at any size."""
    df = entry.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "], [], [" not in line and not line.rstrip().endswith(", []"), line


def test_every_range_of_an_order_has_rows(spark):
    """At sf0.1 the numbering of documents is spread over all ranges."""
    from simpairs.operators.permute import numbered

    ids = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows, n = numbered(ids, ["doc_id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [len(p) for p in rows.select("pos").rdd.glom().collect()]
    assert n == 10000 and max(parts) < 3 * n / 32
