"""Packed run logs: the files of very many runs in few tables, read as if each were loose."""

import glob
import os

from pyspark.sql import functions as F

from simpairs.operators import rank
from simpairs.plans import queries as q
from simpairs.sources import runlog_source as rs
from simpairs.sources import runlogs
from simpairs.sources.runlogs import read_metrics
from tests.test_runlog import log_root  # noqa: F401

RUNS = 120


def _files(root):
    return [p for p in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(p)]


def _documents(spark, folder):
    d = spark.range(RUNS).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    d.write.parquet(f"{folder}/documents.parquet")
    d.where("doc_id < 10").select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit(0).cast("long").alias("toxic")).write.parquet(f"{folder}/labels.parquet")


def _events(spark, folder):
    """Two events a run; run 5 has 2500 more."""
    few = spark.range(2 * RUNS).select(F.col("id").alias("event_id"), (F.col("id") % RUNS).alias("user_id"))
    e = few.union(spark.range(2500).select(F.col("id") + 2 * RUNS, F.lit(5).cast("long")))
    e.select("event_id", F.timestamp_seconds("event_id").alias("ts"), "user_id", F.lit("click").alias("event_type"),
             F.col("event_id").cast("double").alias("value")).write.parquet(f"{folder}/events.parquet")


def _texts(root, kind):
    return [(os.path.relpath(p, root), open(p, newline="").read()) for p in _files(root) if p.endswith(rs.FILES[kind])]


def test_packs_read_as_loose_files_do(spark, log_root, tmp_dir):  # noqa: F811
    for kind in ("metrics", "results", "hparams"):
        rs.write_packs(spark.createDataFrame(_texts(log_root, kind), "path string, content string"), f"{tmp_dir}/{kind}")
        packed, loose = rs.load_runs(spark, f"{tmp_dir}/{kind}", kind), rs.load_runs(spark, log_root, kind)
        for rows in (lambda d: d, lambda d: d.where("run_id < 2")):
            assert sorted(map(repr, rows(packed).collect())) == sorted(map(repr, rows(loose).collect()))
        assert rs.load_runs(spark, f"{tmp_dir}/{kind}", kind, "other.*").count() == 0
    metrics = rs.load_runs(spark, f"{tmp_dir}/metrics", "metrics")
    assert sorted(map(repr, metrics.collect())) == sorted(map(repr, read_metrics(spark, log_root).collect()))


def test_loose_files_and_packs_of_one_root_add_up(spark, log_root):  # noqa: F811
    before = rs.load_runs(spark, log_root, "results").count()
    rs.write_packs(spark.createDataFrame([("version_90/results.json", '{"a": 1, "b": 2.5}')], "path string, content string"), log_root)
    assert rs.load_runs(spark, log_root, "results").count() == before + 2


def test_option_files_of_many_runs_are_few_files(spark, tmp_dir):
    _documents(spark, tmp_dir)
    root = q._write_hparams(spark, tmp_dir)
    assert len(_files(root)) < RUNS / 2
    got = {r.run_id: r for r in q.runlog_hparams(spark, tmp_dir).collect()}
    assert len(got) == RUNS and got[1].batch_size == 64 and got[0].batch_size == 32 and got[50].batch_size is None
    assert got[1].train_dataset_name == "['ro-sts', 'biblical_01']" and {r.n_options for r in got.values()} == {13}


def test_result_files_of_many_runs_are_few_files(spark, tmp_dir):
    _events(spark, tmp_dir)
    assert len(_files(q._write_results(spark, tmp_dir))) < RUNS / 2
    got = q.runlog_results(spark, tmp_dir).collect()
    assert len({r.run_id for r in got}) == RUNS and sum(r.metric == "extra_metric" for r in got) == RUNS
    assert {(r.metric, r.value) for r in got if r.run_id == 7} == {("extra_metric", 1.5), ("test_click", 67.0)}


def test_report_of_many_runs(spark, tmp_dir):
    _documents(spark, tmp_dir)
    _events(spark, tmp_dir)
    got = {r.run_id: r for r in q.runlog_report(spark, tmp_dir).collect()}
    assert len(got) == RUNS and got[7].test_click == 67.0 and got[7].batch_size == 64 and got[50].batch_size is None


def test_metric_files_of_many_runs_are_few_files(spark, tmp_dir):
    _events(spark, tmp_dir)
    assert len(_files(q._write_metric_files(spark, tmp_dir))) < RUNS / 2
    got = {r.run_id: r for r in q.runlog_lines(spark, tmp_dir).collect()}
    assert len(got) == RUNS - 1 and (got[5].rows, got[5].bad_rows) == (2502, 0) and (got[0].rows, got[0].bad_rows) == (2, 1)


def test_histories_of_a_run_in_several_stretches(spark, tmp_dir):
    _events(spark, tmp_dir)
    got = q.runlog_metrics(spark, tmp_dir).where("run_id = 5").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(2500)) and [r.epoch for r in got] == [5 * k for k in range(2500)]


def test_result_files_are_shuffled_once(spark, tmp_dir, monkeypatch):
    """A run is one row of its results: it is not grouped a second time to be packed."""
    _events(spark, tmp_dir)
    held = []
    monkeypatch.setattr(q, "write_packs", lambda files, root: held.append(files))
    q._write_results(spark, tmp_dir)
    plan = held[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert held[0].where("path = 'version_7/results.json' and endswith(content, '\n')").count() == 1 and held[0].count() == RUNS


def test_results_of_events_without_a_run_are_kept(spark, tmp_dir):
    rows = [(1, None, "click", 2.0), (2, 3, "click", 4.0), (4, 3, "view", None)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    e.write.parquet(f"{tmp_dir}/events.parquet")
    got = sorted(map(tuple, q.runlog_results(spark, tmp_dir).collect()), key=repr)
    assert got == [(3, "dev_click", 4.0), (3, "extra_metric", 1.5), (None, "extra_metric", 1.5), (None, "test_click", 2.0)]


def test_lines_of_runs_are_counted_once(spark, log_root, monkeypatch):  # noqa: F811
    """Both orders of ``metrics_long`` share one count where no run is large."""
    calls, count = [], rank._largest_group
    for module in (rank, runlogs):
        monkeypatch.setattr(module, "_largest_group", lambda *a: calls.append(a) or count(*a), raising=False)
    metrics = rs.load_runs(spark, log_root, "metrics")
    once = sorted(map(repr, runlogs.metrics_long(metrics).collect()))
    assert len(calls) == 1
    monkeypatch.setattr(rank, "ROWS_PER_BUCKET", 1)
    assert sorted(map(repr, runlogs.metrics_long(metrics).collect())) == once


def test_cells_of_metric_lines():
    names = ["step", "a", "epoch", "a"]
    assert rs.parse_line("3,1.5, 2 ,nan", names, 7)[:3] == (7, 2, 3)
    assert rs.parse_line("3,1.5,2,4e1", names, 7) == (7, 2, 3, [("a", 40.0)], None)
    assert rs.parse_line("nan,1.5,\t, ", names, 7) == (7, None, None, [], None)
    for bad in ("3,1.5,2", "3,1_0,2,1", "3,x,2,1", "x,,,"):
        assert rs.parse_line(bad, names, 7) == (7, None, None, None, bad)
