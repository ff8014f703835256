"""Streaming states: epochs in order give the batch answer across micro-batches,
a hot run is spread, a late epoch fails, an empty stream gives an empty table."""

import os
import time

import pytest
from pyspark.sql import functions as F

from simpairs import session
from simpairs.operators.metrics import correlations
from simpairs.operators.runlog import early_stop
from simpairs.streaming import monitors
from simpairs.streaming.monitors import PatienceMonitor, fold_patience, replay_in_order, run_complete_to_table, stream_metrics, stream_rank_metrics

SCHEMA = "run_id long, epoch long, value double"


def _series(spark, values, run=0):
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(values)], SCHEMA)


def _replayed(spark, df, src, chunks):
    monitor = PatienceMonitor(spark, "test-stop", 4)
    replay_in_order(df, src, "epoch", chunks, 2, lambda: monitor.feed(spark.readStream.schema(SCHEMA).parquet(src)))
    return monitor


def test_monitor_matches_batch_across_micro_batches(spark, tmp_dir):
    df = _series(spark, [5, 4, 4, 4, 6, 1, 1, 1, 1]).unionByName(_series(spark, [1, 2, 3], 7)).unionByName(
        _series(spark, [float("nan"), 2, 2, 2, 2, 2], None))
    got = {(r.run_id, r.stop_epoch) for r in _replayed(spark, df, os.path.join(tmp_dir, "in"), 3).stops().collect()}
    want = {(r.run_id, r.stop_epoch) for r in early_stop(df, 4).where("stop_epoch is not null").collect()}
    assert got == want == {(0, 8), (None, 5)}


def test_a_hot_run_equals_the_batch_answer(spark, tmp_dir):
    df = spark.range(0, 20000).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("epoch"),
                                      F.when(F.col("id") < 15000, F.col("id")).otherwise(0).cast("double").alias("value"))
    assert [tuple(r) for r in _replayed(spark, df, os.path.join(tmp_dir, "hot"), 3).stops().collect()] == [(1, 15003)]


def test_a_replayed_micro_batch_changes_nothing(spark):
    monitor = PatienceMonitor(spark, "test-again", 4)
    first, second = _series(spark, [5, 4, 4]), _series(spark, [5, 4, 4, 4, 4, 4]).where("epoch > 2")
    monitor.update(first, 0)
    monitor.update(second, 1)
    monitor.update(second, 1)
    assert [tuple(r) for r in monitor.stops().collect()] == [(0, 4)]


def test_late_epoch_fails(spark):
    state = fold_patience(spark.createDataFrame([], "run_id long, best double, last_imp long, last_epoch long, stop_epoch long"),
                          _series(spark, [5, 4, 4, 4]), 4)
    with pytest.raises(Exception, match="arrived after"):
        fold_patience(state, _series(spark, [9]), 4).collect()


def test_empty_streams_give_empty_tables(spark, tmp_dir):
    src = os.path.join(tmp_dir, "none")
    schema = "stage string, y double, y_hat double, loss double"
    spark.createDataFrame([], schema).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    assert run_complete_to_table(stream_metrics(stream(), ["stage"], "y", "y_hat", "loss"), spark, "e1").count() == 0
    assert stream_rank_metrics(stream(), spark, "stage", "y", "y_hat", "e2").count() == 0
    assert _replayed(spark, _series(spark, []), os.path.join(tmp_dir, "no-log"), 2).stops().count() == 0


def test_streamed_spearman_keeps_null_groups(spark, tmp_dir):
    src = os.path.join(tmp_dir, "pred")
    rows = [(g, float(i), float(i * i % 7)) for g in ("a", None) for i in range(9)]
    spark.createDataFrame(rows, "stage string, y double, y_hat double").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("stage string, y double, y_hat double").option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.stage: (r.n, r.spearman) for r in stream_rank_metrics(stream, spark, "stage", "y", "y_hat", "nulls").collect()}
    assert set(got) == {"a", None} and got["a"] == got[None] and got["a"][0] == 9


def test_spearman_after_every_micro_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "running")
    schema = "stage string, y double, y_hat double"
    rows = [[("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0)], [("a", 3.0, 0.0)], [("b", 3.0, None), ("a", 4.0, 5.0)]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files arrive in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r.batch, r.stage, r.n, round(r.spearman, 6)) for r in monitors.running_rank_metrics(stream, spark, "stage", "y", "y_hat", "running").collect()}
    assert got == {(0, "a", 2, 1.0), (0, "b", 2, -1.0), (1, "a", 3, -0.5), (2, "a", 4, 0.4)}


def test_a_new_monitor_goes_on_where_the_old_one_stopped(spark, tmp_dir):
    src, path = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "monitor")
    df = _series(spark, [5, 4, 4, 4, 6, 1, 1, 1, 1])
    chunks = [df.where("epoch < 3"), df.where("epoch between 3 and 5"), df.where("epoch > 5")]
    for part in chunks:  # every feed by an object that knows nothing but the path
        part.coalesce(1).write.mode("append").parquet(src)
        PatienceMonitor(spark, "again", 4, path=path).feed(spark.readStream.schema(SCHEMA).parquet(src))
    assert [tuple(r) for r in PatienceMonitor(spark, "again", 4, path=path).stops().collect()] == [(0, 8)]
    assert len(os.listdir(os.path.join(path, "state"))) == 2  # this version and the one a replay needs


def test_scratch_folder_without_the_setting():
    """In a session of its own: the fallback of a local master, and the error of a cluster."""
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
from simpairs.session import checkpoint_root, scratch_dir
a = scratch_dir(spark, 'x')
spark.range(3).write.parquet(a)
assert checkpoint_root(spark) == checkpoint_root(spark) and a.startswith(checkpoint_root(spark))
assert spark.range(4).checkpoint().count() == 4 and spark.read.parquet(a).count() == 3
print('fine')
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


# -- count levels ---------------------------------------------------------------------

def _spearman(pairs):
    def ranks(v):
        order = sorted(v)
        return [order.index(x) + (order.count(x) + 1) / 2 for x in v]

    a, b = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    ab, aa, bb = (sum((x - mx) * (z - mz) for x, z in zip(u, w)) for u, w, mx, mz in ((a, b, ma, mb), (a, a, ma, ma), (b, b, mb, mb)))
    return ab / (aa * bb) ** 0.5 if aa and bb else None


def test_levels_equal_the_batch_answer_and_stay_flat(spark, tmp_dir):
    """Twenty micro-batches: Spearman of all rows so far, at a resolution, and
    the rows that a micro-batch reads do not follow the history."""
    import random

    from simpairs.streaming.levels import RankLevels

    rng, seen, read = random.Random(2), [], []
    state = RankLevels(spark, os.path.join(tmp_dir, "levels"), ["stage"], "y", "y_hat", fan=3, widths=(0.5, 0.25))
    schema = "stage string, y double, y_hat double"
    for b in range(20):
        rows = [(rng.choice("ab"), y := rng.uniform(0, 4), min(3.99, max(0.0, y + rng.gauss(0, 1)))) for _ in range(400)]
        seen += rows
        state.update(spark.createDataFrame(rows, schema), b)
        if b == 7:
            state.update(spark.createDataFrame(rows, schema), b)  # replayed
        live = state.live()
        read.append(sum(r.rows for r in live))
        assert max(sum(r.level == k for r in live) for k in range(9)) < 3
        if b in (0, 7, 19):
            got = {r.stage: (r.n, r.spearman) for r in state.running(spark.createDataFrame([], schema)).where(f"batch = {b}").collect()}
            for g in "ab":
                cells = [(y // 0.5, p // 0.25) for s, y, p in seen if s == g]
                assert got[g][0] == len(cells) and abs(got[g][1] - _spearman(cells)) < 1e-9
    assert max(read[10:]) <= 2 * max(read[:6]) and max(read) < len(seen) / 4
    kept = os.listdir(os.path.join(tmp_dir, "levels", "runs"))
    assert len(kept) <= len(state.live()) + len(state.live(18))


def test_levels_go_on_after_a_restart(spark, tmp_dir):
    src, path = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "state")
    schema = "stage string, y double, y_hat double"
    parts = [[("a", 1.0, 1.0), ("a", 2.0, 2.0)], [("a", 3.0, 0.0), ("b", 1.0, 1.0)], [("a", 4.0, 5.0)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        got = monitors.running_rank_metrics(spark.readStream.schema(schema).parquet(src), spark, "stage", "y", "y_hat", "x", path=path)
    assert {(r.batch, r.stage, r.n, r.spearman and round(r.spearman, 6)) for r in got.collect()} == {
        (0, "a", 2, 1.0), (1, "a", 3, -0.5), (1, "b", 1, None), (2, "a", 4, 0.4)}


# -- epochs that close ----------------------------------------------------------------

STEPS = "run_id long, stage string, epoch long, batch_id long, y double, y_hat double, loss double, at timestamp, announced long"


def _steps(spark, rows):
    import datetime

    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    return spark.createDataFrame([(*r[:7], at(r[7]), r[8]) for r in rows], STEPS)


def _feed(spark, src, path, rows, **options):
    from simpairs.streaming.epochs import run_epoch_metrics

    _steps(spark, rows).coalesce(1).write.mode("append").parquet(src)
    return run_epoch_metrics(spark.readStream.schema(STEPS).parquet(src), path, **options)


def _epoch(run, stage, epoch, values, at=0, per_batch=2):
    return [(run, stage, epoch, i // per_batch, y, p, loss, at + i, None) for i, (y, p, loss) in enumerate(values)]


def test_epochs_close_once_across_restarts(spark, tmp_dir):
    import numpy as np

    src, path = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "state")
    values = [(1.0, 2.0, 0.1), (2.0, 1.0, 0.3), (3.0, 5.0, 0.8), (4.0, 4.0, None), (5.0, 9.0, 0.4)]
    first = _epoch(1, "dev", 0, values)
    end = (1, "dev", 0, None, None, None, None, 9, 5)
    assert _feed(spark, src, path, first[:3]).count() == 0                       # open
    assert _feed(spark, src, path, [end] + _epoch(1, "train", 0, values)).count() == 0  # the mark comes before the last rows
    got = _feed(spark, src, path, first[3:] + _epoch(None, None, 3, [(1.0, 1.0, 1.0)]) + [(None, None, 3, None, None, None, None, 8, 1)]).collect()
    assert {(r.run_id, r.stage, r.epoch, r.n, r.n_batches, r.complete) for r in got} == {(1, "dev", 0, 5, 3, True), (None, None, 3, 1, 1, True)}
    dev = next(r for r in got if r.stage == "dev")
    assert abs(dev.pearson - np.corrcoef([v[0] for v in values], [v[1] for v in values])[0, 1]) < 1e-12
    assert abs(dev.avg_loss - (0.2 + 0.8 + 0.4) / 3) < 1e-12
    assert next(r for r in got if r.stage is None).pearson is None
    # Nothing more is emitted for closed epochs; the open one expires once the stream is past it.
    late = _feed(spark, src, path, _epoch(2, "dev", 0, [(1.0, 1.0, 0.5)], at=100_000), idle_seconds=60)
    late = _feed(spark, src, path, _epoch(2, "dev", 1, [(1.0, float("nan"), 0.5), (2.0, 2.0, 0.5), (3.0, None, 0.1)], at=200_000) +
                 [(2, "dev", 1, None, None, None, None, 200_003, 3)], idle_seconds=60).collect()
    rows = {(r.run_id, r.stage, r.epoch): r for r in late}
    assert len(rows) == len(late) and not rows[1, "train", 0].complete and rows[1, "train", 0].n == 5
    assert rows[2, "dev", 1].n == 2 and rows[2, "dev", 1].pearson != rows[2, "dev", 1].pearson and not rows[2, "dev", 0].complete


def test_partitions_of_the_counts_follow_their_rows(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions are not put together
    before = spark.conf.get("spark.sql.shuffle.partitions")
    src, path = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    spark.range(2000).select(F.lit("a").alias("stage"), F.col("id").cast("double").alias("y"), (F.col("id") * 7 % 2000).cast("double").alias("y_hat")).write.parquet(src)
    stream = spark.readStream.schema("stage string, y double, y_hat double").parquet(src)
    got = monitors.running_rank_metrics(stream, spark, "stage", "y", "y_hat", "wide", path=path).collect()
    plain = correlations(spark.read.parquet(src), "y", "y_hat", ["stage"], digits=None).first()
    assert [(r.n, round(r.spearman, 9)) for r in got] == [(2000, round(plain.spearman, 9))]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{path}/ranks/runs/batch=0-level=0")) > 10
