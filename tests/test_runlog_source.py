"""The run-log source: ranges, pushed filters, growing files, commits and aborts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from simpairs.sources import runlog_source as rs
from simpairs.sources.runlogs import read_metrics
from tests.test_runlog import log_root  # noqa: F401


def _metrics(df):
    return sorted(((r.run_id, r.epoch, r.step, tuple(sorted((r["values"] or {}).items())), r._corrupt_record) for r in df.collect()), key=repr)


def test_reads_what_the_text_reader_reads(spark, log_root):  # noqa: F811
    rs.register(spark)
    assert _metrics(rs.load_runs(spark, log_root, "metrics")) == _metrics(read_metrics(spark, log_root))
    for size in (1, 7, 40):  # a range may begin anywhere in a line
        df = spark.read.format("runlog").option("splitBytes", size).load(log_root)
        assert _metrics(df) == _metrics(read_metrics(spark, log_root))
    assert rs.load_runs(spark, log_root, "results").where("metric = 'extra'").count() == 5
    hp = {r.run_id: r for r in rs.load_runs(spark, log_root, "hparams").collect()}
    assert hp[0].options["new_key"] == '[1, "x"]' and len(hp[2].parse_error) > 200 and hp[2].options == {}
    assert rs.load_runs(spark, os.path.join(log_root, "none"), "metrics").count() == 0


def test_conditions_on_runs_choose_files(spark, log_root):  # noqa: F811
    os.remove(os.path.join(log_root, "version_3", "metrics.csv"))
    os.symlink(os.path.join(log_root, "gone"), os.path.join(log_root, "version_3", "metrics.csv"))  # opening it would fail
    df = rs.load_runs(spark, log_root, "metrics")
    assert df.where("run_id = 0").count() == 4 and df.where("run_id in (0, 1)").count() == 7
    assert df.where("run_id < 2 and epoch >= 1").count() == 5
    reader = rs.RunLogReader({"path": log_root})
    from pyspark.sql.datasource import EqualTo, LessThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("run_id",), 1), LessThan(("epoch",), 9)])] == [LessThan]
    assert [r[1] for p in reader.partitions() for r in p.ranges] == [1]


def test_large_files_are_cut_and_small_ones_packed():
    files = [("a", 1, 0, 100), ("b", 2, 0, 5), ("c", 3, 0, 5)]
    parts = [p.ranges for p in rs.dealt(files, 40, False)]
    assert [r for p in parts for r in p if r[0] == "a"] == [("a", 1, 0, 40), ("a", 1, 40, 80), ("a", 1, 80, 100)]
    assert len(rs.dealt([("x", i, 0, 10) for i in range(10_000)], 32 << 20, False)) < 40
    assert len(rs.dealt(files, 40, True)) == 3


ROWS = "run_id long, epoch long, metric string, value double"


def test_a_replayed_write_adds_no_row(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    one = spark.createDataFrame([(1, 0, "dev/pearson", 0.8), (9, 0, "dev/pearson", None)], ROWS)
    two = spark.createDataFrame([(5, 1, "dev/pearson", 0.7)], ROWS)
    for rows, name in ((one, "a"), (two, "b"), (one, "a"), (two, "b")):
        rs.append_log(rows, path, name)
    got = rs.load_runs(spark, path, "log")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 0, "dev/pearson", 0.8), (5, 1, "dev/pearson", 0.7), (9, 0, "dev/pearson", None)]
    entries = rs.committed(*rs.open_store(path))
    assert len(os.listdir(os.path.join(path, "files"))) == len(entries) == 3
    assert got.where("run_id = 5").count() == 1 and got.where("run_id > 5").count() == 1
    reader = rs.RunLogReader({"path": path, "kind": "log"})
    from pyspark.sql.datasource import EqualTo

    assert [type(f) for f in reader.pushFilters([EqualTo(("run_id",), 5)])] == [EqualTo] and sum(len(p.ranges) for p in reader.partitions()) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    bad = spark.range(20).select(F.col("id").alias("run_id"), F.col("id").alias("epoch"), F.lit("m").alias("metric"),
                                 F.when(F.col("id") == 13, F.raise_error(F.lit("boom")).cast("double")).otherwise(1.0).alias("value"))
    with pytest.raises(Exception, match="boom"):
        rs.append_log(bad.repartition(4), path, "x")
    assert rs.load_runs(spark, path, "log").count() == 0
    rs.append_log(bad.where("run_id < 5"), path, "x")
    assert rs.load_runs(spark, path, "log").count() == 5


def test_growing_files_are_streamed_by_whole_lines(spark, tmp_dir):
    root, log, ckpt = (os.path.join(tmp_dir, x) for x in ("runs", "log", "ckpt"))
    rs.register(spark)

    def write(run, text):
        os.makedirs(os.path.join(root, f"version_{run}"), exist_ok=True)
        with open(os.path.join(root, f"version_{run}", "metrics.csv"), "a") as f:
            f.write(text)

    def take():
        lines = spark.readStream.format("runlog").load(root)
        long = lines.where("_corrupt_record is null").select(F.col("run_id").cast("long").alias("run_id"), "epoch", F.explode("values").alias("metric", "value"))
        q = long.writeStream.format("runlog").option("kind", "log").option("path", log).option("checkpointLocation", ckpt).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.run_id, r.epoch, r.metric, r.value) for r in rs.load_runs(spark, log, "log").collect())

    write(0, "epoch,step,m\n0,1,0.5\n1,2,0.")
    assert take() == [(0, 0, "m", 0.5)]
    write(0, "75\n")
    write(1, "m,epoch,step\n9.0,4,5\n")
    want = [(0, 0, "m", 0.5), (0, 1, "m", 0.75), (1, 4, "m", 9.0)]
    assert take() == want and take() == want
    assert len(json.dumps(rs.committed(*rs.open_store(log)))) > 10
