"""Patience, best epoch, grid order, list cells, catalog errors, run-log files
and the texts of labels."""

import os

import pytest
from pyspark.sql import functions as F

from simpairs.operators.grid import expand_grid
from simpairs.operators.runlog import best_epoch, early_stop


def _series(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "run_id long, epoch long, value double")


def test_patience_equal_is_no_improvement(spark):
    s = _series(spark, [5, 4, 4, 4, 4])
    assert early_stop(s, 4).first().stop_epoch == 4
    assert best_epoch(s).first().best_epoch == 0


def test_patience_reset(spark):
    s = _series(spark, [5, 4, 4, 4, 6, 1, 1, 1, 1])
    assert early_stop(s, 4).first().stop_epoch == 8
    assert best_epoch(s).first().best_epoch == 4


def test_running_max_across_blocks(spark):
    from simpairs.operators.runlog import blocked_running_max

    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    s = _series(spark, vals)
    got = blocked_running_max(s, "value", ["run_id"], "epoch", inclusive=True, out="m", block=4).orderBy("epoch").collect()
    exp, cur = [], float("-inf")
    for v in vals:
        cur = max(cur, v)
        exp.append(cur)
    assert [r.m for r in got] == exp


def test_grid_order(spark):
    one = spark.range(1)
    g = expand_grid(one, {"a": [1, 2], "b": ["x", "y"]}).orderBy("grid_pos").collect()
    assert [(r.a, r.b) for r in g] == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]


def test_list_cells_sort(spark):
    from simpairs.operators.runlog import as_name_list

    df = spark.createDataFrame([("ro-sts",), ("biblical_01",)], "n string")
    arrs = df.select(as_name_list(df, "n").alias("n")).union(spark.createDataFrame([(["ro-sts", "biblical_01"],)], "n array<string>"))
    assert [r.n for r in arrs.orderBy("n").collect()] == [["biblical_01"], ["ro-sts"], ["ro-sts", "biblical_01"]]


def test_unknown_names_raise(spark):
    from simpairs.plans.queries import stand_in_catalog
    from simpairs.functions.vectors import angle_score

    cat = stand_in_catalog("/nonexistent")
    with pytest.raises(ValueError):
        cat.load(spark, "zzz")
    with pytest.raises(ValueError):
        cat.get_data(spark, "paraphrase-ro", "test")
    with pytest.raises(ValueError):
        angle_score("u", "v", pooling="max")


def _write(root, run, name, text):
    folder = os.path.join(root, f"version_{run}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


@pytest.fixture()
def log_root(tmp_dir):
    """Headers in any order and with any names, sparse epochs, an empty cell,
    a broken file, a run without a history, options of any key and type."""
    root = os.path.join(tmp_dir, "logs")
    _write(root, 0, "metrics.csv", "dev/avg_loss,dev/pearson,epoch,step\n0.5,0.1,0,10\n0.4,,5,20\n0.3,0.3,10,30\n0.2,0.2,15,40\n")
    _write(root, 1, "metrics.csv", "step,epoch,dev/pearson,dev/avg_loss,val/accuracy_epoch\n1,0,0.7,0.9,1\n2,1,0.8,0.8,0.5\n3,2,0.9,0.7,0\n")
    _write(root, 2, "metrics.csv", "epoch,step,dev/pearson\n0,1,0.5\n1,2,oops\n2,3,0.6\n3,4,0.7\n")
    _write(root, 3, "metrics.csv", "epoch,step,dev/pearson\n0,1,0.5,7\n")
    for run in range(5):
        _write(root, run, "results.json", '{\n "dev_pearson": %s,\n "extra": 1\n}' % (0.1 * run))
    _write(root, 0, "hparams.yaml", "lr: 2.0e-05\ngpus: 2\ntest_dataset_name: ro-sts\nnew_key: [1, x]\n")
    _write(root, 1, "hparams.yaml", "train_dataset_name:\n- ro-sts\n- biblical_01\nbatch_size: 64\ndata_augmentation_translate_data: true\n")
    _write(root, 2, "hparams.yaml", "lr: [1\n" + "x" * 500)
    return root


def test_metrics_are_read_by_header(spark, log_root):
    from simpairs.sources.runlogs import metrics_long, read_metrics, read_report, run_histories

    metrics = read_metrics(spark, log_root)
    got = {(r.run_id, r.epoch): r["values"] for r in metrics.where("_corrupt_record is null").collect()}
    assert got[0, 0] == {"dev/avg_loss": 0.5, "dev/pearson": 0.1} and got[0, 5] == {"dev/avg_loss": 0.4}
    assert got[1, 2] == {"dev/pearson": 0.9, "dev/avg_loss": 0.7, "val/accuracy_epoch": 0.0}
    rep = {r.run_id: (r.rows, r.parsed_rows, r.bad_rows) for r in read_report(metrics).collect()}
    assert rep == {0: (4, 4, 0), 1: (3, 3, 0), 2: (4, 3, 1), 3: (1, 0, 1)}
    long = metrics_long(metrics)
    rows = sorted((r.run_id, r.metric, r.pos, r.epoch, r.value) for r in long.collect())
    assert rows == [
        (0, "dev/avg_loss", 0, 0, 0.5), (0, "dev/avg_loss", 1, 5, 0.4), (0, "dev/pearson", 0, 0, 0.1),
        (1, "dev/avg_loss", 0, 0, 0.9), (1, "dev/pearson", 0, 0, 0.7), (1, "val/accuracy_epoch", 0, 0, 1.0)]
    assert metrics_long(metrics, keep_partial=True).where("run_id = 2").count() == 1
    runs = spark.range(5).select(F.col("id").cast("int").alias("run_id"))
    every = run_histories(runs, long)
    assert {r.run_id for r in every.where("metric is null").collect()} == {2, 3, 4}


def test_epochs_and_steps_of_any_size_keep_their_order(spark):
    from simpairs.sources.runlogs import metrics_long

    rows = [(0, e, s, {"m": float(i)}, None) for i, (s, e) in enumerate([(1, 2**21), (2, 0), (2**40, 1), (2**40 + 1, 0), (2**50, 3), (2**50, 4)])]
    df = spark.createDataFrame(rows, "run_id int, epoch long, step long, values map<string,double>, _corrupt_record string")
    assert [r.value for r in metrics_long(df, 0).orderBy("pos").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_results_and_options_keep_every_key(spark, log_root):
    from simpairs.operators.runlog import DEFAULT_HPARAMS, metric_names, overlay_options, report
    from simpairs.sources.runlogs import option, read_hparams, read_results

    res = read_results(spark, log_root)
    assert metric_names(res) == ["dev_pearson", "extra"] and res.count() == 10
    hp = read_hparams(spark, log_root)
    got = {r.run_id: r for r in hp.collect()}
    assert got[0].lr == 2e-05 and got[0].options["new_key"] == '[1, "x"]' and got[0].test_dataset_name == ["ro-sts"]
    assert got[1].train_dataset_name == ["ro-sts", "biblical_01"] and got[1].batch_size == 64 and got[1].data_augmentation_translate_data
    assert len(got[2].parse_error) > 200 and got[2].options == {}
    over = {r.run_id: r.options for r in overlay_options(hp, DEFAULT_HPARAMS).collect()}
    assert over[0]["gpus"] == "2" and over[1]["gpus"] == "1" and over[0]["new_key"] == '[1, "x"]'
    typed = hp.select("run_id", option("gpus", "int").alias("gpus"), option("lr", "int").alias("bad")).orderBy("run_id").first()
    assert (typed.gpus, typed.bad) == (2, None)
    wide = {r.run_id: r for r in report(res, hp, ["lr"]).collect()}
    assert set(wide) == {0, 1, 2} and wide[1].extra == 1.0


def test_tail_is_dropped_by_position(spark):
    from simpairs.operators.runlog import drop_tail

    df = spark.createDataFrame([(0, e, m) for e in (0, 5, 10, 15) for m in "ab"] + [(None, 1, "a"), (None, 9, "a"), (None, 11, "a")],
                               "run_id long, epoch long, metric string")
    got = sorted((str(r.run_id), r.epoch) for r in drop_tail(df, 2).collect())
    assert got == [("0", 0), ("0", 0), ("0", 5), ("0", 5), ("None", 1)]


def test_doubles_print_as_python_prints_them(spark):
    from simpairs.operators.runlog import py_text

    values = [2e-05, 1e-4, 5e-4, 0.001, 0.1, 1.0, -2.5, 123456.75, 1e7, 12345678.5, -3.25e15, 1e16, 1.5e300, 1e-300, 0.0,
              float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = [r.t for r in df.orderBy("i").select(py_text(F.col("x"), "double").alias("t")).collect()]
    assert got == [str(x) for x in values]


def test_best_epoch_of_a_run_without_values_is_null(spark):
    s = spark.createDataFrame([(0, 0, float("nan")), (0, 1, None)], "run_id long, epoch long, value double")
    assert best_epoch(s).first().best_epoch is None


def test_experiment_defaults_and_extra_keys(spark):
    from simpairs.operators.grid import effective_batch_size
    from simpairs.operators.runlog import EXPERIMENT_DEFAULTS, overlay

    logged = spark.createDataFrame([(64, "MSE"), (None, None)], "batch_size int, loss_function string")
    rows = overlay(logged, EXPERIMENT_DEFAULTS).withColumn("eff", effective_batch_size("batch_size", "accumulate_grad_batches")).collect()
    assert [(r.eff, r.loss_function, r.lr) for r in rows] == [(1024, "MSE", 2e-05), (256, None, 2e-05)]
