"""Experiment run-log sources (A9-A13, A15) and their long form.

A log root holds one folder per run, ``version_<n>``, each with
``metrics.csv`` (one row per validation, any metric columns),
``results.json`` and ``hparams.yaml`` (any keys).  Each kind is read with one
globbed scan for all runs (not a loop over folders); the run id comes from
the file path.  Files are read by their own header, never by position.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import _largest_group, _null_safe_join, value_rank

# The bookkeeping columns of a metrics file.
EPOCH, STEP = "epoch", "step"
# Hyper-parameter keys with a typed column of their own.
TYPED_HPARAMS = {
    "accumulate_grad_batches": "INT", "batch_size": "INT", "data_augmentation_negative_samples": "BOOLEAN",
    "data_augmentation_translate_data": "BOOLEAN", "dev_dataset_name": "ARRAY<STRING>", "loss_function": "STRING",
    "lr": "DOUBLE", "max_train_epochs": "INT", "model_name": "STRING", "test_dataset_name": "ARRAY<STRING>",
    "train_dataset_name": "ARRAY<STRING>", "training_method": "STRING",
}
RUN_ID_PATTERN = r"version_(\d+)"


def _run_id(path="_metadata.file_path"):
    return F.regexp_extract(F.col(path), RUN_ID_PATTERN, 1).try_cast("int")


def read_metrics(spark: SparkSession, root: str, name: str = "metrics.csv") -> DataFrame:
    """All ``metrics.csv`` files (A9; ``name`` may be a pattern): one row per line with ``run_id`` (A12),
    ``epoch``, ``step``, ``values`` (a map from every other column of the
    file's header to its number; empty cells are absent, B12) and
    ``_corrupt_record`` (the line, when it does not fit its header or holds a
    cell that is no number; its values are null).

    Files are split freely: the header is the first line of a file's first
    block, joined to the file's lines by path.  Cells hold numbers, so a
    comma is always a separator.
    """
    lines = spark.read.text(os.path.join(root, "*", name)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    first = lines.where(F.col("block") == 0).groupBy("path").agg(F.min(F.struct("line", "value")).alias("h"))
    header = first.select(F.col("path").alias("_path"), F.split(F.trim("h.value"), r"\s*,\s*").alias("names"))
    head_line = first.select(F.col("path").alias("_path"), F.col("h.value").alias("head"))
    rows = lines.join(header, F.col("path") == F.col("_path")).drop("_path").join(head_line, F.col("path") == F.col("_path"))
    # A repeated header line (a file written by two processes) is no data.
    rows = rows.where((F.col("value") != F.col("head")) & (F.trim("value") != ""))
    cells = F.split("value", ",", -1)
    named = F.transform(F.arrays_zip(F.col("names"), cells.alias("cells")), lambda c: F.struct(
        c["names"].alias("name"), F.trim(c["cells"]).alias("text"), F.nullif(F.trim(c["cells"]), F.lit("")).try_cast("double").alias("number")))
    parsed = rows.select(_run_id("path").alias("run_id"), "value", (F.size("names") == F.size(cells)).alias("fits"), named.alias("cells"))
    bad = ~F.col("fits") | F.exists("cells", lambda c: (c["text"] != "") & c["number"].isNull())

    def cell(name: str):
        return F.get(F.filter("cells", lambda c: c["name"] == name), F.lit(0))["number"].cast("bigint")

    given = F.filter("cells", lambda c: ~c["name"].isin(EPOCH, STEP) & c["number"].isNotNull())
    ok = F.when(~bad, F.lit(True))
    return parsed.select(
        "run_id", F.when(ok, cell(EPOCH)).alias(EPOCH), F.when(ok, cell(STEP)).alias(STEP),
        F.when(ok, F.map_from_entries(F.transform(given, lambda c: F.struct(c["name"], c["number"])))).alias("values"),
        F.when(bad, F.col("value")).alias("_corrupt_record"),
    )


def read_results(spark: SparkSession, root: str, name: str = "results.json") -> DataFrame:
    """All ``results.json`` files (A10): (run_id, metric, value) for every
    number a file holds, whatever its name."""
    text = spark.read.text(os.path.join(root, "*", name), wholetext=True)
    pairs = F.from_json("value", "map<string,double>")
    return text.select(_run_id().alias("run_id"), F.explode(pairs).alias("metric", "value"))


def read_hparams(spark: SparkSession, root: str, name: str = "hparams.yaml") -> DataFrame:
    """All ``hparams.yaml`` files (A11): one row per run with ``options`` (every
    key, its value as JSON text), the typed columns of ``TYPED_HPARAMS`` and
    ``parse_error``.  Dataset names always become arrays.

    One small text per file is parsed per Arrow batch; the parser is a local
    function, so workers need no package of ours.
    """
    pattern = RUN_ID_PATTERN

    def parse(batches):
        import json
        import re

        import pandas as pd
        import yaml

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["value"]):
                run = re.search(pattern, path)
                options, error = {}, None
                try:
                    data = yaml.safe_load(text) or {}
                    options = {str(k): json.dumps(v, default=str) for k, v in data.items()}
                except (yaml.YAMLError, AttributeError) as exc:  # kept and reported, never lost
                    error = str(exc)
                rows.append((int(run[1]) if run else None, options, error))
            yield pd.DataFrame(rows, columns=["run_id", "options", "parse_error"])

    text = spark.read.text(os.path.join(root, "*", name), wholetext=True)
    text = text.select(F.col("_metadata.file_path").alias("path"), "value")
    raw = text.mapInPandas(parse, "run_id INT, options MAP<STRING,STRING>, parse_error STRING")
    return typed_hparams(raw)


def typed_hparams(raw: DataFrame) -> DataFrame:
    """(run_id, options, parse_error) with the typed columns of ``TYPED_HPARAMS``."""
    return raw.select("run_id", "options", *[option(k, t).alias(k) for k, t in TYPED_HPARAMS.items()], "parse_error")


def option(key: str, dtype: str):
    """One key of ``options`` as a typed column; a single name where a list
    is asked for becomes a list of one, other mismatches are null."""
    value = F.expr(f"get_json_object(concat('[', options['{key}'], ']'), '$[0]')")
    if dtype.upper() == "ARRAY<STRING>":
        raw = F.expr(f"options['{key}']")
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(value.isNotNull(), F.array(value))
    return value.try_cast(dtype)


def metrics_long(metrics: DataFrame, drop_eval_rows: int = 2, keep_partial: bool = False) -> DataFrame:
    """Long form ``(run_id, epoch, step, pos, metric, value)`` of the metric logs.

    The last ``drop_eval_rows`` rows of every file (the final dev and test
    evaluations, B11) are removed by position from the end, ordered by step,
    then epoch; both are only kept for order (B10), and empty cells disappear
    (B13).  A run with a corrupt line has no history, as in the reference;
    ``keep_partial`` keeps its good lines.  Positions come from the bucketed
    ordered index, so no run is held by one task."""
    ok = metrics.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if not keep_partial:
        broken = metrics.where(F.col("_corrupt_record").isNotNull()).select(F.col("run_id").alias("_broken")).distinct()
        ok = ok.join(broken, F.col("run_id").eqNullSafe(F.col("_broken")), "left_anti")
    # Rows equal in step and epoch are ordered by their content.
    tie = F.md5(F.to_json(F.array_sort(F.map_entries("values"))))
    keyed = ok.withColumn("_back", -F.col(STEP)).withColumn("_back2", -F.col(EPOCH)).withColumn("_tie", tie)
    # A run has at most one row per metric and line: its lines are counted once for both orders.
    most = _largest_group(ok, ["run_id"])
    ranked = value_rank(keyed, "_back", tie_cols=["_back2", "_tie"], group_cols=["run_id"], out="_from_end", largest=most)
    kept = ranked.where(F.col("_from_end") > drop_eval_rows)
    long = kept.select("run_id", EPOCH, STEP, "_tie", F.explode("values").alias("metric", "value"))
    out = value_rank(long, STEP, tie_cols=[EPOCH, "_tie"], group_cols=["run_id", "metric"], out="_p", largest=most)
    return out.select("run_id", EPOCH, STEP, (F.col("_p") - 1).alias("pos"), "metric", "value")


def read_report(metrics: DataFrame) -> DataFrame:
    """Per run: lines read, parsed and failed."""
    return metrics.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("_corrupt_record").isNull().cast("bigint")).alias("parsed_rows"),
        F.count("_corrupt_record").alias("bad_rows"),
    )


def run_histories(runs: DataFrame, long: DataFrame) -> DataFrame:
    """Every run of ``runs`` with its history, null where it has none."""
    return _null_safe_join(runs, long, ["run_id"], "left")


def write_metric_log(long: DataFrame, path: str, mode: str = "append") -> None:
    """Metric-log sink (A15): long rows appended to a parquet table.  Rows are
    sorted by run inside each file, so a filter on runs skips row groups;
    runs get no directories of their own."""
    long.sortWithinPartitions("run_id").write.mode(mode).parquet(path)
