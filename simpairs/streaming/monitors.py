"""Streaming forms of the two incremental states of the reference.

* J1: running evaluation metrics while predictions arrive: a streaming
  aggregation whose Pearson is the same expression as the batch one (metrics
  that close with their epoch are in ``epochs``), and Spearman after every
  micro-batch from the count table of ``levels``.
* J2: an early-stopping monitor over an epoch stream.  The state is one small
  row per run (best value, last improving epoch, last epoch, stopped).  A
  micro-batch is folded into it by the same blocked running maxima as the
  batch operator, so a run with very many rows is spread over tasks.

State tables are written under the micro-batch's id, so a replayed micro-batch
writes the same rows again.  Given a path, state and progress stay there, and
a new object on that path goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import pearson
from ..operators.rank import _null_safe_join
from ..operators.runlog import blocked_running_max
from ..session import child_names, delete_folder, scratch_dir
from .levels import RankLevels


def run_available(stream: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Feed everything that is there to ``update``, micro-batch by micro-batch."""
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(update)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_metrics(stream: DataFrame, group_cols: Sequence[str], y: str, y_hat: str, loss: str) -> DataFrame:
    """Streaming aggregation: n, Pearson, mean loss per group (J1).  The
    losses arrive one row per batch, so the batch mean is a plain ``avg``."""
    return stream.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), pearson(y, y_hat).alias("pearson"), F.avg(loss).alias("avg_loss")
    )


def run_complete_to_table(agg: DataFrame, spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """Run a complete-mode aggregation with ``availableNow`` and return the
    final result.  Each micro-batch writes the whole result (one row per group)
    under its id, so the one before stands until it is there; older ones are
    removed.  A stream without rows gives an empty result."""
    path = path or scratch_dir(spark, name)

    def update(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={batch_id}")
        for old in _batches(spark, f"{path}/result"):
            if old < batch_id - 1:
                delete_folder(spark, f"{path}/result/batch={old}")

    run_available(agg, f"{path}/checkpoint", update, "complete")
    done = _batches(spark, f"{path}/result")
    if not done:
        return spark.createDataFrame([], agg.schema)
    return spark.read.schema(agg.schema).parquet(f"{path}/result/batch={done[-1]}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in child_names(spark, path))


def running_rank_metrics(stream: DataFrame, spark: SparkSession, group_col: str, y: str, y_hat: str, name: str,
                         path: str | None = None, **levels) -> DataFrame:
    """(batch, group, n, spearman): for every micro-batch, the groups it touched
    with Spearman over everything seen up to then (J1)."""
    path = path or scratch_dir(spark, name)
    state = RankLevels(spark, f"{path}/ranks", [group_col], y, y_hat, **levels)
    run_available(stream, f"{path}/checkpoint", state.update)
    return state.running(stream)


def stream_rank_metrics(stream: DataFrame, spark: SparkSession, group_col: str, y: str, y_hat: str, name: str) -> DataFrame:
    """(group, n, spearman) after the last micro-batch (J1): per group the last
    row of ``running_rank_metrics``."""
    found = running_rank_metrics(stream, spark, group_col, y, y_hat, name)
    last = found.groupBy(group_col).agg(F.max_by(F.struct("n", "spearman"), "batch").alias("_last"))
    return last.select(group_col, "_last.n", "_last.spearman")


STATE_SCHEMA = "run_id long, best double, last_imp long, last_epoch long, stop_epoch long"


def fold_patience(state: DataFrame, rows: DataFrame, patience: int) -> DataFrame:
    """The state after ``rows`` (run_id, epoch, value) came in (J2): mode max,
    strict improvement; null and NaN never improve.

    ``stop_epoch`` is the first epoch at which ``patience`` epochs have passed
    without improvement, and stays once set.  Epochs of a run must arrive in
    order across calls; a row at or before a run's last epoch raises, since it
    would silently change the answer.  Inside one call any order will do.
    """
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    d = _null_safe_join(rows.select("run_id", "epoch", value.alias("_v")), state, ["run_id"], "left")
    late = F.raise_error(F.format_string("run %s: epoch %d arrived after epoch %d", F.col("run_id").cast("string"), F.col("epoch"), F.col("last_epoch")))
    d = d.withColumn("epoch", F.when(F.col("epoch") <= F.col("last_epoch"), late.cast("bigint")).otherwise(F.col("epoch")))
    d = blocked_running_max(d, "_v", ["run_id"], "epoch", inclusive=False, out="_before")
    before = F.greatest("_before", "best")
    d = d.withColumn("_imp", F.when(F.col("_v").isNotNull() & (before.isNull() | (F.col("_v") > before)), F.col("epoch")))
    d = blocked_running_max(d, "_imp", ["run_id"], "epoch", inclusive=True, out="_last")
    since = F.coalesce(F.greatest("_last", "last_imp"), F.lit(-1))
    stop = F.when(F.col("epoch") - since >= patience, F.col("epoch"))
    new = d.groupBy("run_id").agg(
        F.greatest(F.max("_v"), F.first("best")).alias("best"),
        F.greatest(F.max("_imp"), F.first("last_imp")).alias("last_imp"), F.max("epoch").alias("last_epoch"),
        F.coalesce(F.first("stop_epoch"), F.min(stop)).alias("stop_epoch"))
    return state.join(new.select(F.col("run_id").alias("_r")), F.col("run_id").eqNullSafe(F.col("_r")), "left_anti").unionByName(new)


class PatienceMonitor:
    """Stop events of an epoch stream, with its state in shared tables.

    With a ``path`` the monitor can be made again there: it starts from the
    last state, and the stream from the last micro-batch that was finished."""

    def __init__(self, spark: SparkSession, name: str, patience: int = 4, path: str | None = None) -> None:
        self.spark, self.patience = spark, patience
        path = path or scratch_dir(spark, name)
        self.root, self.checkpoint = f"{path}/state", f"{path}/checkpoint"
        found = _batches(spark, self.root)
        self.version = found[-1] if found else -1
        if not found:
            self._write(spark.createDataFrame([], STATE_SCHEMA), -1)

    def _write(self, state: DataFrame, version: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.root}/version={version}")
        self.version = version
        for old in _batches(self.spark, self.root):
            if old < version - 1:
                delete_folder(self.spark, f"{self.root}/version={old}")

    def state(self) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.root}/version={self.version}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        # A replayed micro-batch starts from the version before it.
        self.version = min(self.version, batch_id - 1)
        self._write(fold_patience(self.state(), batch, self.patience), batch_id)

    def feed(self, stream: DataFrame) -> None:
        """Take in everything that the source has now."""
        run_available(stream, self.checkpoint, self.update)

    def stops(self) -> DataFrame:
        return self.state().where("stop_epoch is not null").select("run_id", "stop_epoch")


def replay_in_order(df: DataFrame, path: str, order_col: str, chunks: int, partitions: int, take: Callable[[], None]) -> None:
    """Write ``df`` to ``path`` in ``chunks`` steps of rising ``order_col`` and
    call ``take`` after each, so a file source gets them in that order however
    coarse its file times are.  Chunks cut the span of the order evenly."""
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    if lo is None:
        df.write.mode("append").parquet(path)
        take()
        return
    step = F.expr(f"(({order_col} - {lo}) * {chunks}) div ({hi} - {lo} + 1)")
    for c in range(chunks):
        df.where(step == c).repartition(partitions).write.mode("append").parquet(path)
        take()
