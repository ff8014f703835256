"""Metrics per (run, stage, epoch) while predictions arrive.

The stream carries one row per prediction and one end mark per epoch.  An
epoch's state is one row of moments and a list of batch losses, kept in the
state store under its key.  It is emitted once and removed:

* when its end mark is there and as many predictions as the mark announces,
  in whatever order they came (``complete`` is true);
* or when nothing has come for ``idle`` and the watermark has passed that
  time (a run that was killed; ``complete`` is false).

Predictions are combined per (epoch, batch) inside the tasks that read them,
before anything is dealt out by key: an epoch that holds a third of all rows
sends its tasks a few numbers per batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

KEYS = ["run_id", "stage", "epoch"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOMENTS = ["n", "my", "mp", "yy", "pp", "yp"]


def merge_moments(a: tuple, b: tuple) -> tuple:
    """(n, mean y, mean p, sums of squares and products around the means) of
    both parts together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if not a[0] else a
    dy, dp, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return (n, a[1] + dy * b[0] / n, a[2] + dp * b[0] / n, a[3] + b[3] + dy * dy * w, a[4] + b[4] + dp * dp * w, a[5] + b[5] + dy * dp * w)


def moments_pearson(m: tuple) -> float | None:
    """Pearson; none when either side is constant, as in the batch operator."""
    spread = math.sqrt(m[3]) * math.sqrt(m[4]) if m[3] >= 0 and m[4] >= 0 else m[3] * m[4]
    return None if spread == 0 else m[5] / spread


def combine_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per frame one row per (run, stage, epoch, batch): moments, loss sum and
    count, latest time and the announced number of predictions."""
    for rows in frames:
        if rows.empty:
            continue
        rows = rows.reset_index(drop=True)
        by = rows.groupby([*KEYS, "batch_id"], dropna=False, sort=False)
        group = by.ngroup()
        known = rows["y"].notna() & rows["y_hat"].notna() | rows["nan"]
        y, p = rows["y"].where(known), rows["y_hat"].where(known)
        y[rows["nan"]] = math.nan
        n = known.groupby(group).sum()
        my, mp = (v.where(known, 0.0).groupby(group).sum() / n.where(n > 0, 1) for v in (y, p))
        dy, dp = (y - group.map(my)).where(known, 0.0), (p - group.map(mp)).where(known, 0.0)
        out = rows[[*KEYS, "batch_id"]].groupby(group).head(1).set_index(group[~group.duplicated()].to_numpy())
        total = lambda v: v.groupby(group).sum(min_count=0)
        bad = rows["nan"].groupby(group).any()
        spoil = lambda v: v.where(~bad, math.nan)
        out["n"], out["my"], out["mp"] = n, spoil(my), spoil(mp)
        out["yy"], out["pp"], out["yp"] = spoil(total(dy * dy)), spoil(total(dp * dp)), spoil(total(dy * dp))
        out["loss_sum"], out["loss_n"] = total(rows["loss"].fillna(0.0)), rows["loss"].notna().groupby(group).sum()
        out["rows"] = rows["announced"].isna().groupby(group).sum()
        out["announced"] = rows["announced"].groupby(group).max()
        out["at"] = rows["at"].groupby(group).max()
        yield out


COMBINED = "n long, my double, mp double, yy double, pp double, yp double, loss_sum double, loss_n long, rows long, announced long, at timestamp"


class EpochMetrics(StatefulProcessor):
    """Keyed state of one open epoch."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, my double, mp double, yy double, pp double, yp double, seen long, announced long, timer long")
        self.losses = handle.getListState("losses", "batch_id long, loss_sum double, loss_n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.total.get() if self.total.exists() else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, None, None)
        moments, (seen, announced, timer) = tuple(held[:6]), held[6:]
        last, losses = 0, []
        for part in rows:
            for r in part.itertuples(index=False):
                moments = merge_moments(moments, tuple(getattr(r, c) for c in MOMENTS))
                seen += int(r.rows)
                if not pd.isna(r.announced):
                    announced = int(r.announced)
                if r.loss_n:
                    losses.append((None if pd.isna(r.batch_id) else int(r.batch_id), float(r.loss_sum), int(r.loss_n)))
                last = max(last, int(r.at.timestamp() * 1000))
        if losses:
            self.losses.appendList(losses)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if announced is not None and seen >= announced:
            yield self._close(key, moments, True)
            return
        timer = max(last + self.idle_ms, timer or 0, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.total.update((int(moments[0]), *map(float, moments[1:]), seen, announced, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.total.exists():
            yield self._close(key, tuple(self.total.get()[:6]), False)

    def _close(self, key: Any, moments: tuple, complete: bool) -> pd.DataFrame:
        batches: dict = {}
        for batch, total, n in self.losses.get():
            a, b = batches.get(batch, (0.0, 0))
            batches[batch] = (a + total, b + n)
        loss = sum(a / b for a, b in batches.values()) / len(batches) if batches else None
        self.total.clear()
        self.losses.clear()
        pearson = moments_pearson(moments) if moments[0] else None
        return pd.DataFrame({
            **{c: [k] for c, k in zip(KEYS, key)}, "n": [int(moments[0])], "n_batches": [len(batches)],
            "pearson": pd.array([pearson], "object"), "avg_loss": pd.array([loss], "object"),
            # pandas has one word for null and NaN: the flag tells them apart.
            "nan": [pearson is not None and math.isnan(pearson)], "complete": [complete]})

    def close(self) -> None:
        pass


def epoch_metrics_stream(steps: DataFrame, delay: str = "10 minutes", idle_seconds: int = 3600) -> DataFrame:
    """Streaming (run_id, stage, epoch, n, n_batches, pearson, avg_loss, complete), one row per epoch.

    ``steps`` holds run_id, stage, epoch, batch_id, y, y_hat, loss, ``at`` (event
    time) and ``announced``: null on predictions, the number of the epoch's
    predictions on its end mark.  n and Pearson cover predictions with y and
    y_hat; the loss is the mean over batches of their mean loss.  A NaN makes
    Pearson NaN; null keys are keys.  Rows later than ``delay`` behind the
    newest are dropped by the watermark.  Predictions beyond the announced
    number open the epoch again and end as an incomplete row.
    """
    ship_package(steps.sparkSession)
    nan = F.isnan("y") | F.isnan("y_hat")
    d = steps.select(*KEYS, F.col("batch_id").cast("long").alias("batch_id"), F.col("y").cast("double").alias("y"),
                     F.col("y_hat").cast("double").alias("y_hat"), F.coalesce(nan, F.lit(False)).alias("nan"),
                     F.col("loss").cast("double").alias("loss"), F.col("announced").cast("long").alias("announced"), "at")
    kinds = ", ".join(f"{k} {d.schema[k].dataType.simpleString()}" for k in KEYS)
    combined = d.mapInPandas(combine_batches, f"{kinds}, batch_id long, {COMBINED}").withWatermark("at", delay)
    closed = combined.groupBy(*KEYS).transformWithStateInPandas(
        EpochMetrics(idle_seconds * 1000), f"{kinds}, n long, n_batches long, pearson double, avg_loss double, nan boolean, complete boolean",
        "append", "EventTime")
    return closed.withColumn("pearson", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("pearson"))).drop("nan")


def run_epoch_metrics(steps: DataFrame, path: str, **options) -> DataFrame:
    """Take in what the source has now; closed epochs are appended to
    ``path``/epochs.  State and progress live in ``path``/checkpoint, so a later
    call on the same path, by whatever driver, goes on where the last ended."""
    spark = steps.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        out = epoch_metrics_stream(steps, **options)
        query = out.writeStream.format("parquet").option("path", f"{path}/epochs").option("checkpointLocation", f"{path}/checkpoint") \
            .outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.schema(out.schema).parquet(f"{path}/epochs")
