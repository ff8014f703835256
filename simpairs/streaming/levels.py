"""Spearman after every micro-batch from a log-structured count table.

Ranks need counts of everything seen.  They are kept as runs: tables of
distinct (group, y, y_hat) with their number of rows, a value being one of a
grid's buckets when a resolution is given.  A micro-batch writes its own
combined run to level 0; as soon as a level holds ``fan`` runs they are merged
into one run of the next level, equal values added up.  So at most ``fan - 1``
runs per level and a logarithmic number of levels are read, and what was
counted before is never read again as rows.  With a resolution a run never
exceeds the number of cells, and the work of a micro-batch stays level however
long the stream runs; without one it follows the number of distinct values.

Which runs are live after a micro-batch is itself a small table, written last
under the batch id.  A replayed or resumed micro-batch starts from the table
before it and writes the same runs again.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import rank_correlation
from ..operators.rank import _null_safe_join, spread_join
from ..session import child_names, delete_folder, shuffles_for

LIVE = "name string, level int, rows long"


def bucketed(value: str, width: float | None) -> Column:
    """The value, or the lower end of its bucket of ``width``; NaN and
    infinities stay."""
    v = F.col(value).cast("double")
    if width is None:
        return v
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.floor(v / F.lit(float(width))) * F.lit(float(width)))


class RankLevels:
    """Running (n, spearman) per group, with its state under ``path``."""

    def __init__(self, spark: SparkSession, path: str, group_cols: Sequence[str], y: str, y_hat: str, fan: int = 4,
                 widths: tuple[float | None, float | None] = (None, None)) -> None:
        if fan < 2:
            raise ValueError("a level holds at least two runs before it is merged")
        self.spark, self.path, self.groups, self.fan = spark, path.rstrip("/"), list(group_cols), fan
        self.y, self.y_hat, self.widths = y, y_hat, widths

    def _versions(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in child_names(self.spark, f"{self.path}/live") if n.startswith("version="))

    def live(self, version: int | None = None) -> list:
        """(name, level, rows) of the runs that count up to a batch id: a few per level."""
        known = [v for v in self._versions() if version is None or v <= version]
        if not known:
            return []
        return self.spark.read.schema(LIVE).parquet(f"{self.path}/live/version={known[-1]}").collect()

    def _counts(self, rows: DataFrame) -> DataFrame:
        known = rows.where(F.col(self.y).isNotNull() & F.col(self.y_hat).isNotNull())
        cells = known.select(*self.groups, bucketed(self.y, self.widths[0]).alias("y"), bucketed(self.y_hat, self.widths[1]).alias("y_hat"))
        return cells.groupBy(*self.groups, "y", "y_hat").agg(F.count(F.lit(1)).alias("weight"))

    def _write(self, counts: DataFrame, batch_id: int, level: int) -> tuple[str, int, int]:
        name = f"batch={batch_id}-level={level}"
        counts.write.mode("overwrite").parquet(f"{self.path}/runs/{name}")
        return name, level, self.spark.read.parquet(f"{self.path}/runs/{name}").count()

    def _read(self, runs: list, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/runs/{r[0]}" for r in runs])

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Count a micro-batch and rank the groups that it touched."""
        counts = self._counts(batch)
        schema = counts.schema
        runs = [tuple(r) for r in self.live(batch_id - 1)]
        with shuffles_for(batch.sparkSession, batch.count()):
            own = self._write(counts, batch_id, 0)
        runs.append(own)
        level = 0
        while sum(r[1] == level for r in runs) >= self.fan:
            full = [r for r in runs if r[1] == level]
            merged = self._read(full, schema).groupBy(*self.groups, "y", "y_hat").agg(F.sum("weight").alias("weight"))
            level += 1
            with shuffles_for(self.spark, sum(r[2] for r in full)):
                runs = [r for r in runs if r not in full] + [self._write(merged, batch_id, level)]
        with shuffles_for(self.spark, sum(r[2] for r in runs)):
            self._rank(runs, own, schema, batch_id)
        self.spark.createDataFrame(runs, LIVE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/version={batch_id}")
        self._forget(batch_id)

    def _rank(self, runs: list, own: tuple, schema, batch_id: int) -> None:
        """Write the ranks of the groups of the micro-batch's own run over all runs."""
        seen = self._read(runs, schema)
        if self.groups:
            touched = self._read([own], schema).select(*self.groups).distinct()
            seen = spread_join(seen, touched, self.groups, ["y", "y_hat"])
        n = seen.groupBy(*self.groups).agg(F.sum("weight").alias("n"))
        ranked = rank_correlation(seen, "y", "y_hat", self.groups)
        out = _null_safe_join(n, ranked, self.groups) if self.groups else n.withColumn("spearman", ranked.select("spearman").scalar()).where("n > 0")
        out.write.mode("overwrite").parquet(f"{self.path}/running/batch={batch_id}")

    def _forget(self, batch_id: int) -> None:
        """Remove runs and tables that neither this batch nor its replay reads."""
        needed = {r[0] for v in (batch_id - 1, batch_id) for r in self.live(v)}
        for name in child_names(self.spark, f"{self.path}/runs"):
            if name not in needed and int(name.split("-")[0].split("=")[1]) < batch_id:
                delete_folder(self.spark, f"{self.path}/runs/{name}")
        for version in self._versions():
            if version < batch_id - 1:
                delete_folder(self.spark, f"{self.path}/live/version={version}")

    def running(self, like: DataFrame) -> DataFrame:
        """(batch, groups.., n, spearman): one row per micro-batch and group that
        it touched; ``like`` gives the types of the groups."""
        kinds = "".join(f"{g} {like.schema[g].dataType.simpleString()}, " for g in self.groups)
        found = f"{self.path}/running"
        if not child_names(self.spark, found):
            return self.spark.createDataFrame([], f"batch int, {kinds}n long, spearman double")
        return self.spark.read.schema(f"{kinds}n long, spearman double").option("basePath", found).parquet(f"{found}/*") \
            .select("batch", *self.groups, "n", "spearman")
