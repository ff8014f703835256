"""Analysis of experiment run logs.

Logs are handled in long form ``(run_id, epoch, metric, value)``; wide
reports are a ``pivot`` with the metric names given, so there is no extra
pass to find them.  Series operators (best epoch, early stop) are running
maxima; a run may hold a third of all rows, so the running maxima are
computed per block of epochs with a prefix over block maxima.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import _cols, _null_safe_join, value_rank

# Report defaults of the run-log overlay, in the reference's order.
DEFAULT_HPARAMS = {
    "gpus": 1,
    "batch_size": 256,
    "accumulate_grad_batches": 16,
    "lr": 2e-05,
    "model_max_length": 512,
    "max_train_epochs": 20,
    "model_name": "dumitrescustefan/bert-base-romanian-cased-v1",
    "train_dataset_name": "ro-sts",
    "dev_dataset_name": "ro-sts",
    "test_dataset_name": "ro-sts",
    "data_augmentation_translate_data": False,
    "training_method": "simple-train",
}
# Option defaults of one experiment (B9), for `overlay`; they
# differ from the report defaults in the batch size and name no training method.
EXPERIMENT_DEFAULTS = {
    **{k: v for k, v in DEFAULT_HPARAMS.items() if k != "training_method"},
    "batch_size": 16,
}
# Metric prefixes of the logs.
METRIC_PREFIXES = ("dev", "test")
BLOCK = 4096  # epochs per block of the blocked running maximum


def overlay(df: DataFrame, defaults: dict) -> DataFrame:
    """Logged keys win over defaults, key by key (B8); a key absent from the
    frame is added with its default.  List-valued defaults of dataset names
    become one-element arrays when the column is an array (B16)."""
    out = df
    for k, v in defaults.items():
        if k in df.columns:
            dtype = dict(df.dtypes)[k]
            lit = F.array(F.lit(v)) if dtype.startswith("array") and not isinstance(v, (list, tuple)) else F.lit(v)
            out = out.withColumn(k, F.coalesce(F.col(k), lit.cast(dtype)))
        else:
            out = out.withColumn(k, F.lit(v))
    return out


def as_name_list(df: DataFrame, c: str) -> Column:
    """A dataset-name cell as ``array<string>``: ``'x'`` -> ``['x']`` (B16);
    arrays compare element by element, so mixed cells sort."""
    if dict(df.dtypes)[c].startswith("array"):
        return F.col(c)
    return F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))


def drop_tail(df: DataFrame, n_tail: int = 2, run_col: str = "run_id", epoch_col: str = "epoch") -> DataFrame:
    """Drop the last ``n_tail`` epochs of every run by position from the end
    (B11), whatever gaps the epoch numbers have; all rows of an epoch go."""
    epochs = df.select(run_col, epoch_col).distinct().withColumn("_back", -F.col(epoch_col))
    tail = value_rank(epochs, "_back", group_cols=[run_col], out="_from_end").where(F.col("_from_end") <= n_tail)
    t = tail.select(F.col(run_col).alias("_tr"), F.col(epoch_col).alias("_te"))
    return df.join(t, df[run_col].eqNullSafe(t["_tr"]) & df[epoch_col].eqNullSafe(t["_te"]), "left_anti")


def present_metrics(df: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Keep a metric of a run only if some value is present (B12, B13): in
    long form this is simply dropping nulls (and NaN, an empty cell)."""
    return df.where(F.col("value").isNotNull() & ~F.isnan("value"))


def split_name(metric: str | Column = "metric") -> tuple[Column, Column]:
    """``dev/pearson`` -> (``dev``, ``pearson``) (B15); no prefix -> nulls."""
    c = F.col(metric) if isinstance(metric, str) else metric
    pat = "^(" + "|".join(METRIC_PREFIXES) + ")[/_](.*)$"
    prefix = F.nullif(F.regexp_extract(c, pat, 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(c, pat, 2), F.lit(""))
    return prefix, suffix


def py_double(c: Column) -> Column:
    """A double as Python's ``repr`` prints it: shortest digits, plain notation
    from 1e-4 up to 1e16, otherwise ``2e-05`` form; ``nan``, ``inf``."""
    text = c.cast("double").cast("string")
    pattern = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, lead, frac = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    power = F.regexp_extract(text, pattern, 4).try_cast("int")
    tail = F.when(frac == "0", F.lit("")).otherwise(frac)
    digits = F.concat(lead, tail)
    whole = F.rpad(digits, power + 1, "0")
    plain = F.when(power >= 0, F.concat(
        F.substring(whole, F.lit(1), power + 1), F.lit("."),
        F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.length(digits))).otherwise(F.lit("0")),
    )).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits))
    size = F.abs(power).cast("string")
    scientific = F.concat(lead, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)), F.lit("e"),
                          F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size))
    return (
        F.when(F.isnan(c), F.lit("nan")).when(text == "Infinity", F.lit("inf")).when(text == "-Infinity", F.lit("-inf"))
        .when(power.isNull(), text).when((power >= 16) | (power < -4), F.concat(sign, scientific))
        .otherwise(F.concat(sign, plain))
    )


def py_text(c: Column, dtype: str) -> Column:
    """A value as Python's ``str()`` prints it; null as ``None``."""
    if dtype == "boolean":
        t = F.when(c.isNull(), F.lit(None)).when(c, F.lit("True")).otherwise(F.lit("False"))
    elif dtype.startswith("array"):
        t = F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    elif dtype in ("double", "float"):
        t = py_double(c)
    else:
        t = c.cast("string")
    return F.coalesce(t, F.lit("None"))


def label(df: DataFrame, keys: Sequence[str], sep: str = "/") -> Column:
    """Curve label: chosen hyper-parameters joined by ``/``."""
    types = dict(df.dtypes)
    return F.concat_ws(sep, *[py_text(F.col(k), types[k]) for k in keys])


def title(df: DataFrame, keys: Sequence[str]) -> Column:
    """Table title: ``k=v`` joined by ``, ``."""
    types = dict(df.dtypes)
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), py_text(F.col(k), types[k])) for k in keys])


def safe_name(c) -> Column:
    """File-name-safe text: ``/`` -> ``_``."""
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("/"), F.lit("_"))


def unpivot_metrics(df: DataFrame, id_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide result rows -> long (run_id, metric, value)."""
    return df.unpivot(list(id_cols), list(metrics), "metric", "value")


def arg_best(long: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per metric: run and value of the maximum and of the minimum.

    Ties go to the lowest run id (the reference keeps the first it sees).
    The reference reports the maximum for every metric, losses included;
    both ends are given here."""
    v = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    d = long.select("metric", F.col(run_col).alias("_run"), v.alias("_v")).where(F.col("_v").isNotNull())
    agg = d.groupBy("metric").agg(
        F.max(F.struct(F.col("_v"), (-F.col("_run")).alias("_nr"))).alias("_mx"),
        F.min(F.struct(F.col("_v"), F.col("_run"))).alias("_mn"),
    )
    return agg.select(
        "metric",
        (-F.col("_mx._nr")).alias("max_run"),
        F.col("_mx._v").alias("max_value"),
        F.col("_mn._run").alias("min_run"),
        F.col("_mn._v").alias("min_value"),
    )


def select_runs(df: DataFrame, run_ids: Sequence[int], run_col: str = "run_id") -> DataFrame:
    """Keep the given runs and their list position ``sel_pos`` (C7): a join
    with a ``posexplode``d literal array (bounded by the list)."""
    sel = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(int(r)) for r in run_ids])).alias("sel_pos", "_sel_run")
    )
    return df.join(F.broadcast(sel), df[run_col] == sel["_sel_run"], "inner").drop("_sel_run")


def metric_names(metrics_long: DataFrame) -> list[str]:
    """All metric names found in the data, sorted (D16).  One row per name,
    which is the width of the report that is built from them."""
    return [r[0] for r in metrics_long.select("metric").distinct().orderBy("metric").collect()]


def report(
    metrics_long: DataFrame,
    hparams: DataFrame,
    hp_keys: Sequence[str],
    names: Sequence[str] | None = None,
    run_col: str = "run_id",
) -> DataFrame:
    """One row per run of ``hparams``: chosen hyper-parameters, then the sorted
    metrics, missing -> null (D19).  ``names`` are the pivot values; without
    them they are found in the data (D16).  Only the metrics of those runs
    are pivoted."""
    runs = hparams.select(run_col).distinct()
    own = metrics_long.join(runs, run_col, "left_semi")
    wide = own.groupBy(run_col).pivot("metric", sorted(names) if names is not None else metric_names(own)).agg(F.first("value"))
    return hparams.select(run_col, *hp_keys).join(wide, run_col, "left")


def overlay_options(df: DataFrame, defaults: dict, options: str = "options") -> DataFrame:
    """Any logged key over the defaults (B8, B9): ``options`` becomes a map of
    every default and every logged key, values as JSON text."""
    import json

    base = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, json.dumps(v))])
    logged = F.coalesce(F.col(options), F.create_map().cast("map<string,string>"))
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(logged, k))
    return df.withColumn(options, F.map_concat(rest, logged))


def best_epoch(series: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch", value: str = "value") -> DataFrame:
    """Per run: epoch of the highest value, earliest on ties (E6); NaN is
    treated as missing.  Also the run's length and its last epoch."""
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    return series.groupBy(run_col).agg(
        F.max(F.struct(v.alias("_v"), (-F.col(epoch_col)).alias("_ne"))).alias("_b"),
        F.count(F.lit(1)).alias("n_epochs"),
        F.max(epoch_col).alias("last_epoch"),
    ).select(
        run_col,
        "n_epochs",
        "last_epoch",
        F.when(F.col("_b._v").isNotNull(), -F.col("_b._ne")).alias("best_epoch"),
        F.col("_b._v").alias("best_value"),
    )


def blocked_running_max(
    df: DataFrame,
    value: str,
    group_cols: Iterable[str],
    idx: str,
    inclusive: bool = True,
    out: str = "_runmax",
    block: int = BLOCK,
) -> DataFrame:
    """Running maximum of ``value`` along the dense index ``idx`` per group.

    Rows are cut into blocks of ``block`` consecutive indices; block maxima
    get a prefix maximum (a few rows per group), which is joined back and
    combined with the running maximum inside the block.  A group with a
    third of all rows is thus spread over many tasks.
    """
    g = _cols(group_cols)
    d = df.withColumn("_blk", F.floor(F.col(idx) / F.lit(block)))
    blocks = d.groupBy(*g, "_blk").agg(F.max(value).alias("_bmax"))
    wb = Window.partitionBy(*g).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_bprev", F.max("_bmax").over(wb)).drop("_bmax")
    d = _null_safe_join(d, blocks, [*g, "_blk"])
    wi = Window.partitionBy(*g, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return d.withColumn(out, F.greatest(F.col("_bprev"), F.max(value).over(wi))).drop("_blk", "_bprev")


def early_stop(
    series: DataFrame,
    patience: int = 4,
    max_epochs: int | None = None,
    run_col: str = "run_id",
    epoch_col: str = "epoch",
    value: str = "value",
) -> DataFrame:
    """Per run: the epoch at which training stops (E7), mode max.

    An epoch improves when its value is strictly above every earlier value
    (the first present value always does); NaN or null never improves.  The
    stop epoch is the first whose distance to the last improving epoch
    reaches ``patience``.  ``max_epochs`` caps the run: a stop at or after
    the cap is reported as null with ``capped`` true.  Epochs must be dense
    from 0 per run.
    """
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    d = series.select(run_col, epoch_col, v.alias("_v"))
    d = blocked_running_max(d, "_v", [run_col], epoch_col, inclusive=False, out="_prev")
    improve = F.col("_v").isNotNull() & (F.col("_prev").isNull() | (F.col("_v") > F.col("_prev")))
    d = d.withColumn("_imp_epoch", F.when(improve, F.col(epoch_col)))
    d = blocked_running_max(d, "_imp_epoch", [run_col], epoch_col, inclusive=True, out="_last_imp")
    streak = F.col(epoch_col) - F.coalesce(F.col("_last_imp"), F.lit(-1))
    stop = F.when(streak >= patience, F.col(epoch_col))
    if max_epochs is not None:
        stop = F.when(F.col(epoch_col) < max_epochs, stop)
    out = d.groupBy(run_col).agg(F.min(stop).alias("stop_epoch"), F.max(epoch_col).alias("_last"))
    capped = F.col("stop_epoch").isNull() & F.lit(max_epochs is not None) & (F.col("_last") + 1 >= F.lit(max_epochs or 0))
    return out.select(run_col, "stop_epoch", capped.alias("capped"))
