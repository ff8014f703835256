"""Supervised scoring, re-aimed from neural training.

The reference fine-tunes a transformer; here the same protocol (fit on train,
choose on dev, report dev and test with D3-D5) runs on pair features.  Every
configuration is one feature and one ridge weight; its closed form needs only
sums over the training part, so all configurations are fitted by one
aggregation and scored by one pass, whatever their number.  ``fit_regressor``
is the same step with a distributed MLlib model over all features.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import angle_score, cosine, norm, pairwise_distance
from .metrics import correlations

# The norm ratio is no default: vectors of length one make it rounding noise.
FEATURES = ["f_cos", "f_dist", "f_angle"]


def pair_features(df: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Per pair: cosine (F1), distance (F4), angle score (F5), norm ratio."""
    return (
        df.withColumn("f_cos", cosine(u, v))
        .withColumn("f_dist", pairwise_distance(u, v))
        .withColumn("f_angle", angle_score(u, v, tau=1.0))
        .withColumn("f_ratio", F.try_divide(F.least(norm(u), norm(v)), F.greatest(norm(u), norm(v))))
        .fillna(0.0, subset=["f_ratio", "f_angle"])
    )


def configurations(features: Sequence[str], reg_params: Sequence[float]) -> list[tuple[int, str, float]]:
    """(position, feature, ridge weight) in product order, the weight fastest."""
    return [(i * len(reg_params) + j, f, float(r)) for i, f in enumerate(features) for j, r in enumerate(reg_params)]


def _per_config(df: DataFrame, configs: Sequence[tuple[int, str, float]], keep: Sequence[str]) -> DataFrame:
    """Every row once per configuration, with the configuration's feature as ``x``."""
    rows = F.array(*[F.struct(F.lit(p).alias("config_pos"), F.lit(f).alias("feature"), F.lit(r).alias("reg_param"), F.col(f).alias("x"))
                     for p, f, r in configs])
    return df.select(*keep, F.explode(rows).alias("_c")).select(*keep, "_c.*")


def ridge_lines(train: DataFrame, configs: Sequence[tuple[int, str, float]], label: str = "score") -> DataFrame:
    """(config_pos, slope, intercept) of every configuration by one aggregation:
    ``slope = cov(x, y) / (var(x) + weight)``; a constant feature without
    weight has slope 0."""
    y = F.col(label).cast("double")
    sums = _per_config(train, configs, [label]).groupBy("config_pos", "reg_param").agg(
        F.covar_pop("x", y).alias("_c"), F.var_pop("x").alias("_v"), F.avg("x").alias("_mx"), F.avg(y).alias("_my"))
    slope = F.coalesce(F.try_divide(F.col("_c"), F.col("_v") + F.col("reg_param")), F.lit(0.0))
    return sums.select("config_pos", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"))


def _scores(pred: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    return correlations(pred, label, "prediction", groups, spearman=True, digits=None,
                        extra_aggs=[F.avg(F.pow(F.col("prediction") - F.col(label), 2)).alias("mse")])


def grid_fit(parts: DataFrame, reg_params: Sequence[float], features: Sequence[str] = FEATURES, label: str = "score",
             choose: str = "pearson") -> DataFrame:
    """Run every configuration (I4): one row each with its dev and test scores
    and ``chosen`` for the one with the best dev score, ties to the first.

    The configurations are a short literal list; training rows are read once
    for all of them.
    """
    configs = configurations(features, reg_params)
    lines = ridge_lines(parts.where(F.col("part") == "train"), configs, label)
    held = _per_config(parts.where(F.col("part").isin("dev", "test")), configs, ["part", label])
    pred = held.join(lines, "config_pos").withColumn("prediction", F.col("slope") * F.col("x") + F.col("intercept"))
    rows = _scores(pred, ["config_pos", "feature", "reg_param", "part"], label)
    side = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{part}_{c}")
    wide = rows.groupBy("config_pos", "feature", "reg_param").agg(
        *[side(p, c) for p in ("dev", "test") for c in ("n", "pearson", "spearman", "mse")])
    best = wide.agg(F.max_by(F.struct("config_pos"), F.struct(F.coalesce(f"dev_{choose}", F.lit(float("-inf"))), -F.col("config_pos")))).scalar()
    return wide.withColumn("chosen", F.col("config_pos") == best["config_pos"])


def train_and_report(parts: DataFrame, reg_params: Sequence[float] = (0.0,), features: Sequence[str] = FEATURES,
                     label: str = "score") -> DataFrame:
    """Fit on train, choose on dev, report the chosen one's dev and test rows."""
    best = grid_fit(parts, reg_params, features, label).where("chosen")
    side = lambda part: F.struct(F.lit(part).alias("part"), *[F.col(f"{part}_{c}").alias(c) for c in ("n", "pearson", "spearman", "mse")])
    return best.select("feature", "reg_param", F.explode(F.array(side("dev"), side("test"))).alias("_r")).select(
        "_r.part", "feature", "reg_param", "_r.n", "_r.pearson", "_r.spearman", "_r.mse")


def staged_fit(noisy: DataFrame, parts: DataFrame, first: str = "f_cos", second: str = "f_dist", label: str = "score") -> DataFrame:
    """Stage 1 fits ``first`` on the large noisy set; stage 2 fits what stage 1
    leaves over on the clean train part with ``second``, a feature that stage 1
    has not seen (I2).  Reports dev and test."""
    line1 = ridge_lines(noisy, [(0, first, 0.0)], label).select(F.struct("slope", "intercept").alias("l")).scalar()
    d = parts.withColumn("_base", line1["slope"] * F.col(first) + line1["intercept"])
    rest = d.where(F.col("part") == "train").withColumn("_rest", F.col(label) - F.col("_base"))
    line2 = ridge_lines(rest, [(0, second, 0.0)], "_rest").select(F.struct("slope", "intercept").alias("l")).scalar()
    pred = d.where(F.col("part").isin("dev", "test")).withColumn(
        "prediction", F.col("_base") + line2["slope"] * F.col(second) + line2["intercept"])
    return _scores(pred, ["part"], label)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str = "score", reg: float = 0.0):
    """An MLlib linear regressor on all features (squared error) as a function
    from rows to rows with ``prediction``."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_features")
    lr = LinearRegression(featuresCol="_features", labelCol=label, predictionCol="prediction", regParam=reg, maxIter=50)
    model = lr.fit(asm.transform(train))
    return lambda df: model.transform(asm.transform(df)).drop("_features")
