"""Ridge regression over several pair features.

The normal equations need the training rows only through their moments: one
aggregation gives n, the means, and the covariances of all features with each
other and with the label (the Gram matrix, centred).  It is as wide as the
square of the number of features, whatever the number of rows; from it every
ridge weight is solved at once.  A second stage starts from the first one's
weights: it shrinks towards them instead of towards zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import correlations
from .text import tokens

#: Features of a pair of vectors and of its two texts.
PAIR_FEATURES = ["f_cos", "f_dist", "f_angle", "f_overlap", "f_length"]


def text_features(df: DataFrame, text1: str = "text1", text2: str = "text2") -> DataFrame:
    """Adds ``f_overlap``, the share of the two texts' distinct tokens that both
    have, and ``f_length``, the smaller number of tokens over the larger.

    Whole texts are compared row by row: each side's tokens become one set,
    and the sets meet in the row, so nothing is exploded or joined.  Two texts
    without tokens (null, empty, blank) have overlap and length ratio 1, one of
    them against a text with tokens 0.
    """
    d = df.withColumn("_t1", tokens(text1)).withColumn("_t2", tokens(text2))
    d = d.withColumn("_s1", F.array_distinct("_t1")).withColumn("_s2", F.array_distinct("_t2"))
    both = F.size(F.array_intersect("_s1", "_s2"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))
    n1, n2 = F.size("_t1"), F.size("_t2")
    return d.withColumn("f_overlap", share(both, F.size("_s1") + F.size("_s2") - both)) \
        .withColumn("f_length", share(F.least(n1, n2), F.greatest(n1, n2))).drop("_t1", "_t2", "_s1", "_s2")


@dataclass
class Moments:
    """What a fit knows of its rows; mergeable by the usual rules."""

    n: int
    means: np.ndarray
    label_mean: float
    gram: np.ndarray
    cross: np.ndarray


@dataclass
class Ridge:
    """A linear model over named features."""

    features: list[str]
    reg_param: float
    weights: np.ndarray
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for name, w in zip(self.features, self.weights):
            out = out + F.lit(float(w)) * F.col(name)
        return out


def moments(df: DataFrame, features: Sequence[str], label: str = "score") -> Moments:
    """Moments of the rows that have a label and all features, in one pass; a
    frame of (features + 2)^2 / 2 numbers reaches the driver."""
    k = len(features)
    known = df.where(F.col(label).isNotNull())
    for f in features:
        known = known.where(F.col(f).isNotNull())
    x, y = [F.col(f).cast("double") for f in features], F.col(label).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = known.agg(F.count(F.lit(1)), F.avg(y), *[F.avg(c) for c in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs],
                    *[F.covar_pop(c, y) for c in x]).first()
    n, values = row[0], [0.0 if v is None else float(v) for v in row[1:]]
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, values[1 + k:]):
        gram[i, j] = gram[j, i] = v
    return Moments(n, np.array(values[1:1 + k]), values[0], gram, np.array(values[1 + k + len(pairs):]))


def solve(m: Moments, features: Sequence[str], reg_params: Sequence[float], prior: Ridge | None = None) -> list[Ridge]:
    """The minimiser of mean squared error + reg * |w - prior|^2 for every
    ``reg``.  Equations that do not determine the weights (a constant feature,
    no ridge) take the solution of least norm."""
    start = np.zeros(len(features)) if prior is None else np.array([dict(zip(prior.features, prior.weights)).get(f, 0.0) for f in features])
    out = []
    for reg in reg_params:
        a, b = m.gram + reg * np.eye(len(features)), m.cross + reg * start
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        out.append(Ridge(list(features), float(reg), w, float(m.label_mean - w @ m.means)))
    return out


def score_models(rows: DataFrame, models: Sequence[Ridge], groups: Sequence[str], label: str = "score") -> DataFrame:
    """n, Pearson, Spearman and MSE per (model, group): all models in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.lit(m.reg_param).alias("reg_param"), m.column().alias("prediction"))
                               for i, m in enumerate(models)]))
    pred = rows.select(*groups, label, each.alias("_m")).select(*groups, label, "_m.*")
    mse = F.avg(F.pow(F.col("prediction") - F.col(label), 2)).alias("mse")
    return correlations(pred, label, "prediction", ["model", "reg_param", *groups], spearman=True, digits=None, extra_aggs=[mse])


def fit_features(parts: DataFrame, features: Sequence[str] = PAIR_FEATURES, reg_params: Sequence[float] = (0.001, 0.01, 0.1), label: str = "score",
                 prior: Ridge | None = None, choose: str = "pearson") -> tuple[DataFrame, list[Ridge]]:
    """Fit on ``part`` train, choose the ridge weight on dev, report dev and test.

    One row per (ridge weight, part) with its scores and ``chosen`` for the
    weight whose dev score is best (ties: the first); and the models.
    """
    models = solve(moments(parts.where(F.col("part") == "train"), features, label), features, reg_params, prior)
    rows = score_models(parts.where(F.col("part").isin("dev", "test")), models, ["part"], label)
    dev = F.when((F.col("part") == "dev") & ~F.isnan(choose), F.col(choose))
    best = rows.agg(F.max_by("model", F.struct(F.coalesce(dev, F.lit(float("-inf"))), -F.col("model")))).scalar()
    return rows.withColumn("chosen", F.col("model") == best), models


def fit_stages(noisy: DataFrame, parts: DataFrame, features: Sequence[str] = PAIR_FEATURES, first_reg: float = 0.01,
               reg_params: Sequence[float] = (0.001, 0.01, 0.1), label: str = "score") -> tuple[DataFrame, list[Ridge]]:
    """Stage 1 on the large noisy rows; stage 2 on the clean train part with
    stage 1's weights as its prior (I2).  Reported as by ``fit_features``."""
    first = solve(moments(noisy, features, label), features, [first_reg])[0]
    return fit_features(parts, features, reg_params, label, first)
