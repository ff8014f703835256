"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that the risk needs.  With
class prior p and logistic loss, the unbiased risk of a linear score is
``p * R(positives as +) + [R(unlabelled as -) - p * R(positives as -)]``.
The bracket estimates the loss on hidden negatives and cannot truly be below
zero; whenever it is, the step goes the other way (non-negative correction).
The prior is estimated from the labelled rows' share of positives.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..session import ship_package
from .common import crc_fold, staged, text_slices

#: Bounds of the fit: rows read of each kind (fewer rows: all).
SAMPLE_POSITIVE = 20_000
SAMPLE_UNLABELLED = 20_000
THRESHOLD = 0.7
SLICE_CHARS = 2_000_000

# Character classes of the style features.
UPPER_CASE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
MARKS = b"#$%&*@^~=<>+_{}[]\\"
SPACES = b" \t\n\r\x0b\x0c"
FEATURES = (
    "log_chars", "log_words", "upper", "digits", "marks", "bang", "pipe", "stops", "commas", "colons",
    "spaces", "wide", "distinct", "repeated", "word_length", "marked_words", "upper_words", "lines", "repeated_lines",
    "long_words",
)


def style_features(text: str | None) -> list[float]:
    """Numbers in about [0, 1] (logs: about [0, 12]) that describe how a text is written."""
    text = text or ""
    raw = text.encode()
    n = max(1, len(raw))

    def share(letters: bytes) -> float:
        return (len(raw) - len(raw.translate(None, letters))) / n

    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    plain = sum(map(str.isalpha, words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), share(UPPER_CASE), share(DIGITS), share(MARKS), share(b"!"),
        share(b"|"), share(b"."), share(b","), share(b":;/"), share(SPACES), (len(raw) - len(text)) / n,
        len(set(words)) / k, sum(map(eq, words, words[1:])) / k, min(1.0, len(raw) / k / 40), 1 - plain / k,
        sum(map(str.isupper, words)) / k, min(1.0, 40 * len(lines) / n), 1 - len(set(lines)) / m,
        sum(len(w) > 20 for w in words) / k,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good text for feature rows."""
        z = _expand((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, z * z - 1])


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05,
           decay: float = 1e-4) -> QualityModel:
    """Minimise the non-negative risk by full-batch Adam steps from zero.

    Without positives or unlabelled rows every score is the prior.
    """
    n = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        w = np.zeros(2 * n + 1)
        w[0] = np.log(prior / (1 - prior))
        return QualityModel(np.zeros(n), np.ones(n), w, prior)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = _expand((positive - mean) / scale), _expand((unlabelled - mean) / scale)
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
        as_good = p.T @ (sp - 1) / len(p)          # gradient of mean log(1 + exp(-z)) over positives
        hidden = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_bad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        grad = (prior * as_good + as_bad if hidden >= 0 else -as_bad) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return QualityModel(mean, scale, w, prior)


def _feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        out = []
        for batch in range(0, len(column), 1000):
            out += [style_features(t) for t in column.slice(batch, 1000).to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return features(text)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", folds: int = 4, held_fold: int = 2) -> QualityModel:
    """Fit on bounded samples drawn by a hash of the id; held-out rows are in none.

    Trusted positives are ids all of whose labels are 1; null labels and null
    ids are ignored.  Unlabelled rows are documents without any label row.
    """
    ship_package(docs.sparkSession)
    use = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = staged(use.where(crc_fold(id_col, folds) != held_fold).groupBy(F.col(id_col).alias("id"))
                    .agg(F.min(label_col).alias("good")), "quality-labels")
    n, good = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("good") == 1).cast("long")), F.lit(0))).first()
    prior = min(0.98, max(0.02, good / n)) if n else 0.5
    ids = docs.where(F.col(id_col).isNotNull() & (crc_fold(id_col, folds) != held_fold)).select(F.col(id_col).alias("id")).distinct()
    free = staged(ids.join(use.select(F.col(id_col).alias("id")), "id", "left_anti"), "quality-unlabelled")
    n_free = free.count()

    def drawn(frame: DataFrame, have: int, most: int) -> DataFrame:
        return frame.where(hash_unit(F.lit("quality"), F.col("id")) < (most / have if have > most else 1.0))

    wanted = drawn(marked.where("good = 1"), good, SAMPLE_POSITIVE).select("id", F.lit(True).alias("good")).unionByName(
        drawn(free, n_free, SAMPLE_UNLABELLED).select("id", F.lit(False).alias("good")))
    # At most about SAMPLE_POSITIVE + SAMPLE_UNLABELLED ids: a proven bound.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id")
    got = rows.select("good", "id", _feature_column(F.col("text")).alias("x")).collect()
    got.sort(key=lambda r: (r["id"], r["x"]))  # the same sums on every run
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    is_good = np.array([r["good"] for r in got], bool)
    return fit_pu(x[is_good], x[~is_good], prior)


def quality_column(docs: DataFrame, model: QualityModel, text: Column) -> Column:
    """The score (0 to 1) of a text column; null counts as empty."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = []
        texts = column.to_pylist()
        for start, stop in text_slices(texts, SLICE_CHARS):
            out.append(model.score(np.array([style_features(t) for t in texts[start:stop]])))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Only the text is scored.  Null and empty texts get the score of empty
    features, repeated rows score alike, null ids count as fold 0, an empty
    table gives an empty result and other columns are not read.
    """
    model = fit_quality(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col), (crc_fold(id_col, 4) == 2).alias("held_out"),
                      quality_column(docs, model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
