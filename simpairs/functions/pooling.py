"""Token pooling and the linear readout.

Pooling is an aggregation over token vectors: one vector sum per sentence,
divided by the padded length of the sentence's batch (padding
counted, as the reference's plain mean does) or by its own length
(``masked``).  The readout is a matrix product per Arrow batch in a pandas
UDF, with the weight matrix shipped once in the closure.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean_pool_tokens(df: DataFrame, sent_col: str, batch_col: str, vec_col: str, masked: bool = False) -> DataFrame:
    """One row per sentence with ``pooled`` (array<double>) and ``n_tokens``.

    Each input row is one token vector.  Vectors are summed whole and combined
    before the shuffle, so a long sentence is spread over many tasks and
    leaves one vector per task."""
    sums = df.groupBy(sent_col, batch_col).agg(
        Summarizer.sum(array_to_vector(F.col(vec_col))).alias("_s"), F.count(F.lit(1)).alias("n_tokens"))
    per_batch = sums.groupBy(batch_col).agg(F.max("n_tokens").alias("_pad_len"))
    j = sums.join(per_batch, batch_col)
    denom = F.col("n_tokens") if masked else F.col("_pad_len")
    return j.select(sent_col, batch_col, F.transform(vector_to_array("_s"), lambda x: x / denom).alias("pooled"), "n_tokens")


def readout_weights(n_in: int, n_out: int) -> np.ndarray:
    """A fixed readout matrix by rule: ``w[j, i] = ((7 i + 13 j) % 11 - 5) / 10``."""
    i = np.arange(n_in)[None, :]
    j = np.arange(n_out)[:, None]
    return (((7 * i + 13 * j) % 11) - 5) / 10.0


def linear_readout(col, weights: np.ndarray) -> Column:
    """``weights @ x`` for every vector, as an Arrow-batched pandas UDF."""
    w = np.asarray(weights, dtype=np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _readout(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(s.to_numpy()).astype(np.float64)
        y = x @ w.T
        return pd.Series(list(y))

    return _readout(F.col(col) if isinstance(col, str) else col)
