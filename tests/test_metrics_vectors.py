"""Hand-written edge cases of the metrics and vector functions."""

import math

import numpy as np
from pyspark.sql import functions as F

from simpairs.functions.vectors import angle_score, cosine, pairwise_distance
from simpairs.operators.metrics import correlations, mean_batch_loss


def test_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    r = correlations(df, "y", "p").first()
    assert r.pearson is None and r.spearman is None


def test_single_row_gives_null(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "y double, p double")
    r = correlations(df, "y", "p").first()
    assert r.n == 1 and r.pearson is None


def test_spearman_matches_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 5, 300).astype(float)
    p = y + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = correlations(df, "y", "p", digits=None).first()

    def avg_rank(x):
        order = np.argsort(x, kind="stable")
        ranks = np.empty(len(x))
        ranks[order] = np.arange(1, len(x) + 1)
        for v in np.unique(x):
            m = x == v
            ranks[m] = ranks[m].mean()
        return ranks

    ref = np.corrcoef(avg_rank(y), avg_rank(p))[0, 1]
    assert abs(r.spearman - ref) < 1e-9
    assert abs(r.pearson - np.corrcoef(y, p)[0, 1]) < 1e-9


def test_zero_vector_cosine_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "u array<double>, v array<double>")
    assert df.select(cosine("u", "v").alias("c")).first().c == 0.0


def test_angle_score_matches_complex_division(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=8), rng.normal(size=8)
    df = spark.createDataFrame([(u.tolist(), v.tolist())], "u array<double>, v array<double>")
    got = df.select(angle_score("u", "v", tau=20.0).alias("s")).first().s
    quotient = (u[:4] + 1j * u[4:]) * np.conj(v[:4] + 1j * v[4:]) / (np.linalg.norm(u) * np.linalg.norm(v))
    assert abs(got - 20.0 * abs(quotient.real.sum() + quotient.imag.sum())) < 1e-9
    mean = df.select(angle_score("u", "v", tau=20.0, pooling="mean").alias("s")).first().s
    assert abs(mean - 20.0 * abs(np.concatenate([quotient.real, quotient.imag]).mean())) < 1e-9


def test_pairwise_distance_adds_eps(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0])], "u array<double>, v array<double>")
    got = df.select(pairwise_distance("u", "v").alias("d")).first().d
    assert abs(got - math.sqrt(2) * 1e-6) < 1e-15


def test_short_last_batch_weighs_the_same(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0), (2, 4.0)], "b int, loss double")
    r = mean_batch_loss(df, "loss", "b").first()
    assert r.avg_loss == 2.0 and r.n_batches == 3


def test_epoch_metrics_groups_all_stages_at_once(spark):
    from simpairs.operators.metrics import epoch_metrics

    rows = [(0, s, 0, b, float(i), float(i) * 2 + (1 if s == "dev" else -1) * (i % 3), float(i % 2))
            for s in ("dev", "test") for b in range(3) for i in range(b * 4, b * 4 + 4)]
    df = spark.createDataFrame(rows, "run_id long, stage string, epoch long, batch_id long, y double, p double, loss double")
    got = {r.stage: r for r in epoch_metrics(df, "y", "p", "loss", "batch_id").collect()}
    assert set(got) == {"dev", "test"}
    assert got["dev"].n == 12 and got["dev"].avg_loss == 0.5 and got["dev"].n_batches == 3
    assert -1.0 <= got["test"].spearman <= 1.0


def test_nan_makes_the_correlations_nan(spark):
    nan = float("nan")
    rows = [("a", 1.0, 2.0), ("a", 2.0, nan), ("a", 3.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 3.0), (None, 1.0, 1.0), (None, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r.g: r for r in correlations(df, "y", "p", ["g"]).collect()}
    assert math.isnan(got["a"].pearson) and math.isnan(got["a"].spearman)
    assert (got["b"].spearman, got[None].spearman, got[None].n) == (1.0, -1.0, 2)


def test_rounding_keeps_nan_infinity_and_large_values(spark):
    from simpairs.functions.numeric import rnd

    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (float("nan"), inf, -inf, 1e13, -2.5e15, 0.1234565, None)], "x double")
    got = [r.r for r in df.select(rnd("x").alias("r")).collect()]
    assert math.isnan(got[0]) and got[1:5] == [inf, -inf, 1e13, -2.5e15] and got[6] is None and abs(got[5] - 0.123457) < 1e-12


def test_epoch_metrics_keep_null_groups(spark):
    from simpairs.operators.metrics import epoch_metrics

    rows = [(s, b, float(i), float(i * i), 1.0) for s in ("dev", None) for b in range(2) for i in range(3)]
    df = spark.createDataFrame(rows, "stage string, batch_id long, y double, p double, loss double")
    assert {r.stage for r in epoch_metrics(df, "y", "p", "loss", "batch_id", ["stage"]).collect()} == {"dev", None}


def test_pairwise_distance_other_norms(spark):
    df = spark.createDataFrame([([1.0, 5.0], [4.0, 1.0])], "u array<double>, v array<double>")
    for p in (1.0, 3.0):
        got = df.select(pairwise_distance("u", "v", p).alias("d")).first().d
        assert abs(got - np.linalg.norm(np.array([-3.0, 4.0]) + 1e-6, p)) < 1e-9


def test_ranks_read_the_combined_rows_once(spark, capsys):
    from simpairs.operators.metrics import rank_correlation

    # Rows with a null side count nowhere, and weights of any integer type add up.
    rows = [("a", 1.0, 2.0, 1), ("a", 1.0, 2.0, 2), ("a", 2.0, 5.0, 1), ("a", 3.0, 4.0, 1), ("a", None, 9.0, 7), (None, 1.0, 1.0, 1), (None, 2.0, 3.0, 1)]
    df = spark.createDataFrame(rows, "k string, y double, p double, weight int")
    out = rank_correlation(df, "y", "p", ["k"])
    out.explain()
    assert "rank-pairs" in capsys.readouterr().out
    got = {r.k: r.spearman for r in out.collect()}
    import numpy as np

    y, p = [2, 2, 2, 4, 5], [2, 2, 2, 5, 4]
    assert abs(got["a"] - np.corrcoef(y, p)[0, 1]) < 1e-12 and abs(got[None] - 1.0) < 1e-12
