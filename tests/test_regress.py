"""Ridge over several features equals numpy; text features equal their definition."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from simpairs.operators.regress import Ridge, fit_features, fit_stages, moments, solve, text_features

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def _rows(spark, n=400, noise=0.1, seed=3, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [10.0, 0.0, shift]
    y = x @ [0.5, -0.2, 3.0] + 1.0 + noise * rng.normal(size=n)
    part = ["train" if i % 10 < 7 else "dev" if i % 10 < 8 else "test" for i in range(n)]
    df = spark.createDataFrame([(p, *map(float, r), float(v)) for p, r, v in zip(part, x, y)], "part string, a double, b double, c double, score double")
    return df, x, y, np.array(part)


def _ridge(x, y, reg, start):
    z, t = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(z.T @ z / len(x) + reg * np.eye(x.shape[1]), z.T @ t / len(x) + reg * start)
    return w, y.mean() - w @ x.mean(axis=0)


def test_all_ridge_weights_equal_numpy(spark):
    df, x, y, part = _rows(spark)
    train = part == "train"
    m = moments(df.where("part = 'train'"), ["a", "b", "c"])
    prior = Ridge(["a", "c"], 0.0, np.array([2.0, -1.0]), 0.0)
    for p, start in ((None, np.zeros(3)), (prior, np.array([2.0, 0.0, -1.0]))):
        for model in solve(m, ["a", "b", "c"], [0.0, 0.01, 1.0, 100.0], p):
            w, b = _ridge(x[train], y[train], model.reg_param, start)
            assert np.allclose(model.weights, w, atol=1e-9) and abs(model.intercept - b) < 1e-8


def test_the_best_on_dev_is_chosen_and_reported(spark):
    df, x, y, part = _rows(spark)
    rows, models = fit_features(df, ["a", "b", "c"], [1000.0, 0.001, 0.1])
    got = {(r.reg_param, r.part): r for r in rows.collect()}
    assert len(got) == 6
    for model in models:
        for p in ("dev", "test"):
            pred = x[part == p] @ model.weights + model.intercept
            assert abs(got[model.reg_param, p].pearson - np.corrcoef(pred, y[part == p])[0, 1]) < 1e-9
            assert abs(got[model.reg_param, p].mse - np.mean((pred - y[part == p]) ** 2)) < 1e-9
    best = max(models, key=lambda m: got[m.reg_param, "dev"].pearson).reg_param
    assert {k[0] for k, r in got.items() if r.chosen} == {best} and best != 1000.0


def test_second_stage_keeps_what_the_first_has_learned(spark):
    noisy, *_ = _rows(spark, 3000, 0.5, 5)
    few, x, y, part = _rows(spark, 20, 0.5, 7)
    _, alone = fit_features(few, ["a", "b", "c"], [1.0])
    _, staged = fit_stages(noisy, few, ["a", "b", "c"], 0.0, [1.0])
    true = np.array([0.5, -0.2, 3.0])
    assert np.abs(staged[0].weights - true).max() < np.abs(alone[0].weights - true).max() / 2


def test_odd_inputs(spark):
    df = spark.createDataFrame([("train", 1.0, 2.0, 0.5), ("train", 1.0, None, 0.1), ("train", 1.0, 4.0, 1.5), ("train", 1.0, 1.0, None), ("dev", 1.0, 3.0, 1.0)],
                               "part string, k double, a double, score double")
    rows, models = fit_features(df, ["k", "a"], [0.0])  # k is constant: the equations leave its weight open
    assert np.allclose(models[0].weights, [0.0, 0.5]) and abs(models[0].intercept + 0.5) < 1e-12
    assert [(r.part, r.n, r.pearson, round(r.mse, 9)) for r in rows.collect()] == [("dev", 1, None, 0.0)]
    assert moments(df.where("part = 'none'"), ["k", "a"]).n == 0


def test_text_features_equal_their_definition(spark):
    texts = ["the cat sat", "The cat, the cat!", "", None, "  \n", "x " * 30000, "ünï 日本 x", "a_b a b"]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    got = {r.i: (r.f_overlap, r.f_length) for r in text_features(spark.createDataFrame(rows, "i int, text1 string, text2 string").withColumn("_x", F.lit(1))).collect()}
    for i, a, b in rows:
        s, t = TOKEN.findall(a or ""), TOKEN.findall(b or "")
        union = set(s) | set(t)
        assert got[i][0] == pytest.approx(len(set(s) & set(t)) / len(union) if union else 1.0)
        assert got[i][1] == pytest.approx(min(len(s), len(t)) / max(len(s), len(t)) if s or t else 1.0)
