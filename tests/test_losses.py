"""Ranking and in-batch losses against brute force on small batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simpairs.operators.losses import in_batch_loss, in_batch_rows, ranking_loss, select_loss


def brute_ranking(labels, scores):
    terms = [0.0] + [scores[i] - scores[j] for i in range(len(labels)) for j in range(len(labels)) if labels[i] < labels[j]]
    m = max(terms)
    return m + math.log(sum(math.exp(t - m) for t in terms))


def test_ranking_loss_matches_theta_join(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b in range(6):
        for k in range(9):
            rows.append((b, float(rng.integers(0, 4)), float(rng.normal() * 20)))
    df = spark.createDataFrame(rows, "batch_id long, label double, s double")
    got = {r.batch_id: r.loss for r in ranking_loss(df, "s", "label").collect()}
    for b in range(6):
        lab = [r[1] for r in rows if r[0] == b]
        sc = [r[2] for r in rows if r[0] == b]
        assert abs(got[b] - brute_ranking(lab, sc)) < 1e-9


def test_large_log_sum_exp_is_finite(spark):
    # pairs (i, j) with label_i < label_j: s_i - s_j = 1000 and 2; with the added 0 -> ~1000
    df = spark.createDataFrame([(0, 0.0, 1000.0), (0, 1.0, 0.0), (0, 2.0, 998.0)], "batch_id long, label double, s double")
    loss = ranking_loss(df, "s", "label").first().loss
    assert abs(loss - brute_ranking([0.0, 1.0, 2.0], [1000.0, 0.0, 998.0])) < 1e-9
    assert abs(loss - 1000.0) < 1e-6


def test_no_ordered_pair_gives_zero(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (0, 1.0, -2.0)], "batch_id long, label double, s double")
    assert ranking_loss(df, "s", "label").first().loss == 0.0


def test_in_batch_loss_matches_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(8):
        rows.append((0, k, rng.normal(size=6).tolist(), rng.normal(size=6).tolist(), float(k % 2)))
    df = spark.createDataFrame(rows, "batch_id long, pair_id long, u array<double>, v array<double>, score double")
    got = in_batch_loss(df, tau=20.0).first().loss
    x = []
    for r in rows:
        x += [np.array(r[2]), np.array(r[3])]
    x = np.array([e / np.linalg.norm(e) for e in x])
    sims = x @ x.T * 20.0
    ce = []
    for i in range(len(x)):
        if math.floor(rows[i // 2][4]) != 1:
            ce.append(0.0)
            continue
        logits = np.delete(sims[i], i)
        lse = np.log(np.sum(np.exp(logits - logits.max()))) + logits.max()
        ce.append(lse - sims[i, i ^ 1])
    assert abs(got - np.mean(ce)) < 1e-9


def test_unknown_loss_name_raises():
    import pytest

    with pytest.raises(ValueError):
        select_loss("zzz")
    assert select_loss("MSE") is not None


def test_positive_threshold_option(spark):
    rows = [(0, k, [1.0, float(k)], [1.0, float(k) + 0.1], 0.99) for k in range(4)]
    df = spark.createDataFrame(rows, "batch_id long, pair_id long, u array<double>, v array<double>, score double")
    assert in_batch_loss(df).first().loss == 0.0          # 0.99 cut to 0: no positives
    assert in_batch_loss(df, positive_threshold=0.9).first().loss > 0.0


def test_categorical_crossentropy_matches_numpy(spark):
    from simpairs.operators.losses import categorical_crossentropy

    logits = np.array([[1000.0, 2.0, 0.0], [0.5, -1.0, 3.0]])
    target = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]])
    rows = [(i, j, float(logits[i, j]), float(target[i, j])) for i in range(2) for j in range(3)]
    df = spark.createDataFrame(rows, "r long, c long, logit double, target double")
    got = {r.r: r.ce for r in categorical_crossentropy(df, ["r"]).collect()}
    for i in range(2):
        m = logits[i].max()
        lse = m + np.log(np.exp(logits[i] - m).sum())
        assert abs(got[i] - (-(target[i] * (logits[i] - lse)).sum())) < 1e-9


def test_zigzag_rows(spark):
    from simpairs.operators.losses import zigzag_rows

    df = spark.createDataFrame([(0, 0, [1.0], [2.0]), (0, 1, [3.0], [4.0])], "batch_id long, batch_idx long, u array<double>, v array<double>")
    rows = {r.idx: (r.vec[0], r.partner) for r in zigzag_rows(df).collect()}
    assert rows == {0: (1.0, 1), 1: (2.0, 0), 2: (3.0, 3), 3: (4.0, 2)}


def test_wide_spans_do_not_underflow(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 1000.0), (1, 0.0, 2000.0), (1, 1.0, -2000.0), (2, None, 5.0), (2, 1.0, 3.0)],
                               "batch_id long, label double, s double")
    got = {r.batch_id: r.loss for r in ranking_loss(df, "s", "label").collect()}
    assert got[0] == 0.0 and abs(got[1] - 4000.0) < 1e-9 and got[2] == 0.0


def _pairs(spark, n, dims=5, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(0, k, rng.normal(size=dims).tolist(), rng.normal(size=dims).tolist(), float(k % 3 == 0) if k % 5 else 0.95) for k in range(n)]
    return spark.createDataFrame(rows, "batch_id long, pair_id long, u array<double>, v array<double>, score double")


def test_tiles_give_the_same_rows_as_one_step(spark):
    df = _pairs(spark, 60)
    key = lambda r: (r.pair_id, r.side)
    one = sorted(in_batch_rows(df, 20.0, 5.0, 0.9).collect(), key=key)
    many = sorted(in_batch_rows(df, 20.0, 5.0, 0.9, tile_pairs=7).collect(), key=key)
    assert len(one) == len(many) == 120
    for a, b in zip(one, many):
        assert all(abs(a[c] - b[c]) < 1e-9 for c in ("lse", "partner_sim", "ce"))


def test_batches_of_any_size_and_any_tau(spark):
    df = _pairs(spark, 2500, 3)
    got = in_batch_rows(df, tau=500.0).collect()
    assert len(got) == 5000 and all(math.isfinite(r.lse) for r in got)


def test_negative_weight_marks_scores_of_zero_only(spark):
    u, v = [1.0, 0.0], [0.6, 0.8]
    df = spark.createDataFrame([(0, 0, u, v, 0.95), (0, 1, v, u, 0.0), (0, 2, u, u, 0.5)],
                               "batch_id long, pair_id long, u array<double>, v array<double>, score double")
    plain = {(r.pair_id, r.side): r for r in in_batch_rows(df, 20.0, 0.0, 0.9).collect()}
    heavy = {(r.pair_id, r.side): r for r in in_batch_rows(df, 20.0, 5.0, 0.9).collect()}
    for k, r in heavy.items():
        if k[0] == 1:
            assert r.lse > plain[k].lse
        else:
            assert abs(r.lse - plain[k].lse) < 1e-12 and abs(r.ce - plain[k].ce) < 1e-12


def test_losses_chosen_by_name_take_the_same_rows(spark):
    df = _pairs(spark, 20, 4)
    for name in ("MSE", "AnglE"):
        out = select_loss(name)(df)
        assert out.columns == ["batch_id", "loss"] and out.count() == 1


def test_a_pair_meets_a_bounded_number_of_strips(spark):
    from simpairs.operators.losses import MOST_STRIPS, deal_strips

    dealt = deal_strips(_pairs(spark, 2000, 2), 7).groupBy("pair_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert dealt.most == MOST_STRIPS and dealt["all"] == 2000 * MOST_STRIPS


@pytest.mark.parametrize("tau", [20.0, 500.0])
def test_strips_give_the_sums_over_all_rows(spark, tau):
    df = _pairs(spark, 400, 4)
    rows = sorted(df.collect(), key=lambda r: r.pair_id)
    x = np.array([v for r in rows for v in (r.u, r.v)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    logits = x @ x.T * tau
    for k, r in enumerate(rows):
        if r.score == 0:
            logits[2 * k, 2 * k + 1] += 5
            logits[2 * k + 1, 2 * k] += 5
    np.fill_diagonal(logits, -np.inf)
    top = logits.max(axis=1)
    lse = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    for r in in_batch_rows(df, tau, 5.0, 0.9, tile_pairs=7).collect():
        assert abs(r.lse - lse[2 * r.pair_id + r.side - 1]) < 1e-9
