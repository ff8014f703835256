"""Batch losses (D6-D14, F8), as aggregations per batch.

* MSE losses are plain ``avg`` aggregations.
* The ordered-pair ranking losses (CoSENT on cosine, and the angle variant)
  are computed without enumerating pairs: per (batch, label) sums, then one
  fold over a batch's labels in order, all in logarithms.
* The in-batch contrastive loss needs every dot product inside a batch.  A
  batch is cut into strips; a task holds two strips, goes over them in tiles,
  and each row of either gets a partial ``(max, sum exp)`` over the other.  The
  partials are merged by an aggregation, so a batch may have any size and no
  pair rows are emitted.  A row is sent to one task per strip: up to
  ``MOST_STRIPS`` strips, the exchange grows as the input does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import NORMALIZE_EPS, angle_score, cosine, dot, norm, pairwise_distance
from ..session import ship_package
from .rank import _null_safe_join

# Default weights and scales of the combined AnglE loss.
COSINE_W, IBN_W, ANGLE_W = 0.0, 20.0, 1.0
COSINE_TAU, IBN_TAU, ANGLE_TAU = 20.0, 20.0, 20.0
#: Pairs of one tile of an in-batch step; larger batches have several tiles.
TILE_PAIRS = 1024
#: Strips of a batch, unless a strip would be above STRIP_PAIRS, which bounds a task's memory.
MOST_STRIPS, STRIP_PAIRS = 32, 32_768
#: Columns of one tile, and logits up to which exp needs no maximum of its own.
TILE_COLUMNS, SAFE_LOGIT = 512, 300.0
#: Tasks that the cells are dealt over at least: their work is far above their bytes, by which Spark would join them.
LEAST_TASKS = 256


def normalized_cosine(u, v) -> Column:
    """Dot product of the two L2-normalised vectors (cosine-loss form)."""
    return dot(u, v) / (F.greatest(norm(u), F.lit(NORMALIZE_EPS)) * F.greatest(norm(v), F.lit(NORMALIZE_EPS)))


def mse_per_batch(df: DataFrame, pred: str, target: str, batch_col: str = "batch_id", group_cols=()) -> DataFrame:
    """Mean squared error of ``pred`` vs ``target`` per batch."""
    return df.groupBy(*group_cols, batch_col).agg(
        F.avg(F.pow(F.col(pred) - F.col(target), 2)).alias("loss"), F.count(F.lit(1)).alias("n")
    )


def pair_loss_per_batch(df: DataFrame, cos12: str, sim: str, cos13: str, batch_col: str = "batch_id") -> DataFrame:
    """``mse(cos(1,2), sim) + mse(cos(1,3), 0)`` per batch."""
    return df.groupBy(batch_col).agg(
        F.avg(F.pow(F.col(cos12) - F.col(sim), 2)).alias("loss_similar"),
        F.avg(F.pow(F.col(cos13), 2)).alias("loss_dissimilar"),
    ).withColumn("loss", F.col("loss_similar") + F.col("loss_dissimilar"))


def triplet_terms(df: DataFrame, anchor: str, positive: str, negative: str, margin: float = 1.0, p: float = 2.0) -> DataFrame:
    """Per row: ``d_ap``, ``d_an``, hinge ``max(0, d_ap - d_an + margin)`` and
    ``correct = d_ap < d_an`` (F4, D8, D9)."""
    return (
        df.withColumn("d_ap", pairwise_distance(anchor, positive, p))
        .withColumn("d_an", pairwise_distance(anchor, negative, p))
        .withColumn("hinge", F.greatest(F.lit(0.0), F.col("d_ap") - F.col("d_an") + F.lit(margin)))
        .withColumn("correct", F.col("d_ap") < F.col("d_an"))
    )


def triplet_per_batch(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Triplet margin loss (mean) and accuracy per batch."""
    return df.groupBy(batch_col).agg(
        F.avg("hinge").alias("loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def ranking_loss(df: DataFrame, score: str, label: str, batch_col: str = "batch_id") -> DataFrame:
    """``ln(1 + sum over label_i < label_j of exp(s_i - s_j))`` per batch.

    ``score`` is already scaled by tau.  Per label: the log of the sum of
    ``exp(s)`` and of ``exp(-s)``, each as a maximum and a scaled sum.  A fold
    over the labels in order keeps the running log-sum of the lower labels'
    ``exp(s)`` and of the result, so no span of scores under- or overflows.
    No ordered pair gives 0; rows without label or score are left out.
    """
    s = F.col(score)
    known = F.col(label).isNotNull() & s.isNotNull()
    top = df.groupBy(batch_col, label).agg(F.max(F.when(known, s)).alias("_hi"), F.min(F.when(known, s)).alias("_lo"))
    d = _null_safe_join(df.select(batch_col, label, s.alias("_s")), top, [batch_col, label])
    per_label = d.groupBy(batch_col, label, "_hi", "_lo").agg(
        F.sum(F.exp(F.col("_s") - F.col("_hi"))).alias("_up"), F.sum(F.exp(F.col("_lo") - F.col("_s"))).alias("_down"))
    rows = per_label.groupBy(batch_col).agg(F.array_sort(F.collect_list(F.when(
        F.col("_hi").isNotNull(), F.struct(F.col(label).cast("double").alias("l"), "_hi", "_lo", "_up", "_down")))).alias("_labels"))
    none = F.lit(float("-inf"))
    zero = F.struct(none.alias("m"), F.lit(0.0).alias("x"), F.lit(0.0).alias("om"), F.lit(1.0).alias("ox"))

    def step(acc, r):
        # exp(-s) of this label times exp(s) of the lower ones, added to the result.
        om = F.greatest(acc["om"], acc["m"] - r["_lo"])
        ox = acc["ox"] * F.exp(acc["om"] - om) + acc["x"] * r["_down"] * F.exp(acc["m"] - r["_lo"] - om)
        m = F.greatest(acc["m"], r["_hi"])
        x = acc["x"] * F.exp(acc["m"] - m) + r["_up"] * F.exp(r["_hi"] - m)
        return F.struct(m.alias("m"), x.alias("x"), om.alias("om"), ox.alias("ox"))

    loss = F.aggregate("_labels", zero, step, lambda acc: acc["om"] + F.log(acc["ox"]))
    return rows.select(batch_col, loss.alias("loss"))


def cosent_loss(df: DataFrame, u: str, v: str, label: str, tau: float = COSINE_TAU, batch_col: str = "batch_id") -> DataFrame:
    """Ranking loss on ``tau * cos(u, v)``."""
    d = df.select(batch_col, label, (F.lit(tau) * normalized_cosine(u, v)).alias("_s"))
    return ranking_loss(d, "_s", label, batch_col)


def angle_loss(
    df: DataFrame, u: str, v: str, label: str, tau: float = ANGLE_TAU, pooling: str = "sum", batch_col: str = "batch_id"
) -> DataFrame:
    """Ranking loss on the angle score."""
    d = df.select(batch_col, label, angle_score(u, v, tau, pooling).alias("_s"))
    return ranking_loss(d, "_s", label, batch_col)


PARTIAL_SCHEMA = "batch_id long, pair_id long, side int, m double, x double, partner_sim double, score double"
PARTIAL_ARROW = pa.schema([("batch_id", pa.int64()), ("pair_id", pa.int64()), ("side", pa.int32()),
                           *[(c, pa.float64()) for c in ("m", "x", "partner_sim", "score")]])


def _zigzag(part: pa.Table) -> np.ndarray:
    """The normalised rows u, v, u, v, .. of the pairs."""
    u, v = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1) for c in "uv")
    x = np.empty((2 * len(part), u.shape[1]))
    x[0::2], x[1::2] = u, v
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORMALIZE_EPS)


def _log_sums(a: np.ndarray, b: np.ndarray | None, tau: float, raised: np.ndarray, weight: float, tile: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(max, sum exp)`` of the logits of every row of ``a`` over ``b`` and of
    ``b`` over ``a``, tile by tile.  Without ``b``, of ``a`` over its other
    rows, the partner's logit of the rows ``raised`` higher by ``weight``."""
    other = a if b is None else b
    sides = [0, 1] if b is not None else [0]
    bound = abs(tau) + max(weight, 0.0)
    safe = bound <= SAFE_LOGIT  # cosines are at most 1
    top = [np.full(len(x), bound if safe else -np.inf) for x in (a, other)]
    total = [np.zeros(len(x)) for x in (a, other)]
    for i in range(0, len(a), 2 * tile):
        for j in range(0, len(other), TILE_COLUMNS):
            logits = a[i:i + 2 * tile] @ other[j:j + TILE_COLUMNS].T * tau
            if b is None:
                idx = np.arange(max(i, j), max(i, j, min(i + 2 * tile, j + TILE_COLUMNS, len(a))))
                up = idx[raised[idx]]
                logits[up - i, (up ^ 1) - j] += weight
                logits[idx - i, idx - j] = -np.inf  # self excluded
            places = slice(i, i + 2 * tile), slice(j, j + TILE_COLUMNS)
            if safe:
                grown = np.exp(logits - bound)
                for side in sides:
                    total[side][places[side]] += grown.sum(axis=1 - side)
                continue
            for side in sides:
                at, old = places[side], top[side][places[side]]
                new = np.maximum(old, logits.max(axis=1 - side))
                grown = np.exp(logits - (new[:, None] if side == 0 else new))
                total[side][at] = total[side][at] * np.exp(old - new) + grown.sum(axis=1 - side)
                top[side][at] = new
    return [(top[side], total[side]) for side in sides]


def _strip_rows(tau: float, negative_weight: float, tile: int):
    """Partial log-sums of the rows of strips ``rt`` and ``ct`` over each other."""

    def fn(cell: pa.Table) -> pa.Table:
        rt, ct = cell.column("rt")[0].as_py(), cell.column("ct")[0].as_py()
        strip = cell.column("tile").to_numpy()
        parts = [cell.filter(pa.array(strip == k)) for k in ([rt] if rt == ct else [rt, ct])]
        if not all(map(len, parts)):
            return PARTIAL_ARROW.empty_table()
        score = [np.repeat(p.column("score").to_numpy().astype(np.float64), 2) for p in parts]
        rows = [_zigzag(p) for p in parts]
        own = len(parts) == 1
        # Pairs scored exactly 0 are raised.
        raised = (score[0] == 0) & (negative_weight > 0)
        sums = _log_sums(rows[0], None if own else rows[1], tau, raised, negative_weight if own else 0.0, tile)
        out = []
        for part, x, (m, total), s in zip(parts, rows, sums, score):
            sim = np.einsum("ij,ij->i", x, x[np.arange(len(x)) ^ 1]) if own else np.full(len(x), np.nan)
            ids = [np.repeat(part.column(c).to_numpy(), 2).astype(np.int64) for c in ("batch_id", "pair_id")]
            columns = [*ids, np.tile(np.array([1, 2], np.int32), len(part)), m, total, sim, s]
            out.append(pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, PARTIAL_ARROW)], schema=PARTIAL_ARROW))
        return pa.concat_tables(out)

    return fn


def deal_strips(df: DataFrame, tile_pairs: int) -> DataFrame:
    """Pairs with their strip ``tile`` (by a hash of the pair id) and the two
    strips ``rt <= ct`` of the cell that each copy goes to, one copy per strip
    of the batch."""
    n = F.count(F.lit(1))
    strips = F.greatest(F.least(F.ceil(n / F.lit(float(tile_pairs))), F.lit(MOST_STRIPS)), F.ceil(n / F.lit(float(STRIP_PAIRS))))
    # Only batches above a tile are looked up, at most one per ``tile_pairs`` rows,
    # so a batch is not gathered in one task for it.
    sizes = df.groupBy("batch_id").agg(strips.cast("int").alias("_many")).where("_many > 1")
    d = df.where(F.col("batch_id").isNotNull()).select("batch_id", "pair_id", "u", "v", "score").join(F.broadcast(sizes), "batch_id", "left")
    d = d.withColumn("_tiles", F.coalesce("_many", F.lit(1)))
    d = d.withColumn("tile", F.pmod(F.xxhash64("pair_id"), F.col("_tiles")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda k: F.struct(
        F.least(k, "tile").alias("rt"), F.greatest(k, "tile").alias("ct")))
    return d.withColumn("_meet", F.explode(meets)).select("batch_id", "pair_id", "u", "v", "score", "tile", "_meet.rt", "_meet.ct")


def in_batch_rows(
    df: DataFrame, tau: float = IBN_TAU, negative_weight: float = 0.0, positive_threshold: float | None = None,
    tile_pairs: int | None = None,
) -> DataFrame:
    """Per zigzag row of every batch: log-sum-exp over the other rows of the
    batch, similarity to its partner (C3, C4, E11, F2, F3) and the
    categorical cross-entropy toward the partner (D12, D13).

    Input columns: batch_id, pair_id, u, v, score.  A pair is a positive
    when its score cut to an integer is 1 (the reference's rule, so 0.99
    counts as 0), or when ``score >= positive_threshold`` if one is given.
    With a ``negative_weight``, the partner's logit of a pair scored exactly 0
    is raised by it.  Batches are gone over in tiles of ``tile_pairs`` pairs;
    those larger than one are cut into strips by a hash of the pair id.
    """
    ship_package(df.sparkSession)
    limit = tile_pairs or TILE_PAIRS
    tasks = max(LEAST_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    partial = deal_strips(df, limit).repartition(tasks, "batch_id", "rt", "ct").groupBy("batch_id", "rt", "ct").applyInArrow(_strip_rows(tau, negative_weight, limit), PARTIAL_SCHEMA)
    known = F.when(F.isnan("partner_sim"), None).otherwise(F.col("partner_sim"))
    merged = partial.repartition(tasks, "batch_id", "pair_id", "side").groupBy("batch_id", "pair_id", "side").agg(
        F.collect_list(F.struct("m", "x")).alias("_parts"), F.max("m").alias("_m"), F.max(known).alias("partner_sim"), F.max("score").alias("score"))
    lse = F.col("_m") + F.log(F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["x"] * F.exp(p["m"] - F.col("_m"))))
    positive = F.floor("score") == 1 if positive_threshold is None else F.col("score") >= F.lit(positive_threshold)
    raised = F.lit(tau) * F.col("partner_sim") + F.when(F.col("score") == 0, F.lit(float(negative_weight))).otherwise(F.lit(0.0))
    return merged.select("batch_id", "pair_id", "side", lse.alias("lse"), "partner_sim",
                         F.when(positive, lse - raised).otherwise(F.lit(0.0)).alias("ce"))


def in_batch_loss(
    df: DataFrame, tau: float = IBN_TAU, negative_weight: float = 0.0, positive_threshold: float | None = None
) -> DataFrame:
    """In-batch contrastive loss per batch: mean CE over the 2B rows."""
    rows = in_batch_rows(df, tau, negative_weight, positive_threshold)
    return rows.groupBy("batch_id").agg(F.avg("ce").alias("loss"))


def combined_loss(
    df: DataFrame,
    cosine_w: float = COSINE_W,
    ibn_w: float = IBN_W,
    angle_w: float = ANGLE_W,
    cosine_tau: float = COSINE_TAU,
    ibn_tau: float = IBN_TAU,
    angle_tau: float = ANGLE_TAU,
    pooling: str = "sum",
) -> DataFrame:
    """Weighted sum of the three losses per batch (D14); a zero weight skips
    its term entirely.  Input columns: batch_id, pair_id, u, v, score."""
    parts = []
    if cosine_w > 0:
        parts.append(cosent_loss(df, "u", "v", "score", cosine_tau).select("batch_id", (F.col("loss") * cosine_w).alias("_t")))
    if ibn_w > 0:
        parts.append(in_batch_loss(df, ibn_tau).select("batch_id", (F.col("loss") * ibn_w).alias("_t")))
    if angle_w > 0:
        parts.append(angle_loss(df, "u", "v", "score", angle_tau, pooling).select("batch_id", (F.col("loss") * angle_w).alias("_t")))
    if not parts:
        return df.select("batch_id").distinct().withColumn("loss", F.lit(0.0))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("batch_id").agg(F.sum("_t").alias("loss"))


# K3: loss chosen by name.
def select_loss(name: str):
    """``MSE`` -> cosine MSE per batch; ``AnglE`` -> combined loss; else
    ValueError.  Both take batch_id, pair_id, u, v, score and give batch_id, loss."""
    if name == "MSE":
        return lambda df: mse_per_batch(df.withColumn("_cos", cosine("u", "v")), "_cos", "score").select("batch_id", "loss")
    if name == "AnglE":
        return combined_loss
    raise ValueError(f"Unknown loss function {name}")


def zigzag_rows(df: DataFrame, u: str = "u", v: str = "v", batch_col: str = "batch_id", pos_col: str = "batch_idx") -> DataFrame:
    """Pairs as the zigzag rows of the reference's batch matrix (C4, E11):
    row ``2k`` is sentence 1 of pair ``k``, row ``2k + 1`` its sentence 2;
    ``partner = idx ^ 1``.  Even rows are ``idx % 2 == 0``."""
    rows = df.select(batch_col, pos_col, F.expr(f"stack(2, 0, {u}, 1, {v}) AS (_side, vec)"), *[c for c in df.columns if c not in (batch_col, pos_col, u, v)])
    rows = rows.withColumn("idx", (F.col(pos_col) * 2 + F.col("_side")).cast("bigint"))
    return rows.withColumn("partner", F.col("idx").bitwiseXOR(F.lit(1))).drop("_side")


def categorical_crossentropy(logits: DataFrame, row_cols, logit: str = "logit", target: str = "target") -> DataFrame:
    """``-sum_j target_j * log_softmax(logit)_j`` per row (D13), from a long
    table (row, column, logit, target).  The log-sum-exp is stabilised by the
    row maximum; both passes are aggregations per row."""
    rc = list(row_cols)
    m = logits.groupBy(*rc).agg(F.max(logit).alias("_m"))
    j = logits.join(m, rc)
    agg = j.groupBy(*rc).agg(
        F.first("_m").alias("_m"),
        F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_s"),
        F.sum(F.col(target) * F.col(logit)).alias("_tl"),
        F.sum(F.col(target)).alias("_t"),
    )
    lse = F.col("_m") + F.log(F.col("_s"))
    return agg.select(*rc, (F.col("_t") * lse - F.col("_tl")).alias("ce"))
