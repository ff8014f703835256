"""The named queries of FIXTURES.md section 4, as lazy DataFrame plans.

Each takes ``(spark, sf_dir)`` and returns a DataFrame; nothing here collects.
Output columns are aliased to the names the DuckDB oracle uses, and doubles
are rounded to 6 digits so both engines compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from ..functions.numeric import rnd
from ..functions.vectors import as_double_array, cosine, l2_normalize, pairwise_distance
from ..functions.pooling import linear_readout, mean_pool_tokens, readout_weights
from ..operators.losses import (
    angle_loss, categorical_crossentropy, combined_loss, cosent_loss, in_batch_loss, in_batch_rows,
    pair_loss_per_batch, select_loss, triplet_per_batch, triplet_terms,
)
from ..operators.batching import prepare_batches, sequential_batches, shuffled_batches
from ..operators.metrics import batch_accuracy, correlations, epoch_metrics, mean_batch_loss
from ..operators.negatives import draw_donors, draw_negatives
from ..operators.split import keep_keys, key_counts, rare_keys, split_chain, stratified_split
from ..operators.grid import effective_batch_size, expand_grid, mean_over_seeds, resolve_pad
from ..operators.rank import value_rank
from ..operators.runlog import (
    DEFAULT_HPARAMS, EXPERIMENT_DEFAULTS, arg_best, as_name_list, best_epoch, drop_tail, early_stop, label, overlay,
    overlay_options, present_metrics, py_text, report, safe_name, select_runs, split_name, title, unpivot_metrics,
)
from ..functions.numeric import fixed4
from ..functions.hashing import hash_unit
from ..operators.batching import apply_translation, route_augmentation
from ..operators.lookup import apply_translation_filtered, drop_keys
from ..operators.text import pad_batches, score_pairs, score_triplets, token_ids, tokens, vocabulary
from ..operators.fit import FEATURES, grid_fit, pair_features, staged_fit, train_and_report
from ..operators.regress import PAIR_FEATURES, fit_features, fit_stages, text_features
from ..session import checkpoint_root, scratch_dir
from ..sources.buckets import encode_bucketed, score_stored_pairs, write_bucketed
from ..sources.runlog_source import append_log, load_runs, write_packs
from ..sources.runlogs import metrics_long, option, read_report, run_histories, typed_hparams
from ..streaming.epochs import run_epoch_metrics
from ..streaming.levels import RankLevels
from ..streaming.monitors import PatienceMonitor, replay_in_order, run_available, run_complete_to_table, stream_metrics, stream_rank_metrics
from ..sources.pairs import split_counts as count_splits
from ..sources.pairs import (
    Catalog, DatasetSpec, compute_once, normalise_scores, read_header_csv, read_scored_tsv, read_unscored_tsv,
    to_instances, with_positions, write_header_csv, write_results, write_scored_tsv, write_unscored_tsv,
)

R = 6  # digits kept on every double output


def sts_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: encoded pairs -> cosine -> per label: MSE, Pearson, Spearman."""
    p = fx.vec_pairs(spark, sf_dir).select(
        F.col("label_a").alias("label"), "score", cosine("u", "v").alias("cos")
    )
    corr = correlations(p, "score", "cos", ["label"], spearman=True, digits=None,
                        extra_aggs=[F.avg(F.pow(F.col("cos") - F.col("score"), 2)).alias("mse")])
    return corr.select("label", "n", rnd("mse").alias("mse"), rnd("pearson").alias("pearson"), rnd("spearman").alias("spearman"))


QUERIES = {
    "sts_eval": sts_eval,
}


# -- helpers ----------------------------------------------------------------

def _materialize(spark: SparkSession):
    """Cut lineage with a reliable checkpoint in the session's shared folder."""
    checkpoint_root(spark)
    return lambda d: d.checkpoint(eager=True)


# -- B1 B2 B4 B5 B6 ---------------------------------------------------------

def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0..5 and 0..100 scores to [0, 1], projected to instance records."""
    ro = normalise_scores(fx.text_pairs(spark, sf_dir, 6), "ro-sts")
    bib = normalise_scores(fx.text_pairs(spark, sf_dir, 101), "biblical_01")
    parts = [
        to_instances(d, keep=["pair_id"]).withColumn("dataset", F.lit(name))
        for name, d in (("ro-sts", ro), ("biblical_01", bib))
    ]
    out = parts[0].unionByName(parts[1])
    return out.select("dataset", "pair_id", "sentence1", "sentence2", "sentence3", rnd("sim").alias("sim"))


# -- A16 D1 E2 / E1 E2 H2 ------------------------------------------------------

def split_chain_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-step split, computed once and stored partitioned by part (A5);
    the result is always read back from the stored table."""
    s = fx.strata(spark, sf_dir, 50)
    path = scratch_dir(spark, "split-chain")
    stored = compute_once(
        spark, lambda: split_chain(s, "doc_id", "skey", seed="42", materialize=_materialize(spark)).select("doc_id", "skey", "part"),
        path, partition_col="part")
    return stored.select("doc_id", "skey", "part")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts per split of the three-step chain, one pass for all splits."""
    counted = count_splits(split_chain_q(spark, sf_dir).withColumnRenamed("part", "split"))
    return counted.withColumnRenamed("split", "part")


def stratified_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare-safe stratified split of the hard key (n_chars), test size 0.3."""
    s = fx.strata(spark, sf_dir, 1)
    return stratified_split(s, "doc_id", "skey", 0.3, seed="42").select("doc_id", "skey", "part")


# -- B7 D2 --------------------------------------------------------------------

def key_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.strata(spark, sf_dir, 50)
    rare = rare_keys(s, "skey")
    a = keep_keys(s, rare, "skey", keep=True).withColumn("kind", F.lit("rare"))
    b = keep_keys(s, rare, "skey", keep=False).withColumn("kind", F.lit("common"))
    return a.unionByName(b).select("doc_id", "skey", "kind")


# -- C1 E3 --------------------------------------------------------------------

def negatives_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = normalise_scores(fx.text_pairs(spark, sf_dir, 6), "ro-sts")
    n = draw_negatives(tp, "pair_id", ("text1", "text2"), seed="42")
    return n.select(
        "pair_id", "donor_id", "side",
        F.col("text1").alias("sentence1"), F.col("text2").alias("sentence2"), "sentence3",
        rnd("score").alias("sim"),
    )


def negatives_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = fx.turn_pairs(spark, sf_dir)
    n = draw_negatives(tp, "pair_id", ("text1", "text2"), seed="42")
    return n.select(
        "pair_id", "donor_id", "side",
        F.col("text1").alias("sentence1"), F.col("text2").alias("sentence2"), "sentence3",
    )


# -- E4 E5 --------------------------------------------------------------------

def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled batches of 16 for epochs 0 and 1, and sequential batches."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id")
    parts = [
        shuffled_batches(d, "doc_id", 16, seed="42", epoch=e).withColumn("kind", F.lit(f"shuffled-{e}"))
        for e in (0, 1)
    ]
    parts.append(sequential_batches(d, "doc_id", 16).withColumn("kind", F.lit("sequential")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("kind", "doc_id", "batch_id", "batch_idx")


# -- B21 ----------------------------------------------------------------------

def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every document in id order; ``row_at`` filters on it."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return with_positions(d, "doc_id").select("position", "doc_id", "lang", "n_chars")


# -- D3 D4 D21 D5 -------------------------------------------------------------

def pearson_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.predictions(spark, sf_dir)
    return correlations(p, "y", "y_hat", ["stage"], spearman=False, digits=R).select("stage", "n", "pearson")


def spearman_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.predictions(spark, sf_dir)
    return correlations(p, "y", "y_hat", ["stage"], spearman=True, digits=R).select("stage", "n", "spearman")


def mean_batch_loss_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of per-batch squared errors on scores scaled to [0, 1]."""
    p = fx.predictions(spark, sf_dir)
    loss = F.pow(F.col("y_hat") / F.lit(105000.0) - F.col("y") / F.lit(50.0), 2)
    out = mean_batch_loss(p, loss, "batch_id", ["stage"])
    return out.select("stage", "n_batches", rnd("avg_loss").alias("avg_loss"))


QUERIES.update({
    "score_normalise": score_normalise,
    "split_counts": split_counts,
    "split_chain": split_chain_q,
    "stratified_split": stratified_split_q,
    "key_semi_anti": key_semi_anti,
    "negatives_pair": negatives_pair,
    "negatives_triplet": negatives_triplet,
    "batches": batches,
    "row_lookup": row_lookup,
    "pearson_by_stage": pearson_by_stage,
    "spearman_by_stage": spearman_by_stage,
    "mean_batch_loss": mean_batch_loss_q,
})


# -- C2 F7 C3 C4 E11 F3 D6-D14 F4-F10 D20 ----------------------------------------

def theta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair: how many pairs of its batch have a strictly lower / higher
    score (the ordered-pair mask of the ranking losses), from ranks in the
    batch instead of a self join."""
    p = fx.vec_pairs(spark, sf_dir).select("batch_id", "pair_id", "score")
    w_up = Window.partitionBy("batch_id").orderBy(F.col("score").asc())
    w_dn = Window.partitionBy("batch_id").orderBy(F.col("score").desc())
    return p.select(
        "batch_id", "pair_id",
        (F.rank().over(w_up) - 1).cast("bigint").alias("n_lower"),
        (F.rank().over(w_dn) - 1).cast("bigint").alias("n_higher"),
    )


def inbatch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_batch_rows(fx.vec_pairs(spark, sf_dir))
    return rows.select("batch_id", "pair_id", "side", *[rnd(c).alias(c) for c in ("lse", "partner_sim", "ce")])


def inbatch_loss_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_batch_loss(fx.vec_pairs(spark, sf_dir)).select("batch_id", rnd("loss").alias("loss"))


def inbatch_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-batch loss of one batch over all pairs, in tiles: a positive
    threshold, and a weight on the pairs scored exactly 0 (D12)."""
    p = fx.vec_pairs(spark, sf_dir, batch_size=1_000_000)
    rows = in_batch_rows(p, tau=20.0, negative_weight=5.0, positive_threshold=0.9, tile_pairs=256)
    return rows.select("pair_id", "side", *[rnd(c).alias(c) for c in ("lse", "partner_sim", "ce")])


def triplet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets of turns encoded from text: distances, hinge, and the accuracy
    of every batch and of all batches (G7, D8, D9)."""
    turns = fx.turn_pairs(spark, sf_dir)
    drawn = draw_donors(turns.select("pair_id"), "pair_id", seed="42").join(
        sequential_batches(turns.select("pair_id"), "pair_id", 16), "pair_id")
    first = turns.select(F.concat(F.lit("a"), "pair_id").alias("id"), F.col("text1").alias("text"))
    docs = first.unionByName(turns.select(F.concat(F.lit("b"), "pair_id").alias("id"), F.col("text2").alias("text")))
    side = F.when(F.col("side") == 1, F.lit("a")).otherwise(F.lit("b"))
    trip = drawn.select("batch_id", F.concat(F.lit("a"), "pair_id").alias("anchor"), F.concat(F.lit("b"), "pair_id").alias("positive"),
                        F.concat(side, "donor_id").alias("negative"))
    t = score_triplets(docs, trip, "id", "text", "anchor", "positive", "negative")
    per_batch = triplet_per_batch(t).select(F.col("batch_id"), "n", "loss", "accuracy")
    every = mean_batch_loss(t, "hinge", "batch_id", [], "loss").select("loss", "n_batches")
    total = batch_accuracy(t, F.col("correct"), "batch_id").select("accuracy")
    all_row = every.select(F.lit(None).cast("bigint").alias("batch_id"), F.col("n_batches").alias("n"), "loss").withColumn(
        "accuracy", total.scalar())
    return per_batch.unionByName(all_row).select("batch_id", "n", rnd("loss").alias("loss"), rnd("accuracy").alias("accuracy"))


def epoch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (run, stage, epoch): Pearson, Spearman and mean batch loss, with the
    null stage as a group of its own (D21)."""
    p = fx.predictions(spark, sf_dir).select(
        (F.col("l_orderkey") % 3).alias("run_id"), F.nullif(F.col("stage"), F.lit("N")).alias("stage"),
        F.col("l_linenumber").cast("bigint").alias("epoch"), "batch_id", "y", "y_hat",
        F.pow(F.col("y_hat") / F.lit(105000.0) - F.col("y") / F.lit(50.0), 2).alias("loss"))
    out = epoch_metrics(p, "y", "y_hat", "loss", "batch_id")
    return out.select("run_id", "stage", "epoch", "n", "n_batches", "pearson", "spearman", "avg_loss")


def angle_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle loss with mean pooling, and distances with p = 1 and p = 3."""
    p = fx.vec_pairs(spark, sf_dir)
    loss = angle_loss(p, "u", "v", "score", tau=300.0, pooling="mean")
    dist = p.groupBy("batch_id").agg(F.avg(pairwise_distance("u", "v", 1.0)).alias("d1"), F.avg(pairwise_distance("u", "v", 3.0)).alias("d3"))
    return loss.join(dist, "batch_id").select("batch_id", *[rnd(c).alias(c) for c in ("loss", "d1", "d3")])


def combined_loss_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined_loss(fx.vec_pairs(spark, sf_dir)).select("batch_id", rnd("loss").alias("loss"))


def cosent_loss_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosent_loss(fx.vec_pairs(spark, sf_dir), "u", "v", "score").select("batch_id", rnd("loss").alias("loss"))


def angle_loss_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angle_loss(fx.vec_pairs(spark, sf_dir), "u", "v", "score").select("batch_id", rnd("loss").alias("loss"))


def pair_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mse(cos(1,2), sim) + mse(cos(1,3), 0)`` per batch, sentence 3 drawn by C1."""
    p = draw_negatives(fx.vec_pairs(spark, sf_dir), "pair_id", ("u", "v"), seed="42", out="w")
    p = p.select("batch_id", "score", cosine("u", "v").alias("cos12"), cosine("u", "w").alias("cos13"))
    out = pair_loss_per_batch(p, "cos12", "score", "cos13")
    return out.select("batch_id", *[rnd(c).alias(c) for c in ("loss_similar", "loss_dissimilar", "loss")])


def triplet_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor k, positive k + 1, negative by C1: margin loss and accuracy per batch."""
    p = draw_negatives(fx.vec_pairs(spark, sf_dir), "pair_id", ("u", "v"), seed="42", out="w")
    t = triplet_terms(p, "u", "v", "w", margin=1.0, p=2.0)
    out = triplet_per_batch(t)
    return out.select("batch_id", "n", rnd("loss").alias("loss"), rnd("accuracy").alias("accuracy"))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a sentence whose tokens are its vectors (in id order);
    labels are batched by ``label div 5`` and padded to the longest sentence
    of the batch with zero vectors, which the mean counts (D20).  Then a
    fixed linear readout (F9) and L2 normalisation (F2)."""
    e = fx.read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("sent_id"), F.expr("label div 5").alias("batch_id"), as_double_array("embedding").alias("vec")
    )
    pooled = mean_pool_tokens(e, "sent_id", "batch_id", "vec", masked=False)
    ro = pooled.withColumn("readout", linear_readout("pooled", readout_weights(64, 16)))
    ro = ro.withColumn("normalized", l2_normalize("readout"))
    a = pooled.select(F.lit("pooled").alias("kind"), "sent_id", F.posexplode("pooled").alias("dim", "value"))
    b = ro.select(F.lit("readout").alias("kind"), "sent_id", F.posexplode("normalized").alias("dim", "value"))
    return a.unionByName(b).select("kind", F.col("sent_id").alias("label"), F.col("dim").cast("bigint").alias("dim"), rnd("value").alias("value"))


QUERIES.update({
    "theta_pairs": theta_pairs,
    "inbatch_similarity": inbatch_similarity,
    "inbatch_loss": inbatch_loss_q,
    "inbatch_weighted": inbatch_weighted,
    "triplet_text": triplet_text,
    "epoch_report": epoch_report,
    "angle_mean_loss": angle_mean_loss,
    "combined_loss": combined_loss_q,
    "cosent_loss": cosent_loss_q,
    "angle_loss": angle_loss_q,
    "pair_loss": pair_loss,
    "triplet_eval": triplet_eval,
    "mean_pool": mean_pool,
})


# -- run logs: B8-B20, C5-C7, D15-D19, E6-E10, I4, I5 ------------------------------

RESULT_METRICS = [f"{p}_{t}" for p in ("dev", "test") for t in fx.EVENT_TYPES]


def _history_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.read(spark, sf_dir, "events").select("user_id")
    return ev.groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n_epochs"))


def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged hyper-parameters over defaults (B8, B9), joined with the run's
    history length and one result by run id; both may be absent (C6)."""
    cfg = overlay(fx.run_config(spark, sf_dir), DEFAULT_HPARAMS)
    res = fx.run_metrics(spark, sf_dir).select("run_id", "dev_click")
    j = cfg.join(_history_length(spark, sf_dir), "run_id", "left").join(res, "run_id", "left")
    types = dict(j.dtypes)
    return j.select(
        "run_id", "gpus", "batch_size", "accumulate_grad_batches", "lr", "model_max_length", "max_train_epochs",
        "model_name", "training_method", "data_augmentation_translate_data", "data_augmentation_negative_samples",
        py_text(F.col("train_dataset_name"), types["train_dataset_name"]).alias("train_dataset_name"),
        "dev_dataset_name", "test_dataset_name", "n_epochs", rnd("dev_click").alias("dev_click"),
    )


def log_tail_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the two trailing evaluation rows of every log, the bookkeeping
    columns, and empty cells (B10-B13)."""
    log = present_metrics(drop_tail(fx.epoch_log(spark, sf_dir), 2))
    return log.select("run_id", "epoch", "metric", rnd("value").alias("value"))


def labels_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric names split into prefix and suffix (B15), safe file names
    (B17), 4-decimal text (B18), curve labels and titles (B14)."""
    long = present_metrics(unpivot_metrics(fx.run_metrics(spark, sf_dir), ["run_id"], RESULT_METRICS))
    cfg = fx.run_config(spark, sf_dir).select("run_id", "model_name", "data_augmentation_translate_data")
    j = long.join(cfg, "run_id", "left")
    prefix, suffix = split_name("metric")
    keys = ["model_name", "data_augmentation_translate_data"]
    return j.select(
        "run_id", "metric", prefix.alias("prefix"), suffix.alias("suffix"),
        safe_name(F.concat_ws("/", prefix, suffix)).alias("safe_name"),
        label(j, keys).alias("label"), title(j, keys).alias("title"),
        fixed4("value").alias("value_text"),
    )


REPORT_RUNS = [12, 3, 7, 140, 0, 55, 99, 21, 8, 130, 64, 149]


def report_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report table for an explicit run list (C7): chosen hyper-parameters,
    then the sorted metric columns (D16, D19), sorted by the
    hyper-parameters with list cells compared element-wise (B16, E9)."""
    long = unpivot_metrics(fx.run_metrics(spark, sf_dir), ["run_id"], RESULT_METRICS)
    cfg = overlay(select_runs(fx.run_config(spark, sf_dir), REPORT_RUNS), DEFAULT_HPARAMS)
    cfg = cfg.withColumn("train_dataset_name", as_name_list(cfg, "train_dataset_name"))
    hp = ["model_name", "train_dataset_name", "data_augmentation_translate_data"]
    rep = report(long, cfg, ["sel_pos", *hp], RESULT_METRICS)
    # The selection is bounded by the literal run list, so one window is fine.
    w = Window.orderBy(*[F.col(k).asc_nulls_first() for k in hp], "run_id")
    rep = rep.withColumn("sort_pos", F.row_number().over(w).cast("bigint")).withColumn("sel_pos", F.col("sel_pos").cast("bigint"))
    types = dict(rep.dtypes)
    return rep.select(
        "sel_pos", "sort_pos", "run_id", "model_name",
        py_text(F.col("train_dataset_name"), types["train_dataset_name"]).alias("train_dataset_name"),
        "data_augmentation_translate_data",
        *[rnd(m).alias(m) for m in sorted(RESULT_METRICS)],
    )


def best_run_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arg-max and arg-min run per metric, ties to the lowest run id."""
    long = unpivot_metrics(fx.run_metrics(spark, sf_dir), ["run_id"], RESULT_METRICS)
    b = arg_best(long)
    return b.select("metric", "max_run", rnd("max_value").alias("max_value"), "min_run", rnd("min_value").alias("min_value"))


def mean_over_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs repeated with ten seeds (config = run_id div 10, seed = run_id % 10),
    averaged per configuration (D18, I5)."""
    rm = fx.run_metrics(spark, sf_dir).withColumn("config_id", F.expr("run_id div 10"))
    out = mean_over_seeds(rm, ["config_id"], RESULT_METRICS)
    return out.select("config_id", "n_repeats", *[rnd(m).alias(m) for m in RESULT_METRICS])


def best_epoch_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = best_epoch(fx.epoch_log(spark, sf_dir))
    return b.select("run_id", "n_epochs", "best_epoch", rnd("best_value").alias("best_value"))


def early_stop_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop epoch with patience 4 (strict improvement) and an epoch cap of 60."""
    return early_stop(fx.epoch_log(spark, sf_dir), patience=4, max_epochs=60).select("run_id", "stop_epoch", "capped")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame behind the metric plots (E10): per suffix (in first-seen order of
    the first run, D17), run, label, epoch index in its series (E8), value."""
    prefix, suffix = split_name("metric")
    # Rankings build on each other; the log is cut off from the first ones.
    log = _materialize(spark)(present_metrics(drop_tail(fx.epoch_log(spark, sf_dir), 2)).withColumn("suffix", suffix))
    idx = value_rank(log, "epoch", group_cols=["run_id", "metric"], out="_p")
    first_run = log.agg(F.min("run_id")).scalar()
    order = log.where(F.col("run_id") == first_run).groupBy("suffix").agg(F.min("epoch").alias("_seen"))
    order = value_rank(order, "_seen", tie_cols=["suffix"], out="suffix_pos")
    cfg = fx.run_config(spark, sf_dir).select("run_id", "model_name")
    j = idx.join(order.select("suffix", "suffix_pos"), "suffix", "left").join(cfg, "run_id", "left")
    return j.select(
        "suffix", "suffix_pos", "run_id", label(j, ["model_name"]).alias("label"),
        (F.col("_p") - 1).alias("epoch"), rnd("value").alias("value"),
    )


# Fixed experiment grid of the effective-batch report.
GRID = {"batch_size": [16, 32, 64, 256], "accumulate_grad_batches": [1, 4, 8, 16]}


def effective_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged configuration times the grid (C5, I4): the effective batch
    (B19) of the run's own accumulation and of each grid point."""
    cfg = overlay(fx.run_config(spark, sf_dir).select("run_id", "accumulate_grad_batches"), EXPERIMENT_DEFAULTS)
    own = effective_batch_size("batch_size", "accumulate_grad_batches").alias("own_batch")
    g = expand_grid(cfg.select("run_id", own), GRID)
    return g.select(
        "run_id", "own_batch", "grid_pos", "batch_size", "accumulate_grad_batches",
        effective_batch_size("batch_size", "accumulate_grad_batches").alias("effective_batch"),
    )


def pad_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First present of pad, sep, eos, bos, cls per run."""
    rc = fx.read(spark, sf_dir, "documents").select("doc_id").join(
        fx.read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    tokens = rc.select(
        F.col("doc_id").alias("run_id"),
        F.when(F.col("quality") == 1, F.lit("[PAD]")).alias("pad_token"),
        F.when(F.col("toxic") == 0, F.lit("[SEP]")).alias("sep_token"),
        F.when(F.col("quality").isNotNull(), F.lit("</s>")).alias("eos_token"),
        F.lit(None).cast("string").alias("bos_token"),
        F.lit("[CLS]").alias("cls_token"),
    )
    return resolve_pad(tokens).select("run_id", "pad", "pad_source")


QUERIES.update({
    "config_overlay": config_overlay,
    "log_tail_drop": log_tail_drop,
    "labels_and_names": labels_and_names,
    "report_sorted": report_sorted,
    "best_run_per_metric": best_run_per_metric,
    "mean_over_repeats": mean_over_repeats,
    "best_epoch": best_epoch_q,
    "early_stop": early_stop_q,
    "curves": curves,
    "effective_batch": effective_batch,
    "pad_symbol": pad_symbol,
})


# -- run-log files: A9-A13, B11, D16 -------------------------------------------------

def _run_folder():
    return F.concat(F.lit("version_"), F.col("run_id").cast("string")).alias("run")


def _pack_files(texts: DataFrame, root: str, name: str, head: str = "", *parts) -> None:
    """Texts of runs (run, value) as packed run files ``<run>/<name>``; ``parts``
    cut the texts of a run into several rows, each below ``head``."""
    files = texts.groupBy("run", *parts).agg(F.array_join(F.collect_list("value"), "\n").alias("text"), *([F.max(head).alias("head")] if head else []))
    path = F.concat(F.coalesce("run", F.lit("no_run")), F.lit(f"/{name}"))
    write_packs(files.select(path.alias("path"), F.concat(*([F.col("head"), F.lit("\n")] if head else []), "text", F.lit("\n")).alias("content")), root)


def _all_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("run_id")).distinct()


def _odd_runs(spark: SparkSession, sf_dir: str):
    """The run whose file is broken (smallest id) and the run without a file (largest id)."""
    ids = fx.read(spark, sf_dir, "events").agg(F.struct(F.min("user_id").alias("broken"), F.max("user_id").alias("missing")).alias("r"))
    return ids.scalar()


# Fixed value: lines of one stretch of a metric file.
STRETCH_LINES = 1000


def _write_metric_files(spark: SparkSession, sf_dir: str) -> str:
    """The epoch log as one CSV file per run, in packs: even runs with
    ``dev/`` columns, odd runs with ``val/`` columns in another order; epochs
    have gaps; one run has a cell that is no number, one has no file."""
    root = scratch_dir(spark, "run-metrics")
    odd_run = _odd_runs(spark, sf_dir)
    log = fx.epoch_log(spark, sf_dir).where((F.col("run_id") != odd_run["missing"]) & (F.col("run_id") % 2).isin(0, 1))
    cell = F.when((F.col("run_id") == odd_run["broken"]) & (F.col("epoch") == 0), F.lit("oops")).otherwise(F.col("value").cast("string"))
    kind = F.split("metric", "/")[1]
    base = [(F.col("epoch") * 5).alias("epoch"), (F.col("epoch") * 10).alias("step")]
    even = [*[F.when(kind == t, cell) for t in fx.EVENT_TYPES], *base]
    odd = [*base, *[F.when(kind == t, cell) for t in fx.EVENT_TYPES[::-1]]]
    even_names = [*[f"dev/{t}" for t in fx.EVENT_TYPES], "epoch", "step"]
    odd_names = ["epoch", "step", *[f"val/{t}_epoch" for t in fx.EVENT_TYPES[::-1]]]
    is_even = F.col("run_id") % 2 == 0
    lines = log.select(_run_folder(), F.expr(f"epoch div {STRETCH_LINES}").alias("stretch"),
                       F.when(is_even, F.lit(",".join(even_names))).otherwise(F.lit(",".join(odd_names))).alias("head"),
                       F.when(is_even, F.to_csv(F.struct(*even))).otherwise(F.to_csv(F.struct(*odd))).alias("value"))
    _pack_files(lines, root, "metrics.csv", "head", "stretch")
    return root


def runlog_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files read by their own headers through the run-log source, the
    last two rows dropped by position, every run kept by a left join (A9, A12,
    A13, B10-B13)."""
    metrics = load_runs(spark, _write_metric_files(spark, sf_dir), "metrics", "*.csv")
    long = metrics_long(_materialize(spark)(metrics))
    return run_histories(_all_runs(spark, sf_dir), long).select("run_id", "epoch", "pos", "metric", rnd("value").alias("value"))


def runlog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: lines read, parsed and failed."""
    metrics = load_runs(spark, _write_metric_files(spark, sf_dir), "metrics", "*.csv")
    return read_report(metrics).select("run_id", "rows", "parsed_rows", "bad_rows")


def metric_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch log appended in two writes, the second one replayed, and read
    back: every row once (A15)."""
    log = _materialize(spark)(fx.epoch_log(spark, sf_dir).select("run_id", "epoch", "metric", "value"))
    path = scratch_dir(spark, "metric-log")
    early = F.col("epoch") < 10
    append_log(log.where(early), path, "early")
    for _ in range(2):
        append_log(log.where(~early), path, "late")
    return load_runs(spark, path, "log").select("run_id", "epoch", "metric", rnd("value").alias("value"))


def _write_results(spark: SparkSession, sf_dir: str) -> str:
    """One result file per run, in packs; a run is one row, so nothing is grouped."""
    root = scratch_dir(spark, "run-results")
    text = F.to_json(F.struct(*RESULT_METRICS, F.lit(1.5).alias("extra_metric")))
    path = F.concat(F.coalesce(_run_folder(), F.lit("no_run")), F.lit("/results.json"))
    write_packs(fx.run_metrics(spark, sf_dir).select(path.alias("path"), F.concat(text, F.lit("\n")).alias("content")), root)
    return root


def runlog_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files with any metric names, in long form (A10)."""
    res = load_runs(spark, _write_results(spark, sf_dir), "results", "*.json")
    return res.select("run_id", "metric", rnd("value").alias("value"))


def _write_hparams(spark: SparkSession, sf_dir: str) -> str:
    """Sparse option files of the runs, in packs, with a key that no list knows."""
    root = scratch_dir(spark, "run-hparams")
    cfg = fx.run_config(spark, sf_dir)
    line = lambda key, text: F.when(text.isNotNull(), F.concat(F.lit(f"{key}: "), text))
    names = F.concat(F.lit("["), F.array_join("train_dataset_name", ", "), F.lit("]"))
    text = F.concat_ws("\n", F.lit("lr: 2.0e-05"), line("model_name", F.col("model_name")), line("batch_size", F.col("batch_size").cast("string")),
                       line("data_augmentation_translate_data", F.col("data_augmentation_translate_data").cast("string")),
                       line("train_dataset_name", names), line("warmup_share", F.lit("0.25")), F.lit("test_dataset_name: ro-sts"))
    _pack_files(cfg.select(text.alias("value"), _run_folder()), root, "hparams.txt")
    return root


def runlog_hparams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option files with any keys over the defaults."""
    hp = overlay_options(typed_hparams(load_runs(spark, _write_hparams(spark, sf_dir), "hparams", "*.txt")), DEFAULT_HPARAMS)
    types = dict(hp.dtypes)
    return hp.select(
        "run_id", "batch_size", "model_name", option("gpus", "int").alias("gpus"), option("warmup_share", "double").alias("warmup_share"),
        option("max_train_epochs", "int").alias("max_train_epochs"), "data_augmentation_translate_data",
        py_text(F.col("lr"), types["lr"]).alias("lr"), py_text(F.col("train_dataset_name"), types["train_dataset_name"]).alias("train_dataset_name"),
        py_text(F.col("test_dataset_name"), types["test_dataset_name"]).alias("test_dataset_name"),
        F.size(F.map_keys("options")).cast("bigint").alias("n_options"),
    )


def runlog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options and results from files; metric names found in the data."""
    hp = _materialize(spark)(typed_hparams(load_runs(spark, _write_hparams(spark, sf_dir), "hparams", "*.txt")))
    res = _materialize(spark)(load_runs(spark, _write_results(spark, sf_dir), "results", "*.json"))
    wide = report(res, hp, ["model_name", "batch_size"])
    return wide.select("run_id", "model_name", "batch_size", *[rnd(m).alias(m) for m in wide.columns[3:]])


QUERIES.update({
    "runlog_metrics": runlog_metrics,
    "runlog_lines": runlog_lines,
    "metric_log_replay": metric_log_replay,
    "runlog_results": runlog_results,
    "runlog_hparams": runlog_hparams,
    "runlog_report": runlog_report,
})


# -- text: G1-G6, C8, K1, K2 --------------------------------------------------------

def tokenise_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-corpus vocabulary, first 512 token ids per document, batches of
    16 in id order padded to their longest row (G1, G2)."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = vocabulary(docs, "doc_id", "text")
    ids = token_ids(docs, "doc_id", "text", vocab, max_length=512)
    padded = prepare_batches(docs.select("doc_id"), "doc_id", 16, lambda b: pad_batches(b.join(ids, "doc_id"), "batch_id"))
    return padded.select(
        "doc_id", "batch_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("padded_length").cast("bigint").alias("padded_length"),
        F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_hash"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
    )


def encode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode both sentences of every scored pair (hashed bag of tokens over
    the whole text), cosine as the prediction, and its squared error (G5, G6)."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    tp = normalise_scores(fx.text_pairs(spark, sf_dir, 6), "ro-sts").select(
        "pair_id", F.col("pair_id").alias("doc_a"), (F.col("pair_id") + 1).alias("doc_b"), "score")
    j = score_pairs(docs, tp, "doc_id", "text", "doc_a", "doc_b")
    return j.select(
        "pair_id", rnd("score").alias("sim"), rnd("cos").alias("prediction"),
        rnd(F.pow(F.col("cos") - F.col("score"), 2)).alias("sq_error"),
    )


def _routed_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fx.turn_pairs(spark, sf_dir)
    trip = draw_negatives(turns, "pair_id", ("text1", "text2"), seed="42").select(
        "pair_id", F.col("text1").alias("sentence1"), F.col("text2").alias("sentence2"), "sentence3")
    numbered = sequential_batches(turns.select("pair_id"), "pair_id", 16)
    return route_augmentation(trip.join(numbered, "pair_id"), "batch_id", seed="42", epoch=0)


def augment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets in batches of 16; one routing draw and one pivot language per
    batch (G3, G4); the routed sentence is replaced from the translation
    memory, or kept when there is no entry (C8)."""
    out = apply_translation(_routed_triplets(spark, sf_dir), fx.translation_memory(spark, sf_dir))
    return out.select("pair_id", "batch_id", "route", "lang", "translated", "sentence1", "sentence2", "sentence3")


# -- catalog and files: A1-A8, A14, A16-A18, H1 -----------------------------------

def stand_in_catalog(sf_dir: str) -> Catalog:
    """The three corpora stood in for by driver-table derivations, each with
    a seeded hash split (scored: 70/15/15, unscored: train/dev 80/20)."""
    def ro(spark):
        tp = fx.text_pairs(spark, sf_dir, 6)
        u = hash_unit(F.lit("split"), F.col("pair_id"))
        return tp.withColumn("split", F.when(u < 0.7, "train").when(u < 0.85, "dev").otherwise("test"))

    def bib(spark):
        tp = fx.text_pairs(spark, sf_dir, 101)
        u = hash_unit(F.lit("split"), F.col("pair_id"))
        return tp.withColumn("split", F.when(u < 0.7, "train").when(u < 0.85, "dev").otherwise("test"))

    def para(spark):
        tp = fx.turn_pairs(spark, sf_dir).select("pair_id", "text1", "text2")
        u = hash_unit(F.lit("split"), F.col("pair_id"))
        return tp.withColumn("split", F.when(u < 0.8, "train").otherwise("dev"))

    cat = Catalog()
    cat.register(DatasetSpec("ro-sts", ro, preprocess=lambda d: normalise_scores(d, "ro-sts")))
    cat.register(DatasetSpec("biblical_01", bib, preprocess=lambda d: normalise_scores(d, "biblical_01")))
    cat.register(DatasetSpec("paraphrase-ro", para, splits=("train", "dev"), scored=False))
    return cat


def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train from the union of a scored and an unscored set, dev and test
    from the scored one (A6, A7, A17, H1)."""
    cat = stand_in_catalog(sf_dir)
    parts = cat.load_parts(spark, ["ro-sts", "paraphrase-ro"], "ro-sts", "ro-sts")
    return parts.select("part", "dataset", "pair_id", rnd("score").alias("score"), "text1", "text2")


def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the scored pairs as headerless TSV, the unscored pairs as TSV and
    the 0..100 pairs as CSV with a header, all compressed, then read all three back with the
    source readers (A1, A2, A3, A14).  Equals the original tables."""
    root = scratch_dir(spark, "tsv-roundtrip")
    ro, para, bib = f"{root}/ro-sts", f"{root}/paraphrase", f"{root}/biblical"
    write_scored_tsv(fx.text_pairs(spark, sf_dir, 6), ro, compression="gzip")
    write_unscored_tsv(fx.turn_pairs(spark, sf_dir), para, compression="gzip")
    write_header_csv(fx.text_pairs(spark, sf_dir, 101).select("text1", "text2", "score"), bib, compression="gzip")
    a = read_scored_tsv(spark, ro, multiline=True).withColumn("dataset", F.lit("ro-sts"))
    b = read_unscored_tsv(spark, para, multiline=True).withColumn("dataset", F.lit("paraphrase-ro"))
    c = read_header_csv(spark, bib, multiline=True).withColumn("dataset", F.lit("biblical_01"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c.select("text1", "text2", "score", "dataset"), allowMissingColumns=True)
    return u.select("dataset", "score", "text1", "text2")


QUERIES.update({
    "tokenise_pad": tokenise_pad,
    "encode_score": encode_score,
    "augment_lookup": augment_lookup,
    "catalog_union": catalog_union,
    "tsv_roundtrip": tsv_roundtrip,
})


# -- I1 I2 (rows-only check) ---------------------------------------------------------

def _scored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_pairs with features, split 70/15/15 by the exact stratified split
    on the score class.  The feature table and the first split are
    checkpointed: each split step reads its input several times."""
    m = _materialize(spark)
    cols = ["pair_id", "score", *FEATURES]
    p = m(pair_features(fx.vec_pairs(spark, sf_dir)).select(*cols).withColumn("skey", F.round(F.col("score") * 9).cast("int")))
    s1 = m(stratified_split(p, "pair_id", "skey", 0.3, seed="fit-1", out="part", first="train", second="temp"))
    tr = s1.where(F.col("part") == "train")
    s2 = stratified_split(s1.where(F.col("part") == "temp").drop("part"), "pair_id", "skey", 0.5, seed="fit-2",
                          out="part", first="dev", second="test")
    return tr.select("part", *cols).unionByName(s2.select("part", *cols))


def _fit_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, "n", *[rnd(c).alias(c) for c in ("pearson", "spearman", "mse")])


REG_PARAMS = [0.0, 0.01, 0.1]


def regressor_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on train pair features, choose the feature on dev, report the
    chosen one on dev and test (I1)."""
    parts = _materialize(spark)(_scored_parts(spark, sf_dir))
    return _fit_columns(train_and_report(parts), "part", "feature")


def _noisy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and features of vectors k and k + 2."""
    e = fx.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    a = e.select("vec_id", as_double_array("embedding").alias("u"), F.col("label").alias("la"))
    b = e.select((F.col("vec_id") - 2).alias("vec_id"), as_double_array("embedding").alias("v"), F.col("label").alias("lb"))
    noisy = pair_features(a.join(b, "vec_id").select("u", "v", "la", "lb")).withColumn(
        "score", F.lit(1.0) - F.abs(F.col("la") - F.col("lb")) / F.lit(9.0))
    return noisy.select("score", *FEATURES)


def staged_fit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 on a large noisy set (vector k with k + 2), stage 2 on what it
    leaves over on the clean train part (I2)."""
    parts = _materialize(spark)(_scored_parts(spark, sf_dir))
    return _fit_columns(staged_fit(_noisy_pairs(spark, sf_dir), parts), "part")


def pair_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap and length ratio of the whole texts of every pair."""
    d = text_features(fx.text_pairs(spark, sf_dir, 6).select("pair_id", "text1", "text2"))
    return d.select("pair_id", rnd("f_overlap").alias("f_overlap"), rnd("f_length").alias("f_length"))


def _parts_with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split pairs with all five features: vectors k and k + 1, documents k and k + 1."""
    texts = text_features(fx.text_pairs(spark, sf_dir, 6).select("pair_id", "text1", "text2")).select("pair_id", "f_overlap", "f_length")
    return _scored_parts(spark, sf_dir).join(texts, "pair_id")


def regressor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge over cosine, distance, angle, token overlap and length ratio for
    every ridge weight, chosen on dev, reported on dev and test (I1, I4)."""
    rows, _ = fit_features(_materialize(spark)(_parts_with_texts(spark, sf_dir)), PAIR_FEATURES, RIDGES)
    return rows.select("part", "reg_param", "n", *[rnd(c).alias(c) for c in ("pearson", "spearman", "mse")], "chosen")


def staged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 over three features on noisy pairs (vectors k and k + 2); stage 2
    on the clean train part with stage 1's weights as its prior (I2)."""
    parts = _materialize(spark)(_scored_parts(spark, sf_dir))
    rows, _ = fit_stages(_noisy_pairs(spark, sf_dir), parts, FEATURES, RIDGES[0], RIDGES)
    return rows.select("part", "reg_param", "n", *[rnd(c).alias(c) for c in ("pearson", "spearman", "mse")], "chosen")


# The ridge weights of the fits over several features.
RIDGES = [0.01, 0.1, 1.0]

# -- J1 J2 ---------------------------------------------------------------------------

def stream_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log replayed as a file stream; running n, Pearson and mean
    loss per stage (J1).  ``availableNow`` over all files equals the batch query."""
    p = fx.predictions(spark, sf_dir).withColumn(
        "loss", F.pow(F.col("y_hat") / F.lit(105000.0) - F.col("y") / F.lit(50.0), 2))
    src = scratch_dir(spark, "pred-stream")
    n_files = max(1, spark.sparkContext.defaultParallelism)
    p.repartition(n_files, "batch_id").write.parquet(src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", max(1, n_files // 3)).parquet(src)
    out = run_complete_to_table(stream_metrics(stream, ["stage"], "y", "y_hat", "loss"), spark, "stream-metrics")
    return out.select("stage", "n", rnd("pearson").alias("pearson"), rnd("avg_loss").alias("avg_loss"))


def stream_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman per stage after the whole prediction stream, from the count
    table that every micro-batch adds to (J1)."""
    p = fx.predictions(spark, sf_dir).select("stage", "batch_id", "y", "y_hat")
    src = scratch_dir(spark, "pred-rank-stream")
    n_files = max(1, spark.sparkContext.defaultParallelism)
    p.repartition(n_files, "batch_id").write.parquet(src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", max(1, n_files // 3)).parquet(src)
    out = stream_rank_metrics(stream, spark, "stage", "y", "y_hat", "stream-spearman")
    return out.select("stage", "n", rnd("spearman").alias("spearman"))


# Micro-batches of the replay, and the bucket width of y_hat.
RANK_STEPS, Y_HAT_WIDTH = 6, 100.0


def stream_spearman_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman per stage after every micro-batch, predictions replayed in
    order of their order key; y_hat at a resolution of 100 (J1)."""
    p = fx.predictions(spark, sf_dir).select("l_orderkey", "stage", F.col("y").cast("double").alias("y"), F.col("y_hat").cast("double").alias("y_hat"))
    path = scratch_dir(spark, "rank-steps")
    state = RankLevels(spark, f"{path}/ranks", ["stage"], "y", "y_hat", fan=3, widths=(None, Y_HAT_WIDTH))
    stream = lambda: spark.readStream.schema(p.schema).parquet(f"{path}/in")
    replay_in_order(p, f"{path}/in", "l_orderkey", RANK_STEPS, spark.sparkContext.defaultParallelism,
                    lambda: run_available(stream(), f"{path}/checkpoint", state.update))
    return state.running(p).select(F.col("batch").cast("int").alias("batch"), "stage", "n", rnd("spearman").alias("spearman"))


def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, Pearson and mean batch loss of every (run, stage, epoch), emitted when
    the epoch closes; several runs on one checkpoint take the stream in (J1)."""
    p = fx.prediction_steps(spark, sf_dir)
    path = scratch_dir(spark, "epoch-metrics")
    stream = lambda: spark.readStream.schema(p.schema).parquet(f"{path}/in")
    seconds = p.withColumn("second", F.unix_seconds("at"))
    replay_in_order(seconds, f"{path}/in", "second", 2, spark.sparkContext.defaultParallelism, lambda: run_epoch_metrics(stream(), f"{path}/state"))
    out = run_epoch_metrics(stream(), f"{path}/state")
    return out.select("run_id", "stage", "epoch", "n", "n_batches", rnd("pearson").alias("pearson"), rnd("avg_loss").alias("avg_loss"), "complete")


def stream_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch log replayed in epoch order as a file stream; the patience
    monitor gives one stop event per run that stops (J2)."""
    log = _materialize(spark)(fx.epoch_log(spark, sf_dir).select("run_id", "epoch", "value"))
    src = scratch_dir(spark, "epoch-stream")
    n_files = max(1, spark.sparkContext.defaultParallelism)
    monitor = PatienceMonitor(spark, "stream-stop", patience=4)
    stream = spark.readStream.schema("run_id long, epoch long, value double").parquet
    replay_in_order(log, src, "epoch", 4, n_files, lambda: monitor.feed(stream(src)))
    return monitor.stops()


def grid_fit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration (feature and ridge weight) fitted on train and
    scored on dev and test, one row each; the best on dev is chosen (I4)."""
    parts = _materialize(spark)(_scored_parts(spark, sf_dir))
    return grid_fit(parts, REG_PARAMS).select("config_pos", "feature", "reg_param", "dev_n", "test_n",
                      *[rnd(f"{p}_{c}").alias(f"{p}_{c}") for p in ("dev", "test") for c in ("pearson", "mse")])


QUERIES.update({
    "grid_fit": grid_fit_q,
    "pair_text_features": pair_text_features,
    "regressor_features": regressor_features,
    "staged_features": staged_features,
    "regressor_eval": regressor_eval,
    "staged_fit": staged_fit_q,
    "stream_metrics": stream_metrics_q,
    "stream_spearman": stream_spearman,
    "stream_spearman_steps": stream_spearman_steps,
    "stream_epochs": stream_epochs,
    "stream_stop": stream_stop,
})


# -- D13, K3, A14, A18, K2 ------------------------------------------------------------

def categorical_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical cross-entropy per row: an order's lines are the columns,
    with soft targets (D13)."""
    li = fx.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") / F.lit(10000.0)).cast("double").alias("logit"), (F.col("l_quantity") / F.lit(50.0)).cast("double").alias("target"))
    return categorical_crossentropy(li, ["l_orderkey"]).select("l_orderkey", rnd("ce").alias("ce"))


def loss_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both losses that can be chosen by name, on the same rows (K3)."""
    p = fx.vec_pairs(spark, sf_dir)
    each = [select_loss(name)(p).select(F.lit(name).alias("name"), "batch_id", rnd("loss").alias("loss")) for name in ("MSE", "AnglE")]
    return each[0].unionByName(each[1])


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every run written as JSON objects and read back."""
    rows = fx.run_metrics(spark, sf_dir)
    path = scratch_dir(spark, "results")
    write_results(rows, path)
    return spark.read.schema(rows.schema).json(path).select("run_id", *[rnd(m).alias(m) for m in RESULT_METRICS])


def catalog_train_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and dev without a test part, dev from a set without scores."""
    parts = stand_in_catalog(sf_dir).load_parts(spark, "ro-sts", "paraphrase-ro")
    return parts.select("part", "dataset", "pair_id", rnd("score").alias("score"), "text1", "text2")


def token_profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """An encoder of the caller's own: tokens, distinct tokens, characters."""
    found = tokens(text_col)
    parts = [F.size(found), F.size(F.array_distinct(found)), F.length(F.coalesce(text_col, F.lit("")))]
    return docs.select(id_col, F.array(*[x.cast("double") for x in parts]).alias("vec"))


def encode_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents scored with an encoder given by the caller (K2)."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = fx.text_pairs(spark, sf_dir, 6).select("pair_id", F.col("pair_id").alias("doc_a"), (F.col("pair_id") + 1).alias("doc_b"))
    return score_pairs(docs, pairs, "doc_id", "text", "doc_a", "doc_b", encoder=token_profile).select("pair_id", rnd("cos").alias("cos"))


QUERIES.update({
    "categorical_loss": categorical_loss,
    "loss_by_name": loss_by_name,
    "results_roundtrip": results_roundtrip,
    "catalog_train_dev": catalog_train_dev,
    "encode_custom": encode_custom,
})


# -- filtered lookups (B7, C8) and bucketed tables (G5, G6, A17) --------------------

def key_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by whether their key is rare: the rare ones by the anti join with the
    common keys, the common ones by the anti join with the rare keys, each on
    the rows that a Bloom filter of the listed keys does not rule out (B7)."""
    s = fx.strata(spark, sf_dir, 50)
    rare = rare_keys(s, "skey")
    common = key_counts(s, "skey").where("n > 1").select("skey")
    a = drop_keys(s, common, "skey").withColumn("kind", F.lit("rare"))
    b = drop_keys(s, rare, "skey").withColumn("kind", F.lit("common"))
    return a.unionByName(b).select("doc_id", "skey", "kind")


def augment_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``augment_lookup`` with a Bloom filter of the translation memory before
    the join: sentences that it rules out are not exchanged (C8).  The routed
    triplets are written first, as both sides of the filter read them."""
    m = _materialize(spark)
    out = apply_translation_filtered(m(_routed_triplets(spark, sf_dir)), m(fx.translation_memory(spark, sf_dir)))
    return out.select("pair_id", "batch_id", "route", "lang", "translated", "sentence1", "sentence2", "sentence3")


def encode_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_score`` over vectors written in buckets by document: the two
    joins exchange pairs only (G5, G6)."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    tp = normalise_scores(fx.text_pairs(spark, sf_dir, 6), "ro-sts").select(
        "pair_id", F.col("pair_id").alias("doc_a"), (F.col("pair_id") + 1).alias("doc_b"), "score")
    vectors = spark.table(encode_bucketed(docs, "doc_id", "text"))
    j = score_stored_pairs(vectors, tp, "doc_id", "doc_a", "doc_b")
    return j.select("pair_id", rnd("score").alias("sim"), rnd("cos").alias("prediction"),
                    rnd(F.pow(F.col("cos") - F.col("score"), 2)).alias("sq_error"))


def parts_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and pair texts written in buckets by pair and joined without an
    exchange: pairs, characters and mean score per part (A17, A16)."""
    pairs = normalise_scores(fx.text_pairs(spark, sf_dir, 6), "ro-sts").select("pair_id", "score", "text1", "text2")
    u = hash_unit(F.lit("split"), F.col("pair_id"))
    parts = fx.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id")).withColumn(
        "part", F.when(u < 0.7, "train").when(u < 0.85, "dev").otherwise("test"))
    texts = spark.table(write_bucketed(pairs, "pair_id", "pair_texts"))
    j = spark.table(write_bucketed(parts, "pair_id", "pair_parts")).join(texts, "pair_id")
    return j.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text1") + F.length("text2")).cast("bigint").alias("n_chars"),
        rnd(F.avg("score")).alias("mean_score"))


QUERIES.update({
    "key_filtered": key_filtered,
    "augment_filtered": augment_filtered,
    "encode_stored": encode_stored,
    "parts_bucketed": parts_bucketed,
})
