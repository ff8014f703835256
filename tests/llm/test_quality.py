import zlib

import numpy as np

from simpairs.llm.quality import FEATURES, fit_pu, score_quality, style_features
from tests.conftest import SF01
from tests.llm.helpers import EDGE_DOCS, edge_docs, empty_docs

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id: r.quality for r in labels.collect()}
    got = score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in held) >= 0.95 * len(held)


def test_held_out_labels_are_not_read(spark):
    from pyspark.sql import functions as F
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet").limit(400) for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    spoilt = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    hidden = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    one = {(r.doc_id, r.score) for r in score_quality(docs, labels).collect()}
    assert one == {(r.doc_id, r.score) for r in score_quality(hidden, spoilt).collect()}


def test_positives_and_unlabelled_suffice():
    """Two clouds; labels on one only, the other hides in the unlabelled rows."""
    rnd = np.random.default_rng(2)
    n = len(FEATURES)
    good, bad = (lambda k: rnd.normal(1, 1, (k, n))), (lambda k: rnd.normal(-1, 1, (k, n)))
    model = fit_pu(good(2000), np.vstack([good(1400), bad(600)]), 0.7)
    assert (model.score(good(500)) >= 0.5).mean() > 0.95 and (model.score(bad(500)) < 0.5).mean() > 0.95
    alone = fit_pu(np.empty((0, n)), good(5), 0.3)
    assert np.allclose(alone.score(good(4)), 0.3)


def test_features_have_names_and_are_finite():
    for t in (None, "", " ", "\n", "A!! | " * 9, "日本 ß", "x" * 10**6):
        x = style_features(t)
        assert len(x) == len(FEATURES) and np.isfinite(x).all()


def test_edge_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, None), (None, 1, 0), (8, None, 0), (99, 0, 0)], LABELS)
    got = score_quality(edge_docs(spark), labels).collect()
    assert len(got) == len(EDGE_DOCS) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in score_quality(edge_docs(spark), none).collect()} == {0.5}
    assert score_quality(empty_docs(spark), none).count() == 0
