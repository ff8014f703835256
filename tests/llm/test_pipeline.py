"""Each stage on its own input, against the operators' rows and brute force."""

from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from simpairs.llm.mixing import mix_counts
from simpairs.llm.quality import score_quality
from simpairs.llm.queries import tokenizer_path
from tests.conftest import SF001, SF01
from tests.llm.helpers import CLASHES, DOC_SCHEMA, EDGE_DOCS, edge_docs, empty_docs
from tests.llm.test_near_dup import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_named_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "mixing", "bpe"]


def test_quality_stage_keeps_what_the_classifier_accepts(spark, docs):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    want = Counter(r.doc_id for r in score_quality(docs, labels).collect() if r.predicted == 1)
    out = pipeline.quality(spark, docs, SF01)
    assert out.columns == docs.columns and ids(out) == want
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & set(want)) >= 0.98 * len(good)  # clean documents stay


def test_exact_stage_keeps_one_row_of_each_text(spark, docs):
    out = pipeline.exact(spark, docs, SF01)
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max(r.doc_id, best.get(r.text or "", r.doc_id))
    assert out.columns == docs.columns and ids(out) == Counter(best.values())


def test_near_stage_keeps_one_of_each_group(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter(i for i, (_, _, kept) in brute(rows, 5).items() if kept)
    out = pipeline.near(spark, docs, SF01)
    assert out.columns == docs.columns and ids(out) == want


def test_mixing_stage_repeats_documents(spark, docs):
    out = pipeline.mixing(spark, docs, SF01)
    assert out.columns == docs.columns
    assert ids(out) == Counter({r.doc_id: r.copies for r in mix_counts(docs).collect() if r.copies})


def test_run_encodes_what_is_left(spark):
    library = Tokenizer.from_file(tokenizer_path())
    out = pipeline.run(spark, SF001).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert out and all(r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids) for r in out)


def test_edge_rows_pass_every_stage(spark):
    rows = edge_docs(spark)
    for _, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, rows, SF001)
        assert out.columns == rows.columns and out.count() >= 0
    texts = Counter(r.text or "" for r in pipeline.exact(spark, rows, SF001).collect())
    assert set(texts.values()) == {1} and set(texts) == {r[1] or "" for r in EDGE_DOCS}
    same_id = spark.createDataFrame([(5, "one text", "en", "a", 1), (5, "another one", "en", "a", 1), (9, "another one", "en", "a", 1)], DOC_SCHEMA)
    assert sorted((r.doc_id, r.text) for r in pipeline.exact(spark, same_id, SF001).collect()) == [(5, "one text"), (9, "another one")]
    assert CLASHES and pipeline.near(spark, empty_docs(spark), SF001).count() == 0
