import zlib

from simpairs.llm.language import LanguageScorer, fit_languages, identify_languages
from tests.conftest import SF01
from tests.llm.helpers import EDGE_DOCS, docs_of, edge_docs, empty_docs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify_languages(docs).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    from pyspark.sql import functions as F
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    spoilt = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    one = {(r.doc_id, r.lang_pred, r.score) for r in identify_languages(docs).collect()}
    assert one == {(r.doc_id, r.lang_pred, r.score) for r in identify_languages(spoilt).collect()}


def test_words_first_then_shorter_grams(spark):
    rows = [(i, "the house and the garden", "en", None, 0) for i in range(40)] + [(100 + i, "das haus und der garten", "de", None, 0) for i in range(40)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long"))
    scorer = LanguageScorer(model)
    assert [f for f, _ in scorer.features("the")] == [model.words["the"]]
    backed = scorer.features("gartenhaus")
    assert len(backed) > 1 and abs(sum(w for _, w in backed) - 1) < 1e-9 and all(f >= len(model.words) for f, _ in backed)
    assert scorer.predict(["gartenhaus", "garden", "", "123", None])[0] == ["de", "en", "und", "und", "und"]


def test_edge_rows(spark):
    got = identify_languages(edge_docs(spark)).collect()
    assert len(got) == len(EDGE_DOCS)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert identify_languages(empty_docs(spark)).count() == 0
    plain = docs_of(spark, [(1, "text")]).selectExpr("*", "cast(null as string) lang")
    assert [(r.lang_pred, r.score) for r in identify_languages(plain).collect()] == [("und", 0.0)]


def test_one_unbroken_text_of_a_million_letters(spark):
    """Work follows the length of a word, in training and in scoring."""
    import time

    rows = [(1, "ab" * 500_000, "xx"), (2, "the house is here", "en"), (3, "the mouse is there", "en")]
    start = time.time()
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")).collect()}
    assert time.time() - start < 120 and len(got) == 3


def test_a_small_language_beside_large_ones(spark):
    """Three languages of thousands of words each and one of forty texts."""
    import random

    rng = random.Random(8)
    rows, letters = [], {"aa": "bcdfg", "bb": "hjklm", "cc": "npqrs", "small": "tvwxz"}
    for lang, own in letters.items():
        words = ["".join(rng.choices(own + "aeiou", k=rng.randrange(4, 10))) for _ in range(6000 if lang != "small" else 500)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=30)), lang) for i in range(1200 if lang != "small" else 40)]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    truth = {i: lang for i, _, lang in rows}
    small = [r.lang_pred == "small" for r in got if truth[r.doc_id] == "small"]
    assert small and sum(small) / len(small) >= 0.9
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.95


def test_scores_equal_the_definition(spark):
    """Brute force over all entries of the fitted model."""
    import math

    from simpairs.llm import language as la

    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 200")
    model = la.fit_languages(docs)
    back = [dict() for _ in model.languages]
    for i in range(len(model.start) - 1):
        for e in range(model.start[i], model.start[i + 1]):
            back[model.language[e]][i] = model.gain[e]
    scorer = la.LanguageScorer(model)
    for text in [r.text for r in docs.where("doc_id < 12").collect()] + ["qqqzzz unseenword", "Straße x²"]:
        total = [0.0] * len(model.languages)
        for word in la.words_of(text or ""):
            if word in model.words:
                parts = [(model.words[word], 0)]
            else:
                edged = la.EDGE + word + la.EDGE
                hits = [next((g for n in range(5, 0, -1) if (g := edged[i:i + n]) in model.grams), None) for i in range(len(edged))]
                parts = [(model.grams[g], 1) for g in hits if g is not None]
            for f, kind in parts:
                for k in range(len(total)):
                    total[k] += (model.unseen[kind][k] + back[k].get(f, 0.0)) / len(parts)
        names, sure = scorer.predict([text])
        if text:
            top = max(total)
            p = [math.exp(x - top) for x in total]
            assert names[0] == model.languages[p.index(max(p))] and abs(sure[0] - max(p) / sum(p)) < 1e-6
