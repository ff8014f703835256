"""Language identification: known words first, then shorter and shorter n-grams.

A word that the model knows adds its log frequency in each language.  An
unseen word is covered by its longest known character n-grams, from five
letters down to one, starting at every position; their log frequencies are
averaged, so a word weighs as one word either way.

Words are cut and lower-cased by one rule (``words_of``) in training and in
scoring.  Every language keeps its own most frequent words and n-grams, so a
small language loses nothing to large ones, and the model holds only the
entries that a language has: its size follows the number of languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..session import ship_package
from .common import crc_fold, staged, text_slices

#: Bound of the fit: labelled rows read per language (fewer rows: all).
SAMPLE_ROWS = 3_000
#: Bounds of the model that is broadcast: entries kept per language, most
#: frequent first.
MODEL_WORDS = 50_000
MODEL_GRAMS = 50_000
LONGEST = 5
SMOOTH = 0.5
CHUNK_MEMORY = 300_000
SLICE_CHARS = 1_000_000
UNKNOWN = "und"
EDGE = "\x02"  # stands for a word's start and end; no letter
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


@dataclass
class LanguageModel:
    """Languages, numbers of words and n-grams, and what an entry adds to the
    log frequency that its language gives to anything unseen."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    start: np.ndarray      # entries of number i: start[i] to start[i + 1]
    language: np.ndarray   # of each entry
    gain: np.ndarray       # of each entry
    unseen: np.ndarray     # log frequency of an unseen word, of an unseen n-gram, per language


def _entries(rows: list, at: dict[str, int], base: int) -> tuple[dict[str, int], list[tuple[int, int, float]], np.ndarray]:
    """Numbers of the keys, their entries, and each language's log frequency of
    an unseen key."""
    number: dict[str, int] = {}
    for key, _, _ in rows:
        number.setdefault(key, base + len(number))
    total = np.full(len(at), SMOOTH * max(1, len(number)))
    for _, lang, n in rows:
        total[at[lang]] += n
    found = [(number[key], at[lang], float(np.log(n + SMOOTH) - np.log(SMOOTH))) for key, lang, n in rows]
    return number, found, np.log(SMOOTH) - np.log(total)


def _top(counted: DataFrame, key: str, most: int) -> list[tuple[str, str, int]]:
    """(key, lang, n) of every language's ``most`` most frequent keys: at most
    that many rows a language reach the driver."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))
    rows = counted.withColumn("place", place).where(F.col("place") <= most).select(key, "lang", "n").toArrow().to_pydict()
    return sorted(zip(rows[key], rows["lang"], rows["n"]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to counts of words, combined per batch."""
    for batch in batches:
        held: dict[str, Counter] = {}
        for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
            held.setdefault(lang, Counter()).update(words_of(text))
        yield _counts(held, "word")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) rows to counts of n-grams.  One pass over the letters
    for each length, so the work follows the length of a word."""
    for batch in batches:
        held: dict[str, Counter] = {}
        for lang, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            counts, text = held.setdefault(lang, Counter()), EDGE + word + EDGE
            for size in range(1, LONGEST + 1):
                for i in range(len(text) - size + 1):
                    counts[text[i:i + size]] += n
            if sum(map(len, held.values())) > CHUNK_MEMORY:
                yield _counts(held, "gram")
                held = {}
        yield _counts(held, "gram")


def _counts(held: dict[str, Counter], key: str) -> pa.RecordBatch:
    rows = [(lang, k, n) for lang, counts in held.items() for k, n in counts.items()]
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", key, "n"])


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                  sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Counts over at most about ``sample_rows`` labelled rows of each language,
    drawn by a hash of the id.  Rows without language or text are left out."""
    ship_package(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = rows.groupBy(F.col(lang_col).alias("__l")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not per:
        return LanguageModel([], {}, {}, np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros((2, 0)))
    rate = F.create_map(*[F.lit(x) for r in per for x in (r[0], min(1.0, sample_rows / r[1]))])
    drawn = rows.where(hash_unit(F.lit("language"), F.col(id_col)) < rate[F.col(lang_col)])
    words = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count_words, "lang string, word string, n long")
    words = staged(words.groupBy("word", "lang").agg(F.sum("n").alias("n")), "language-words")
    grams = words.select("lang", "word", "n").mapInArrow(_count_grams, "lang string, gram string, n long")
    grams = grams.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in per)
    at = {x: i for i, x in enumerate(languages)}
    w, w_found, w_unseen = _entries(_top(words, "word", MODEL_WORDS), at, 0)
    g, g_found, g_unseen = _entries(_top(grams, "gram", MODEL_GRAMS), at, len(w))
    found = sorted(w_found + g_found)
    start = np.searchsorted([f[0] for f in found], np.arange(len(w) + len(g) + 1))
    return LanguageModel(languages, w, g, start, np.array([f[1] for f in found], int), np.array([f[2] for f in found], float), np.array([w_unseen, g_unseen]))


class LanguageScorer:
    """Scores texts, remembering the scores of white-space chunks."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def features(self, chunk: str) -> list[tuple[int, float]]:
        found = []
        for word in words_of(chunk):
            if (w := self.model.words.get(word)) is not None:
                found.append((w, 1.0))
                continue
            text, hits, gram = EDGE + word + EDGE, [], self.model.grams.get
            for i in range(len(text)):
                for n in range(LONGEST, 0, -1):
                    if (g := gram(text[i:i + n])) is not None:
                        hits.append(g)
                        break
            found += [(g, 1.0 / len(hits)) for g in hits]
        return found

    def learn(self, chunks: list[str]) -> None:
        first, model = len(self.row), self.model
        owner, number, weight = [], [], []
        for k, chunk in enumerate(chunks):
            self.row[chunk] = first + k
            for f, w in self.features(chunk):
                owner.append(k)
                number.append(f)
                weight.append(w)
        size = len(model.languages)
        fresh = np.zeros((len(chunks), size))
        if owner:
            at, feature, share = np.array(owner), np.array(number), np.array(weight)
            for kind, mine in enumerate((feature < len(model.words), feature >= len(model.words))):
                fresh += np.bincount(at[mine], share[mine], len(chunks))[:, None] * model.unseen[kind]
            # Every feature's entries, one after the other.
            count = model.start[feature + 1] - model.start[feature]
            entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(model.start[feature], count)
            cell = np.repeat(at, count) * size + model.language[entry]
            fresh += np.bincount(cell, model.gain[entry] * np.repeat(share, count), len(chunks) * size).reshape(fresh.shape)
        self.scores = np.vstack([self.scores, fresh])

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        if len(self.row) > CHUNK_MEMORY:
            self.forget()
        split = [(t or "").split() for t in texts]
        fresh: set[str] = set()
        for chunks in split:
            fresh.update(chunks)
        fresh.difference_update(self.row)
        self.learn(sorted(fresh))
        names, sure = [], []
        get = self.row.__getitem__
        for t, chunks in zip(texts, split):
            if not self.model.languages or not t or not any(map(str.isalpha, t)):
                names.append(UNKNOWN)
                sure.append(0.0)
                continue
            total = self.scores[np.fromiter(map(get, chunks), np.int64, len(chunks))].sum(axis=0)
            p = np.exp(total - total.max())
            best = int(np.argmax(p))
            names.append(self.model.languages[best])
            sure.append(float(p[best] / p.sum()))
        return names, sure


def language_column(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column.  The model is broadcast: at
    most MODEL_WORDS + MODEL_GRAMS entries a language."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        if not held:
            held["scorer"] = LanguageScorer(shared.value)
        scorer = held["scorer"]
        texts = column.to_pylist()
        names, sure = [], []
        for start, stop in text_slices(texts, SLICE_CHARS):
            a, b = scorer.predict(texts[start:stop])
            names += a
            sure += b
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       folds: int = 3, held_fold: int = 1) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``.

    Rows whose crc32 of the id leaves ``held_fold`` modulo ``folds`` are held
    out; the model learns from the text and language of the others.  A null
    text, or one without a letter, is ``und`` with score 0; so is every row if
    there is nothing to learn from.  A text with letters of which nothing is
    known gets the first language with an even score.  Ties go to the first
    language in code-point order.  Null ids count as fold 0, repeated rows are
    predicted alike, other columns are not read.
    """
    model = fit_languages(docs.where(crc_fold(id_col, folds) != held_fold), text_col, lang_col, id_col)
    guess = docs.select(F.col(id_col), (crc_fold(id_col, folds) == held_fold).alias("held_out"),
                        language_column(docs, model, F.col(text_col)).alias("__g"))
    return guess.select(id_col, "held_out", "__g.lang_pred", "__g.score")
