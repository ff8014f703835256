"""Spelling variants: words one edit apart, grouped under their frequent form.

Near words are found by dynamic programming over sorted lists.  A query word
walks the sorted words of its list; the edit matrix is kept as one banded row
per prefix letter (three cells, as only one edit is asked for), and the rows of
the prefix that a word shares with the one before are reused.  When no cell of
a row is below two, every following word with that prefix is skipped.

One list of the whole vocabulary would have to reach every task.  Two words
one edit apart, the shorter of m letters, agree in the shorter's first half or
in its last half, so a word meets only words of the same m and half.  A list
that is still too long is cut the same way again: the rest of the word is
halved, and words agree in one more quarter, and so on.  A rest of one letter
bounds a list by the alphabet, so every cut ends, whatever the words are.  A
pair is taken from exactly one list.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import LOWER, UPPER, staged, text_slices

# The runs, the damage and the limits of the contract.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGE = 31
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a list that is walked as it is; longer lists are cut again.
LIST = 64
SLICE_CHARS = 2_000_000
HELD_WORDS = 200_000
_TO_LOWER = str.maketrans(UPPER, LOWER)
#: A form has at least RATIO times its word's count, and counts are below
#: 2^63 < RATIO^19: chains of forms have fewer than 2^5 links.
DOUBLINGS = 5


def damaged(run: str, doc_id) -> str:
    """The word of a lower-cased run, one letter less where the draw says so."""
    draw = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if draw % DAMAGE:
        return run
    at = draw % len(run)
    return run[:at] + run[at + 1:]


def _count(batches: Iterable[pa.RecordBatch], damage: bool, least: int) -> Iterator[pa.RecordBatch]:
    """(id, text) rows to counts of words, combined per task before any shuffle."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                found = Counter(w.lower() if w.isascii() else w.translate(_TO_LOWER) for w in RUN.findall(text) if len(w) >= least)
                if damage:
                    for run, n in found.items():
                        word = damaged(run, doc)
                        if len(word) >= least:
                            held[word] += n
                else:
                    held.update(found)
                if len(held) >= HELD_WORDS:
                    yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True, least: int = LEAST_LETTERS,
               at_least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all whole texts; ``damage`` deletes letters as the contract asks."""
    counted = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: _count(it, damage, least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def _part(word: str, first: str, last: str) -> Column:
    """The list key: m, the letters that a list shares at the start and the end."""
    return F.concat_ws("|", "m", F.expr(f"substring({word}, 1, {first})"), F.lit(""), F.expr(f"right({word}, {last})"))


def _lists(vocab: DataFrame) -> DataFrame:
    """Every word in its four lists: as the shorter (m letters) or the longer
    (m + 1) of a pair, by the first or the last half of the shorter.

    ``head`` and ``tail`` letters are shared; ``differ`` is the length of the
    prefix in which a pair must differ, so that the other half has not seen it."""
    d = vocab.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"))
    return _halved(d.select("word", "n", "m", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(0).alias("differ")))


def _halved(d: DataFrame) -> DataFrame:
    """Rows of a list in its two half lists."""
    cut = "head + (m - head - tail) div 2"
    sides = F.array(F.struct(F.expr(cut).cast("int").alias("head"), F.col("tail"), F.col("differ")),
                    F.struct(F.col("head"), F.expr(f"m - ({cut})").cast("int").alias("tail"), F.expr(cut).cast("int").alias("differ")))
    d = d.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.*")
    return d.withColumn("key", _part("word", "head", "tail"))


def near_in_list(words: list[str], counts: list[int], m: int, head: int, tail: int, differ: int) -> list[tuple[str, int, str, int]]:
    """The pairs (word, n, word, n) of one list at exactly one edit.

    The words share their first ``head`` and last ``tail`` letters, so the
    matrix covers the rest.  Lists without a shared start are sorted from
    their ends, so that the rest has long common prefixes either way.
    """
    back = head == 0
    order = sorted((w[::-1] if back else w, w, n) for w, n in zip(words, counts))
    skip, end = (tail, head) if back else (head, tail)
    rest = [r[skip:len(r) - end] for r, _, _ in order]
    size = len(rest)
    shared = [0] * size
    for i in range(1, size):
        a, b = rest[i - 1], rest[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[i] = k
    out = []
    short = m - head - tail
    for at, query in enumerate(rest):
        if len(query) != short:
            continue
        letters = query + "\0\0"  # beyond the end nothing matches
        rows = [(2, 0, 1)]  # cells left of, on and right of the diagonal
        i = 0
        while i < size:
            word = rest[i]
            keep = shared[i] if i else 0
            if keep < len(rows) - 1:
                del rows[keep + 1:]
            depth = len(rows) - 1
            x, y, z = rows[depth]
            dead = False
            while depth < len(word):
                c = word[depth]
                left = min(x + (letters[depth - 1] != c) if depth else 2, y + 1)
                mid = min(y + (letters[depth] != c) if depth <= short else 2, z + 1, left + 1)
                right = min(z + (letters[depth + 1] != c) if depth + 1 <= short else 2, mid + 1)
                x, y, z = left, mid, right
                depth += 1
                rows.append((x, y, z))
                if x > 1 and y > 1 and z > 1:
                    dead = True
                    break
            if dead:
                # Every following word with this prefix is out as well.
                i += 1
                while i < size and shared[i] >= depth:
                    i += 1
                continue
            gap = len(word) - short
            if (gap == 0 and y == 1 and i > at or gap == 1 and x == 1):
                a, b = order[at], order[i]
                if not differ or a[1][:differ] != b[1][:differ]:
                    out.append((a[1], a[2], b[1], b[2]))
            i += 1
    return out


PAIRS = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (rows sorted by key, next to one another) to their near pairs."""
    out: list[tuple] = []
    key, spec, words, counts = None, (0, 0, 0, 0), [], []
    for batch in batches:
        for now, word, n, *shape in zip(*[c.to_pylist() for c in batch.columns]):
            if now != key:
                if len(words) > 1:
                    out += near_in_list(words, counts, *spec)
                key, spec, words, counts = now, shape, [], []
            words.append(word)
            counts.append(n)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIRS)], schema=PAIRS)
            out = []
    if len(words) > 1:
        out += near_in_list(words, counts, *spec)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIRS)], schema=PAIRS)


def near_pairs(vocab: DataFrame, limit: int = LIST) -> DataFrame:
    """(a, na, b, nb): every two words of ``vocab`` (word, n; unique) that
    differ by one inserted, deleted or replaced code point, once."""
    ship_package(vocab.sparkSession)
    found = []
    rest = staged(_lists(vocab), "spelling-lists")
    while True:
        sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("m").alias("m"), F.first("head").alias("head"), F.first("tail").alias("tail"))
        # A list is too long only while there is a rest to halve.
        long = staged(sizes.where((F.col("rows") > limit) & (F.col("m") - F.col("head") - F.col("tail") > 1)).select("key"), "spelling-long")
        walkable = rest.join(sizes.where("rows > 1").select("key"), "key", "left_semi").join(long, "key", "left_anti")
        ordered = walkable.select("key", "word", "n", "m", "head", "tail", "differ").repartition("key").sortWithinPartitions("key")
        found.append(ordered.mapInArrow(_walk, "a string, na long, b string, nb long"))
        if long.isEmpty():
            break
        rest = staged(_halved(rest.join(long, "key", "left_semi")), "spelling-lists")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that is at least ten times the word's own n, ``root`` the last form of
    the chain.  Null texts have no words, a null id is written as nothing in
    the draw, an empty table gives an empty result; other columns are not read.
    """
    vocab = staged(vocabulary(docs, id_col, text_col, damage), "spelling-words")
    pairs = near_pairs(vocab)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = vocab.join(best, "word", "left")
    fits = -F.col("best.m") >= RATIO * F.col("n")
    rows = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"),
                                F.when(fits, -F.col("best.m")).alias("form_n")), "spelling-forms")
    # Only words with a form have a chain; each round doubles the link's reach.
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        links = staged(links, "spelling-links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(staged(links, "spelling-links"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
