import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simpairs.llm import spelling as sp
from tests.conftest import SF01
from tests.llm.helpers import docs_of, edge_docs, empty_docs


def words_of(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def near_of(n):
    """Brute force over words that share a word with one letter left out."""
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i] + w[i + 1:]].add(w)
        by[w].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def expected(n):
    near, form = near_of(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def result(df):
    got = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected(words_of(rows))
    assert result(sp.spelling_variants(docs)) == want
    assert sum(w[1] is not None for w in want) > 20


def test_long_lists_are_cut_without_losing_pairs(spark):
    """Hot prefixes and suffixes, long words, and a list limit of three."""
    import random

    rng = random.Random(3)
    words = {"constant" + "".join(rng.choices("abe", k=rng.randrange(0, 5))) for _ in range(400)}
    words |= {"".join(rng.choices("ab", k=rng.randrange(1, 5))) + "fication" for _ in range(200)}
    words |= {"x" * k for k in range(7, 40)} | {"aaaaaaa" + c for c in "abcdefghijklmnopqrstuvwxyzàéü"} | {"é" * 9, "é" * 10, "a" * 6 + "÷"}
    n = {w: rng.randrange(2, 300) for w in sorted(words)}
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    for limit in (3, 64):
        got = sp.near_pairs(vocab, limit).collect()
        pairs = [tuple(sorted((r.a, r.b))) for r in got]
        assert len(set(pairs)) == len(pairs)
        near = near_of(n)
        assert set(pairs) == {tuple(sorted((a, b))) for a in n for b in near[a]}
        assert all(n[r.a] == r.na and n[r.b] == r.nb for r in got)


LETTERS = st.text(alphabet="abc", min_size=2, max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.sets(LETTERS, max_size=25), st.integers(2, 5))
def test_walk_of_a_sorted_list_equals_brute_force(words, m):
    words = sorted(w for w in words if len(w) in (m, m + 1))
    got = sp.near_in_list(words, list(range(len(words))), m, 0, 0, 0)
    pairs = [tuple(sorted((a, b))) for a, _, b, _ in got]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b) and min(len(a), len(b)) == m}
    assert len(set(pairs)) == len(pairs) and set(pairs) == want


def test_chains_of_forms_end_at_the_root(spark):
    counts = {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "abcdefghijk": 2000}
    text = " ".join(w for w, c in counts.items() for _ in range(c))
    got = {r.word: r for r in sp.spelling_variants(docs_of(spark, [(1, text)]), damage=False).collect()}
    assert {r.root for r in got.values()} == {"abcdefghijk"} and got["abcdefgh"].form == "abcdefghi"


def test_edge_rows(spark):
    docs = edge_docs(spark).withColumn("word", F.lit("clash")).withColumn("form", F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10, "Straßen STRASSEN Straßen ÀÉÎÕÜßÿ àéîõüßÿ ÀÉÎÕÜßÿ àéîõüßÿ straßen"), (None, "null-id nullid nullidx nullidx")]
    docs = docs.select("doc_id", "text", "word", "form").unionByName(docs_of(spark, rows[-2:]), allowMissingColumns=True)
    assert result(sp.spelling_variants(docs)) == expected(words_of(rows))
    assert sp.spelling_variants(empty_docs(spark)).count() == 0
