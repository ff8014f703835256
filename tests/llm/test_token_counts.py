import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from simpairs.llm.token_counts import SECTION, attribute, token_counts
from tests.conftest import SF001
from tests.llm.helpers import docs_of, edge_docs, empty_docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_spans(library, text):
    """Character spans, byte by byte."""
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    at, out = 0, []
    for t in library.encode_ordinary(text):
        n = len(library.decode_single_token_bytes(t))
        out.append((owner[at], owner[at + n - 1] + 1))
        at += n
    return out


def brute(spans, sections, rule):
    counts, outside = [0.0] * len(sections), 0.0
    for a, b in spans:
        part = [max(0, min(b, y) - max(a, x)) for x, y in sections]
        rest = b - a - sum(part)
        if rule == "share":
            counts = [c + p / (b - a) for c, p in zip(counts, part)]
            outside += rest / (b - a)
        elif rule == "start":
            hit = [i for i, (x, y) in enumerate(sections) if x <= a < y]
            if hit:
                counts[hit[0]] += 1
            else:
                outside += 1
        elif max(part, default=0) and max(part) >= rest:
            counts[part.index(max(part))] += 1
        else:
            outside += 1
    return counts, outside


@pytest.mark.parametrize("rule", ["most", "start", "share"])
def test_spans_and_rules_against_brute_force(spark, library, rule):
    texts = ["Hello  world\n\n\nab", "ß👍é x", "one two three " * 5, "a", "   ", "日本語 text"]
    rnd = np.random.default_rng(4)
    rows, plan = [], {}
    for i, t in enumerate(texts):
        cuts = sorted(set(rnd.integers(0, len(t) + 1, 6).tolist()))
        plan[i] = [(x, y) for x, y in zip(cuts[:-1], cuts[1:]) if rnd.random() < 0.8]
        rows.append((i, t, [(f"s{x}", x, y) for x, y in plan[i]]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, parts array<{SECTION}>")
    got = token_counts(df, PATH, P.PATTERN, rule, F.col("parts")).collect()
    for i, t in enumerate(texts):
        want, outside = brute(token_spans(library, t), plan[i], rule)
        mine = {r.section: r for r in got if r.doc_id == i}
        assert [mine[k].n_tokens for k in range(len(want))] == pytest.approx(want), (i, rule)
        assert (mine[None].n_tokens if None in mine else 0) == pytest.approx(outside)
        assert [mine[k].name for k in range(len(want))] == [f"s{x}" for x, _ in plan[i]]


def test_lines_of_documents_add_up(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = token_counts(docs, PATH, P.PATTERN).groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count("section").alias("lines"), F.min("start").alias("lo"), F.max("stop").alias("hi")).collect()
    got = {r.doc_id: r for r in got}
    for r in docs.collect():
        g = got[r.doc_id]
        assert g.n == len(library.encode_ordinary(r.text)) and (g.lo, g.hi) == (0, len(r.text))
        assert g.lines == len([x for x in r.text.split("\n")[:-1]]) + bool(r.text.split("\n")[-1])


def test_crossing_tokens_are_counted_on_both_sides():
    counts, crossing = attribute(np.array([0, 4]), np.array([4, 6]), np.array([0, 3]), np.array([3, 6]), "most")
    assert counts.tolist() == [1, 1, 0] and crossing.tolist() == [1, 1, 0]


def test_edge_rows(spark):
    got = token_counts(edge_docs(spark), PATH, P.PATTERN).collect()
    assert {r.doc_id for r in got if r.doc_id in (1, 2)} == set()
    assert sum(r.doc_id == 4 for r in got) == 2 and all(r.section is not None for r in got)
    assert token_counts(empty_docs(spark), PATH, P.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, "abcdef", None), (2, "abcdef", [None, ("x", None, None), ("y", 2, 4), ("z", 5, 2), ("w", -3, 99)])],
                                f"doc_id long, text string, p array<{SECTION}>")
    rows = {(r.doc_id, r.section): r for r in token_counts(odd, PATH, P.PATTERN, "most", F.col("p")).collect()}
    assert set(rows) == {(1, None), (2, 0)} and (rows[2, 0].start, rows[2, 0].stop) == (0, 6)
    with pytest.raises(ValueError):
        token_counts(docs_of(spark, []), PATH, P.PATTERN, "middle")
