import re
from collections import Counter, defaultdict

import pytest

from simpairs.llm.mixing import MAX_REPEAT, mix, mix_counts, source_targets
from tests.conftest import SF01
from tests.llm.helpers import EDGE_DOCS, edge_docs, empty_docs


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """Share by weight, stop at three times the size, reshare the excess, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        left = total - sum(full.values())
        rest = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 3, "d": 1000, None: 5}, {"b": 0, "a": 10}, {"x": 7},
    {"a": 10, "b": 10, "c": 1, "d": 1, "e": 1, "f": 500},
])
def test_targets_are_the_reshared_weights(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    for s, t in targets(sizes).items():
        assert got[s] == pytest.approx(t, abs=1e-6)


def test_documents_meet_their_targets(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = mix_counts(docs).collect()
    assert len(got) == docs.count()
    size = {r.doc_id: words(r.text) for r in docs.collect()}
    assert all(r["size"] == size[r.doc_id] for r in got)
    taken, target, biggest = Counter(), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= MAX_REPEAT and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        biggest[r.source] = max(biggest[r.source], r["size"])
    for s in target:  # one document of slack, two at the ends
        assert abs(taken[s] - target[s]) <= 2 * biggest[s]
    again = {(r.doc_id, r.taken) for r in mix_counts(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    copies = Counter({r.doc_id: r.copies for r in got if r.copies})
    assert Counter(r.doc_id for r in mix(docs).select("doc_id").collect()) == copies


def test_edge_rows(spark):
    docs = edge_docs(spark)
    got = mix_counts(docs).collect()
    assert len(got) == len(EDGE_DOCS)
    total = sum(words(r[1]) for r in EDGE_DOCS)
    assert sum({r.source: r.source_size for r in got}.values()) == total
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert mix(docs).columns == docs.columns
    assert mix_counts(empty_docs(spark)).count() == 0
    assert mix(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mix_counts(blank).collect()] == [(0.0, 0), (0.0, 0)]
