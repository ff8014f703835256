import random
import re

import numpy as np
import pytest

from simpairs.llm import near_dup as module
from simpairs.llm.near_dup import clearly_below, near_duplicates, registers, shingle_sets
from tests.conftest import SF01
from tests.llm.helpers import EDGE_DOCS, docs_of, edge_docs, empty_docs

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, percent=80):
    sets, root = sets_of(rows, k), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(rows[a][0]), find(rows[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets)}


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("k", [4, 5])
def test_documents_against_all_pairs(spark, k):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert answer(near_duplicates(docs, k)) == brute(rows, k)


def chained(seed, n, length=60, edits=3):
    """One base and copies at every distance around the threshold."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    base = [word() for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(length)] = word()
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("small, block, far", [(8, 1024, 200_000), (2, 16, 0)])
def test_a_large_group_around_the_threshold(spark, monkeypatch, small, block, far):
    monkeypatch.setattr(module, "SMALL", small)
    monkeypatch.setattr(module, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(module, "FAR_ROWS", far)
    rows = chained(1, 150) + [(i + 1000, t) for i, t in chained(2, 20, edits=1)] + [(2000 + i, f"alone {i} and no other text like it") for i in range(5)]
    assert answer(near_duplicates(docs_of(spark, rows), 4)) == brute(rows, 4)


def in_one_band(texts, k):
    sketch = registers(shingle_sets(texts, k))[:, :module.ROWS]
    return (sketch == sketch[0]).all()


def mosaics(k=4, clusters=10, body=60):
    """Clusters of near copies that are far from each other, but agree in the
    first band through the passages that all of them hold."""
    rnd = random.Random(5)
    passages = [" ".join(f"h{i}x{j}" for j in range(k)) for i in range(20_000)]
    sketch = registers(shingle_sets(passages, k))
    shared = " ".join(passages[int(np.argmax(sketch[:, r]))] for r in range(module.ROWS))
    rows = []
    for c in range(clusters):
        words = [f"c{c}w{rnd.randint(0, 10**6)}" for _ in range(body)]
        for i in range(3):
            w = list(words)
            w[rnd.randrange(body)] = f"e{c}e{i}"
            rows.append((10 * c + i, f"{shared} {' '.join(w)}"))
    assert in_one_band([t for _, t in rows], k)
    return rows


@pytest.mark.parametrize("far", [200_000, 0])
def test_far_members_lose_no_links(spark, monkeypatch, far):
    monkeypatch.setattr(module, "BANDS", 1)
    monkeypatch.setattr(module, "FAR_ROWS", far)
    rows = mosaics()
    want = brute(rows, 4)
    assert len({c for _, c, _ in want.values()}) < len(rows)
    assert answer(near_duplicates(docs_of(spark, rows), 4)) == want


def trimmed(length, cuts, k=4):
    """Texts cut from one of ``length`` words, which all agree in the first band."""
    for seed in range(1000):
        rnd = random.Random(seed)
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(length)]
        texts = [" ".join(words[a:length - b]) for a, b in cuts]
        if in_one_band(texts, k):
            return list(enumerate(texts))


@pytest.mark.parametrize("length, cuts", [
    (13, [(0, 2), (0, 0), (2, 0)]),  # 8/10 to the pivot and to each other, 6/10 between pivot and last
    (23, [(0, 2), (0, 0), (4, 0)]),  # 18/20 to the pivot, 16/20 to each other, 14/20 between pivot and last
])
def test_links_at_exactly_the_threshold(spark, monkeypatch, length, cuts):
    monkeypatch.setattr(module, "BANDS", 1)
    rows = trimmed(length, cuts)
    want = brute(rows, 4)
    assert {c for _, c, _ in want.values()} == {0}
    assert answer(near_duplicates(docs_of(spark, rows), 4)) == want


def test_edge_rows(spark):
    got = near_duplicates(edge_docs(spark), 4).collect()
    assert len(got) == len(EDGE_DOCS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [(by_id[i].component_id, by_id[i].kept) for i in (1, 2, 3)] == [(1, True), (2, True), (3, True)]
    assert by_id[5].component_id == 4 and not by_id[5].kept and by_id[7].component_id == 6
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles) == [(1, 4, False)]
    assert near_duplicates(empty_docs(spark), 4).count() == 0


def test_registers_merge_and_estimate():
    rnd = random.Random(4)
    words = [f"t{rnd.randint(0, 10**9)}" for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[500:2500])
    sa, sb = shingle_sets([a, b], 4)
    ra, rb, rab = registers([sa, sb, np.union1d(sa, sb)])
    assert (np.maximum(ra, rb) == rab).all()  # mergeable
    true = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
    assert abs((ra == rb).mean() - true) < 0.2
    na, nb = np.array([float(len(sa))]), np.array([float(len(sb))])
    assert not clearly_below(ra[None], rb[None], na, nb, true)[0]
    assert clearly_below(ra[None], rb[None], na, nb, 0.97)[0]


def brute_rows(rows, k):
    """(n, component, kept) of every row, links by rows, ids only as names."""
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def probe_rows():
    rnd = random.Random(11)
    a, b = ([f"w{rnd.randint(0, 999)}" for _ in range(80)] for _ in range(2))
    near = lambda words, at: " ".join(words[:at] + ["x"] + words[at + 1:])
    return [(5, " ".join(a)), (5, " ".join(b)), (7, near(a, 40)), (9, near(b, 30)), (None, near(b, 50)), (None, "alone in the world today"),
            (11, "alone in the world"), (None, None), (11, near(a, 20))]


@pytest.mark.parametrize("order", [0, 1])
def test_repeated_and_null_ids_are_judged_by_their_own_texts(spark, order):
    rows = probe_rows()[::-1] if order else probe_rows()
    got = near_duplicates(docs_of(spark, rows).coalesce(1), 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_rows(rows, 4)
