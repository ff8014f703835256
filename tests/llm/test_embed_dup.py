import math

import numpy as np
import pytest

from simpairs.llm.embed_dup import embedding_duplicates, leaf_of, splitting_tree, unite

SCHEMA = "vec_id long, embedding array<double>, label int, rep string, size string, tile string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "r", "s", "t") for i, v in vectors], SCHEMA)


def brute(vectors, threshold):
    fine = {}
    for k, (_, v) in enumerate(vectors):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[k] = np.array(v) / np.linalg.norm(v)
    links, root = [0] * len(vectors), np.arange(len(vectors))
    for a in fine:
        for b in fine:
            if a != b and fine[a] @ fine[b] >= threshold:
                links[a] += 1
                unite(root, np.array([a]), np.array([b]))
    return {i: (links[k], vectors[root[k]][0], root[k] == k) for k, (i, _) in enumerate(vectors)}


@pytest.mark.parametrize("tile", [4096, 40])
def test_clusters_against_all_pairs(spark, tile):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 48))
    rows = [(i, (centres[i % 12] + rnd.normal(size=48) * rnd.choice([0.1, 0.28, 0.35])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000 + i, (np.array(rows[5][1]) * (i + 2)).tolist()) for i in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(frame(spark, rows), 0.9, tile=tile).collect()}
    assert got == brute(rows, 0.9)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 0.0, 0.0]),
            (7, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [2.0, 1e-9, 0.0]), (10, [1e300, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(frame(spark, rows)).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 11))
    assert [got[i] for i in (7, 8, 9, 10)] == [(3, 7, True), (3, 7, False), (3, 7, False), (3, 7, False)]
    assert embedding_duplicates(frame(spark, [])).count() == 0
    assert embedding_duplicates(frame(spark, [(1, None)])).count() == 1


def test_tree_leaves_are_balanced():
    z = np.random.default_rng(1).normal(size=(4000, 10))
    sizes = np.bincount(leaf_of(z, splitting_tree(z, 13)), minlength=16)
    assert len(sizes) == 16 and sizes.min() > 200


@pytest.mark.parametrize("order", [1, -1])
def test_repeated_and_null_ids_count_by_their_own_vectors(spark, order):
    """(5, v1), (5, v2), (7, near v1), (null, v3), (8, near v3): links by rows."""
    rnd = np.random.default_rng(6)
    v1, v2, v3 = (rnd.normal(size=24) for _ in range(3))
    near = lambda v: (v + rnd.normal(size=24) * 0.05).tolist()
    rows = [(5, v1.tolist()), (5, v2.tolist()), (7, near(v1)), (None, v3.tolist()), (8, near(v3)), (None, rnd.normal(size=24).tolist())][::order]
    got = embedding_duplicates(frame(spark, rows).coalesce(1)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(5, 1, 5, True), (5, 0, 5, True), (7, 1, 5, False), (None, 1, 8, False), (8, 1, 8, True), (None, 0, None, True)], key=repr)
