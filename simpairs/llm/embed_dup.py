"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated so that their leading dimensions
carry most of the product.  Tiles are cells of a splitting tree over those
dimensions; two tiles are compared only if their boxes are near enough for
the threshold.  Inside a pair of tiles, products grow dimension block by
block; what the remaining dimensions can still add is bounded by the product
of the suffix norms, and a pair is dropped as soon as the bound rules it out.
Survivors are decided by the plain cosine of the vectors as given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..session import ship_package
from .common import connected_components, staged

#: Bound of the fit: vectors that the rotation and the splitting tree are fitted on.
SAMPLE = 20_000
TILE = 4096
#: Leading dimensions that the boxes describe, and dimensions per step.
LEAD = 8
STEP = 16
ROWS = 512
PAIRS = 50_000
EPS = 1e-9


def unit_rows(vectors: list, width: int) -> np.ndarray:
    """Double rows of length one; shorter vectors are continued by zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    biggest = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(biggest > 0, biggest, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def principal_axes(units: np.ndarray) -> np.ndarray:
    """Columns: directions of falling mean square (products, not deviations, are bounded)."""
    if not len(units):
        return np.eye(units.shape[1])
    _, axes = np.linalg.eigh(units.T @ units)
    return axes[:, ::-1]


def splitting_tree(z: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A balanced tree in heap order: (dimension, cut) of every inner node.
    Each node cuts the widest of the leading dimensions at its median."""
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    tree: list[tuple[int, float]] = []
    rows = [np.arange(len(z))]
    for _ in range(depth):
        below = []
        for r in rows:
            d = int(np.argmax(np.ptp(z[r, :LEAD], axis=0))) if len(r) else 0
            cut = float(np.median(z[r, d])) if len(r) else 0.0
            tree.append((d, cut))
            below += [r[z[r, d] < cut], r[z[r, d] >= cut]]
        rows = below
    return tree


def leaf_of(z: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(z), np.int64)
    if not tree:
        return node
    dims, cuts = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
    for _ in range((len(tree) + 1).bit_length() - 1):
        node = 2 * node + 1 + (z[np.arange(len(z)), dims[node]] >= cuts[node])
    return node - len(tree)


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k] in place; a root is its set's smallest number."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def similar_pairs(a: np.ndarray, b: np.ndarray, za: np.ndarray, zb: np.ndarray, threshold: float):
    """Blocks (i, j) of row numbers with cosine of a[i] and b[j] at or above the threshold."""
    width = za.shape[1]
    cuts = list(range(STEP, width, STEP)) + [width]
    # Norms of what lies beyond each cut.
    ta = [np.sqrt(np.maximum((za[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    tb = [np.sqrt(np.maximum((zb[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    for at in range(0, len(za), ROWS):
        part = za[at:at + ROWS]
        dots = part[:, :cuts[0]] @ zb[:, :cuts[0]].T
        open_pairs = dots + ta[0][at:at + ROWS, None] * tb[0][None, :] >= threshold - EPS
        level = 0
        while open_pairs.mean() > 0.02 and level + 1 < len(cuts):  # still dense: whole blocks
            lo, hi = cuts[level], cuts[level + 1]
            dots += part[:, lo:hi] @ zb[:, lo:hi].T
            level += 1
            open_pairs = dots + ta[level][at:at + ROWS, None] * tb[level][None, :] >= threshold - EPS
        every_i, every_j = np.nonzero(open_pairs)
        for k in range(0, len(every_i), PAIRS):
            i, j = every_i[k:k + PAIRS], every_j[k:k + PAIRS]
            part_dots = dots[i, j]
            for lev in range(level + 1, len(cuts)):  # sparse: pair by pair
                lo, hi = cuts[lev - 1], cuts[lev]
                part_dots = part_dots + np.einsum("ij,ij->i", part[i, lo:hi], zb[j, lo:hi])
                on = part_dots + ta[lev][at + i] * tb[lev][j] >= threshold - EPS
                i, j, part_dots = i[on], j[on], part_dots[on]
            sure = np.einsum("ij,ij->i", a[at + i], b[j]) >= threshold
            yield at + i[sure], j[sure]


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                         vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite numbers
    link with nothing: no links, their own component, kept.  Vectors of
    different lengths are compared as if the shorter were continued by zeros.
    Equal vectors are one row in every comparison and count as links of each
    other.  Rows with a null id take part; a group with null ids only has a
    null component.  Rows that repeat an id count each.  An empty table gives
    an empty result; other columns are not read.

    All tiles are compared with all tiles that their boxes do not rule out,
    which is the contract's all-pairs comparison in blocks.  A task holds two
    tiles and one block of products, and returns at most one row per vector:
    its links and a spanning forest, never the pairs.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) \
        & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    groups = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    # A class of equal vectors is named by 128 bits of its vector, not by an id that other vectors may share.
    name = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), "v")))
    groups = staged(groups.select(name.alias("rep"), "id", "size", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("h2")), "embed-groups")
    n, width = groups.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 1
    rate = min(1.0, SAMPLE / n) if n else 1.0
    sample = [r[0] for r in groups.where(hash_unit(F.lit("axes"), F.col("h")) < rate).orderBy("h", "rep").select("v").collect()]
    units = unit_rows(sample, width)
    axes = principal_axes(units)
    tree = splitting_tree(units @ axes, -(-(n or 1) // tile))
    shared = spark.sparkContext.broadcast((axes, tree, width))
    lead = min(LEAD, width)
    def place(batches):
        axes, tree, width = shared.value
        for t in batches:
            z = unit_rows(t.column("v").to_pylist(), width) @ axes
            yield pa.RecordBatch.from_arrays(
                [*t.columns, pa.array(leaf_of(z, tree)), pa.array(list(z[:, :lead]), pa.list_(pa.float64()))],
                names=[*t.schema.names, "leaf", "lead"])

    placed = groups.drop("id").mapInArrow(place, "rep string, size long, v array<double>, h long, h2 int, leaf long, lead array<double>")
    # A leaf that its cuts could not part (equal leading dimensions) is parted by hash.
    leaves = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * tile)).alias("parts"))
    placed = staged(placed.join(leaves, "leaf").withColumn("tile", F.xxhash64("leaf", F.pmod("h2", F.col("parts")))), "embed-placed")
    boxes = placed.groupBy("tile").agg(
        F.array(*[F.min(F.col("lead")[d]) for d in range(lead)]).alias("lo"),
        F.array(*[F.max(F.col("lead")[d]) for d in range(lead)]).alias("hi"))
    reach = float(np.sqrt(2 - 2 * threshold)) + EPS  # distance of unit vectors at the threshold
    # Range join of the boxes: equal cells of the first axis, then the distance of the boxes.
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach).cast("int"), F.floor(hi / reach).cast("int")))
    x = boxes.select(F.col("tile").alias("t"), "lo", "hi", cells(F.col("lo")[0], F.col("hi")[0]).alias("cell"))
    y = boxes.select(F.col("tile").alias("u"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
                     cells(F.col("lo")[0] - reach, F.col("hi")[0] + reach).alias("cell"))
    gap = F.aggregate(F.zip_with(
        F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b),
        lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d)
    meet = x.join(y, "cell").where(F.col("t") <= F.col("u")).where(gap <= reach * reach).select("t", "u").distinct()
    meet = staged(meet.withColumn("pair", F.xxhash64("t", "u")), "embed-meet")
    side = meet.select("pair", F.col("t").alias("tile")).unionByName(meet.select("pair", F.col("u").alias("tile"))) \
        .groupBy("pair", "tile").agg((F.count(F.lit(1)) == 2).alias("self"))
    work = placed.select("tile", "rep", "size", "v").join(side, "tile").select("pair", "self", "tile", "rep", "size", "v")

    def compare(group: pa.Table) -> pa.Table:
        axes, _, width = shared.value
        group = group.combine_chunks()
        tiles = group.column("tile").to_numpy()
        own = group.column("self").to_pylist()[0]
        order = np.argsort(tiles, kind="stable")
        units = unit_rows(group.column("v").to_pylist(), width)[order]
        sizes = group.column("size").to_numpy()[order]
        split = len(units) if own else int(np.searchsorted(tiles[order], tiles.max()))
        a, first = units[:split], 0 if own else split
        b = units[first:]
        links = np.zeros(len(units), np.int64)
        root = np.arange(len(units))
        for i, j in similar_pairs(a, b, a @ axes, b @ axes, threshold):
            j = j + first
            if own:
                i, j = i[i != j], j[i != j]  # both (i, j) and (j, i) are there
            links += np.bincount(i, sizes[j], len(units)).astype(np.int64)
            if not own:
                links += np.bincount(j, sizes[i], len(units)).astype(np.int64)
            unite(root, i, j)
        hit = np.flatnonzero(links)
        reps = group.column("rep").take(pa.array(order))
        return pa.table({"rep": reps.take(pa.array(hit)), "links": pa.array(links[hit]), "peer": reps.take(pa.array(root[hit]))})

    found = staged(work.groupBy("pair").applyInArrow(compare, "rep string, links long, peer string"), "embed-links")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = staged(groups.select("rep", "id").join(component.select(F.col("node").alias("rep"), "component"), "rep"), "embed-joined")
    least = joined.groupBy("component").agg(F.min("id").alias("least"))
    known = groups.select("rep", "id", "size", "v").join(counted, "rep", "left") \
        .join(joined.join(least, "component").select("rep", "least"), "rep", "left") \
        .select("v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    out = rows.join(known, "v", "left")
    of = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      of.alias("component_id"), F.col("id").eqNullSafe(of).alias("kept"))
