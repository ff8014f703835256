"""Near-duplicate groups by SetSketch registers.

A register holds ``floor(1 - log_b(x))`` of the least of a document's
exponentially distributed shingle values, truncated to 16 bits.  Equal sets
give equal registers, the registers of a union are the maxima, and two
documents agree in a register with a probability close to their Jaccard
similarity.  Bands of registers propose groups, the joint likelihood of all
registers and both set sizes drops proposals that are clearly too far apart,
and full shingle sets decide.

Within a group all members are compared with one pivot, never all with all.
Jaccard distance is a metric: members as close to the pivot as the threshold
need no comparison with members farther than twice the threshold's distance.
Only links between components matter, so what is in one component already is
left alone.  Members in the ring around a component are compared with it in
blocks; where many members are far from the pivots, they are regrouped first
by their rarest shingles, of which any two linked sets have one in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import connected_components, staged, text_slices
from .embed_dup import unite
from .rolling import Stretches, mix

BANDS = 28
ROWS = 4
REGISTERS = BANDS * ROWS
SKETCH_BASE = 1.001
SKETCH_RATE = 20.0
TOP = 2**16 - 1
#: Groups up to this size are compared pair by pair (at most 28 pairs).
SMALL = 8
#: Log-likelihood distance at which an estimate is taken as certain.
CERTAIN = 14.0
#: Bounds that only prune are this much wider, so that rounding never prunes a pair at exactly the threshold.
SLACK = 1e-9
#: Bounds of a block of members that are compared with other blocks by matrix products.
BLOCK_MEMBERS = 1024
#: Up to so many memberships of far members are compared in blocks; more are
#: regrouped once.  Either way finds every link.
FAR_ROWS = 200_000
BLOCK_SHINGLES = 1_500_000
COLUMNS = 4096
SLICE_CHARS = 1_000_000
BLOCK = 60_000

_RNG = np.random.Generator(np.random.PCG64(7331))
_MULTIPLIERS = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: runs of ``words``
    words, A-Z lower-cased; fewer words give one shingle, none give none."""
    raw = [(t or "").encode() for t in texts]
    data = _TO_LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    begin = np.cumsum([1] + [len(x) + 1 for x in raw])[:-1]
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, stop = edge[0::2], edge[1::2]
    hashes = Stretches(data).of(start, stop)
    first = np.searchsorted(start, begin)
    last = np.append(first[1:], len(start))
    out = []
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        rolled += hashes[j:j + len(rolled)] * _PLACES[j % 64] + np.uint64(j // 64)
    rolled = mix(rolled)
    for a, b in zip(first.tolist(), last.tolist()):
        n = b - a
        if n >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif n:
            out.append(mix((hashes[a:b] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, REGISTERS) uint16; sets without shingles get zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    at = 0
    while at < len(sets):
        size, stop = len(sets[at]), at + 1
        while stop < len(sets) and size + len(sets[stop]) <= BLOCK:
            size += len(sets[stop])
            stop += 1
        full = [i for i in range(at, stop) if len(sets[i])]
        if full:
            flat = np.concatenate([sets[i] for i in full])
            starts = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
            least = np.empty((REGISTERS, len(full)), np.uint64)
            for r in range(REGISTERS):
                least[r] = np.minimum.reduceat(flat * _MULTIPLIERS[r], starts)
            share = (least.T.astype(np.float64) + 0.5) / 2.0**64
            value = -np.log1p(-np.minimum(share, 1 - 1e-16)) / SKETCH_RATE
            out[full] = np.clip(np.floor(1 - np.log(value) / np.log(SKETCH_BASE)), 0, TOP).astype(np.uint16)
        at = stop
    return out


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def set_keys(sets: list[np.ndarray]) -> list[bytes]:
    """A 128-bit digest of every set: the name of its class, whoever holds it."""
    out = np.zeros((len(sets), 2), np.uint64)
    for k, s in enumerate(sets):
        if len(s):
            out[k] = s.sum(dtype=np.uint64) + np.uint64(len(s)) * _PLACES[0], mix(s).sum(dtype=np.uint64)
    return [row.tobytes() for row in out]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, rep, sketch) per row of (id, text): set size, the set's key, and
    its registers as bytes."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for start, stop in text_slices(texts, SLICE_CHARS):
                sets = shingle_sets(texts[start:stop], words)
                sig = registers(sets)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(start, stop - start), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(set_keys(sets), pa.binary()), pa.array([row.tobytes() for row in sig], pa.binary()),
                ], names=["id", "n", "rep", "sketch"])

    return docs.mapInArrow(run, f"id {id_type}, n long, rep binary, sketch binary")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) per row of (text); the id is the set's key."""
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, stop in text_slices(texts, SLICE_CHARS):
                sets = shingle_sets(texts[start:stop], words)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = _signed(np.concatenate(sets)) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_keys(sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["id", "shingles"])

    return docs.select("text").mapInArrow(run, "id binary, shingles array<long>")


def _log_p(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b - 1) / b), the chance that a register is ahead."""
    return -np.log1p(-np.clip(x, 0, 1) * (SKETCH_BASE - 1) / SKETCH_BASE) / np.log(SKETCH_BASE)


def clearly_below(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, floor: float) -> np.ndarray:
    """For rows of registers and set sizes, whether the joint likelihood rules
    out a similarity of ``floor`` (or the sizes alone do)."""
    ahead, behind = (a > b).sum(axis=1), (a < b).sum(axis=1)
    even = REGISTERS - ahead - behind
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _log_p(u - v * j), _log_p(v - u * j)
        tiny = 1e-12
        return ahead * np.log(p + tiny) + behind * np.log(q + tiny) + even * np.log(np.maximum(1 - p - q, tiny))

    best = np.full(len(a), -np.inf)
    for x in np.linspace(0, 1, 41):
        best = np.maximum(best, np.where(x * most <= floor, log_likelihood(x * most), -np.inf))
    at = log_likelihood(np.minimum(floor, most))
    return (most < floor - SLACK) | (best - at > CERTAIN)


def _plausible(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """The pairs that the likelihood does not rule out."""
    r = reps.select("rep", "n", "sketch")
    both = pairs.join(r.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a") \
        .join(r.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b") \
        .select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            na, nb = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            keep = ~clearly_below(sa, sb, na, nb, floor)
            yield t.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    schema = f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}, na long, nb long"
    return both.mapInArrow(run, schema)


def _compared(pairs: DataFrame, reps: DataFrame, sets: DataFrame, floor: float) -> DataFrame:
    """(a, b, shared, either) for the plausible pairs: intersection and union
    sizes of the full sets, staged."""
    left = staged(_plausible(pairs, reps, floor), "near-plausible")
    x = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b") \
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    x = x.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))
    return staged(x.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("either")).distinct(), "near-compared")


def _band_key(band: Column) -> Column:
    return F.xxhash64(F.lit(0).cast("long"), band, F.substring(F.col("sketch"), band * (2 * ROWS) + 1, F.lit(2 * ROWS)))


def _grouped(members: DataFrame) -> DataFrame:
    """Members of the groups of two or more, with the group's pivot and size."""
    g = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    return members.join(g, "gid")


def _rare_groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(gid, rep) of the representatives in ``members``, grouped by shingle.

    Linked sets share at least ``percent`` of the larger one, so in any order
    common to all sets, the first ``n - ceil(n * percent / 100) + 1`` shingles
    of both have one in common.  Shingles held by fewest of the sets come
    first; the order decides how large the groups are, not which links are found.
    """
    held = sets.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    held = held.select(F.col("id").alias("rep"), F.explode("shingles").alias("gid"))
    counted = held.join(held.groupBy("gid").agg(F.count(F.lit(1)).alias("sets")), "gid")
    ordered = counted.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("sets", "gid"))).alias("rarest"))
    most = F.expr(f"size(rarest) - int((size(rarest) * {percent}L + 99) div 100) + 1")
    first = ordered.select("rep", F.explode(F.slice("rarest", F.lit(1), most)).alias("s"))
    return first.where("s.sets > 1").select("s.gid", "rep")


def near_components(reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes with a link, from every pair at or above
    ``percent`` that the bands bring together.  Links inside a component are
    not looked for once it is one.

    ``reps`` holds a class per row: its key ``rep``, the ``id`` of one of its
    rows, size and registers.  That id finds its text again; where an id stands
    for several texts, the key tells which one is meant."""
    near = percent / 100.0
    ring = max(0.0, 2 * near - 1)  # farther from the pivot than this: no link to what is near it
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    members = reps.select("rep", "sketch", band).select(_band_key(F.col("band")).alias("gid"), "rep")
    members = staged(_grouped(members), "near-members")
    wanted = staged(reps.select("rep", "id").join(members.select("rep").distinct(), "rep", "left_semi"), "near-wanted")
    held = wanted.select(F.col("id").alias("of")).distinct()
    sets = full_sets(texts.join(held, texts["id"].eqNullSafe(held["of"]), "left_semi"), words)
    sets = staged(sets.join(wanted.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "near-sets")
    linked = F.col("shared") * 100 >= F.col("either") * percent
    low = ring / 2
    links, found = [], None  # found: (node, component) by the first links
    for last in (False, True):
        star = members.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        seen = _compared(star, reps, sets, low)
        links.append(seen.where(linked).select("a", "b"))
        if found is None:
            found = staged(connected_components(links[0]), "near-first")
        rest = _unsettled(members, seen.withColumn("near", linked), found, ring, 1 - near)
        few = rest.where(F.col("size") <= SMALL)
        pairs = few.alias("x").join(few.alias("y"), "gid").where("x.rep < y.rep and x.component != y.component") \
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        links.append(_compared(pairs, reps, sets, near).where(linked).select("a", "b"))
        many = rest.where(F.col("size") > SMALL)
        # Members far from the pivot: few of them join the blocks; else they
        # are regrouped, with those that may be near one of them.
        far = many.where(F.col("sim") < low)
        regroup = not last and far.count() > FAR_ROWS
        close = many.where((F.col("component") == F.col("centre")) | (F.col("sim") >= low)) if regroup else many
        links.append(_block_links(close, sets, percent))
        if not regroup:
            break
        again = many.where(F.col("sim") < low + 1 - near + SLACK).join(far.select("gid").distinct(), "gid", "left_semi")
        members = staged(_grouped(_rare_groups(again, sets, percent)), "near-members")
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for more in links[1:]:
        edges = edges.unionByName(more)
    return connected_components(edges)


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that join the members outside a centre's component with it
    or with each other, for every ``centre``.

    The members of a centre, gathered over all its groups, are dealt into
    blocks of bounded size, and every block of outsiders meets every block.
    Intersections are products of membership matrices inside a task, which
    returns a spanning forest of its links, never the pairs.
    """
    m = members.groupBy("centre", "rep").agg(F.max("component").alias("component"))
    m = staged(m.withColumn("outside", F.col("component") != F.col("centre")), "near-blocks")
    m = m.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")
    dealt = m.groupBy("centre", "outside").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    outs = dealt.where("outside").select("centre", F.col("blocks").alias("outs"))
    ins = dealt.where("not outside").select("centre", F.col("blocks").alias("ins"))
    plan = staged(outs.join(ins, "centre", "left").select("centre", "outs", F.coalesce("ins", F.lit(0)).alias("ins")), "near-plan")
    x = m.join(plan, "centre")
    block = F.pmod(F.hash("rep"), F.when(F.col("outside"), F.col("outs")).otherwise(F.col("ins")))
    x = x.select("centre", "rep", "component", "shingles", "outside", "outs", "ins", block.alias("block"))
    # Blocks 0 .. outs-1 hold outsiders, the rest insiders; a task is (outsider block, block).
    meets = F.when(F.col("outside"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("outs") + F.col("ins") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j"))),
    )).otherwise(F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda k: F.struct(k.alias("i"), (F.col("outs") + F.col("block")).alias("j"))))
    at = F.when(F.col("outside"), F.col("block")).otherwise(F.col("outs") + F.col("block"))
    work = x.select("centre", "rep", "component", "shingles", at.alias("at"), F.explode(meets).alias("task"))
    work = work.select(F.xxhash64("centre", "task.i", "task.j").alias("job"), F.col("task.i").alias("i"), F.col("task.j").alias("j"), "at", "rep", "component", "shingles")
    kind = sets.schema["id"].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        where, i, j = (group.column(c).to_numpy() for c in ("at", "i", "j"))
        reps = group.column("rep").combine_chunks()
        _, component = np.unique(np.array([repr(c) for c in group.column("component").to_pylist()]), return_inverse=True)
        lists = group.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        a, b = np.flatnonzero(where == i), np.flatnonzero(where == j)
        size = np.diff(ends)
        shared = shared_counts([flat[ends[k]:ends[k + 1]] for k in a], [flat[ends[k]:ends[k + 1]] for k in b])
        linked = (100 * shared >= percent * (size[a][:, None] + size[b][None, :] - shared)) & (component[a][:, None] != component[b][None, :])
        x, y = np.nonzero(linked)
        root = np.arange(len(where))
        unite(root, a[x], b[y])
        hit = np.flatnonzero(root != np.arange(len(where)))
        return pa.table({"a": reps.take(pa.array(hit)), "b": reps.take(pa.array(root[hit]))})

    return work.groupBy("job").applyInArrow(compare, f"a {kind}, b {kind}")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of ``a`` with all sets of ``b``."""
    out = np.zeros((len(a), len(b)))
    if not a or not b:
        return out
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)

    def numbered(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        known = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        return owner[known][order], at[known][order]

    (ra, ca), (rb, cb) = numbered(flat_a, a), numbered(flat_b, b)
    for lo in range(0, len(both), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for matrix, rows, columns in ((x, ra, ca), (y, rb, cb)):
            s, e = np.searchsorted(columns, [lo, lo + COLUMNS])
            matrix[rows[s:e], columns[s:e] - lo] = 1
        out += x @ y.T
    return out


def _unsettled(members: DataFrame, seen: DataFrame, found: DataFrame, ring: float, reach: float) -> DataFrame:
    """The members that may still have links which would join components, with
    their component and the size of what is left of the group, staged.

    The pivot is settled, and so are members near it unless a member of
    another component lies in the ring around them; groups whose members are
    all in one component are settled as a whole.
    """
    own = found.select(F.col("node").alias("rep"), "component")
    rest = members.where("rep != pivot and size > 2").join(
        seen.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), (F.col("shared") / F.col("either")).alias("sim"), "near"),
        ["pivot", "rep"], "left").join(own, "rep", "left") \
        .join(own.select(F.col("rep").alias("pivot"), F.col("component").alias("centre")), "pivot", "left")
    rest = staged(rest.select(
        "gid", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("sim", F.lit(0.0)).alias("sim"),
        F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("centre", "pivot").alias("centre")), "near-rest")
    outside = ~F.col("near") & (F.col("sim") >= ring - SLACK) & (F.col("component") != F.col("centre"))
    edge = rest.where(outside).groupBy("gid").agg(F.max("sim").alias("edge"))
    rest = rest.join(edge, "gid", "left").where(~F.col("near") | (F.col("sim") <= F.col("edge") + reach + SLACK)) \
        .select("gid", "rep", "component", "sim", "centre")
    parts = rest.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo != hi").select("gid", "size")
    return staged(rest.join(parts, "gid"), "near-unsettled")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words (A-Z
    lower-cased, split at ASCII white space); fewer words make one shingle.
    Documents with ``100 * shared >= percent * union`` are linked, and
    ``component_id`` is the smallest id reachable.

    Null, empty and blank texts have empty sets and are linked with nothing,
    not even with each other.  Equal sets are one class before any comparison,
    so a group of copies costs one row; classes are named by a digest of their
    set, so rows that repeat an id are judged by their own texts and rows with
    a null id take part.  A component without any id is null.  An empty table
    gives an empty result; other columns are not read.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = staged(sketches(texts, words), "near-sketches")
    classes = rows.where("n > 0").groupBy("rep").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes, "near-classes")
    found = staged(near_components(classes, texts, words, percent).select(F.col("node").alias("rep"), "component"), "near-found")
    linked = classes.select("rep", "id").join(found, "rep")
    smallest = linked.groupBy("component").agg(F.min("id").alias("least"))
    named = linked.join(smallest, "component").select("rep", F.col("least").alias("component_id"))
    named = classes.select("rep", "id").join(named, "rep", "left").select(
        "rep", F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    # Rows without words are their own.
    own = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = rows.where("n > 0").select("id", "n", "rep").join(named, "rep", "left").select("id", "n", "component_id").unionByName(own)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
