"""Repeated byte stretches by longest-previous-factor arrays.

The text is cut into runs of neighbouring windows whose least k-gram hash lies
at the same place.  Equal windows have equal least hashes wherever they stand,
so a window can only recur inside another run of the same hash.  A hash that
one run holds is unique and done.  Runs whose whole stretch of bytes recurs are repeated and
done.  What is left are runs of one hash that differ somewhere, such as the
edges of a copied passage.

Their windows are put in suffix order.  For every suffix, the nearest entries
on both sides with a smaller text position give its longest previous factor;
at the window's length or more, the window has an earlier copy.  Removing
only these keeps the first copy; marking the earlier copies too removes all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import staged, text_slices
from .rolling import Stretches, mix

GRAM = 32
SLICE_BYTES = 1_000_000
#: Low bits of a packed least hash hold its place; longer texts are cut into overlapping pieces.
PLACE = np.uint64(2**24 - 1)
PIECE = 2**23
#: Differing runs of one hash that are put in suffix order together.
GROUP = 512
#: Windows of one piece of a run in larger groups.
PIECE_WINDOWS = 16
#: Bytes of runs that one task orders at a time.
BUCKET_BYTES = 400_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by block prefixes and suffixes."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def window_runs(raw: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, least hash, stretch hash) of all runs."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw], np.int64)
    begin = np.cumsum(sizes) - sizes
    if not len(data) or sizes.max() < width:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = max(1, min(GRAM, width // 4))
    stretches = Stretches(data)
    grams = mix(stretches.windows(gram))
    # The leftmost place of the least hash (by its upper bits): the same place
    # in equal windows, so two windows of one run are never equal.
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((grams & ~PLACE) | place, width - gram + 1)
    owner = np.repeat(np.arange(len(raw)), sizes)[: len(least)]
    inside = np.arange(len(least)) + width <= (begin + sizes)[owner]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(least)))
    start, count = start[inside[start]], count[inside[start]]
    anchor = grams[(least[start] & PLACE).astype(np.int64)]
    stretch = stretches.of(start, start + count - 1 + width)
    return owner[start], start - begin[owner[start]], count, anchor, stretch


def run_pieces(raw: list[bytes], count: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(run, first window, windows, core hash, stretch hash) of the pieces of runs.

    A piece holds the windows of a run whose distances to the least hash lie in
    one block of ``PIECE_WINDOWS``.  The core lies inside every window that
    the block can have; both hashes are told apart by run hash and block.
    """
    step = min(PIECE_WINDOWS, width)
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw], np.int64)
    begin = np.cumsum(sizes) - sizes
    gram = max(1, min(GRAM, width // 4))
    stretches = Stretches(data)
    grams = mix(stretches.windows(gram)) & ~PLACE
    least = np.array([np.argmin(grams[b:b + width - gram + 1]) for b in begin], np.int64)
    low, high = (least - count + 1) // step, least // step
    run = np.repeat(np.arange(len(raw)), high - low + 1)
    block = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    first = np.maximum(0, least[run] - step * block - step + 1)
    last = np.minimum(count[run] - 1, least[run] - step * block)
    edge = begin[run] + least[run] - step * block
    mark = mix(h[run] + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    core = mix(stretches.of(edge, edge - step + 1 + width) ^ mark)
    span = mix((least[run] - first).astype(np.uint64) * np.uint64(65536) + (last - first).astype(np.uint64))
    stretch = mix(stretches.of(begin[run] + first, begin[run] + last + width) ^ mark ^ span)
    return run, first, last - first + 1, core, stretch


def suffix_order(data: np.ndarray, begin: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (``count[k]`` starts from ``begin[k]`` on) in the order of their
    ``width`` bytes, ties by place, and the common length of each with the one
    before (at most ``width``).

    Ranks by the first 8 bytes are doubled until they cover the width; only
    places that still tie are sorted again.
    """
    n = len(data)
    first = min(8, width)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(first):
        word = (word << np.uint64(8)) | padded[k:k + n]
    _, rank, size = np.unique(word, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[rank]  # a rank is the place of its class in the order
    ties = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    levels, span = [(first, rank)], first
    while span * 2 <= width:
        rank = rank.copy()
        if len(ties):
            beyond = np.where(ties + span < n, levels[-1][1][np.minimum(ties + span, n - 1)] + 1, 0)
            key = rank[ties] * np.int64(n + 1) + beyond
            order = np.argsort(key, kind="stable")
            t, k = ties[order], key[order]
            base = rank[t]
            new = np.ones(len(t), bool)
            new[1:] = k[1:] != k[:-1]
            lead = np.ones(len(t), bool)
            lead[1:] = base[1:] != base[:-1]
            at = np.arange(len(t))
            rank[t] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(lead, at, 0))
            again = np.bincount(rank[t], minlength=n)[rank[ties]] > 1
            ties = ties[again]
        span *= 2
        levels.append((span, rank))
    places = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    key = rank[places] * np.int64(n + 1) + rank[places + width - span]
    order = places[np.argsort(key, kind="stable")]
    common = np.zeros(len(order), np.int64)
    a, b = order[1:], order[:-1]
    same = np.zeros(len(a), np.int64)
    for length, r in reversed(levels):
        for _ in range(2):
            fits = same + length <= width
            equal = fits & (r[np.minimum(a + same, n - 1)] == r[np.minimum(b + same, n - 1)])
            same += np.where(equal, length, 0)
    for _ in range(first):
        equal = (same < width) & (data[np.minimum(a + same, n - 1)] == data[np.minimum(b + same, n - 1)])
        same += equal
    common[1:] = same
    return order, common


def longest_previous(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the order, its longest previous factor and where it is.

    The nearest entry with a smaller place is found on both sides by jumping
    over entries that are known to be larger; the least common length on the
    way is the length shared with it.
    """
    n = len(order)
    best, source = np.zeros(n, np.int64), np.full(n, -1)
    for side in (order, order[::-1]):
        link = common if side is order else np.concatenate([common[:1], common[:0:-1]])
        near, shared = np.arange(n) - 1, link.copy()
        live = np.flatnonzero((near >= 0) & (side[near] > side))
        while live.size:
            hop = near[live]
            shared[live] = np.minimum(shared[live], shared[hop])
            near[live] = near[hop]
            live = live[(near[live] >= 0) & (side[near[live]] > side[live])]
        shared = np.where(near >= 0, shared, 0)
        place = np.where(near >= 0, side[near], -1)
        if side is not order:
            shared, place = shared[::-1], place[::-1]
        better = shared > best
        best, source = np.where(better, shared, best), np.where(better, place, source)
    return best, source


def _spans(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches covered by the flagged window starts."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b) - 1 + width) for a, b in zip(edge[0::2], edge[1::2])]


def repeated_spans(docs: DataFrame, width: int = 400, keep_first: bool = False) -> DataFrame:
    """(id, key, start, stop) byte stretches of (id, key, text) rows that are
    covered by windows with another copy (``keep_first``: an earlier one, in
    the order of id and place).  Stretches of one text may overlap."""
    id_type = docs.schema["id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            raw, row, skip = [], [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                whole = (t or "").encode()
                for piece in range(0, max(1, len(whole) - width + 1), PIECE):
                    raw.append(whole[piece:piece + PIECE + width - 1])
                    row.append(k)
                    skip.append(piece)
            row, skip = np.array(row, np.int64), np.array(skip, np.int64)
            for a, b in text_slices(raw, SLICE_BYTES):
                who, start, count, least, stretch = window_runs(raw[a:b], width)
                at, start = pa.array(row[who + a]), start + skip[who + a]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(start), pa.array(count), pa.array(least.view(np.int64)),
                     pa.array(stretch.view(np.int64))], names=["id", "key", "start", "count", "h", "c"])

    runs = staged(docs.mapInArrow(cut, f"id {id_type}, key long, start long, count long, h long, c long"), "suffix-runs")
    whole = runs.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "start", "count")).alias("one"))
    shared = whole.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    whole = staged(whole.join(shared, "h"), "suffix-shared")

    # Runs that recur whole.
    again = runs.join(whole.where("n > 1").select("h", "c", "one"), ["h", "c"])
    if keep_first:
        again = again.where(~(F.col("id").eqNullSafe(F.col("one.id")) & (F.col("key") == F.col("one.key")) & (F.col("start") == F.col("one.start"))))
    spans = again.select("id", "key", "start", (F.col("start") + F.col("count") - 1 + width).alias("stop"))

    # Runs of one hash that differ: fetch the bytes of one run of each kind.
    open_runs = whole.where("kinds > 1").select("one.*", "h", "n", "kinds")
    per_text = open_runs.groupBy("id", "key").agg(F.collect_list(F.struct("start", "count", "h", "n", "kinds")).alias("runs"))
    d, p = docs.dropDuplicates(["id", "key"]).alias("d"), per_text.alias("p")
    found = d.join(p, F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.key") == F.col("p.key"))).select("d.id", "d.key", "d.text", "p.runs")

    def fetch(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            raw = [(t or "").encode() for t in batch.column(2).to_pylist()]
            lists = batch.column(3).to_pylist()
            owner = [k for k, rs in enumerate(lists) for _ in rs]
            flat = [(raw[k], r) for k, rs in enumerate(lists) for r in rs]
            for a in range(0, len(flat), 2000):
                part, at = flat[a:a + 2000], pa.array(owner[a:a + 2000], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), *[pa.array([r[c] for _, r in part], pa.int64()) for c in ("start", "count", "h", "n", "kinds")],
                     pa.array([x[r["start"]:r["start"] + r["count"] - 1 + width] for x, r in part], pa.binary())],
                    names=["id", "key", "start", "count", "h", "n", "kinds", "bytes"])

    differing = staged(found.mapInArrow(fetch, f"id {id_type}, key long, start long, count long, h long, n long, kinds long, bytes binary"), "suffix-open")
    size = differing.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    span_schema = f"id {id_type}, key long, start long, stop long"

    def order_bucket(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rank = np.lexsort((group.column("start").to_numpy(), group.column("key").to_numpy(),
                           group.column("id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False))) \
            if not keep_first else np.array(group.to_pandas().reset_index().sort_values(["id", "key", "start"])["index"])
        group = group.take(pa.array(rank))
        stretches = group.column("bytes").to_pylist()
        count = group.column("count").to_numpy()
        sizes = np.array([len(x) for x in stretches])
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(stretches), np.uint8)
        order, common = suffix_order(data, begin, count, width)
        longest, source = longest_previous(order, common)
        later = longest >= width
        flags = np.zeros(len(data), bool)
        flags[order[later]] = True
        if not keep_first:
            flags[source[later]] = True
        who, start, stop = [], [], []
        offset = group.column("start").to_numpy()
        for k in range(len(stretches)):
            for a, b in _spans(flags[begin[k]:begin[k] + count[k]], width):
                who.append(k)
                start.append(int(offset[k]) + a)
                stop.append(int(offset[k]) + b)
        at = pa.array(who, pa.int64())
        return pa.table({"id": group.column("id").take(at), "key": group.column("key").take(at),
                         "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})

    few = differing.where(F.col("kinds") <= GROUP).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    ordered = few.groupBy("bucket").applyInArrow(order_bucket, span_schema)

    # Hashes with very many differing runs: no task holds such a group.  Its
    # windows are dealt into pieces by their distance from the least hash, the
    # same for equal windows.  All windows of a piece share a core of bytes; a
    # core that stands alone settles its piece, and so does a whole stretch
    # that recurs.  The windows of what is left meet as fingerprints.
    def pieces(batches):
        for batch in batches:
            raw, count, h = batch.column("bytes").to_pylist(), batch.column("count").to_numpy(), batch.column("h").to_numpy()
            for a, b in text_slices(raw, SLICE_BYTES // 4):
                who, at, n, core, stretch = run_pieces(raw[a:b], count[a:b], h[a:b].view(np.uint64), width)
                row = pa.array(who + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(row) for c in ("id", "key", "start")] + [pa.array(at), pa.array(n), pa.array(core.view(np.int64)),
                     pa.array(stretch.view(np.int64)), batch.column("n").take(row)],
                    names=["id", "key", "start", "at", "count", "core", "stretch", "n"])

    many = differing.where(F.col("kinds") > GROUP).select("id", "key", "start", "count", "h", "n", "bytes")
    cuts = many.mapInArrow(pieces, f"id {id_type}, key long, start long, at long, count long, core long, stretch long, n long")
    if keep_first:  # every piece for itself: which copy comes first is judged window by window
        cuts = cuts.withColumn("stretch", F.xxhash64("id", "key", "start", "at"))
    cuts = staged(cuts, "suffix-pieces")
    kinds = cuts.groupBy("core", "stretch").agg(F.sum("n").alias("n"), F.min(F.struct("id", "key", "start", "at", "count")).alias("one"))
    several = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    if not keep_first:
        same = cuts.join(kinds.where("n > 1").select("core", "stretch"), ["core", "stretch"])
        spans = spans.unionByName(same.select("id", "key", (F.col("start") + F.col("at")).alias("start"),
                                              (F.col("start") + F.col("at") + F.col("count") - 1 + width).alias("stop")))
    left = kinds.join(several, "core").select("one.*", "n").groupBy("id", "key", "start").agg(
        F.collect_list(F.struct("at", "count", "n")).alias("pieces")).alias("l")
    m = many.select("id", "key", "start", "bytes").alias("m")
    left = m.join(left, F.col("m.id").eqNullSafe(F.col("l.id")) & (F.col("m.key") == F.col("l.key")) & (F.col("m.start") == F.col("l.start"))) \
        .select("m.id", "m.key", "m.start", "m.bytes", "l.pieces")

    def windows(batches):
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            for a, b in text_slices(raw, SLICE_BYTES // 4):
                lists = batch.column("pieces").slice(a, b - a).to_pylist()
                data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
                sizes = np.array([len(x) for x in raw[a:b]])
                begin = np.cumsum(sizes) - sizes
                flat = [(k, p["at"], p["count"], p["n"]) for k, ps in enumerate(lists) for p in ps]
                who, at, count, n = (np.array([f[c] for f in flat], np.int64) for c in range(4))
                each = np.repeat(np.arange(len(flat)), count)
                offset = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                place = begin[who[each]] + offset
                one = Stretches(data).of(place, place + width)
                two = Stretches(data[::-1].copy()).of(len(data) - place - width, len(data) - place)
                row = pa.array(who[each] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("key").take(row), pa.array(batch.column("start").to_numpy()[a:b][who[each]] + offset),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n[each])], names=["id", "key", "start", "w1", "w2", "n"])

    prints = staged(left.mapInArrow(windows, f"id {id_type}, key long, start long, w1 long, w2 long, n long"), "suffix-windows")
    met = prints.groupBy("w1", "w2").agg(F.sum("n").alias("all"), F.min(F.struct("id", "key", "start")).alias("one")).where("all > 1")
    hit = prints.join(met, ["w1", "w2"])
    if keep_first:
        hit = hit.where(~(F.col("id").eqNullSafe(F.col("one.id")) & (F.col("key") == F.col("one.key")) & (F.col("start") == F.col("one.start"))))
    hit = hit.select("id", "key", "start", (F.col("start") + width).alias("stop"))
    return spans.unionByName(ordered).unionByName(hit)


def remove_repeats(docs: DataFrame, width: int = 400, keep_first: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) for every row: the text's UTF-8 length, the
    maximal removed stretches [start, stop) and the bytes that remain.

    A byte is removed if a window of ``width`` bytes that covers it also
    starts anywhere else, in the same text or another; windows may overlap.
    With ``keep_first`` the earliest copy (by id, then place) stays.  Removal
    is judged on the input.  Bytes are cut wherever windows end, so what
    remains may split a character and is binary.

    Null counts as empty; texts shorter than ``width`` keep all.  Rows that
    repeat id and text are copies of each other; rows that repeat an id with
    another text, and rows with a null id, are texts of their own.  An empty
    table gives an empty result, other columns are not read.  A text is read
    whole; its windows are cut batch by batch.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    spans = repeated_spans(rows, width, keep_first)
    # Per text; its spans are at most its length / run length.
    lists = spans.groupBy("id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("found")).alias("s")
    d = rows.alias("d")
    both = d.join(lists, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.key") == F.col("s.key")), "left").select("d.id", "d.text", "s.found")
    id_type = rows.schema["id"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts, SLICE_BYTES):
                sizes, spans, kept = [], [], []
                for t, found in zip(texts[a:b], batch.column(2).slice(a, b - a).to_pylist()):
                    raw = t.encode()
                    merged: list[list[int]] = []
                    for s in sorted((x["start"], x["stop"]) for x in found or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    edges = [0, *[e for s in merged for e in s], len(raw)]
                    sizes.append(len(raw))
                    spans.append([{"start": s, "stop": e} for s, e in merged])
                    kept.append(b"".join(raw[x:y] for x, y in zip(edges[0::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "spans", "kept"])

    out = both.mapInArrow(apply, f"id {id_type}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def removal_digests(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats`` rows."""
    return cleaned.select(
        id_col, "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
