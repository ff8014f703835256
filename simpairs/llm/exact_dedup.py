"""Exact duplicate groups by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Runs merged at one level: 2 ** FAN_BITS.
FAN_BITS = 4
#: Entries that a block of a sorted run holds on average, at every level.
BLOCK_ROWS = 256
#: Leading digest bits that order a run and cut it into blocks.
POS_BITS = 56


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(run, id, digest, n_bytes, check): one row per document, staged.  The run
    number is the partition that wrote the row; ``check`` and ``n_bytes`` are
    independent of the digest and verify every merge."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return staged(docs.select(
        F.spark_partition_id().cast("long").alias("run"), F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check"),
    ), "digests")


def _same(a: Column, b: Column) -> Column:
    return (a["digest"] == b["digest"]) & (a["n_bytes"] == b["n_bytes"]) & (a["check"] == b["check"])


def sorted_runs(runs: DataFrame, pick, bits: int) -> DataFrame:
    """(run, block, entries): every run without its own copies, sorted by digest
    and cut at the leading ``bits`` of the digest.  A run is combined before its
    exchange, so a text with a third of all rows is one entry per run."""
    key = ["digest", "n_bytes", "check"]
    entry = F.struct("pos", *key, "id", "n")
    return (
        runs.groupBy("run", *key).agg(pick("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .withColumn("pos", F.conv(F.hex(F.substring("digest", 1, POS_BITS // 8)), 16, 10).cast("long"))
        .groupBy("run", F.shiftright("pos", POS_BITS - bits).alias("block"))
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    )


def merge_level(level: DataFrame, pick_array, bits: int) -> DataFrame:
    """One round: 2 ** FAN_BITS neighbouring sorted runs become one.

    The runs exchange their parts: every block of ``bits`` is cut at its next
    FAN_BITS bits, which keeps its order, and the parts of one range meet.
    They are put in order as one array (the JVM's object sort finds the sorted
    parts and merges them, it does not sort them again), and neighbours with
    the same digest, length and second hash become one entry with the kept
    identifier and the sum of rows.
    """
    shift = POS_BITS - bits - FAN_BITS
    fan = 1 << FAN_BITS
    parts = F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda j: F.struct(
        j.alias("j"), F.filter("entries", lambda e: F.shiftright(e["pos"], shift).bitwiseAND(F.lit(fan - 1)) == j).alias("part")))
    merged = (
        level.select(F.shiftright("run", FAN_BITS).alias("run"), "block", F.explode(parts).alias("p"))
        .where(F.size("p.part") > 0)
        .groupBy("run", (F.col("block") * fan + F.col("p.j")).alias("block"))
        .agg(F.sort_array(F.flatten(F.collect_list("p.part"))).alias("merged"))
    )
    at = F.col("merged")
    starts = F.filter(F.sequence(F.lit(0), F.size("merged") - 1),
                      lambda i: F.when(i == 0, True).otherwise(~_same(F.get(at, i), F.get(at, i - 1))))
    merged = merged.withColumn("starts", starts)

    def entry(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.size("merged"))
        group, first = F.slice("merged", start + 1, end - start), F.get(at, start)
        return F.struct(
            *[first[c].alias(c) for c in ("pos", "digest", "n_bytes", "check")],
            pick_array(F.transform(group, lambda e: e["id"])).alias("id"),
            F.aggregate(group, F.lit(0).cast("long"), lambda n, e: n + e["n"]).alias("n"),
        )

    return merged.select("run", "block", F.transform("starts", entry).alias("entries"))


def merge_runs(runs: DataFrame, keep: str = "max") -> DataFrame:
    """(digest, n_bytes, check, keep_id, n): sorted runs merged in binomial
    rounds, 2 ** FAN_BITS runs at a time.

    Merged runs hold more entries, but a round also cuts the blocks, so they
    keep at most about BLOCK_ROWS entries on average (digests are uniform) and
    every round is spread over all tasks.  Two texts are one only when digest,
    length and second hash agree.
    """
    pick, pick_array = {"max": (F.max, F.array_max), "min": (F.min, F.array_min)}[keep]
    top, largest = runs.groupBy("run").count().agg(F.max("run"), F.max("count")).first()
    top, bits = top or 0, max(0, ((largest or 0) // BLOCK_ROWS).bit_length())
    level = sorted_runs(runs, pick, bits)
    while top:
        level = merge_level(level, pick_array, bits)
        top, bits = top >> FAN_BITS, bits + FAN_BITS
    e = level.select(F.explode("entries").alias("e"))
    return e.select("e.digest", "e.n_bytes", "e.check", F.col("e.id").alias("keep_id"), "e.n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row per document.

    Texts are compared as they are; null counts as empty, so null and empty
    texts are one group.  ``keep_id`` is the largest (``keep="max"``) or
    smallest id of the group; null ids count as rows but are never chosen
    while another id exists.  Repeated rows (same id and text) count each and
    share their fate.  An empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    runs = digest_runs(docs, id_col, text_col)
    groups = merge_runs(runs, keep)
    # Only groups of two or more rows are joined back; a single row keeps itself.
    copies = groups.where("n > 1")
    out = runs.join(copies, ["digest", "n_bytes", "check"], "left")
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
