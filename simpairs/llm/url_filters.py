"""URL allow and block rules as a sort-merge range join.

A host is written backwards label by label with a closing dot
(``blog.example.net`` -> ``net.example.blog.``), so a rule host and all its
subdomains form one interval ``[key, key with the last dot replaced by "/")``
of the sorted keys.  The intervals of a rule table are nested or disjoint.

The distinct hosts and the rule hosts are range-partitioned and sorted
together.  A sweep in that order keeps a stack of the rules that are still
open: slot ``d`` of the stack holds the last rule host with ``d`` labels, and
it is open while the key is below its interval end.  Ranges hand their last
slots to the ranges after them, so no range needs another one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, staged

RULE_SCHEMA = "host string, path string, action string"
_URL = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, active) for the distinct ``host`` values that lie in at least one
    rule interval; ``active`` is the stack's open rules, all paths of each."""
    heads = (
        rules.where(F.col("host").isNotNull())
        .select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .withColumn("rule", F.concat("host", "path"))
        # Equal rules: a block wins over an allow.
        .groupBy("host", "path", "rule").agg(F.max("action").alias("action"))
        .groupBy("host").agg(F.collect_list(F.struct("path", "rule", "action")).alias("paths"))
        .withColumn("key", host_key(F.col("host")))
        .select(
            "key", F.expr("concat(substr(key, 1, length(key) - 1), '/')").alias("end"),
            F.size(F.split("host", r"\.")).alias("depth"), "paths",
        )
    )
    heads = staged(heads, "url-rules")
    depths = sorted(r[0] for r in heads.select("depth").distinct().collect())  # at most 127 by the DNS rule
    points = hosts.select(host_key(F.col("host")).alias("key"), "host")
    rows = (
        heads.withColumn("host", F.lit(None).cast("string")).withColumn("kind", F.lit(0))
        .unionByName(points.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    )
    # Written once: the ranges must be the same for the carried slots and the sweep.
    rows = staged(rows.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "url-sweep")

    def slots(entry: Column) -> list[Column]:
        return [F.when((F.col("kind") == 0) & (F.col("depth") == d), entry).alias(f"slot{d}") for d in depths]

    opened = rows.select("part", "kind", "key", "host", *slots(F.struct("key", "end", "paths")))
    ends = opened.groupBy("part").agg(*[F.max(f"slot{d}").alias(f"slot{d}") for d in depths])
    # One row per range: the slots that the ranges before it leave open.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", *[F.last(f"slot{d}", ignorenulls=True).over(before).alias(f"carry{d}") for d in depths])
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = [F.coalesce(F.last(f"slot{d}", ignorenulls=True).over(sweep), F.col(f"carry{d}")) for d in depths]
    swept = opened.join(F.broadcast(carried), "part").select("kind", "key", "host", F.array(*stack).alias("stack"))
    live = F.filter("stack", lambda s: s.isNotNull() & (s["end"] > F.col("key")))
    return swept.where("kind = 1").select("host", F.flatten(F.transform(live, lambda s: s["paths"])).alias("active")) \
        .where(F.size("active") > 0)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    A rule (host, path, action) fits its host and all subdomains if the url's
    path starts with the rule's path.  The longest rule text wins, ties go to
    the longer host.  No rule fits: ``rule`` is null, verdict is ``default``.

    Null urls and urls without ``://`` have empty host and path and fit only
    rules with an empty host.  Repeated rows are judged row by row, an empty
    table or an empty rule table gives ``default`` for every row, and other
    columns of ``pages`` are not read.  The rule table is a configured list;
    the paths under one rule host travel as one array.

    Only distinct hosts are sorted (combined before the shuffle), so a host
    with a third of all pages is one row in the sweep; the join back to the
    pages is one that Spark can split by size.
    """
    p = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"),
                     url_path(F.col(url_col)).alias("path"))
    if rules.isEmpty():
        none = F.lit(None).cast("string")
        return p.withColumn("rule", none).withColumn("verdict", F.lit(default)).withColumnRenamed("page_id", id_col)
    active = active_rules(p.select("host").distinct(), rules)
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct(
        F.length(r["rule"]).alias("n"), (-F.length(r["path"])).alias("h"), r["rule"].alias("rule"),
        r["action"].alias("action")))
    best = F.array_max(ranked)
    out = p.join(active, "host", "left").withColumn("best", best)
    return out.select(
        F.col("page_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
