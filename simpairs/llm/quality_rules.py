"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a document when one statistic of its text is at or beyond a
cutoff.  Cutoffs are not chosen by eye: on labelled holdout rows, each (stratum,
rule) walks a fixed list of cutoffs from the one that rejects least.  At every
cutoff the hypothesis "more than the allowed share of good documents would be
rejected" is tested by the exact binomial tail; the walk stops at the first
cutoff that cannot be refuted.  Tests of one walk need no correction, as they
run in a fixed order; the error chance is divided by the number of walks
(rules times strata), and the allowed share by the number of rules.  So, with
probability 1 - ``error``, in no stratum do the rules together reject more than
``share`` of the good documents that pass the base rule.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import _null_safe_join
from ..session import ship_package
from .common import WORD_PATTERN, crc_fold, staged, text_slices

SLICE_CHARS = 1_000_000
# The symbols and the base limits of the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: Allowed share of good documents rejected in a stratum, and the chance of error.
SHARE, ERROR = 0.05, 0.05
#: Every rule: its statistic and its cutoffs, from the one that rejects least.
#: A cutoff rejects statistics at or beyond it, above for falling lists.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [3.0 * 0.9 ** i for i in range(64)]),
    "long_words": ("word_chars / n_words", [20.0 - 0.25 * i for i in range(64)]),
    "short_words": ("word_chars / n_words", [1.0 + 0.0625 * i for i in range(64)]),
    "repeated_lines": ("n_dup_lines / n_lines", [1.0 * 0.93 ** i for i in range(64)]),
    "repeated_words": ("n_repeat_words / n_words", [REPEAT_PERCENT / 100 - i / 128 for i in range(64)]),
}
_WORD = re.compile(WORD_PATTERN)
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: Sequence[str]) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Two steps of renumbering: a window's number is exact, not a hash.
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * np.int64(len(number)) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + n] |= again
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers of ``STATS`` of one whole text; null is empty."""
    text = text or ""
    words = _WORD.findall(text)
    lines = text.split("\n")
    if len(lines) > 1:
        lines = list(compress(lines, map(_WORD.search, lines)))
    else:
        lines = lines if words else []
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeat_words(words))


def stats_column(text: Column) -> Column:
    """struct of ``STATS`` of a text column."""
    @F.arrow_udf(STATS)
    def stats(column: pa.Array) -> pa.Array:
        rows = []
        for start in range(0, len(column), 500):
            texts = column.slice(start, 500).to_pylist()
            for a, b in text_slices(texts, SLICE_CHARS):
                rows += [text_stats(t) for t in texts[a:b]]
        names = [x.split()[0] for x in STATS.split(", ")]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return stats(text)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def statistic(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(over), F.col(under)), F.lit(0.0))


def falling(rule: str) -> bool:
    return RULES[rule][1][0] > RULES[rule][1][-1]


def rejects(rule: str, cutoff: Column) -> Column:
    return statistic(rule) >= cutoff if falling(rule) else statistic(rule) <= cutoff


def first_cutoff(rule: str) -> Column:
    """Number of the first cutoff of the rule that rejects the row; the number
    of cutoffs if none does."""
    passed = F.filter(F.array(*[F.lit(c) for c in RULES[rule][1]]), lambda c: ~rejects(rule, c))
    return F.size(passed)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most ``k`` of ``n``) for chance ``p``, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose_cutoff(good: Sequence[int], bad: Sequence[int], share: float, error: float) -> int:
    """Of the cutoffs that the walk certifies, the one with the largest gain
    (share of bad rejected less share of good rejected), ties to the stricter
    walk position; -1 when none is certified or none gains.

    ``good[i]`` counts good rows whose first cutoff is i; the last entry counts
    those that no cutoff rejects; ``bad`` likewise.
    """
    n, m = sum(good), sum(bad)
    best, chosen, lost, caught = 0.0, -1, 0, 0
    for i in range(len(good) - 1):
        lost, caught = lost + good[i], caught + bad[i]
        if n == 0 or binomial_tail(lost, n, share) > error:
            break
        gain = (caught / m if m else 0.0) - lost / n
        if gain > best:
            best, chosen = gain, i
    return chosen


def certified_cutoffs(stats: DataFrame, labels: DataFrame, id_col: str, strata: Sequence[str], label_col: str = "quality",
                      share: float = SHARE, error: float = ERROR) -> DataFrame:
    """(strata.., rule, cutoff, n_good, n_rejected): the chosen cutoff of every
    rule that has one in a stratum.

    ``stats`` holds the id, the strata and the columns of ``STATS``; only rows
    that pass the base rule and have a label count.  An id with several labels
    is good if all are 1.  Counts are combined before they meet: per stratum a
    table of rules by cutoffs, whatever its number of rows.
    """
    judged = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")) \
        .agg((F.min(label_col) == 1).alias("__good"))
    rows = stats.where(~base_failed()).join(judged, F.col(id_col) == F.col("__id"))
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), first_cutoff(r).alias("at")) for r in RULES])
    counts = rows.select(*strata, "__good", F.explode(hits).alias("__h")).select(*strata, "__good", "__h.*") \
        .groupBy(*strata, "rule", "at").agg(F.sum(F.col("__good").cast("long")).alias("good"), F.sum((~F.col("__good")).cast("long")).alias("bad"))
    counts = staged(counts, "rule-counts")
    walks = max(1, counts.select(*strata, "rule").distinct().count())
    allowed, chance = share / len(RULES), error / walks

    def choose(part: pa.Table) -> pa.Table:
        rule = part["rule"][0].as_py()
        cuts = RULES[rule][1]
        good, bad = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
        for at, g, b in zip(*[part[c].to_pylist() for c in ("at", "good", "bad")]):
            good[at], bad[at] = g, b
        i = choose_cutoff(good, bad, allowed, chance)
        one = part.select([*strata, "rule"]).slice(0, 1 if i >= 0 else 0)
        for name, value in (("cutoff", cuts[i]), ("n_good", sum(good)), ("n_rejected", sum(good[:i + 1]))):
            one = one.append_column(name, pa.array([value] * one.num_rows, pa.float64() if name == "cutoff" else pa.int64()))
        return one

    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in strata)
    return counts.groupBy(*strata, "rule").applyInArrow(choose, f"{kinds}, rule string, cutoff double, n_good long, n_rejected long")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: Sequence[str] = ("lang",),
                  label_col: str = "quality", folds: int = 4, held_fold: int = 2, share: float = SHARE, error: float = ERROR) -> DataFrame:
    """(id, the numbers of ``STATS``, base_failed, kept, rejected_by) for every row.

    Labels of ids whose crc32 leaves ``held_fold`` modulo ``folds`` are not
    used, so the promise can be tested on them.  A stratum with too few good
    labelled rows for any certificate rejects by the base rule only.  Null and
    empty texts have no words and fail the base rule; null strata are a
    stratum; repeated rows are judged alike; an empty table gives an empty
    result; other columns are not read.
    """
    ship_package(docs.sparkSession)
    own = [f"__stratum{i}" for i in range(len(strata))]
    stats = docs.select(F.col(id_col).alias("__doc"), *[F.col(c).alias(o) for c, o in zip(strata, own)], stats_column(F.col(text_col)).alias("__x"))
    stats = staged(stats.select("__doc", *own, "__x.*"), "text-stats")
    used = labels.where(crc_fold(id_col, folds) != held_fold).select(F.col(id_col).alias("__doc"), F.col(label_col))
    cutoffs = certified_cutoffs(stats, used, "__doc", own, label_col, share, error)
    per = cutoffs.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cuts"))
    rows = _null_safe_join(stats, per, own, "left")
    hit = []
    for rule in RULES:
        hit.append(F.when(rejects(rule, F.element_at("__cuts", F.lit(rule))), F.lit(rule)))
    by = F.when(base_failed(), F.lit("base")).otherwise(F.coalesce(*hit))
    return rows.withColumn("rejected_by", by).select(
        F.col("__doc").alias(id_col), *[x.split()[0] for x in STATS.split(", ")], base_failed().alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"), "rejected_by")
