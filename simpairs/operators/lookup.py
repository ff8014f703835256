"""Lookups that exchange only the rows that can match.

Spark filters inner and semi joins by a runtime filter of its own; an anti or
left join must keep the rows without a match, so it sends all of them through
the exchange.  Here the keys of the lookup side are folded into a Bloom filter
first: rows that it rules out have no match, need no exchange and go past the
join, the others are joined as before.  The filter never rules out a match, so
the result is that of the plain join.

A filter is a table of 64-bit words.  A key sets ``BITS_SET`` bits of one word,
so filters are built by a grouped ``bit_or`` that combines before its exchange,
and merge by the same aggregate.  It is broadcast; ``MAX_WORDS`` bounds it, and
more keys than that bound allows mean the plain join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .batching import apply_translation, routed_text
from .split import keep_keys

#: Bits of the filter per key; with BITS_SET bits a key, about 1 row in 100
#: without a match is let through.
BITS_PER_KEY = 16
BITS_SET = 4
#: Largest filter: 2 ** 19 rows of two longs, for up to two million keys.
MAX_WORDS = 1 << 19


class KeyFilter(NamedTuple):
    """``table`` (word, bits) has one row per word that is not empty."""

    table: DataFrame
    words: int
    types: tuple


def words_for(n_keys: int) -> int:
    """Words of a filter for ``n_keys`` keys: the next power of two."""
    return 1 << max(0, -(-n_keys * BITS_PER_KEY // 64) - 1).bit_length()


def _place(cols: list[Column], words: int) -> tuple[Column, Column]:
    """The word of a key and the bits that it sets there, from two hashes."""
    spread = F.xxhash64(F.lit("bits"), *cols)
    mask = F.lit(0).cast("bigint")
    for i in range(BITS_SET):
        bit = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return F.pmod(F.xxhash64(*cols), F.lit(words)), mask


def _types(df: DataFrame, cols: list[str]) -> tuple:
    return tuple(df.schema[c].dataType for c in cols)


def key_filter(keys: DataFrame, cols: list[str], expected: int | None = None) -> KeyFilter | None:
    """A filter of the keys ``cols`` of ``keys``, written to the shared scratch
    folder.  It is sized for ``expected`` keys (default: the counted rows);
    None when that takes more than ``MAX_WORDS`` words.  Null parts of a key are
    values like others."""
    words = words_for(keys.count() if expected is None else expected)
    if words > MAX_WORDS:
        return None
    word, mask = _place([F.col(c) for c in cols], words)
    table = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    path = scratch_dir(keys.sparkSession, "key-filter")
    table.write.parquet(path)
    return KeyFilter(keys.sparkSession.read.schema(table.schema).parquet(path), words, _types(keys, cols))


def merge_filters(a: KeyFilter, b: KeyFilter) -> KeyFilter:
    """The filter of both key sets; both must have the same size and key types."""
    if (a.words, a.types) != (b.words, b.types):
        raise ValueError("filters of different sizes or key types do not merge")
    table = a.table.unionByName(b.table).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return KeyFilter(table, a.words, a.types)


def split_by_filter(df: DataFrame, cols: list[str], flt: KeyFilter) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of the filter, rows that surely have none).
    Both read ``df``, so a dear input should be a written table.  Key types must
    be those of the filter: equal numbers of different types hash differently."""
    if _types(df, cols) != flt.types:
        raise TypeError(f"keys are {_types(df, cols)}, the filter holds {flt.types}")
    word, mask = _place([df[c] for c in cols], flt.words)
    held = F.broadcast(flt.table.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    inside = (word == held["__word"]) & (held["__bits"].bitwiseAND(mask) == mask)
    return df.join(held, inside, "left_semi"), df.join(held, inside, "left_anti")


def drop_keys(df: DataFrame, keys: DataFrame, key: str, flt: KeyFilter | None = None) -> DataFrame:
    """Rows whose key is not in ``keys`` (B7): the anti join of ``keep_keys``,
    null keys equal, on the rows that may match."""
    flt = flt or key_filter(keys, [key])
    if flt is None:
        return keep_keys(df, keys, key, keep=False)
    maybe, surely = split_by_filter(df, [key], flt)
    return surely.unionByName(keep_keys(maybe, keys, key, keep=False))


def apply_translation_filtered(df: DataFrame, tm: DataFrame, cols=("sentence1", "sentence2", "sentence3"),
                               flt: KeyFilter | None = None) -> DataFrame:
    """``apply_translation`` (C8) on the rows that may have an entry; the others
    keep their texts.  ``flt`` is a filter over (text_key, lang) of ``tm``."""
    flt = flt or key_filter(tm, ["text_key", "lang"])
    if flt is None:
        return apply_translation(df, tm, cols)
    keyed = df.withColumn("__tkey", F.md5(routed_text(cols)))
    maybe, surely = split_by_filter(keyed, ["__tkey", "lang"], flt)
    done = apply_translation(maybe.drop("__tkey"), tm, cols)
    return done.unionByName(surely.drop("__tkey").withColumn("translated", F.lit(False)))
