"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once and whole, so its tokens are those that a model
sees.  The byte lengths of its tokens add up to their character spans; an
interval join of the sorted spans with the sorted sections gives each token
to the section that holds it.  A token that crosses a border is allocated by
an explicit rule: ``most`` (the section with most of its characters, the
earlier one of equals), ``start`` (the section of its first character) or
``share`` (every section its part of the token's characters).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import text_slices

SLICE_CHARS = 2_000_000
RULES = ("most", "start", "share")
SECTION = "struct<name:string,start:bigint,stop:bigint>"


class Encoder:
    """A byte-level vocabulary and the byte length of each of its tokens."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character of every token.  A token that
        holds part of a character's bytes spans the whole character."""
        if not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stop = np.cumsum(self.length[self.encoding.encode_to_numpy(text, disallowed_special=())])
        start = np.concatenate([[0], stop[:-1]])
        if text.isascii():
            return start, stop
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80)
        return character[start] - 1, character[stop - 1]


_LOADED: dict[str, Encoder] = {}


def _load(vocabulary: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(vocabulary, pattern)
    return _LOADED[key]


def lines_of(text: str) -> list[tuple[int, int, str]]:
    """The lines of a text as sections; a line break belongs to the line that
    it ends."""
    stops = np.cumsum([len(x) + 1 for x in text.split("\n")])
    stops[-1] -= 1  # the last line has no break
    starts = np.concatenate([[0], stops[:-1]])
    return [(a, b, "line") for a, b in zip(starts.tolist(), stops.tolist()) if b > a]


def sections_of(text: str, given: list | None) -> list[tuple[int, int, str]]:
    """Given sections in order, clipped to the text and to what earlier ones left."""
    cut, end = [], 0
    for s in sorted((x["start"] or 0, len(text) if x["stop"] is None else x["stop"], x["name"] or "") for x in given or () if x):
        begin, stop = max(s[0], end, 0), min(s[1], len(text))
        if stop > begin:
            cut.append((begin, stop, s[2]))
            end = stop
    return cut


def attribute(start: np.ndarray, stop: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each disjoint sorted section [lo, hi), and
    of what lies in no section as the last entry."""
    n = len(lo)
    counts, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if not n:
        counts[0] = len(start)
        return counts, crossing
    first = np.searchsorted(hi, start, side="right")   # first section that ends after the token begins
    last = np.searchsorted(lo, stop, side="left") - 1  # last section that begins before the token ends
    inside = (first == last) & (lo[np.minimum(first, n - 1)] <= start) & (stop <= hi[np.minimum(first, n - 1)])
    outside = first > last
    counts[:n] = np.bincount(first[inside], minlength=n)[:n]
    counts[n] = outside.sum()
    for t in np.flatnonzero(~inside & ~outside).tolist():
        touched = np.arange(first[t], last[t] + 1)
        part = np.minimum(hi[touched], stop[t]) - np.maximum(lo[touched], start[t])
        rest = stop[t] - start[t] - part.sum()
        crossing[touched] += 1
        if rule == "share":
            counts[touched] += part / (stop[t] - start[t])
            counts[n] += rest / (stop[t] - start[t])
        elif rule == "start":
            counts[touched[0] if lo[touched[0]] <= start[t] else n] += 1
        else:
            best = int(np.argmax(part))
            counts[touched[best] if part[best] >= rest else n] += 1
    return counts, crossing


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str, rule: str = "most", sections: Column | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, name, start, stop, n_tokens, n_crossing): one row per
    section of every document, and one with a null section for tokens outside
    all sections where there are any.

    ``sections`` is a column of ``array<struct<name, start, stop>>`` in
    characters (default: the lines of the text).  Sections are sorted and
    clipped to the text; empty ones and ones that overlap an earlier one from
    its start on are cut to what is left of them, and dropped if nothing is.
    ``n_tokens`` of a document's rows add up to the tokens of its whole text;
    ``n_crossing`` counts the tokens that touch the section and reach beyond
    it.  ``share`` gives fractions, the other rules whole numbers.

    Null, empty texts have no rows.  Null section lists count as empty, null
    bounds as the ends of the text.  Null ids and repeated rows pass row by
    row, an empty table gives an empty result, other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, got {rule!r}")
    ship_package(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    by_line = sections is None
    given = F.lit(None) if by_line else sections
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), given.cast(f"array<{SECTION}>").alias("sections"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        encoder = _load(*shared.value)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            lists = batch.column(2)
            for a, b in text_slices(texts, SLICE_CHARS):
                who, section, name, lo, hi, counts, crossing = ([] for _ in range(7))
                for k, (text, spans) in enumerate(zip(texts[a:b], lists.slice(a, b - a).to_pylist()), start=a):
                    if not text:
                        continue
                    cut = lines_of(text) if by_line else sections_of(text, spans)
                    begin, stop = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)
                    n, x = attribute(*encoder.spans(text), begin, stop, rule)
                    shown = len(cut) + bool(n[-1])
                    who += [k] * shown
                    section += [*range(len(cut)), None][:shown]
                    name += [*[c[2] for c in cut], None][:shown]
                    lo += [*begin.tolist(), None][:shown]
                    hi += [*stop.tolist(), None][:shown]
                    counts += n[:shown].tolist()
                    crossing += x[:shown].tolist()
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(who, pa.int64())), pa.array(section, pa.int64()), pa.array(name, pa.string()), pa.array(lo, pa.int64()),
                     pa.array(hi, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64())],
                    names=["id", "section", "name", "start", "stop", "n_tokens", "n_crossing"])

    out = rows.mapInArrow(run, f"id {id_type}, section long, name string, start long, stop long, n_tokens double, n_crossing long")
    if rule != "share":
        out = out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return out.withColumnRenamed("id", id_col)
