"""Byte-pair encoding and decoding by speculate and verify.

For words not met before, a greedy longest match proposes tokens (one pass
of an automaton over all of them).  A proposal
is the true merge result if and only if every token can be reached by merges
and no merge would ever cross the border of two adjacent tokens, so all
adjacent pairs of a batch are checked at once with array operations.  Only
words with a failing pair go through exact merging.

The vocabulary file (a fixed 1-2 MB) is broadcast as bytes, so executors need
no copy of it.  Words are remembered per Python worker up to ``WORD_MEMORY``
entries; a full memory is emptied, which changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from ..session import ship_package
from .common import text_slices

WORD_MEMORY = 300_000
SLICE_CHARS = 2_000_000
SHORT = 40
NEVER = 1 << 40
NO_MERGE = (NEVER, -1)

# The tokenizer's word pattern, white space and word end.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # the same within ASCII
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
SPLIT = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
SPLIT_ONLY_HERE = "\x1c\x1d\x1e\x1f"  # str.split cuts at these, the tokenizer does not
WORD_END = "</w>"
END = "\x00"  # stands for the word end in the automaton; no byte letter


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for
    itself, the rest for the letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Merge tables of one vocabulary and the words met so far."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * size
        for text, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = text
        self.special = special
        names = sorted(special, key=len, reverse=True)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})

        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((i, j), (r, k))
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        keys = np.array([(i << 32) | j for i, j in self.merge] or [0], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.merge.values()] or [NEVER], np.int64)[order]

        # Tokens that merging can reach: both halves can, and stay apart until they merge.
        joined = np.flatnonzero(self.rank >= 0)
        apart = self.compatible(self.left[joined], self.right[joined], self.rank[joined])
        reach = np.ones(size, bool)
        reach[joined] = False
        for t, fine in sorted(zip(joined.tolist(), apart.tolist()), key=lambda x: self.rank[x[0]]):
            reach[t] = fine and reach[self.left[t]] and reach[self.right[t]]
        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        self.lengths = np.zeros(size, np.int64)
        for text, t in vocab.items():
            if reach[t]:
                key = text.removesuffix(WORD_END) + END if text.endswith(WORD_END) else text
                self.lengths[t] = len(key)
                self.automaton.add_word(key, t)
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}  # white-space chunks
        self.known: dict[str, bytes] = {}  # words of chunks

    def cross_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For every pair, whether no merge crosses its border.

        The merges that built both tokens are undone, latest first.  Before
        each undone merge there was a pair across the border; had its rank
        come first, merging would have crossed.  Of equal ranks the left one
        comes first, hence the +1 for the right token's merges.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while live.size:
            x, y = a[live], b[live]
            crossed = self.cross_rank(x, y) < limit[live]
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = np.where(undo_left, rx, ry + 1)
        return ok

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words in one pass of an automaton:
        tokens, the word each belongs to, and the words left with a gap."""
        line = (END.join(words) + END) if words else ""
        found = np.array(list(self.automaton.iter_long(line)), np.int64).reshape(-1, 2)
        last, token = found[:, 0], found[:, 1]
        ends = np.cumsum([len(w) + 1 for w in words])
        owner = np.searchsorted(ends, last, side="right")
        first = last - self.lengths[token] + 1
        begin = np.concatenate([[0], ends[:-1]]) if words else np.empty(0, np.int64)
        border = np.ones(len(last) + 1, bool)
        border[1:-1] = owner[1:] != owner[:-1]
        at = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        gap = np.where(border[:-1], first != begin[owner], first != at) | (border[1:] & (last != ends[owner] - 1))
        whole = np.ones(len(words), bool)
        whole[owner[gap]] = False
        whole[np.setdiff1d(np.arange(len(words)), owner)] = False
        return token, owner, np.flatnonzero(~whole)

    def merged(self, word: str) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equal ranks."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + WORD_END]]
        if len(ids) <= SHORT:
            return self._merged_short(ids)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.merge[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(queue)
        while queue:
            _, i, (a, b) = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in self.merge:
                    heapq.heappush(queue, (self.merge[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in self.merge:
                heapq.heappush(queue, (self.merge[p][0], h, p))
        return [t for t in ids if t >= 0]

    def _merged_short(self, ids: list[int]) -> list[int]:
        """The same for few letters, without a queue."""
        get = self.merge.get
        found = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        ranks = [f[0] for f in found]
        joined = [f[1] for f in found]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i] = joined[i]
            del ids[i + 1], ranks[i], joined[i]
            if i < len(ranks):
                ranks[i], joined[i] = get((ids[i], ids[i + 1]), NO_MERGE)
            if i:
                ranks[i - 1], joined[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
        return ids

    def pieces(self, chunk: str) -> list[str]:
        """Words of a chunk without white space."""
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                return [text]
            if text[-1] in ",." and text[:-1].isalpha():
                return [text[:-1], text[-1]]
        else:
            # The public library's own Unicode tables, so that every letter falls as it does there.
            text = NORMAL.normalize_str(chunk)
            return [w for w, _ in SPLIT.pre_tokenize_str(text)]
        return PIECE.findall(text)

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks not met before, all their new words at once."""
        plan: list[tuple[str, list[str]]] = []
        number: dict[str, None] = {}
        for chunk in chunks:
            if "<|" in chunk and self.special_at:
                parts = [p for p in self.special_at.split(chunk) if p]
                words = [w for p in parts for w in ([p] if p in self.special else self.pieces(p))]
            else:
                words = self.pieces(chunk)
            plan.append((chunk, words))
            for w in words:
                if w not in self.known:
                    number[w] = None
        words = list(number)
        letters = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        token, owner, gaps = self.propose(letters)
        joint = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique((token[joint] << 32) | token[joint + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = {*gaps.tolist(), *owner[joint][~fine[which]].tolist()}
        stops = np.searchsorted(owner, np.arange(len(words)), side="right").tolist()
        flat = token.astype(np.int32).tobytes()
        known, start = self.known, 0
        for k, (w, stop) in enumerate(zip(words, stops)):
            if w in self.special:
                known[w] = np.int32(self.special[w]).tobytes()
            elif k in failing:
                known[w] = array("i", self.merged(letters[k])).tobytes()
            else:
                known[w] = flat[4 * start:4 * stop]
            start = stop
        for chunk, parts in plan:
            self.words[chunk] = known[parts[0]] if len(parts) == 1 else b"".join([known[w] for w in parts])

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text (null: none) as an int32 array."""
        if len(self.words) > WORD_MEMORY:
            self.words = {}
        if len(self.known) > WORD_MEMORY:
            self.known = {}
        chunked = []
        for t in texts:
            t = t or ""
            odd = any(c in t for c in SPLIT_ONLY_HERE)
            chunked.append([c for c in SPACE.split(t) if c] if odd else t.split())
        fresh: set[str] = set()
        for chunks in chunked:
            fresh.update(chunks)
        fresh.difference_update(self.words)
        if fresh:
            self.learn(fresh)
        word = self.words.__getitem__
        return [np.frombuffer(b"".join(map(word, chunks)), np.int32) for chunks in chunked]

    def forget(self) -> None:
        """Give the words' memory back to the machine."""
        self.words, self.known = {}, {}
        pa.default_memory_pool().release_unused()

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str, WordBpe] = {}


def _load(vocabulary: bytes) -> WordBpe:
    """One table per vocabulary and Python worker."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(vocabulary)
    return _LOADED[key]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                  forget: bool = False) -> DataFrame:
    """(id, ids, decoded) for every row: the token ids of the whole text and
    their decoded form (token texts joined by one space).

    Null and empty texts, and texts of white space alone, have no ids and
    decode to the empty text.  Null ids and repeated rows pass through row by
    row, an empty table gives an empty result, other columns are not read.
    Special-token strings in a text become their special ids.  A word of any
    length is one word; work is linear in text length but for exact merging,
    which is n log n in a failing word.

    ``forget`` empties the words remembered when a task ends, for jobs whose
    Python workers serve other steps too; results are the same.
    """
    ship_package(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        bpe = _load(shared.value)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for start, stop in text_slices(texts, SLICE_CHARS):
                found = bpe.encode(texts[start:stop])
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=ends[1:])
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, stop - start), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array([bpe.decode(x) for x in found], pa.string())],
                    names=["id", "ids", "decoded"])
        if forget:
            bpe.forget()

    return rows.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode`` rows."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
