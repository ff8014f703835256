"""Conversation repair by a Viterbi search that emits what its survivors share.

A repaired conversation reads ``(s?(ua)+)?`` in role initials.  Four states say
how far the output has come: nothing yet, after the system turn, after a user
turn, after an assistant turn.  Each row is kept, given another role or
deleted, with empty turns inserted before it; the cheapest edits win, equal
costs by the smaller string of edit initials.

Survivors are heads of a tree of backpointers with reference counts.  A state
so far behind another that it loses whatever follows is no survivor.  A branch
that no survivor needs is freed; as soon as all survivors descend from one
node, the edits up to it are final and leave the tree.  Ties compare the whole
unresolved suffixes of both branches, back to their common ancestor.

A conversation is cut into blocks of positions, and a block is searched from
every state in which it can begin, so one long conversation is spread over
tasks.  The blocks' results are composed by the same search, a block being one
step.  Cheapest edits of the same rows between the same two states are never
prefixes of one another (the longer would cost more), so the order of whole
strings is the order of their blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import _null_safe_join, value_rank
from ..session import ship_package
from .common import staged

BLOCK = 2048
# The costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# The damage of the contract, by crc32 modulo 20.
DAMAGE = {"drop": 0, "empty": 1, "unmark": 2, "repeat": 3, "user": 4}
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
LEGAL = {"su", "ua", "au"}
#: Whatever follows the second state, the first can follow at no more than this
#: above its cost: by inserting turns, or by deleting the system turn instead.
BEHIND = {
    NOTHING: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0}, SYSTEM: {NOTHING: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {NOTHING: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT}, ASSISTANT: {NOTHING: DELETE, SYSTEM: 0, USER: INSERT},
}
#: How a conversation may end: (state, state, cost, inserted turns).
ENDINGS = [(NOTHING, NOTHING, 0, ""), (ASSISTANT, ASSISTANT, 0, ""), (USER, ASSISTANT, INSERT, "Ia"), (SYSTEM, ASSISTANT, 2 * INSERT, "IuIa")]


class _Node:
    __slots__ = ("parent", "piece", "depth", "refs")

    def __init__(self, parent: "_Node | None", piece: str, depth: int) -> None:
        self.parent, self.piece, self.depth, self.refs = parent, piece, depth, 0


class Survivors:
    """The cheapest way into every state, and the edits that are already final.

    ``step`` takes moves (from, to, cost, piece); a piece is the edits of one
    step, two letters each: K, R, D or I, and the role initial it leaves.
    """

    def __init__(self, state: int = NOTHING) -> None:
        self.root = _Node(None, "", 0)
        self.heads: dict[int, tuple[int, _Node]] = {state: (0, self.root)}

    @staticmethod
    def _before(a: _Node, piece_a: str, b: _Node, piece_b: str) -> bool:
        """Whether the edits through ``a`` come before those through ``b``."""
        left, right = [piece_a], [piece_b]
        while a is not b:
            if a.depth >= b.depth:
                left.append(a.piece)
                a = a.parent
            else:
                right.append(b.piece)
                b = b.parent
        return "".join(reversed(left)) < "".join(reversed(right))

    def step(self, moves: Iterable[tuple[int, int, int, str]]) -> list[str]:
        """Advance all survivors; returns the pieces that became final."""
        best: dict[int, tuple[int, _Node, str]] = {}
        for start, end, cost, piece in moves:
            if (head := self.heads.get(start)) is None:
                continue
            total, held = head[0] + cost, best.get(end)
            if held is None or total < held[0] or total == held[0] and self._before(head[1], piece, held[1], held[2]):
                best[end] = (total, head[1], piece)
        old, self.heads = self.heads, {}
        for end, (total, parent, piece) in best.items():
            # Who can only lose, whatever comes, is no survivor.
            if any(total > best[other][0] + BEHIND[other][end] for other in best if other != end):
                continue
            parent.refs += 1
            self.heads[end] = (total, _Node(parent, piece, parent.depth + 1))
        for _, node in old.values():
            while node.refs == 0 and node.parent is not None:
                node.parent.refs -= 1
                node = node.parent
        return self._settled()

    def _settled(self) -> list[str]:
        if self.root.refs != 1:
            return []
        path = self.path(next(iter(self.heads)))
        out = []
        while self.root.refs == 1:
            self.root = path.pop(0)
            self.root.parent = None
            out.append(self.root.piece)
        return out

    def path(self, state: int) -> list[_Node]:
        """The unresolved nodes of a survivor, oldest first."""
        node, out = self.heads[state][1], []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]


def row_moves(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """The best move of one row between every two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    late = TRUNCATED if fault == "truncated" else 0
    for start in FOLLOWS:
        before = [(start, 0, "")]
        for state, cost, piece in before:  # turns inserted before the row, two at most
            for role, end in FOLLOWS[state].items():
                if role != "s" and len(piece) < 4 and end != start:
                    before.append((end, cost + INSERT, piece + "I" + role))
        for state, cost, piece in before:
            ways = [(state, cost + DELETE, piece + "D.")]
            if fault not in ("blank", "duplicate"):
                for role, end in FOLLOWS[state].items():
                    if role == initial:
                        ways.append((end, cost + late, piece + "K" + role))
                    if role != "s":
                        ways.append((end, cost + late + REROLE, piece + "R" + role))
            for end, total, edits in ways:
                if (start, end) not in best or (total, edits) < best[start, end]:
                    best[start, end] = (total, edits)
    return [(start, end, *found) for (start, end), found in best.items()]


def _by_run(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches, run by run of equal leading columns; a run may
    go over many batches and is never held as a whole."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        key = ahead[:keys]

        def run() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[:keys] == key:
                now, ahead = ahead, next(source, None)
                yield now

        inside = run()
        yield key, inside
        for _ in inside:  # what the reader left
            pass


def _search_blocks(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv, block, pos, initial, fault) rows to the best edits of each block
    between every two states."""
    known: dict[tuple[str, str], list] = {}
    out: list[tuple] = []
    for (conv, block), rows in _by_run(batches, 2):
        entries = [NOTHING] if block == 0 else list(FOLLOWS)
        searches, final = [Survivors(e) for e in entries], [[] for _ in entries]
        first = last = None
        illegal = 0
        for _, _, _, initial, fault in rows:
            if (moves := known.get((initial, fault))) is None:
                moves = known[initial, fault] = row_moves(initial, fault)
            for search, done in zip(searches, final):
                done += search.step(moves)
            illegal += last is not None and last + initial not in LEGAL
            first, last = initial if first is None else first, initial
        for entry, search, done in zip(entries, searches, final):
            for end, (cost, _) in search.heads.items():
                out.append((conv, block, entry, end, cost, "|".join(done + [n.piece for n in search.path(end)]), illegal, first, last))
        if len(out) >= 4096:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _compose(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation, in order, to one row of edits per block; the
    last row of a conversation (``last`` set) has the turns inserted after its
    end, its cost and its illegal neighbours."""
    out: list[tuple] = []
    for (conv,), rows in _by_run(batches, 1):
        search, settled, at, illegal, before, moves = Survivors(), 0, None, 0, None, []

        def step(moves: list) -> None:
            nonlocal settled
            for piece in search.step(moves):
                out.append((conv, settled, piece, False, None, None))
                settled += 1

        for _, block, entry, end, cost, edits, bad, first, last in rows:
            if block != at:
                if moves:
                    step(moves)
                illegal += bad + (before is not None and before + first not in LEGAL)
                at, before, moves = block, last, []
            moves.append((entry, end, cost, edits))
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        step(moves)
        step(ENDINGS)
        best = min(search.heads, key=lambda s: search.heads[s][0])
        if len(search.heads) == 2:  # nothing left, or turns left: equal costs by the edits
            (a, (cost_a, node_a)), (b, (cost_b, node_b)) = search.heads.items()
            if cost_a == cost_b:
                best = a if Survivors._before(node_a, "", node_b, "") else b
        for node in search.path(best):
            out.append((conv, settled, node.piece, False, None, None))
            settled += 1
        conv, number, piece, *_ = out.pop()
        out.append((conv, number, piece, True, search.heads[best][0], illegal))
        if len(out) >= 4096:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with the contract's faults; null parts of the
    drawing key, roles and texts count as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    d = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, blank).alias("role"),
                     F.coalesce(text_col, blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("draw"))
    hit = lambda what: F.col("draw") == DAMAGE[what]
    copies = F.when(hit("repeat"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.where(~hit("drop")).select(
        "conv", "turn", F.when(hit("user"), F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(hit("empty"), F.lit("")).when(hit("unmark"), F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


def positioned(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with ``pos`` from 0 and the row's first
    ``fault`` (blank, duplicate, truncated or null), staged.

    Rows follow their turn, nulls first; rows of one turn follow role, then
    md5 of the text.  A text is a duplicate if role and text stand earlier in
    the conversation.
    """
    spaces = " \t\n\x0b\x0c\r"
    end = F.right(F.rtrim("text", F.lit(spaces)), F.lit(1))
    d = rows.select("conv", "turn", "role", "text", F.md5("text").alias("tie"))
    d = value_rank(d, "turn", tie_cols=["role", "tie"], group_cols=["conv"], out="pos", rows_per_bucket=BLOCK)
    d = staged(d.select("conv", (F.col("pos") - 1).alias("pos"), "turn", "role", "text",
                        F.when(end == "", F.lit("blank")).when(~end.isin(".", "!", "?"), F.lit("truncated")).alias("own"),
                        F.sha2("text", 256).alias("sha")), "turns")
    known = d.select("conv", "pos", "role", "sha", "own")
    first = known.groupBy("conv", "role", "sha").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = _null_safe_join(known, first.drop("rows"), ["conv", "role", "sha"]).where("pos > first and (own is null or own != 'blank')")
    flagged = _null_safe_join(d, again.select("conv", "pos", F.lit(True).alias("seen")), ["conv", "pos"], "left")
    return staged(flagged.select("conv", "pos", "turn", "role", "text", F.when(F.col("seen"), F.lit("duplicate")).otherwise(F.col("own")).alias("fault")),
                  "turns-judged")


def repair(rows: DataFrame, judged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The edits and the totals of every conversation of ``rows`` (conv, turn, role, text).

    Edits: (conv, pos, k, op, role, text) in order of pos and k.  ``op`` is K,
    R, D or I; role and text are those after the edit (before it for D).
    Totals: (conv, cost, illegal).  Roles are told apart by their first
    letter; a role with another initial can only be changed or deleted.  A
    conversation without rows is in neither table.
    """
    ship_package(rows.sparkSession)
    judged = positioned(rows) if judged is None else judged
    conv = _arrow(judged, "conv")
    kind = judged.schema["conv"].dataType.simpleString()
    narrow = judged.select("conv", F.expr(f"pos div {BLOCK}").alias("block"), "pos", F.left("role", F.lit(1)).alias("initial"), "fault")
    found = pa.schema([("conv", conv), ("block", pa.int64()), ("entry", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("edits", pa.string()),
                       ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])
    searched = narrow.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").mapInArrow(
        lambda it: _search_blocks(it, found),
        f"conv {kind}, block long, entry long, end long, cost long, edits string, illegal long, first string, last string")
    settled = pa.schema([("conv", conv), ("block", pa.int64()), ("edits", pa.string()), ("last", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])
    composed = staged(searched.repartition("conv").sortWithinPartitions("conv", "block", "entry", "end").mapInArrow(
        lambda it: _compose(it, settled), f"conv {kind}, block long, edits string, last boolean, cost long, illegal long"), "turn-edits")
    totals = composed.where("last").select("conv", "cost", "illegal")
    # The turns after the end come one block after the last: their own step.
    after = composed.where("last and edits != ''").select("conv", F.lit(None).cast("long").alias("pos"), F.col("edits").alias("piece"))
    inside = composed.where("not last").select("conv", "block", F.posexplode(F.split("edits", r"\|")).alias("i", "piece")) \
        .select("conv", (F.col("block") * BLOCK + F.col("i")).alias("pos"), "piece")
    own = judged.select("conv", "pos", F.col("role").alias("was"), "text")
    edits = _null_safe_join(inside.unionByName(after), own, ["conv", "pos"], "left")
    each = edits.select("conv", "pos", "was", "text", F.posexplode(F.regexp_extract_all("piece", F.lit("([KRDI].)"))).alias("k", "edit"))
    op = F.left("edit", F.lit(1))
    role = F.when(op.isin("K", "D"), F.col("was")).when(F.right("edit", F.lit(1)) == "u", F.lit("user")).otherwise(F.lit("assistant"))
    edited = each.select("conv", "pos", "k", op.alias("op"), role.alias("role"), F.when(op == "I", F.lit("")).otherwise(F.col("text")).alias("text"))
    return edited, totals


def _digest(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for (conv,), rows in _by_run(batches, 1):
        audit, sha, some = [], hashlib.sha256(), False
        for _, _, _, op, role, text in rows:
            audit.append(op)
            if op != "D":
                sha.update((("\n" if some else "") + role + ":" + text).encode())
                some = True
        out.append((conv, "".join(audit), sha.hexdigest()))
        if len(out) >= 4096:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def edit_digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): SHA-256 runs over a conversation from
    its first byte to its last, so its rows stream through one task in order;
    only the hash state and the audit string are held."""
    conv, kind = _arrow(edits, "conv"), edits.schema["conv"].dataType.simpleString()
    schema = pa.schema([("conv", conv), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    ordered = edits.withColumn("at", F.coalesce("pos", F.lit(2 ** 62))).select("conv", "at", "k", "op", "role", "text")
    return ordered.repartition("conv").sortWithinPartitions("conv", "at", "k").mapInArrow(
        lambda it: _digest(it, schema), f"conv {kind}, audit string, repaired_sha256 string")


def repair_report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  faults: bool = True) -> DataFrame:
    """One row per conversation of ``turns``: gaps, counts of first faults,
    illegal neighbours, cost, audit and digest of the repair.

    ``faults`` damages the rows first, as the contract asks.  A null
    conversation id is a conversation.  Conversations without rows after the
    damage get zeros, an empty audit and the hash of nothing; an empty table
    gives an empty result.  Other columns are not read.
    """
    if faults:
        rows = damage(turns, conv_col, turn_col, role_col, text_col)
    else:
        rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                            F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    judged = positioned(rows)
    edits, totals = repair(rows, judged)
    # Distinct turns are combined before they meet: one row per turn.
    distinct = judged.groupBy("conv", "turn").agg(*[F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")])
    counts = distinct.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")])
    found = _null_safe_join(_null_safe_join(counts, totals, ["conv"]), edit_digests(edits), ["conv"])
    every = _null_safe_join(turns.select(F.col(conv_col).alias("conv")).distinct(), found, ["conv"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select(F.col("conv").alias(conv_col), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
