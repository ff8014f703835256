import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simpairs.llm import conversation_repair as cr
from tests.conftest import SF01

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if draw == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def judge(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else None if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


NEXT = {("N", "s"): "S", ("N", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def cheapest(rows, faults):
    """(cost, audit, repaired lines) by plain recursion over all edits."""
    @lru_cache(None)
    def go(i, state, inserted):
        found = []
        if i == len(rows):
            if state in "NA":
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            found.append((4, "D", (), i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    found.append((late, "K", (f"{role}:{text}",), i + 1, NEXT[state, role[:1]]))
                for name in ("user", "assistant"):
                    if (state, name[0]) in NEXT:
                        found.append((late + 3, "R", (f"{name}:{text}",), i + 1, NEXT[state, name[0]]))
        if inserted < 3:
            for name in ("user", "assistant"):
                if (state, name[0]) in NEXT:
                    found.append((3, "I", (f"{name}:",), i, NEXT[state, name[0]]))
        best = None
        for f in found:
            if len(f) == 3:
                way = f
            else:
                rest = go(f[3], f[4], inserted + 1 if f[1] == "I" else 0)
                if rest is None:
                    continue
                way = (f[0] + rest[0], f[1] + rest[1], f[2] + rest[2])
            if best is None or way[:2] < best[:2]:
                best = way
        return best

    return go(0, "N", 0)


def expected(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        faults = judge(kept)
        cost, audit, lines = cheapest(tuple(kept), tuple(faults)) if kept else (0, "", ())
        turns = {r[0] for r in kept if r[0] is not None}
        initials = [r[1][:1] for r in kept]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = cr.repair_report(df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[n] for n in names) for r in got}


def test_whole_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert report(df) == expected(rows)


def odd_rows():
    import random

    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "admin"]
    texts = ["Hello.", "Well", "", " \t", None, "Fine!", "So?", "x. ", "ß ende."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 9))]
    return rows + [(900, t, "user", "Same.") for t in range(7)] + [(901, 3, "user", "Twin.")] * 3 + [(902, -5, "system", "Only.")]


def test_odd_rows_and_ties_equal_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "pos", "block", "fault", "draw", "cost", "audit"):
        df = df.selectExpr("*", f"'clash' as {name}")
    assert report(df) == expected(rows)


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    """Blocks of a few rows, searched apart, give what one search gives."""
    monkeypatch.setattr(cr, "BLOCK", 3)
    rows = odd_rows()
    rows += [(77, t, ["user", "assistant", "assistant", "system"][t * t % 4], ["A.", "b", "", f"c{t}."][t % 4]) for t in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert report(df) == expected(rows)


def test_empty_table(spark):
    assert cr.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edits_are_whole(spark):
    rows = [(1, t, r, f"{r} {t}.") for t, r in enumerate(["assistant", "user", "user", "assistant", "system"])]
    rows = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id conv", "turn", "role", "text")
    edits, totals = cr.repair(rows)
    got = sorted(edits.collect(), key=lambda r: (r.pos is None, r.pos, r.k))
    assert "".join(r.op for r in got) == "IKKIKKD" and totals.collect()[0].cost == 10
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got if r.op != "D"))
    assert totals.collect()[0].illegal == 2


KINDS = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from([None, "truncated", "blank", "duplicate"])), max_size=9)


@settings(max_examples=150, deadline=None)
@given(KINDS)
def test_search_equals_recursion(kinds):
    search, done = cr.Survivors(), []
    for initial, fault in kinds:
        done += search.step(cr.row_moves(initial, fault))
    done += search.step(cr.ENDINGS)
    ways = []
    for state, (cost, _) in search.heads.items():
        ways.append((cost, "".join(done + [n.piece for n in search.path(state)])[::2]))
    rows = tuple((i, {"s": "system", "u": "user", "a": "assistant", "x": "x"}[k], str(i)) for i, (k, _) in enumerate(kinds))
    assert min(ways) == cheapest(rows, tuple(f for _, f in kinds))[:2]


def test_memory_follows_the_unresolved_suffix():
    search, most = cr.Survivors(), 0
    for i in range(5000):
        search.step(cr.row_moves("ua"[i % 2], None))
        most = max(most, *[len(search.path(s)) for s in search.heads])
    assert most < 50


def test_ties_are_compared_back_to_the_common_ancestor():
    """Survivors stay apart for hundreds of rows of a foreign role, then tie."""
    kinds = [("u", None)] + [("x", None)] * 300 + [("a", None)]
    search, done = cr.Survivors(), []
    for initial, fault in kinds:
        done += search.step(cr.row_moves(initial, fault))
    done += search.step(cr.ENDINGS)
    ways = [(c, "".join(done + [n.piece for n in search.path(s)])[::2]) for s, (c, _) in search.heads.items()]
    rows = tuple((i, {"u": "user", "a": "assistant", "x": "x"}[k], str(i)) for i, (k, _) in enumerate(kinds[:1] + kinds[-31:]))
    assert min(ways)[0] == 3 * 300
    # The same rule on a length that recursion can take.
    short = cr.Survivors()
    out = []
    for initial, fault in kinds[:1] + kinds[-31:]:
        out += short.step(cr.row_moves(initial, fault))
    out += short.step(cr.ENDINGS)
    ways = [(c, "".join(out + [n.piece for n in short.path(s)])[::2]) for s, (c, _) in short.heads.items()]
    assert min(ways) == cheapest(rows, (None,) * 32)[:2]
