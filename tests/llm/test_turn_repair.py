"""Conversation repair against brute force over all edit sequences, in segments, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cloudloom.llm import turn_repair as T

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, blank int, copy string, n long"


def brute(rows):
    """The least (cost, audit) over all edits of each row and up to two insertions in each gap."""
    best = None
    gaps = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]

    def grow(i, roles, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        for g in gaps:
            r, c, a = roles + "".join(g), cost + 3 * len(g), audit + "I" * len(g)
            if i == len(rows):
                if GRAMMAR.match(r) and (best is None or (c, a) < best):
                    best = (c, a)
                continue
            initial, bad, cut = rows[i]
            grow(i + 1, r, c + 4, a + "D")
            if not bad:
                extra = 3 if cut else 0
                grow(i + 1, r + (initial or "?"), c + extra, a + "K")
                for to in "ua":
                    grow(i + 1, r + to, c + 3 + extra, a + "R")

    grow(0, "", 0, "")
    return best


def test_search_is_the_cheapest_of_all_edits():
    r = random.Random(3)
    for _ in range(120):
        rows = [(r.choice("suax "), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(0, 5))]
        want = brute(rows)
        for segment in (1, 2, 512):
            assert T.cheapest(rows, segment) == want


def test_segments_do_not_change_long_conversations():
    r = random.Random(4)
    for roles in ("suax", "ua", "x", "s"):
        rows = [(r.choice(roles), r.random() < 0.1, r.random() < 0.1) for _ in range(300)]
        whole = T.cheapest(rows, 10_000)
        assert all(T.cheapest(rows, s) == whole for s in (1, 7, 64))
        assert GRAMMAR.match("".join(t["role"][0] for t in T.applied(whole[1], [({"s": "system", "u": "user", "a": "assistant"}.get(c, c), "") for c, _, _ in rows])))


def expected(rows):
    """What the contract says, in plain Python, of (conv_id, turn, role, text, gone)."""
    out = {}
    for conv in {x[0] for x in rows}:
        own = [(t, " " if ro is None else ro, " " if tx is None else tx) for c, t, ro, tx, gone in rows if c == conv and not gone]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, marks = set(), []
        for _, role, text in own:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            again = (role, text) in seen
            seen.add((role, text))
            marks.append((blank, not blank and again, not blank and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)))
        initials = [x[1][:1] for x in own]
        turns = {x[0] for x in own} - {None}
        cost, audit = T.cheapest([(c, b or d, t) for c, (b, d, t) in zip(initials, marks)], 10_000)
        body = "\n".join(f"{t['role']}:{t['text']}" for t in T.applied(audit, [x[1:] for x in own]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(m[k] for m in marks) for k in range(3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(body.encode()).hexdigest(),
        )
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    rows = df.withColumn("sha", T.digest(F.col("repaired"))).select("conv_id", *names).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    texts = ["Well.", "So", " \t", "", None, "Yes!\n", "É?", "a. b", "x\n\n"]
    out = [(None, 0, "user", "Hi.", False), (None, None, None, None, False), (1, 5, "user", "Gone.", True), (2, 3, "user", "A.", False), (2, 3, "user", "A.", False)]
    for conv in range(3, 40):
        for turn in range(r.randrange(1, 8)):
            out.append((conv, r.choice([turn, turn, turn, None]), r.choice(["system", "user", "assistant", "assistant", "user", "", None, "tool"]), r.choice(texts), r.random() < 0.1))
    return out


def test_repair(spark, rows):
    table = spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SCHEMA)
    want = expected(rows)
    assert want[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(T.repair(table.repartition(7))) == want
    assert found(T.repair(table, segment=2)) == want
    assert found(T.repair(table.where("false"))) == {}


def test_one_long_conversation(spark):
    """A third of all rows in one conversation, and a text of two megabytes."""
    rows = [(0, k, "user" if k % 2 == 0 else "assistant", f"t{k % 900}.", False) for k in range(3000)]
    rows += [(1 + k // 8, k % 8, "user" if k % 2 == 0 else "assistant", "word " * 3 + ".", False) for k in range(6000)]
    rows += [(9000, 0, "user", "word " * 400_000, False)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")
    assert found(T.repair(table)) == expected(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in [*range(40), None] for t in [0, 1, None]]
    got = T.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind in (0, 1) else "One Two" if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
