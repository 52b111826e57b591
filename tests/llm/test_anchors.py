"""Substring dedup against brute force over all windows: copies, overlaps, ties, nulls, many slices and buckets, odd texts."""

import random
import re

import pytest

from cloudloom.llm import anchors as A
from cloudloom.llm._common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, slice long, rid string, n int, starts string, lost int"


def brute(rows, width):
    """(doc_id, words, kept words, removed spans) of rows in the order in which they are read."""
    order = sorted(range(len(rows)), key=lambda k: (-(2**63) if rows[k][0] is None else rows[k][0], k))
    words = [WORD.findall(rows[k][1] or "") for k in order]
    seen, out = set(), []
    for k, w in zip(order, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        edges = [i for i in range(len(w) + 1) if (gone[i - 1] if i else False) != (gone[i] if i < len(w) else False)]
        spans = list(zip(edges[::2], edges[1::2]))
        out.append((rows[k][0], len(w), sum(gone), tuple(spans), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, parts=1, **how):
    table = spark.createDataFrame([(*r, 1, "r", 2, "s", 3) for r in rows], SCHEMA)
    got = A.dedup(Workspace(spark), table.coalesce(1) if parts == 1 else table.repartition(parts, "text"), **how).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, tuple(map(tuple, r.removed)), r.text) for r in got), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    word = lambda: f"w{r.randrange(4000)}"
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 29, 30, 75)]
    out = [(None, None), (1, ""), (2, " \t\n"), (3, "one"), (4, " ".join(["again"] * 60)), (5, " ".join(["a", "b", "c"] * 30)), (6, "É x " * 25)]
    for k in range(10, 60):
        w = [word() for _ in range(r.randrange(0, 70))]
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        out.append((k, r.choice([" ", "\n", "  "]).join(w)))
    hot = " ".join(word() for _ in range(50))
    out += [(1000 + k, hot) for k in range(40)] + [(2000 + k, f"x{k} " + hot[: 20 * k]) for k in range(10)]
    long = " ".join(word() for _ in range(30_000))
    out += [(3000, long), (3001, "new " + long + " more")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("how", [{}, {"bucket": 200}, {"width": 7, "bucket": 5000}, {"width": 1}, {"width": 2}])
def test_dedup(spark, rows, how):
    assert run(spark, rows, **how) == brute(rows, how.get("width", 20))


def test_many_slices(spark, rows):
    assert run(spark, rows, parts=9, bucket=2000) == brute(rows, 20)


def test_ties_and_nulls(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(7, text), (7, text), (None, text), (None, text + " end"), (6, "x " + text)]
    got = run(spark, rows)
    assert got == brute(rows, 20)
    assert [x[2] for x in got if x[0] is None] == [0, 40]
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 0, (), "")]
