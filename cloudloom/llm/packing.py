"""Operator 8, best-fit packing by linear grouping.

Documents become token ids with an end id; only those longer than a sequence are cut, into pieces of a whole sequence and a
rest. The plan is made from the counts of the lengths (at most ``capacity`` numbers, whatever the corpus):

1. pieces of more than an eighth of a sequence, in order of length, fall into groups of equal cardinality, and each counts as
   its group's longest;
2. configurations of these few sizes are chosen, each filling a sequence as far as the rounded sizes left can (an exact
   bounded knapsack), and repeated while the groups last;
3. the actual lengths, in order, take the groups' places, so configurations split into runs of sequences alike;
4. short pieces go, longest first, into the sequences with the least room that holds them; new sequences are opened last.

Lastly each piece finds its place by its rank among the pieces of its length: a lookup in the plan's runs.

Defined cases: a null or empty text has the end id alone; doc_ids may be null or repeated; an empty table gives an empty
result; columns besides ``doc_id, text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _text as T
from cloudloom.llm._common import Workspace
from cloudloom.llm._tokens import encoder, vocabulary_path

CAPACITY = 2048
GROUPS = 512
SLICE_BYTES = 3 << 20  # of texts encoded at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cut(path: str, capacity: int, end_id: int):
    """(doc_id, text) → pieces, each with its place among the task's pieces of its length."""

    def run(batches):
        encode = encoder(path, True).encode
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in T.slices(batches, limit=SLICE_BYTES):
            ends, ids = encode(T.texts_of(batch))
            docs = batch.column("doc_id").to_pylist()
            out = [[] for _ in range(7)]
            for i, doc in enumerate(docs):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    x = own[start : start + capacity]
                    row = (doc, piece, start, len(x), zlib.crc32(x.tobytes()), part, seen[len(x)])
                    seen[len(x)] += 1
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Groups of equal cardinality of the lengths in falling order, each as runs of (length, how many)."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out, room = [[]], size
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return [g for g in out if g]


def best_fill(sizes: list[int], left: list[int], capacity: int, first: int) -> list[int]:
    """How many of each size fill a sequence best that holds one of ``first``; exact, by sums that can be reached."""
    room = capacity - sizes[first]
    reach, choice = 1, []
    for g, s in enumerate(sizes):
        n = min(left[g] - (g == first), room // s)
        steps, each = [reach], reach
        for _ in range(n):
            each = (each << s) & ((1 << (room + 1)) - 1)
            steps.append(each)
            reach |= each
        choice.append(steps)
    at, use = reach.bit_length() - 1, [0] * len(sizes)
    for g in range(len(sizes) - 1, -1, -1):
        for n, s in enumerate(choice[g]):
            if s >> at & 1:
                use[g], at = n, at - n * sizes[g]
                break
    use[first] += 1
    return use


def large_runs(counts: dict[int, int], capacity: int, groups: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences of large pieces: (lengths, how many such sequences)."""
    parts = grouped(counts, groups)
    merged: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for g in parts:
        merged[g[0][0]] += g
    sizes = sorted(merged, reverse=True)
    left = [sum(n for _, n in merged[s]) for s in sizes]
    queues = [list(reversed(merged[s])) for s in sizes]
    out = []
    for first in range(len(sizes)):
        while left[first]:
            use = best_fill(sizes, left, capacity, first)
            many = min(n // u for n, u in zip(left, use, strict=True) if u)
            slots = []
            for g, u in enumerate(use):
                left[g] -= u * many
                for _ in range(u):
                    need, slot = many, []
                    while need:
                        length, n = queues[g].pop()
                        if n > need:
                            queues[g].append((length, n - need))
                            n = need
                        slot.append([length, n])
                        need -= n
                    slots.append(slot)
            at = [0] * len(slots)
            while many:
                n = min(s[i][1] for s, i in zip(slots, at, strict=True))
                out.append((tuple(s[i][0] for s, i in zip(slots, at, strict=True)), n))
                for k, s in enumerate(slots):
                    s[at[k]][1] -= n
                    at[k] += s[at[k]][1] == 0
                many -= n
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences: (lengths in order, how many such sequences)."""
    small = {k: n for k, n in counts.items() if 8 * k <= capacity and n}
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for lengths, n in large_runs({k: n for k, n in counts.items() if 8 * k > capacity and n}, capacity, groups):
        by_room[capacity - sum(lengths)][lengths] += n
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r in by_room]] = True
    for s in sorted(small, reverse=True):
        left = small[s]
        while left:
            fit = np.flatnonzero(rooms[s:])
            if not len(fit):
                t = min(capacity // s, left)
                by_room[capacity - s * t][(s,) * t] += left // t
                rooms[capacity - s * t] = True
                left -= left // t * t
                continue
            r = s + int(fit[0])
            lengths, n = by_room[r].popitem()
            use = min(n, left)
            if n > use:
                by_room[r][lengths] = n - use
            rooms[r] = bool(by_room[r])
            by_room[r - s][(*lengths, s)] += use
            rooms[r - s] = True
            left -= use
    return [(lengths, n) for r in sorted(by_room) for lengths, n in sorted(by_room[r].items()) if n]


def runs(kinds: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence, offset): where its pieces go, by rank."""
    used = np.zeros(capacity + 1, np.int64)
    out: dict[int, list] = defaultdict(list)
    base = 0
    for lengths, n in kinds:
        at = 0
        for s in lengths:
            out[s].append((used[s], base, at))
            used[s] += n
            at += s
        base += n
    return {s: np.array(x, np.int64) for s, x in out.items()}


def placed(table: dict[int, np.ndarray]):
    """(…, length, rank) → pieces with their sequence and offset."""

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                rows = table[int(s)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = rows[k, 1] + rank[at] - rows[k, 0], rows[k, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(ws: Workspace, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or vocabulary_path("word_bpe_49k.json")
    pieces = ws.table(docs.select("doc_id", "text").mapInArrow(cut(path, capacity, end_id), PIECES))
    counts = ws.table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    before = F.expr("coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0L)")
    first = counts.select("part", "length", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = runs(plan(histogram, capacity, groups), capacity)
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
