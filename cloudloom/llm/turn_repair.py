"""Operator 11, conversation structure repair by Dijkstra's search on the lattice (turn index, grammar state).

A conversation's rows, in the order of their turns, become a sequence of roles ``(s?(ua)+)?`` (system, user, assistant) by the
cheapest edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn 3. Blank and duplicate
rows must be deleted; a truncated row that stays costs 3 more. Nodes are made when they are reached. The heap's key is
(cost, audit), where the audit is the initials of the edits so far, so the first end node popped in an accepting state is the
cheapest repair, and of equally cheap ones the one with the least audit.

Two paths to one node that cost the same never have audits of which one begins with the other (what follows could only be
insertions, and these cost), so that order survives whatever is appended, and the search may stop and go on at any row:
conversations are searched in segments of ``segment`` rows. Between two segments only the best path to each of the four
states is kept, by its place among the others; audits in the heap are of one segment. Memory and time of a search grow with
the conversation, not with its square.

Rows are dealt by conversation in one exchange, and duplicates are marked and rows sorted inside it (both spill). A task holds
one conversation at a time: as its repaired turns are one row of the result, it must fit in a row like a document's text. The
turns of one conversation depend on each other in order, so one conversation is one task's work, however long it is.

Defined cases: a null role or text is one space (such a text is blank); null turns come first; a null conv_id is a conversation
like others; equal turns are ordered by role, then text; an empty role is no legal role; a conversation all of whose rows are
``gone`` has zeros, an empty audit and no turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
WANTED = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}  # what an inserted or a reroled turn is
ROLES = {"u": "user", "a": "assistant"}
ACCEPTING = (START, AFTER_A)
LEGAL = frozenset(("su", "ua", "au"))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
RESULT = "turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def search(rows: Sequence[tuple[str, bool, bool]], low: int, high: int, starts: list, last: bool) -> list:
    """Best (cost, place, audit, state) after ``rows[low:high]`` from ``starts`` of the same form, whose audits are empty.

    A row is (role's initial, must go, truncated). In the last segment, only the first accepting end node is returned.
    """
    heap = [(cost, place, audit, low, state) for cost, place, audit, state in starts]
    heapify(heap)
    settled, ends = set(), []
    while heap:
        cost, place, audit, i, state = heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == high:
            if not last:  # insertions at this end belong to the next segment
                ends.append((cost, place, audit, state))
                continue
            if state in ACCEPTING:
                return [(cost, place, audit, state)]
        wanted = STEPS[state][WANTED[state]]
        heappush(heap, (cost + INSERT, place, audit + "I", i, wanted))
        if i < high:
            initial, must_go, truncated = rows[i]
            heappush(heap, (cost + DELETE, place, audit + "D", i + 1, state))
            if not must_go:
                extra = TRUNCATED if truncated else 0
                if initial in STEPS[state]:
                    heappush(heap, (cost + extra, place, audit + "K", i + 1, STEPS[state][initial]))
                heappush(heap, (cost + REROLE + extra, place, audit + "R", i + 1, wanted))
    return ends


def cheapest(rows: Sequence[tuple[str, bool, bool]], segment: int = 512) -> tuple[int, str]:
    """The least (cost, audit) that makes ``rows`` legal."""
    starts, trails, low = [(0, 0, "", START)], [None], 0
    while True:
        high = min(low + segment, len(rows))
        ends = sorted(search(rows, low, high, starts, high == len(rows)), key=lambda e: e[1:3])
        trails = [(trails[place], audit) for _, place, audit, _ in ends]
        if high == len(rows):
            break
        starts, low = [(cost, k, "", state) for k, (cost, _, _, state) in enumerate(ends)], high
    trail, parts = trails[0], []
    while trail:
        trail, audit = trail
        parts.append(audit)
    return ends[0][0], "".join(reversed(parts))


def applied(audit: str, rows: Sequence[tuple[str, str]]) -> list[dict]:
    """The turns that the edits make of ``rows`` (role, text)."""
    state, at, out = START, 0, []
    for edit in audit:
        if edit != "D":
            initial = rows[at][0][:1] if edit == "K" else WANTED[state]
            out.append({"role": rows[at][0] if edit == "K" else ROLES[initial], "text": "" if edit == "I" else rows[at][1]})
            state = STEPS[state][initial]
        at += edit != "I"
    return out


def verdict(rows: list[tuple], segment: int) -> tuple:
    """(turns, gaps, ..., repaired) of a conversation's rows (turn, role, text, blank, duplicate, truncated)."""
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    faults = [sum(r[k] for r in rows) for k in (3, 4, 5)]
    cost, audit = cheapest([(c, r[3] or r[4], r[5]) for c, r in zip(initials, rows)], segment)
    return len(rows), gaps, *faults, illegal, cost, audit, applied(audit, [r[1:3] for r in rows])


def conversations(batches) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of batches sorted by conversation; rows that are gone leave only their conversation."""
    held, key, begun = [], None, False
    for batch in batches:
        for conv, gone, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != key:
                yield key, held
                held = []
            key, begun = conv, True
            if not gone:
                held.append(tuple(row))
    if begun:
        yield key, held


def repair(rows: DataFrame, segment: int = 512) -> DataFrame:
    """``rows(conv_id, turn, role, text[, gone])`` → one row per conversation: conv_id, counts, cost, audit, repaired turns.

    Rows marked ``gone`` don't exist, but their conversation does. Fields: turns (rows), gaps (missing turn numbers), blank,
    duplicate and truncated (each row's first fault), illegal (adjacent roles), cost, audit, repaired.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    full = rows.select("conv_id", gone.alias("gone"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    dealt = full.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1
    blank = ~F.col("text").rlike(BLANK)
    marked = dealt.withColumn("again", again).withColumn("blank", blank).withColumn("duplicate", ~F.col("blank") & F.col("again"))
    marked = marked.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.col("text").rlike(ENDED))
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "gone", "turn", "role", "text", "blank", "duplicate", "truncated")
    key = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, {RESULT}"
    names = ["conv_id", *(f.split()[0] for f in RESULT.split(", "))]

    def stream(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kinds = pa.schema([
            ("conv_id", first.schema.field("conv_id").type), *((n, pa.int64()) for n in names[1:8]), ("audit", pa.string()),
            ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
        ])
        out, size = [], 0
        for conv, held in conversations(chain((first,), batches)):
            out.append(dict(zip(names, (conv, *verdict(held, segment)))))
            size += 100 + sum(len(r[2]) for r in held)
            if len(out) == 1000 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return ordered.mapInArrow(stream, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Planted faults: by crc32 of ``conv_id:turn`` mod 20, 0 drops a row (``gone``), 1 empties its text, 2 takes its ``[.!?]``
    away, 3 repeats it, 4 makes its role user. Nulls are one space first."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text", "gone")


def digest(repaired: Column) -> Column:
    """The hash of repaired turns, ``role:text`` joined by new lines."""
    return F.sha2(F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)


#: DuckDB SQL of the repairs of damaged ``conversations``. A step takes a row after at most one insertion: two insertions in a
#: row are never part of a cheapest repair (leaving both out, or deleting the lone system row before them, costs less).
ORACLE = r"""
    with recursive
    bits as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
    src as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, t,
               list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as s
        from conversations, bits),
    kinds as (select *, xor(list_reduce(list_prepend(4294967295, s), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind from src),
    damaged as (
        select conv_id, turn, case when kind = 4 then 'user' else role end as role,
               case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
               unnest(range(case when kind = 3 then 2 else 1 end)) as copy
        from kinds where kind <> 0),
    placed as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
               row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
               not regexp_matches(text, '[^\x20\x09-\x0D]') as blank
        from damaged),
    faults as (
        select conv_id, turn, role, text, i, blank, again and not blank as duplicate, left(role, 1) as c,
               not blank and not again and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as truncated,
               lag(left(role, 1)) over (partition by conv_id order by i) as before
        from placed),
    convs as (
        select o.conv_id, count(f.i) as n, coalesce(max(f.turn) - min(f.turn) + 1 - count(distinct f.turn), 0) as gaps,
               count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated,
               count(*) filter (where before is not null and before || c not in ('su', 'ua', 'au')) as illegal
        from (select distinct conv_id from conversations) o left join faults f on o.conv_id is not distinct from f.conv_id group by o.conv_id),
    walk as (
        select conv_id, 0::bigint as i, 'b' as st, 0::bigint as cost, '' as audit, ''::varchar as body from convs
        union all
        select conv_id, i, st, min(cost) as cost, arg_min(audit, (cost, audit)) as audit, arg_min(body, (cost, audit)) as body
        from (
            with gap as (
                select conv_id, i, st, cost, audit, body from walk
                union all
                select conv_id, i, case st when 'u' then 'a' else 'u' end, cost + 3, audit || 'I',
                       body || chr(10) || case st when 'u' then 'assistant:' else 'user:' end from walk),
            stepped as (
                select g.*, f.i as j, f.role, f.text, f.c, f.blank or f.duplicate as bad, case when f.truncated then 3 else 0 end as extra,
                       case g.st when 'u' then 'a' else 'u' end as want
                from gap g join faults f on g.conv_id is not distinct from f.conv_id and f.i = g.i + 1)
            select conv_id, j as i, st, cost + 4 as cost, audit || 'D' as audit, body from stepped
            union all
            select conv_id, j, c, cost + extra, audit || 'K', body || chr(10) || role || ':' || text from stepped
            where not bad and (c = want or (c = 's' and st = 'b'))
            union all
            select conv_id, j, want, cost + 3 + extra, audit || 'R', body || chr(10) || case want when 'a' then 'assistant:' else 'user:' end || text
            from stepped where not bad)
        group by conv_id, i, st),
    ends as (
        select w.conv_id, case st when 'u' then cost + 3 else cost end as cost, case st when 'u' then audit || 'I' else audit end as audit,
               case st when 'u' then body || chr(10) || 'assistant:' else body end as body
        from walk w join convs v on w.conv_id is not distinct from v.conv_id and w.i = v.n where st <> 's'),
    best as (select conv_id, min(cost) as cost, arg_min(audit, (cost, audit)) as audit, arg_min(body, (cost, audit)) as body from ends group by conv_id)
    select v.conv_id, v.gaps, v.blank, v.duplicate, v.truncated, v.illegal, b.cost, b.audit, sha256(substr(b.body, 2)) as repaired_sha256
    from convs v join best b on v.conv_id is not distinct from b.conv_id"""
