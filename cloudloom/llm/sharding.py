"""Operator 1, sharding by balanced label propagation.

Documents with equal texts are linked: each to the others of its group, through the group's count in each shard.
Documents start in a shard by hash. Two kinds of rounds follow.

* Homes: a group that lies in several shards asks for the shard that holds most of it, among those with room for all of it (their
  quota less the groups that lie there whole), or for any other with room. A shard accepts groups in the order of how many members it holds already, as far
  as the quota goes; their members move there. Others ask again, until none fits or fewer than one in ``stall`` linked documents move.
* Parts: documents of groups that found no home, most of all those larger than a shard, ask to move to the shard that holds
  most of their group, if that holds more of it than their own. Between two shards as many move one way as the other; beyond that a
  shard accepts as many as it has room, places of those that leave included, and as many move around rings of shards. When no move
  fits, documents ask for the shard with most of their group among those with room. Each move raises the sum of the
  squares of a group's counts, so rounds end.

At last each shard gets its exact number of rows: groups that lie whole come first, then parts; unlinked documents, and linked
ones beyond a quota, are dealt into the places left. Law ``rows``: counts differ by at most one.

Defined cases: a null text has no bytes (size 16, crc32 0) and is equal to the empty text; doc_ids may be null or
repeated, as rows are what is placed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm._common import Workspace, maybe_broadcast, ranked, row_id, running

OVERHEAD = 16


def ring(asks: np.ndarray) -> list[int]:
    """Shards in a ring where some ask to move from each to the next; empty if there is none."""
    n, state = len(asks), np.zeros(len(asks), np.int8)
    for start in range(n):
        path, stack = [], [(start, False)]
        while stack:
            s, leave = stack.pop()
            if leave:
                state[s] = 2
                path.pop()
            elif state[s] == 1:
                return path[path.index(s) :]
            elif state[s] == 0:
                state[s] = 1
                path.append(s)
                stack.append((s, True))
                stack += [(t, False) for t in np.flatnonzero(asks[s]).tolist() if state[t] < 2]
    return []


def allowed(asks: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may move from shard s to shard t, given how many ask: exchanges first, then into room, that of leavers included, then around rings."""
    out = np.minimum(asks, asks.T)
    room = room.copy()
    moved = True
    while moved:
        moved = False
        for t in np.argsort(-room, kind="stable").tolist():
            for s in np.argsort(-(asks[:, t] - out[:, t]), kind="stable").tolist():
                n = min(asks[s, t] - out[s, t], room[t])
                if n <= 0:
                    break
                out[s, t] += n
                room[t] -= n
                room[s] += n
                moved = True
    while found := ring(asks - out):
        steps = (found, [*found[1:], found[0]])
        out[steps] += (asks - out)[steps].min()
    return out


def cut_rows(placed: DataFrame, group: str = "g", shard: str = "shard") -> DataFrame:
    """One row: linked rows, those outside the shard that holds most of their group, and the pairs of equal texts that lie in two shards."""
    held = placed.groupBy(group, shard).agg(F.count(F.lit(1)).alias("c"))
    groups = held.groupBy(group).agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.sum(F.expr("c * (c - 1) div 2")).alias("inner")).where("n > 1")
    return groups.agg(F.sum("n").alias("linked"), F.sum(F.expr("n - most")).alias("apart"), F.sum(F.expr("n * (n - 1) div 2 - inner")).alias("cut_pairs"))


def shard(ws: Workspace, docs: DataFrame, shards: int = 40, stall: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, linked."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    nodes = ws.table(
        docs.select(row_id().alias("rid"), "doc_id", "text").select(
            "rid", "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("g")
        )
    )
    total = nodes.count()
    base, rest = divmod(total, shards)
    groups = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = ws.table(groups)  # tables on both sides of the joins: Spark can split the rows of a large group
    start = F.pmod(F.xxhash64("rid", F.lit(17)), F.lit(shards)).cast("int")
    placed = ws.table(nodes.join(groups, "g").select("rid", "g", "members", start.alias("shard")))
    linked = placed.count()
    while linked and shards > 1:
        held = ws.table(placed.groupBy("g", "members", "shard").agg(F.count(F.lit(1)).alias("c")))
        whole = np.zeros(shards, np.int64)
        for r in held.where("c = members").groupBy("shard").agg(F.sum("c").alias("n")).collect():  # a row per shard
            whole[r["shard"]] = r["n"]
        room = ws.spark.createDataFrame([(t, int(base - n)) for t, n in enumerate(whole.tolist())], "shard int, room long")
        fits = held.where("c < members").join(F.broadcast(room), "shard").where("members <= room")
        asks = fits.groupBy("g", "members").agg(F.max(F.struct("c", F.xxhash64("g", "shard").alias("h"), "shard", "room")).alias("best"))
        asks = asks.select("g", "members", (-F.col("best.c")).alias("fewer"), F.col("best.shard").alias("t"), F.col("best.room").alias("room"))
        # groups that fit into none of their shards ask for another one with room, by hash
        roomiest = F.array(*[F.struct(F.lit(t).alias("shard"), F.lit(int(base - n)).cast("long").alias("room")) for t, n in enumerate(whole.tolist())])
        others = held.where("c < members").select("g", "members").distinct().join(asks.select("g"), "g", "left_anti")
        others = others.withColumn("fit", F.filter(roomiest, lambda x: x["room"] >= F.col("members"))).where("size(fit) > 0")
        others = others.withColumn("to", F.element_at("fit", F.pmod(F.xxhash64("g"), F.size("fit")).cast("int") + 1))
        asks = asks.unionByName(others.select("g", "members", F.lit(0).cast("long").alias("fewer"), F.col("to.shard").alias("t"), F.col("to.room").alias("room")))
        homes = ws.table(running(ws, asks, ["t"], ["fewer", "members", "g"], "members", "before").where("before + members <= room").select("g", F.col("t").alias("home")))
        moving = homes.join(held, "g").where("shard <> home").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        ws.drop(held)
        if moving:
            after = ws.table(placed.join(maybe_broadcast(homes), "g", "left").select("rid", "g", "members", F.coalesce("home", "shard").alias("shard")))
            ws.drop(placed)
            placed = after
        ws.drop(homes)
        if moving * stall < linked:
            break
    roomy = False
    while linked and shards > 1:
        held = ws.table(placed.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")))
        load = np.zeros(shards, np.int64)
        for r in held.groupBy("shard").agg(F.sum("c").alias("n")).collect():  # a row per shard
            load[r["shard"]] = r["n"]
        room = np.maximum(base - load, 0)
        to = held.where(F.col("shard").isin(np.flatnonzero(room > 0).tolist())) if roomy else held
        best = ws.table(to.groupBy("g").agg(F.max(F.struct("c", F.xxhash64("g", "shard").alias("h"), F.col("shard").alias("t"))).alias("best")))
        gains = F.struct(F.col("best.c"), F.col("best.h")) > F.struct("c", F.xxhash64("g", "shard"))
        asks = ws.table(placed.join(held, ["g", "shard"]).join(best, "g").where(gains).select("rid", "g", "members", "shard", F.col("best.t").alias("t")))
        wanted = np.zeros((shards, shards), np.int64)
        for r in asks.groupBy("shard", "t").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per pair of shards
            wanted[r["shard"], r["t"]] = r["n"]
        moving = allowed(wanted, room)
        done = moving.sum() * stall < linked
        if moving.sum():
            table = ws.spark.createDataFrame([(s, t, int(moving[s, t])) for s, t in zip(*map(np.ndarray.tolist, np.nonzero(moving)), strict=True)], "shard int, t int, most long")
            turns = ranked(ws, asks, ["shard", "t"], ["members", "g", "rid"], "turn").join(F.broadcast(table), ["shard", "t"])
            moves = ws.table(turns.where("turn < most").select("rid", F.col("t").alias("to")))
            after = ws.table(placed.join(moves, "rid", "left").select("rid", "g", "members", F.coalesce("to", "shard").alias("shard")))
            ws.drop(placed, moves)
            placed = after
        ws.drop(held, best, asks)
        if done and roomy:
            break
        roomy = roomy or done
    quota = F.when(F.col("shard") < rest, F.lit(base + 1)).otherwise(F.lit(base))
    own = placed.groupBy("g").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).select("g", (F.col("lo") != F.col("hi")).alias("parted"))
    placed = ws.table(placed.join(ws.table(own), "g"))
    seated = ws.table(ranked(ws, placed, ["shard"], ["parted", "members", "g", "rid"], "slot").where(F.col("slot") < quota).select("rid", "shard", "slot"))
    taken = {r["shard"]: r["n"] for r in seated.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    free = nodes.join(seated, "rid", "left_anti").select("rid", F.xxhash64("rid", F.lit(23)).alias("h"))
    free = ranked(ws, free, [], ["h", "rid"], "turn")
    begins, ends = [], [0]
    for s in range(shards):
        begins.append(ends[-1])
        ends.append(ends[-1] + base + (s < rest) - taken.get(s, 0))
    bounds = F.array(*[F.lit(e) for e in ends[1:]])
    own = F.size(F.filter(bounds, lambda e: e <= F.col("turn")))
    first = F.element_at(F.array(*[F.lit(b - taken.get(s, 0)) for s, b in enumerate(begins)]), F.col("shard") + 1)
    free = free.withColumn("shard", own.cast("int")).select("rid", "shard", (F.col("turn") - first).cast("long").alias("slot"))
    linked = seated.select("rid", "shard", "slot").unionByName(free)
    return nodes.join(linked, "rid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("g").alias("text_group")
    )
