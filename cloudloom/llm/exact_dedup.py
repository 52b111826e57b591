"""Operator 10, exact dedup by deterministic block naming (DataFrame functions only).

Texts are lower-cased in A-Z and cut into blocks of ``block_chars`` characters. Distinct blocks are sorted and get
integer names; then names of adjacent blocks are paired, distinct pairs are sorted and named, and so on, until each
document has one name. Two documents have the same (round, name) if and only if their texts are equal.

Blocks are sorted by a 128-bit fingerprint, then named; the blocks of each fingerprint are gathered as a set and
compared, and if one fingerprint had two blocks, all are fingerprinted anew under another seed. So names never
collide, while the texts are shuffled once.

Defined cases: a null text is the empty text; the empty text is a text like others; a null doc_id counts as the
smallest; of rows with the same doc_id and equal texts one stays; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm._common import Workspace, row_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def blocks_of(text: Column, block_chars: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def fingerprint(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def named(ws: Workspace, keys: DataFrame) -> DataFrame:
    """Distinct rows of two long columns, sorted over all partitions, with an integer name each."""
    x, y = keys.columns
    return ws.table(keys.repartitionByRange(x, y).sortWithinPartitions(x, y).withColumn("name", F.monotonically_increasing_id()))


def identities(ws: Workspace, docs: DataFrame, block_chars: int = 4096, rid: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` → ``(rid, doc_id, sha, level, name)``: (level, name) is the identity of a text."""
    seed = 0
    while True:
        cut = docs.select((F.col(rid) if rid else row_id()).alias("rid"), "doc_id", normalised(F.col("text")).alias("t"))
        cut = cut.select("rid", "doc_id", "t", blocks_of(F.col("t"), block_chars).alias("blocks"))
        found = cut.select(F.explode("blocks").alias("block")).select(fingerprint(F.col("block"), seed).alias("f"), "block")
        sets = found.select("f.a", "f.b", "block").groupBy("a", "b").agg(F.size(F.collect_set("block")).alias("texts"))
        sets = ws.table(sets)
        if ws.is_empty(sets.where("texts > 1")):
            break
        seed += 1
        ws.drop(sets)
    names = named(ws, sets.select("a", "b"))
    ws.drop(sets)
    rows = ws.table(cut.select("rid", "doc_id", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"), F.transform("blocks", lambda b: fingerprint(b, seed)).alias("keys")))
    sequence = rows.select("rid", F.size("keys").cast("long").alias("n"), F.posexplode("keys").alias("pos", "k"))
    sequence = sequence.select("rid", "n", F.col("pos").cast("long").alias("pos"), "k.a", "k.b")
    sequence = ws.table(sequence.join(names, ["a", "b"]).select("rid", "n", "pos", "name"))
    ws.drop(names)
    longest, level, done = sequence.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], 0, []
    while True:
        done.append(sequence.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = sequence.where("n > 1").groupBy("rid", "n", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = ws.table(pairs)
        names = named(ws, pairs.select("l", "r").distinct())
        sequence = ws.table(pairs.join(names, ["l", "r"]).select("rid", F.expr("(n + 1) div 2").alias("n"), "pos", "name"))
        ws.drop(pairs, names)
        longest, level = (longest + 1) // 2, level + 1
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return ws.table(rows.drop("keys").join(ids, "rid"))


def exact_dedup(ws: Workspace, docs: DataFrame, block_chars: int = 4096, rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: rid (from the column named so, if it is given), doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id stays."""
    ids = identities(ws, docs, block_chars, rid)
    groups = ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = ws.table(groups)  # both sides are tables now, so that Spark can split the rows of a large group
    return ids.join(groups, ["level", "name"]).select(
        "rid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
