"""Operator 12, source divergence audit by systolic rotation.

Each language's sources are compared by their smoothed shares of the language's kept terms (terms in at least ``min_docs`` of its
documents): p = 1 + floor(10^9 (count + 1) / (N + V)), divergence f = floor((p - q)^2 / q), all in integers.

* Counts: a task counts its slice's terms by group (language, source) before anything is shuffled, and Spark adds them up, again
  with partial sums before the exchange; a hot source or term is a few rows a task.
* Terms get places 0..V-1 in their language by a distributed rank. ``BLOCK`` places are a block, ``TEAM`` sources a team. A group's
  vector in a block is its terms' places and counts, compressed. Vectors of a team and block are one cell, so what a task holds is
  bounded by TEAM x BLOCK, whatever grows.
* Rotation: each cell stays in its partition (kept on disk, made anew from its table if lost); in round r the compressed vectors of
  team t, without terms, visit the cell of team t + r (mod teams). Half of the rounds suffice since each meeting evaluates both
  directions; in an even ring's last round each pair meets in one of its two places. Round 0 is a cell's own pairs and its heaps.
* Heaps: each cell ranks its groups' terms that are commoner than in the language, and keeps the best ``top``; these are
  ranked again per group.

Sums over blocks are added by Spark, then ranked. Terms that neither group has are counted, not listed, by smoothing alone.

Defined cases: null text, lang and source are ''; a language with one source has no pairs; a group without kept terms has only
smoothing; without any kept term pairs have value 0; ties go by UTF-8 order of the item; an empty table gives an empty result;
repeated rows count as often as they are there; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm._common import Workspace, ranked
from cloudloom.llm._text import gathered, slices, texts_of, trim

SCALE, MIN_DOCS, TOP = 10**9, 3, 200
BLOCK, TEAM = 16384, 4
#: Bytes of terms: letters of ASCII (A-Z lower-cased) and all of other characters; the rest are blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, source string, part string, item string, value long"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The texts' terms, and where each text's begin and end."""
    offsets, data = texts.buffers()[1:]
    held = (data.to_pybytes() if data else b"").translate(LETTERS)
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(held), offset=texts.offset))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(at[0], at[-1] - at[0]) if len(at) else lists.values
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
    return before[at - at[0]] if len(at) else before, flat.filter(pa.array(full))


def count_terms(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) → a slice's counts by group and term, and how many of its documents have the term."""
    for batch in gathered(slices(batches)):
        langs, sources = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source"))
        groups = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        offsets, terms = terms_of(texts_of(batch))
        coded = terms.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(groups)), np.diff(offsets))
        keys, n = np.unique(groups[doc] * width + codes, return_counts=True)
        once = np.unique(doc * width + codes)  # each document's terms once
        docs = np.unique(groups[once // width] * width + once % width, return_counts=True)[1]
        group = keys // width
        # every group comes out, with the empty term where it has none, so that none is lost
        bare = np.setdiff1d(groups, group)
        group, term = np.concatenate([group, bare]), pa.concat_arrays([coded.dictionary.take(pa.array(keys % width)).cast(pa.string()), pa.array([""] * len(bare), pa.string())])
        zeros = np.zeros(len(bare), np.int64)
        columns = [
            langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), term,
            pa.array(np.concatenate([n, zeros]).astype(np.int64)), pa.array(np.concatenate([docs, zeros]).astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if k < 2 else c for k, c in enumerate(columns)], ["lang", "source", "term", "n", "docs"])
        trim()


def share(count: np.ndarray | int, total: int, width: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + width)), by long division in three steps: exact for totals up to 9 x 10^15."""
    left, out = np.asarray(count, np.int64) + 1, np.int64(0)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // (total + width), left % (total + width)
    return out + 1


def diverged(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    return pa.compress(np.diff(places, prepend=0).astype("<u2").tobytes() + counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, 10 * size, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<u2", size).astype(np.int64)), np.frombuffer(raw, "<i8", size, 2 * size)


def shares_of(vectors: pa.StructArray, width: int) -> list[tuple[str, np.ndarray]]:
    """(source, shares of all the block's terms) of each vector of a cell."""
    out = []
    for source, total, terms, size, blob in zip(*(vectors.field(c).to_pylist() for c in ("source", "total", "terms", "size", "blob"))):
        places, counts = unpacked(blob, size)
        full = np.zeros(width, np.int64)
        full[places] = counts
        out.append((source, share(full, total, terms)))
    return out


class Partials:
    """Rows of partial results, given out as batches."""

    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())])

    def __init__(self):
        self.rows = []

    def add(self, lang, source, part, item, value):
        self.rows.append((lang, source, part, item, int(value)))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows), self.schema)] if self.rows else [pa.array([], t.type) for t in self.schema], schema=self.schema)
        self.rows = []
        return out


def meet(out: Partials, lang: str, home: list, guests: list) -> None:
    """Both directions of each meeting of two lists of (source, shares)."""
    for a, p in home:
        for b, q in guests:
            out.add(lang, a, "pair", b, diverged(p, q).sum())
            out.add(lang, b, "pair", a, diverged(q, p).sum())


def at_home(top: int):
    """Round 0: a cell's own pairs, and the best terms of each of its groups."""

    def run(batches):
        out = Partials()
        for batch in batches:
            for i in range(batch.num_rows):
                lang, width, whole_total = (batch.column(c)[i].as_py() for c in ("lang", "width", "whole_total"))
                cell = batch.column("vectors")[i].values
                vectors = shares_of(cell, width)
                for k, one in enumerate(vectors):
                    meet(out, lang, [one], vectors[k + 1 :])
                for k, (source, p) in enumerate(vectors):
                    blob, size, terms = (cell.field(c)[k].as_py() for c in ("blob", "size", "terms"))
                    if size:
                        p, q = p[unpacked(blob, size)[0]], share(cell.field("whole")[k].values.to_numpy(), whole_total, terms)
                        f, names = diverged(p, q), cell.field("names")[k].values
                        over = np.flatnonzero(p > q)
                        if len(over) > top:  # all that may be among the best, ties included; the heap ranks them
                            over = over[f[over] >= np.partition(f[over], len(over) - top)[len(over) - top]]
                        for value, name in nlargest(top, ((int(f[j]), Backwards(names[j].as_py())) for j in over)):
                            out.add(lang, source, "term", name.s, value)
                yield out.batch()

    return run


class Backwards:
    """A string that is larger the earlier it comes in UTF-8 order (which is that of code points)."""

    __slots__ = ("s",)

    def __init__(self, s: str):
        self.s = s

    def __lt__(self, other: Backwards) -> bool:
        return self.s > other.s

    def __eq__(self, other: object) -> bool:
        return self.s == other.s


def visited(batches) -> Iterator[pa.RecordBatch]:
    """A later round: cells and the vectors that visit them."""
    out = Partials()
    for batch in batches:
        for i in range(batch.num_rows):
            lang, width = (batch.column(c)[i].as_py() for c in ("lang", "width"))
            meet(out, lang, *(shares_of(batch.column(c)[i].values, width) for c in ("vectors", "guests")))
            yield out.batch()


def cells_of(ws: Workspace, docs: DataFrame, min_docs: int, block: int, team: int) -> DataFrame:
    """One row per (lang, block, team): the vectors of the team's groups in the block."""
    counts = docs.select("lang", "source", "text").mapInArrow(count_terms, COUNTED)
    counts = ws.table(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= min_docs).drop("docs")
    kept = ranked(ws, kept, ["lang"], ["term"], "place")
    kept = ws.table(kept.select("lang", "term", "whole", F.expr(f"place div {block}").alias("block"), F.expr(f"place % {block}").alias("place")))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("whole_total"))
    entries = ws.table(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "block", "place", "n", "whole", "term"))
    # a row for each group
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "whole_total", "total"])
    groups = ws.table(ranked(ws, groups, ["lang"], ["source"], "slot").withColumn("team", F.expr(f"slot div {team}")))
    rings = groups.groupBy("lang").agg((F.max("team") + 1).alias("teams"))
    groups = ws.table(groups.join(rings, "lang").withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(0L, (terms - 1) div {block}))"))))
    own = entries.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "whole", "term"))).alias("e"))  # a block's terms at most
    listed = groups.join(own, ["lang", "source", "block"], "left").withColumn("e", F.coalesce("e", F.expr("cast(array() as array<struct<place:long,n:long,whole:long,term:string>>)")))
    listed = listed.select("lang", "block", "team", "teams", "terms", "whole_total", "source", "total", F.col("e.whole").alias("whole"), F.col("e.term").alias("names"), F.size("e").alias("size"),
                           F.col("e.place").alias("places"), F.col("e.n").alias("counts"))

    def pack(batches):
        for batch in batches:
            places, counts = (batch.column(c) for c in ("places", "counts"))
            blobs = [packed(places[i].values.to_numpy(), counts[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield batch.drop_columns(["places", "counts"]).append_column("blob", pa.array(blobs, pa.binary()))

    flat = listed.mapInArrow(pack, "lang string, block long, team long, teams long, terms long, whole_total long, source string, total long, whole array<long>, names array<string>, size int, blob binary")
    width = F.greatest(F.lit(0), F.least(F.lit(block), F.col("terms") - F.col("block") * block)).cast("int").alias("width")
    vector = F.struct("source", "total", "terms", "size", "blob", "whole", "names")
    cells = flat.groupBy("lang", "block", "team", "teams", "whole_total", width).agg(F.sort_array(F.collect_list(vector)).alias("vectors"))  # a team's groups at most
    return ws.table(cells)


def audit(ws: Workspace, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, team: int = TEAM) -> DataFrame:
    """``docs(text, lang, source)`` → (lang, source, part, item, value, rank): parts ``pair`` (other sources) and ``term``."""
    cells = cells_of(ws, docs, min_docs, block, team)
    key = ["lang", "block", "team"]
    found = [ws.table(cells.mapInArrow(at_home(top), PARTIAL))]
    light = F.transform("vectors", lambda v: F.struct(v["source"].alias("source"), v["total"].alias("total"), v["terms"].alias("terms"), v["size"].alias("size"), v["blob"].alias("blob")))
    resident = cells.select(*key, "teams", "width", light.alias("vectors")).repartition(*key).persist(StorageLevel.DISK_ONLY)
    try:
        longest = cells.agg(F.coalesce(F.max("teams"), F.lit(0))).first()[0]
        for r in range(1, longest // 2 + 1):
            guests = cells.where(F.col("teams") >= 2 * r).select(
                "lang", "block", ((F.col("team") + r) % F.col("teams")).alias("team"), F.col("team").alias("from"), light.alias("guests"))
            once = f"teams <> {2 * r} OR team < `from`"
            met = resident.join(guests.repartition(*key), key).where(once).select("lang", "width", "vectors", "guests")
            found.append(ws.table(met.mapInArrow(visited, PARTIAL)))
    finally:
        resident.unpersist()
    partial = found[0]
    for more in found[1:]:
        partial = partial.unionByName(more)
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = "(partition by lang, source, part order by value desc, item)"
    terms = partial.where("part = 'term'")
    both = pairs.unionByName(terms).withColumn("rank", F.expr(f"cast(row_number() over {order} as int)"))
    return both.where(F.expr(f"part = 'pair' OR rank <= {top}"))


ORACLE = r"""
    with d as (
        select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
        from documents),
    t as (select rid, lang, source, unnest(ts) as term from d),
    kept as (select lang, term, count(*)::hugeint as whole from t group by lang, term having count(distinct rid) >= 3),
    counts as (select lang, source, term, count(*)::hugeint as n from t semi join kept using (lang, term) group by all),
    g as (select distinct lang, source from d),
    v as (select lang, count(*) as v, sum(whole)::hugeint as w from kept group by lang),
    totals as (select lang, source, sum(n)::hugeint as total from counts group by all),
    shares as (
        select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(o.total, 0) + v.v) as p,
               1 + 1000000000::hugeint * (k.whole + 1) // (v.w + v.v) as q
        from g join kept k using (lang) join v using (lang) left join totals o using (lang, source) left join counts c using (lang, source, term)),
    sums as (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
        from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    found as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
        from g a join g b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
        union all
        select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from shares where n > 0 and p > q)
    select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
    from found qualify part = 'pair' or rank <= 200"""
