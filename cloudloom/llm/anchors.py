"""Operator 13, substring dedup by fixed-block anchors.

A window is ``width`` consecutive words of one document. Each word covered by a window whose words also start earlier (smaller
doc_id, or the same document and an earlier start) is removed. Windows are judged on the input.

* Anchors: every document is cut into blocks of a = (width + 1) div 2 words from its start. Each window holds a whole block of
  its document, so the first place of a repeated window holds an indexed block, and every later place holds a rolling window of
  a words equal to it.
* Index and probes: documents are coded by slices (words of a few megabytes of text, written once). Each slice gives the
  distinct hashes of its rolling a-word windows, marked where one is a block, packed by bucket of the hash: four bytes a window,
  and a passage that is on every page is one entry a slice. A bucket's task finds the hashes that are a block somewhere and
  occur twice, and gives each slice its hits. As this only chooses where to extend, equal hashes of different words cost time,
  not results.
* Extension: a hit is extended to the windows around it that lie in the document, and these are held against each other by 128-bit
  fingerprints of all their words: a slice keeps the first place of each, buckets the first of all slices. All other places are
  repeats; what they cover together are the maximal repeats, however long. So a group of thousands of copies needs an entry a slice,
  and no pairs.

The number of buckets grows with the words, and a bucket's size doesn't. No task holds a group of copies. Slices are coded by their
own words, from which the kept text is put together; texts are read once.

Defined cases: a null text has no words; a null doc_id is as the smallest long; of rows with the same doc_id the one read first is
earlier; a text shorter than a window is kept; an empty table gives an empty result; other columns are ignored. Spark holds a text
in one row, so a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm._common import Workspace, row_id
from cloudloom.llm._text import coded, gathered, mixed, multiplier, slices, split_words, texts_of, trim

WIDTH = 20
BUCKET = 1 << 21  # words a bucket
U = np.uint64
KEY_BITS = 30

SLICES = "slice long, n long, rids binary, doc_ids binary, lengths binary, codes binary, words binary"
HASHES = "bucket long, slice long, hashes binary"
HITS = "slice long, bucket long, keys binary"
PLACES = "bucket long, slice long, n int, prints binary, doc_ids binary, rids binary, starts binary"
LOST = "slice long, starts binary"
RESULT = "rid long, doc_id {key}, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, text string"
LEAST = np.iinfo(np.int64).min


def squeezed(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def whole(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def array(blob: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(whole(blob), kind)


class Slice:
    """The coded words of some documents, in the order of their doc_ids."""

    def __init__(self, row: dict):
        self.lengths, self.codes, self.words = array(row["lengths"]), array(row["codes"], np.uint32), whole(row["words"]).split(b"\n")
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def hashed(self, half: int) -> np.ndarray:
        """64 bits of each word's hash."""
        f = (xxhash.xxh3_64_intdigest, lambda w: xxhash.xxh3_128_intdigest(w) >> 64)[half]
        return np.fromiter(map(f, self.words), U, len(self.words))[self.codes] if len(self.codes) else np.empty(0, U)

    def windows(self, width: int, half: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows at each place, and whether the window lies in one document."""
        h = self.hashed(half)
        n = max(len(h) - width + 1, 0)
        acc = np.zeros(n, U)
        for i in range(width):
            acc += h[i : i + n] * multiplier(i)
        return mixed(acc), self.doc[:n] == self.doc[width - 1 : width - 1 + n]

    def anchors(self, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key of each rolling window, whether it counts, whether it is a block): windows of documents that hold a ``width`` window."""
        a = (width + 1) // 2
        h, inside = self.windows(a)
        doc = self.doc[: len(h)]
        return h >> U(64 - bits - KEY_BITS), inside & (self.lengths[doc] >= width), (np.arange(len(h)) - self.offsets[doc]) % a == 0


def code(batches) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) → slices."""
    serial = TaskContext.get().partitionId() << 33
    for batch in gathered(slices(batches)):
        ids, rids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), LEAST).to_numpy(), batch.column("rid").to_numpy()
        order = np.lexsort((rids, ids))
        offsets, words = split_words(texts_of(batch.take(pa.array(order))))
        codes, vocabulary = coded(words)
        row = {
            "slice": serial, "n": len(codes), "rids": squeezed(rids[order]), "doc_ids": squeezed(ids[order]), "lengths": squeezed(np.diff(offsets)),
            "codes": squeezed(codes.astype(np.uint32)), "words": squeezed("\n".join(vocabulary.to_pylist()).encode()),
        }
        serial += 1
        yield pa.RecordBatch.from_pylist([row])
        trim()


def rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its run) of sorted buckets."""
    cuts = firsts(buckets)
    for a, b in zip(cuts, [*cuts[1:], len(buckets)]):
        yield int(buckets[a]), slice(int(a), int(b))


def batch_of(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t.type) for t in kinds], schema=kinds)


def probe(width: int, bits: int):
    """Slices → their distinct keys by bucket. The two low bits of each entry tell whether it is a block, and whether it recurs in the slice."""
    kinds = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for row in rows_of(batches):
            key, counts, block = Slice(row).anchors(width, bits)
            key, block = key[counts], block[counts]
            order = np.argsort(key, kind="stable")
            key, block = key[order], block[order]
            first = firsts(key)
            again = np.diff(first, append=len(key)) > 1
            held = np.logical_or.reduceat(block, first) if len(first) else block
            entry = ((key[first] & U((1 << KEY_BITS) - 1)) << U(2) | held.astype(U) | again.astype(U) << U(1)).astype(np.uint32)
            out = [(b, row["slice"], entry[run].tobytes()) for b, run in by_bucket((key[first] >> U(KEY_BITS)).astype(np.int64))]
            yield batch_of(out, kinds)
            trim()

    return run


def hits(group: pa.Table) -> pa.Table:
    """A bucket's keys that are a block somewhere and occur at two places, for each slice that has them."""
    slice_of, bucket = group.column("slice").to_pylist(), group.column("bucket")[0].as_py()
    entries = [np.frombuffer(b.as_py(), np.uint32) for b in group.column("hashes")]
    entry = np.concatenate(entries)
    owner = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
    order = np.argsort(entry >> 2, kind="stable")
    entry, owner = entry[order], owner[order]
    first = firsts(entry >> 2)
    n = np.diff(first, append=len(entry))
    flags = np.bitwise_or.reduceat(entry, first)
    good = np.repeat((flags & 1 > 0) & ((n > 1) | (flags & 2 > 0)), n)
    keys, owner = (entry >> 2)[good], owner[good]
    order = np.argsort(owner, kind="stable")
    keys, owner = keys[order], owner[order]
    out = [(slice_of[k], bucket, keys[run].tobytes()) for k, run in by_bucket(owner)]
    return pa.Table.from_batches([batch_of(out, pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())]))])


def extend(width: int, bits: int):
    """Slices with their hits → places of the windows around hits: the first of each window of the slice by bucket, the others (lost) in bucket -1."""
    kinds = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("prints", "doc_ids", "rids", "starts"))])

    def run(batches):
        for row in rows_of(batches):
            own = Slice(row)
            found = np.sort(np.concatenate([(np.frombuffer(h["keys"], np.uint32).astype(np.int64) | h["bucket"] << KEY_BITS) for h in row["hits"]]))
            key, counts, _ = own.anchors(width, bits)
            at = np.minimum(np.searchsorted(found, key.astype(np.int64)), len(found) - 1)
            hit = np.concatenate([[0], np.cumsum(counts & (found[at] == key.astype(np.int64)))])
            high, inside = own.windows(width)
            n, a = len(high), (width + 1) // 2
            near = hit[width - a + 1 : width - a + 1 + n] - hit[:n] > 0
            starts = np.flatnonzero(inside & near)
            high, low = high[starts], own.windows(width, 1)[0][starts]
            order = np.lexsort((starts, low, high))
            high, low, starts = high[order], low[order], starts[order]
            new = np.ones(len(starts), bool)
            new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            out = [(-1, row["slice"], int((~new).sum()), b"", b"", b"", squeezed(np.sort(starts[~new]).astype(np.uint32)))] if not new.all() else []
            high, low, starts = high[new], low[new], starts[new]
            ids, rids, bucket = array(row["doc_ids"]), array(row["rids"]), (high >> U(64 - bits)).astype(np.int64)
            order = np.lexsort((starts, bucket))
            high, low, starts = high[order], low[order], starts[order]
            for b, run in by_bucket(bucket[order]):
                doc = own.doc[starts[run]]
                prints = np.concatenate([high[run], low[run]])
                out.append((b, row["slice"], run.stop - run.start, prints.tobytes(), squeezed(ids[doc]), squeezed(rids[doc]), squeezed(starts[run].astype(np.uint32))))
            yield batch_of(out, kinds)
            trim()

    return run


def later(group: pa.Table) -> pa.Table:
    """A bucket's places but the first of each window, by slice."""
    slice_of, n = group.column("slice").to_pylist(), group.column("n").to_numpy()
    prints = [np.frombuffer(b.as_py(), U) for b in group.column("prints")]
    high, low = (np.concatenate([p[k * len(p) // 2 : (k + 1) * len(p) // 2] for p in prints]) for k in (0, 1))
    ids, rids = (np.concatenate([array(b.as_py()) for b in group.column(c)]) for c in ("doc_ids", "rids"))
    starts = np.concatenate([array(b.as_py(), np.uint32) for b in group.column("starts")])
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rids, ids, low, high))
    same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    lost = order[1:][same]
    lost = lost[np.argsort(owner[lost], kind="stable")]
    out = [(slice_of[k], squeezed(starts[lost[run]])) for k, run in by_bucket(owner[lost])]
    return pa.Table.from_batches([batch_of(out, pa.schema([("slice", pa.int64()), ("starts", pa.binary())]))])


def cut(width: int, key: pa.DataType):
    """Slices with lost windows → documents without the words that these cover."""
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def run(batches):
        for row in rows_of(batches):
            own, n = Slice(row), row["n"]
            edge = np.zeros(n + 1, np.int64)
            for blob in row["lost"] or ():
                starts = array(blob, np.uint32).astype(np.int64)
                edge += np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
            gone = np.cumsum(edge)[:n] > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            removed = before[own.offsets[1:]] - before[own.offsets[:-1]]
            # runs of removed words end at their document's end
            begins = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (own.doc[1:] != own.doc[:-1])])) if n else np.empty(0, np.int64)
            stops = np.flatnonzero(gone & np.concatenate([~gone[1:] | (own.doc[1:] != own.doc[:-1]), [True]])) + 1 if n else begins
            home = own.offsets[own.doc[begins]] if n else begins
            spans = pa.StructArray.from_arrays([pa.array((begins - home).astype(np.int32)), pa.array((stops - home).astype(np.int32))], fields=list(span))
            per_doc = np.bincount(own.doc[begins], minlength=len(own.lengths)) if n else np.zeros(len(own.lengths), np.int64)
            kept = pa.array(own.words, pa.binary()).cast(pa.string()).take(pa.array(own.codes[~gone])) if n else pa.array([], pa.string())
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array((own.offsets - before[own.offsets]).astype(np.int32)), kept), " ")
            ids = array(row["doc_ids"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(array(row["rids"])), pa.array(ids, mask=ids == LEAST).cast(key), pa.array(own.lengths), pa.array(removed),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)), spans), texts,
                ],
                ["rid", "doc_id", "n_words", "n_removed", "removed", "text"],
            )
            trim()

    return run


def dedup(ws: Workspace, docs: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """``docs(doc_id, text)`` → rid, doc_id, n_words, n_removed, removed (spans of words), text (the kept words)."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(row_id().alias("rid"), "doc_id", "text")
    coded_slices = ws.table(rows.mapInArrow(code, SLICES), compression="none")
    words = coded_slices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(5, int(words // bucket).bit_length())
    probes = coded_slices.mapInArrow(probe(width, bits), HASHES)
    found = ws.table(probes.groupBy("bucket").applyInArrow(hits, HITS), compression="zstd")
    per_slice = found.groupBy("slice").agg(F.collect_list(F.struct("bucket", "keys")).alias("hits"))  # a slice's own windows at most
    places = coded_slices.join(per_slice, "slice").mapInArrow(extend(width, bits), PLACES)
    places = ws.table(places, compression="none")
    lost = places.where("bucket >= 0").groupBy("bucket").applyInArrow(later, LOST).unionByName(places.where("bucket < 0").select("slice", "starts"))
    lost = ws.table(lost, compression="none")
    ws.drop(found, places)
    lost = lost.groupBy("slice").agg(F.collect_list("starts").alias("lost"))
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]
    return coded_slices.join(lost, "slice", "left").mapInArrow(cut(width, arrow), RESULT.format(key=kind.simpleString()))


ORACLE = r"""
    with d as (select row_number() over (order by doc_id nulls first) as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    w as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
    win as (select rid, i, string_agg(word, ' ') over (partition by rid order by i rows between current row and 19 following) as k, count(*) over (partition by rid order by i rows between current row and 19 following) as n from w),
    firsts as (select k, min((rid, i)) as f from win where n = 20 group by k having count(*) > 1),
    gone as (select distinct rid, unnest(range(i, i + 20)) as i from win join firsts using (k) where n = 20 and (rid, i) <> f),
    kept as (select w.rid, string_agg(word, ' ' order by i) as text, count(*) as n from w anti join gone using (rid, i) group by w.rid)
    select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from d left join kept using (rid)"""
