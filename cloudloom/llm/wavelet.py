"""Operator 9, token ids as a wavelet matrix per shard.

A shard file holds the ids of documents in ascending doc_id order as bit-planes, highest bit first: each plane has the bits of
all ids in the plane's order, and the next plane's order puts ids with bit 0 before those with bit 1, stably. Planes are cut
into blocks of 2^16 bits, each compressed alone, with the number of ones before each block in the directory. So one file
gives the id at a place (access), how often an id occurs before a place (rank) and where its k-th occurrence is (select), by
reading one or two blocks a plane.

Layout: magic, length of the header, header (JSON: counts, planes, lengths of the parts), directory (zeros of each plane; block offsets;
ones before each block), documents (doc_ids, which are null, ends), blocks. Whole shards are decoded plane by plane.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; repeated rows are documents each, side by side;
an empty table gives no shard and an empty result; columns besides ``doc_id, text`` are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _text as T
from cloudloom.llm._common import Workspace, maybe_broadcast
from cloudloom.llm._tokens import encoder, vocabulary_path
from cloudloom.llm.warc import open_in, open_out

MAGIC = b"WVLTMX01"
BLOCK = 1 << 16
END_ID = 2
SHARD_IDS = 1 << 21
BATCH_BYTES = 12 << 20  # of texts encoded at once
SHARDS = "part int, number int, file string, documents long, ids long"


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little")


def build(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes and each plane's number of zeros."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    x = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes, zeros = [], []
    for b in range(width - 1, -1, -1):
        bit = (x >> x.dtype.type(b)).astype(np.uint8) & 1
        one = bit.view(bool)
        planes.append(packed(one))
        low = x.compress(~one)
        zeros.append(len(low))
        x = np.concatenate([low, x.compress(one)])
    return planes, zeros


def decoded(planes: list[np.ndarray], zeros: list[int], n: int) -> np.ndarray:
    """All ids, from the last plane back to the first."""
    width = len(planes)
    x = np.zeros(n, np.uint16 if width <= 16 else np.uint32)
    for level in range(width - 1, -1, -1):
        one = np.unpackbits(planes[level], count=n, bitorder="little").view(bool)
        y = np.empty_like(x)
        z = zeros[level]
        y[np.flatnonzero(~one)] = x[:z]
        y[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << (width - 1 - level))
        x = y
    return x


def shard_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    planes, zeros = build(ids)
    compress = zstandard.ZstdCompressor(level=1).compress
    blocks, ones = [], []
    for p in planes:
        before = 0
        for at in range(0, max(1, len(p)), BLOCK // 8):
            part = p[at : at + BLOCK // 8]
            ones.append(before)
            before += int(np.bitwise_count(part).sum())
            blocks.append(compress(part.tobytes()))
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<i8")
    directory = compress(b"".join([np.array(zeros, "<i8").tobytes(), offsets.tobytes(), np.array(ones, "<i8").tobytes()]))
    ids_of = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    documents = compress(ids_of + np.array([d is None for d in doc_ids], "u1").tobytes() + ends.astype("<i8").tobytes())
    header = json.dumps({"ids": len(ids), "documents": len(doc_ids), "planes": len(planes), "blocks": len(blocks), "directory": len(directory), "table": len(documents)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, directory, documents, *blocks])


class WaveletFile:
    """A shard: whole, or by access, rank and select."""

    def __init__(self, uri: str):
        self.f = open_in(uri)
        if self.f.read(8) != MAGIC:
            raise ValueError(f"{uri} is no shard")
        (size,) = struct.unpack("<I", self.f.read(4))
        h = json.loads(self.f.read(size))
        whole = zstandard.ZstdDecompressor().decompress
        d = np.frombuffer(whole(self.f.read(h["directory"])), "<i8")
        self.n, self.planes = h["ids"], h["planes"]
        self.zeros = d[: self.planes].tolist()
        self.offsets = d[self.planes : self.planes + h["blocks"] + 1]
        self.ones = d[self.planes + h["blocks"] + 1 :]
        t, m = whole(self.f.read(h["table"])), h["documents"]
        null = np.frombuffer(t, "u1", m, 8 * m)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(t, "<i8", m).tolist(), null.tolist(), strict=True)]
        self.ends = np.frombuffer(t, "<i8", m + 1, 9 * m)
        self.first = 12 + size + h["directory"] + h["table"]
        self.per_plane = h["blocks"] // self.planes
        self.held: dict[int, np.ndarray] = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def block(self, k: int) -> np.ndarray:
        if k not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            self.f.seek(self.first + int(self.offsets[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.offsets[k + 1] - self.offsets[k])))
            self.held[k] = np.frombuffer(raw, np.uint8)
        return self.held[k]

    def ids(self) -> np.ndarray:
        self.f.seek(self.first)
        raw = self.f.read(int(self.offsets[-1]))
        whole = zstandard.ZstdDecompressor().decompress
        parts = [whole(raw[a:b]) for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        k = self.per_plane
        return decoded([np.frombuffer(b"".join(parts[i * k : (i + 1) * k]), np.uint8) for i in range(self.planes)], self.zeros, self.n)

    def bit(self, plane: int, i: int) -> int:
        b = self.block(plane * self.per_plane + i // BLOCK)
        return int(b[i % BLOCK // 8]) >> (i % 8) & 1

    def rank1(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        k = plane * self.per_plane + i // BLOCK
        b, r = self.block(k), i % BLOCK
        return int(self.ones[k]) + int(np.bitwise_count(b[: r // 8]).sum()) + (int(b[r // 8]) & ((1 << r % 8) - 1)).bit_count()

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.planes):
            one = self.bit(p, i)
            value = value << 1 | one
            i = self.zeros[p] + self.rank1(p, i) if one else i - self.rank1(p, i)
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before place i."""
        if value >> self.planes:
            return 0
        a = 0
        for p in range(self.planes):
            if value >> (self.planes - 1 - p) & 1:
                a, i = self.zeros[p] + self.rank1(p, a), self.zeros[p] + self.rank1(p, i)
            else:
                a, i = a - self.rank1(p, a), i - self.rank1(p, i)
        return i - a

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``; -1 if there are fewer."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            if self.rank(value, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low


def writer(path: str, folder: str, end_id: int, shard_ids: int):
    """Sorted (doc_id, text) → written shards' rows."""

    def run(batches):
        encode = encoder(path, False).encode
        part, number = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        chunks: list[np.ndarray] = []
        ends = [0]

        def closed() -> pa.RecordBatch:
            nonlocal number
            file = f"{folder}/{uuid.uuid4().hex}.wm"
            with open_out(file) as f:
                f.write(shard_bytes(docs, np.array(ends), np.concatenate(chunks)))
            row = [part, number, file, len(docs), ends[-1]]
            number += 1
            docs.clear()
            chunks.clear()
            ends[:] = [0]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "file", "documents", "ids"])

        for batch in T.slices(T.gathered(batches, BATCH_BYTES), limit=BATCH_BYTES):
            at, ids = encode(T.texts_of(batch))
            lengths = np.diff(at)
            out = np.full(len(ids) + len(lengths), end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(lengths + 1) - 1] = False
            out[keep] = ids
            chunks.append(out)
            docs.extend(batch.column("doc_id").to_pylist())
            ends.extend((ends[-1] + np.cumsum(lengths + 1)).tolist())
            if ends[-1] >= shard_ids:
                yield closed()
        if docs:
            yield closed()

    return run


def write(ws: Workspace, docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards; returns the table of shards with ``before``, the ids of all shards before."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = ws.table(ordered.mapInArrow(writer(path, folder, end_id, shard_ids), SHARDS))
    # partitions before, then the shards before in a partition: no window holds more rows than there are partitions
    parts = ws.table(shards.groupBy("part").agg(F.sum("ids").alias("total")))
    earlier = parts.select("part", F.expr("coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0L)").alias("base"))
    inner = F.expr("coalesce(sum(ids) over (partition by part order by number rows between unbounded preceding and 1 preceding), 0L)")
    return ws.table(shards.withColumn("inner", inner).join(maybe_broadcast(earlier), "part").select("part", "number", "file", "documents", "ids", (F.col("base") + F.col("inner")).alias("before")))


def reader(batches):
    for batch in batches:
        for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
            with WaveletFile(file) as w:
                ids = w.ids()
                ends = w.ends
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(w.doc_ids, pa.int64()), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(shards: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, shards.count())
    return shards.select("file", "before").repartition(min(n, 4096), "file").mapInArrow(reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
