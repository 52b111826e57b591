"""Operator 6, WARC records in seekable Zstandard bundles.

A bundle is one file: records are grouped into independent Zstandard frames of about ``frame_bytes``, so that one frame can be
read and decompressed alone; a last skippable frame is the seek table (for each frame its compressed and decompressed size,
then their number and a magic number), as in the public seekable format. The index, a table, maps each record's id to its
bundle, frame and offset within the decompressed frame. Archives are written to the shared folder by the executors, under
names of their own for each attempt; only files that the index names count, so a lost task leaves no trace in what is read.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is the response, the others are
revisits that refer to it.

Defined cases: a null html is the empty payload; a null page_id is the smallest and its record's id is ``null``; of repeated
rows one is the response; empty tables give no bundles and an empty result; columns besides ``page_id, url, html`` are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _text as T
from cloudloom.llm._common import Workspace, numbered

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the format
INDEX = "rid long, page_id long, record_type string, refers_to long, bundle string, frame int, frame_at long, frame_size long, at long, size long"


def local_path(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith(("file:/", "/")) else None


def open_out(uri: str):
    """A file of the shared folder to write: a plain path, or whatever file system Arrow knows for the scheme."""
    if (path := local_path(uri)) is not None:
        path = path.removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def open_in(uri: str):
    if (path := local_path(uri)) is not None:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    body = payload
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Bundle:
    """Writes one seekable file."""

    def __init__(self, uri: str, frame_bytes: int):
        self.uri, self.frame_bytes = uri, frame_bytes
        self.out, self.frames, self.at = open_out(uri), [], 0
        self.parts: list[bytes] = []
        self.filled = 0
        self.waiting: list[tuple] = []
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress

    def add(self, row: tuple, raw: bytes) -> Iterator[tuple]:
        self.waiting.append((*row, self.uri, len(self.frames), self.at, self.filled, len(raw)))
        self.parts.append(raw)
        self.filled += len(raw)
        if self.filled >= self.frame_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.parts:
            frame = self.compress(b"".join(self.parts))
            self.out.write(frame)
            self.frames.append((len(frame), self.filled))
            self.at += len(frame)
            for w in self.waiting:
                yield (*w[:7], len(frame), *w[7:])
            self.parts, self.waiting, self.filled = [], [], 0

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of an open bundle."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    table, at, out = f.read(8 * n), 0, []
    for packed, whole in struct.iter_unpack("<II", table):
        out.append((at, packed, whole))
        at += packed
    return out


def writer(folder: str, frame_bytes: int, bundle_bytes: int):
    """(rid, page_id, url, html, response, …) → index rows."""

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        names = [x.split()[0] for x in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches):
        bundle = None
        for batch in T.slices(batches, "html"):
            rows = []
            for rid, page_id, url, html, keeper, refers in zip(*(batch.column(c).to_pylist() for c in ("rid", "page_id", "url", "html", "keeper", "refers")), strict=True):
                payload = (html or "").encode()
                revisit = keeper is not None and keeper != rid
                raw = record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers, revisit)
                bundle = bundle or Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                rows += bundle.add((rid, page_id, "revisit" if revisit else "response", refers if revisit else None), raw)
                if bundle.at >= bundle_bytes:
                    rows += bundle.close()
                    bundle = None
            if rows:
                yield columns(rows)
        if bundle is not None:
            yield columns(list(bundle.close()))

    return run


def write(ws: Workspace, pages: DataFrame, folder: str, least: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 30) -> DataFrame:
    """Writes the archives; returns the index, a table."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    written = numbered(ws, pages, "page_id", "url", "html")
    rows = written.withColumn("same", F.when(F.octet_length(raw) >= least, F.sha2(raw, 256)))
    groups = rows.where("same is not null").groupBy("same").agg(F.max(F.struct("page_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = ws.table(groups.select("same", F.col("keep.rid").alias("keeper"), F.col("keep.page_id").alias("refers")))
    lone = rows.withColumn("same", F.coalesce("same", F.concat(F.lit("-"), F.col("rid").cast("string"))))  # no common key for short payloads
    marked = lone.join(groups, "same", "left") if not ws.is_empty(groups) else rows.withColumn("keeper", F.lit(None).cast("long")).withColumn("refers", F.lit(None).cast("long"))
    index = ws.table(marked.select("rid", "page_id", "url", "html", "keeper", "refers").mapInArrow(writer(folder, frame_bytes, bundle_bytes), INDEX))
    ws.drop(written, groups)
    return index


def lookup(bundle: str, frame_at: int, frame_size: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record, by reading and decompressing its frame alone."""
    with open_in(bundle) as f:
        f.seek(frame_at)
        whole = zstandard.ZstdDecompressor().decompress(f.read(frame_size))
    return parse(whole[at : at + size])


def reader(batches):
    """Frames (bundle, frame, frame_at, frame_size, entries) → records, checked against the seek table and their digests."""
    tables: dict[str, list] = {}
    for batch in batches:
        for bundle, frame, frame_at, frame_size, entries in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "frame_at", "frame_size", "entries")), strict=True):
            with open_in(bundle) as f:
                if bundle not in tables:
                    tables = {bundle: seek_table(f, f.seek(0, 2))}
                where = tables[bundle][frame]
                if where[:2] != (frame_at, frame_size):
                    raise ValueError(f"{bundle}: the index and the seek table differ in frame {frame}")
                f.seek(frame_at)
                whole = zstandard.ZstdDecompressor().decompress(f.read(frame_size))
            out = []
            for e in entries:
                fields, body = parse(whole[e["at"] : e["at"] + e["size"]])
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{bundle}: the payload of {fields['WARC-Record-ID']} is damaged")
                name = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                refers = fields["WARC-Refers-To"][len("<urn:page:") : -1] if revisit else "null"
                length = int(fields["X-Payload-Length"])
                out.append((None if name == "null" else int(name), length, digest, fields["WARC-Type"], None if refers == "null" else int(refers), None if revisit else body.decode()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])


def read(index: DataFrame) -> DataFrame:
    """All records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits)."""
    frames = index.groupBy("bundle", "frame", "frame_at", "frame_size").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("entries"))
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
