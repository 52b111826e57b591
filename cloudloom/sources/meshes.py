"""Meshes and scenes as Spark sources and sinks.

``spark.read.format("pointcloud")`` reads a folder of PLY, OBJ, OFF or STL files, one partition a file; each file is a frame,
numbered in the order of names. Normals come from the file, else from its faces; colours are null if absent. Register with
``register(spark)``. Writers give a file per frame.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINTS = "frame_id int, pt_id long, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int"
PLY = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def face_normals(xyz: np.ndarray, faces: list[list[int]]) -> np.ndarray:
    """Normalised mean of the normals of a vertex's faces."""
    out = np.zeros_like(xyz)
    for f in faces:
        if len(f) >= 3:
            n = np.cross(xyz[f[1]] - xyz[f[0]], xyz[f[2]] - xyz[f[0]])
            length = np.linalg.norm(n)
            if length > 0:
                out[f] += n / length
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 0, out / np.maximum(length, 1e-300), np.nan)


def read_ply(raw: bytes) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    head, _, body = raw.partition(b"end_header\n") if b"end_header\n" in raw else raw.partition(b"end_header\r\n")
    kind, elements = "ascii", []
    for line in head.decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], tuple(w[1:-1])))
    columns, faces = {}, []
    if kind == "ascii":
        rows = iter(body.decode("ascii", "replace").splitlines())
        for name, n, props in elements:
            lines = [next(rows).split() for _ in range(n)]
            if name == "vertex":
                table = np.array([[float(v) for v in r[: len(props)]] for r in lines]).reshape(n, len(props))
                columns = {p: table[:, i] for i, (p, _) in enumerate(props)}
            elif name == "face":
                faces = [[int(v) for v in r[1 : 1 + int(r[0])]] for r in lines]
        return columns, faces
    order, at = "<" if "little" in kind else ">", 0
    for name, n, props in elements:
        if all(t[0] != "list" for _, t in props):
            kinds = np.dtype([(p, order + PLY[t[0]]) for p, t in props])
            table = np.frombuffer(body, kinds, n, at)
            at += n * kinds.itemsize
            if name == "vertex":
                columns = {p: table[p].astype(float) for p, _ in props}
            continue
        for _ in range(n):
            for _, t in props:
                if t[0] == "list":
                    count = struct.unpack_from(order + PLY[t[1]], body, at)[0]
                    at += struct.calcsize(PLY[t[1]])
                    values = struct.unpack_from(order + str(count) + PLY[t[2]], body, at)
                    at += struct.calcsize("=" + str(count) + PLY[t[2]])
                    if name == "face":
                        faces.append(list(values))
                else:
                    at += struct.calcsize(PLY[t[0]])
    return columns, faces


def read_obj(raw: bytes) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    v, n, faces = [], [], []
    for line in raw.decode("utf-8", "replace").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            v.append([float(x) for x in w[1:7]])
        elif w[:1] == ["vn"]:
            n.append([float(x) for x in w[1:4]])
        elif w[:1] == ["f"]:
            faces.append([int(x.split("/")[0]) - 1 for x in w[1:]])
    table = np.array([r[:3] for r in v], float).reshape(-1, 3)
    out = {c: table[:, i] for i, c in enumerate("xyz")}
    if v and all(len(r) == 6 for r in v):
        c = np.array([r[3:] for r in v]) * 255
        out |= {k: c[:, i] for i, k in enumerate(("red", "green", "blue"))}
    if len(n) == len(v) and n:
        out |= {k: np.array(n)[:, i] for i, k in enumerate(("nx", "ny", "nz"))}
    return out, faces


def read_off(raw: bytes) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    w = re.sub(r"#.*", "", raw.decode("ascii", "replace")).split()
    w = w[1:] if w and w[0].endswith("OFF") else w
    n, m, at = int(w[0]), int(w[1]), 3
    table = np.array(w[at : at + 3 * n], float).reshape(n, 3)
    at += 3 * n
    faces = []
    for _ in range(m):
        k = int(w[at])
        faces.append([int(x) for x in w[at + 1 : at + 1 + k]])
        at += 1 + k
    return {c: table[:, i] for i, c in enumerate("xyz")}, faces


def read_stl(raw: bytes) -> tuple[dict[str, np.ndarray], list[list[int]]]:
    if raw[:5] == b"solid" and b"facet" in raw[:1000]:
        v = np.array(re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", raw), float).reshape(-1, 3)
    else:
        n = struct.unpack_from("<I", raw, 80)[0]
        t = np.frombuffer(raw, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), n, 84)
        v = t["v"].reshape(-1, 3).astype(float)
    xyz, back = np.unique(v, axis=0, return_inverse=True)
    return {c: xyz[:, i] for i, c in enumerate("xyz")}, back.reshape(-1, 3).tolist()


READERS = {".ply": read_ply, ".obj": read_obj, ".off": read_off, ".stl": read_stl}


def decoded(name: str, raw: bytes) -> pd.DataFrame:
    """One file's points."""
    columns, faces = READERS[os.path.splitext(name)[1].lower()](raw)
    n = len(columns.get("x", ()))
    out = pd.DataFrame({"pt_id": np.arange(n), **{c: columns[c] for c in "xyz"}}) if n else pd.DataFrame({"pt_id": [], "x": [], "y": [], "z": []})
    normals = np.stack([columns[c] for c in ("nx", "ny", "nz")], 1) if "nx" in columns else face_normals(out[list("xyz")].to_numpy(float), faces) if faces else np.full((n, 3), np.nan)
    for i, c in enumerate(("nx", "ny", "nz")):
        out[c] = normals[:, i] if n else []
    for c, k in (("r", "red"), ("g", "green"), ("b", "blue")):
        out[c] = columns[k].astype(int) if k in columns else None
    return out


def none(v):
    return None if v is None or v != v else v


class _File(InputPartition):
    def __init__(self, frame: int, path: str):
        self.frame, self.path = frame, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[_File]:
        path = self.path.removeprefix("file://")
        if os.path.isfile(path):
            return [_File(0, path)]
        names = sorted(f for f in os.listdir(path) if os.path.splitext(f)[1].lower() in READERS and f.endswith(self.suffix))
        return [_File(i, os.path.join(path, f)) for i, f in enumerate(names)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            table = decoded(partition.path, f.read())
        for r in table.itertuples(index=False):
            yield (partition.frame, int(r.pt_id), float(r.x), float(r.y), float(r.z), none(r.nx), none(r.ny), none(r.nz), *(None if none(c) is None else int(c) for c in (r.r, r.g, r.b)))


class PointCloud(DataSource):
    """``spark.read.format("pointcloud").option("suffix", ".ply").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointCloud)


def read_any_store(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """The same from any store that Spark reads, through its binary files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(folder).select("path", "content")
    names = files.select("path").distinct().withColumn("frame_id", F.expr("cast(row_number() over (order by path) - 1 as int)"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out = decoded(r.path, r.content)
                out.insert(0, "frame_id", r.frame_id)
                yield out

    return files.join(F.broadcast(names), "path").mapInPandas(run, POINTS)


def ply_text(pdf: pd.DataFrame, precision: int = 10) -> str:
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in pdf and pdf[c].notna().all()]
    colours = [c for c in "rgb" if c in pdf and pdf[c].notna().all()]
    head = ["ply", "format ascii 1.0", f"element vertex {len(pdf)}", *[f"property double {c}" for c in names], *[f"property uchar {dict(r='red', g='green', b='blue')[c]}" for c in colours], "end_header"]
    rows = [" ".join([*(f"{v:.{precision}g}" for v in r[: len(names)]), *(str(int(v)) for v in r[len(names) :])]) for r in pdf[[*names, *colours]].itertuples(index=False, name=None)]
    return "\n".join([*head, *rows]) + "\n"


def ply_bytes(pdf: pd.DataFrame) -> bytes:
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in pdf and pdf[c].notna().all()]
    colours = [c for c in "rgb" if c in pdf and pdf[c].notna().all()]
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(pdf)}", *[f"property double {c}" for c in names], *[f"property uchar {dict(r='red', g='green', b='blue')[c]}" for c in colours], "end_header", ""]
    table = np.empty(len(pdf), np.dtype([*[(c, "<f8") for c in names], *[(c, "u1") for c in colours]]))
    for c in (*names, *colours):
        table[c] = pdf[c].to_numpy()
    return "\n".join(head).encode() + table.tobytes()


def obj_text(pdf: pd.DataFrame) -> str:
    return "".join(f"v {x:.10g} {y:.10g} {z:.10g}\n" for x, y, z in pdf[["x", "y", "z"]].itertuples(index=False, name=None))


def off_text(pdf: pd.DataFrame) -> str:
    return f"OFF\n{len(pdf)} 0 0\n" + "".join(f"{x:.10g} {y:.10g} {z:.10g}\n" for x, y, z in pdf[["x", "y", "z"]].itertuples(index=False, name=None))


WRITERS = {"ply": lambda p: ply_text(p).encode(), "ply_binary": ply_bytes, "obj": lambda p: obj_text(p).encode(), "off": lambda p: off_text(p).encode()}


def write_frames(points: DataFrame, folder: str, kind: str = "ply") -> DataFrame:
    """A file per frame, written by the executors to a shared folder: (frame_id, path, points)."""
    encode, suffix = WRITERS[kind], kind.split("_")[0]
    path = folder.removeprefix("file://")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(path, exist_ok=True)
        frame = int(pdf.frame_id.iloc[0])
        target = os.path.join(path, f"frame{frame:05d}.{suffix}")
        with open(f"{target}.{os.getpid()}.part", "wb") as f:
            f.write(encode(pdf.sort_values("pt_id")))
        os.replace(f"{target}.{os.getpid()}.part", target)  # a second attempt writes the same file
        return pd.DataFrame({"frame_id": [frame], "path": [target], "points": [len(pdf)]})

    return points.groupBy("frame_id").applyInPandas(run, "frame_id int, path string, points long")


def read_ascii(spark: SparkSession, path: str) -> DataFrame:
    """A raw matrix of N x 3 or 3 x N numbers: (pos, x, y, z)."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda v: v.cast("double")).alias("v")).where(F.size("v") > 0)
    n = rows.count()
    if n == 3 and rows.agg(F.max(F.size("v"))).first()[0] != 3:
        flat = rows.withColumn("axis", F.expr("row_number() over (order by line)")).select("axis", F.posexplode("v").alias("pos", "c"))  # three rows
        return flat.groupBy("pos").agg(*[F.max(F.when(F.col("axis") == i + 1, F.col("c"))).alias(a) for i, a in enumerate("xyz")])
    return rows.select(F.col("line").alias("pos"), *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")])


def parse_transform(text: str) -> list[tuple]:
    """``#name`` and twelve numbers (three rows of r r r t) each: (name, r00..r22, tx, ty, tz)."""
    out, name, numbers = [], None, []
    for line in [*text.splitlines(), "#"]:
        if line.startswith("#"):
            if name is not None and len(numbers) >= 12:
                m = np.array(numbers[:12]).reshape(3, 4)
                out.append((name, *map(float, m[:, :3].ravel()), *map(float, m[:, 3])))
            name, numbers = line[1:].strip(), []
        else:
            numbers += [float(x) for x in line.split()]
    return out


def read_transform(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).collect()  # a scene's poses: a few lines
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
    return spark.createDataFrame([t for r in rows for t in parse_transform(r["value"])], "name string, " + ", ".join(f"{n} double" for n in names))


class Config(dict):
    """Keys with values after them, ``#`` comments; the last of equal keys wins."""

    @classmethod
    def parse(cls, text: str) -> Config:
        out = cls()
        for line in text.splitlines():
            w = line.split("#", 1)[0].split()
            if w:
                out[w[0]] = " ".join(w[1:])
        return out

    def number(self, key: str, default: float | None = None) -> float:
        return float(self[key]) if key in self else default

    def whole(self, key: str, default: int | None = None) -> int:
        return int(float(self[key])) if key in self else default

    def numbers(self, key: str) -> list[float]:
        return [float(x) for x in self.get(key, "").split()]

    def overlaid(self, other: dict) -> Config:
        return Config({**self, **other})


def over(configs: list[Config], action) -> list:
    """Runs an action for each overlay of a configuration."""
    return [action(c) for c in configs]


def save_labels(points: DataFrame, path: str) -> None:
    points.select("frame_id", "pt_id", "label").write.mode("overwrite").partitionBy("frame_id").parquet(path)


def load_labels(points: DataFrame, path: str) -> DataFrame:
    """Points with saved labels; each frame must have as many labels as points."""
    saved = points.sparkSession.read.parquet(path)
    sizes = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).join(saved.groupBy("frame_id").agg(F.count(F.lit(1)).alias("m")), "frame_id", "full")
    if not sizes.where("n IS NULL OR m IS NULL OR n <> m").isEmpty():
        raise ValueError("labels and points differ in number")
    return points.drop("label").join(saved, ["frame_id", "pt_id"])


def save_graph(nodes: DataFrame, edges: DataFrame, membership: DataFrame, path: str) -> None:
    for name, df in (("supervoxels", nodes), ("edges", edges), ("labels", membership)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges, membership = (spark.read.parquet(f"{path}/{n}") for n in ("supervoxels", "edges", "labels"))
    if nodes.count() != membership.where("sv > 0").select("frame_id", "sv").distinct().count():
        raise ValueError("supervoxels and labels differ in number")
    return nodes, edges, membership


def read_annotation(pixels: DataFrame) -> DataFrame:
    """Colour-coded pixels (prow, pcol, r, g, b) as labels from 0 by first appearance; black is -1."""
    code = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    at = pixels.withColumn("code", code)
    first = at.where("code > 0").groupBy("code").agg(F.min(F.struct("prow", "pcol")).alias("f")).withColumn("label", F.expr("cast(row_number() over (order by f) - 1 as int)"))
    return at.join(F.broadcast(first.select("code", "label")), "code", "left").select("prow", "pcol", F.coalesce("label", F.lit(-1)).alias("label"))
