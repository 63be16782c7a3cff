"""Readers and writers of volumes and relations: Parquet layout by blocks, NumPy arrays, JSON, SWC, images.

Files are read with Spark's own `binaryFile` source and decoded on the executors, and written by Spark; nothing here opens a path on its
own, so any store that Spark reads will do.  Chunked folders are in `arrays`, which opens single chunks.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXES, Triple, floor_div, inside
from .arrays import decode_mrc, load_n5, load_zarr

VOXELS = "z long, y long, x long, value double"


def save_volume(df: DataFrame, path: str, block: Triple, *, mode: str = "overwrite") -> None:
    """Voxels partitioned by block; a second write replaces the partitions that it has (idempotent by block)."""
    out = df.withColumns({f"b{a}": floor_div(a, n) for a, n in zip(AXES, block)})
    out.repartition("bz", "by", "bx").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bz", "by", "bx").parquet(path)


def load_volume(spark: SparkSession, path: str, block: Triple, start: Triple | None = None, stop: Triple | None = None) -> DataFrame:
    """The voxels of a box; the box becomes conditions on block numbers, so only its partitions are read."""
    df = spark.read.parquet(path)
    if start is not None:
        for a, n, s, e in zip(AXES, block, start, stop):
            df = df.filter(F.col(f"b{a}").between(s // n, (e - 1) // n))
        df = df.filter(inside(start, stop))
    return df.drop("bz", "by", "bx")


def volume_info(df: DataFrame, *, dtype: str, voxel_size: Triple, block: Triple, layer_type: str = "image") -> DataFrame:
    """One row of metadata: bounds, dtype, voxel size, block and layer type."""
    bounds = [F.min(a).alias(f"{a}0") for a in AXES] + [(F.max(a) + 1).alias(f"{a}1") for a in AXES]
    fixed = {"dtype": dtype, "layer_type": layer_type} | {f"v{a}": float(v) for a, v in zip(AXES, voxel_size)} | {f"n{a}": v for a, v in zip(AXES, block)}
    return df.agg(*bounds).withColumns({k: F.lit(v) for k, v in fixed.items()})


def layer_type_of(dtype: str, ndim: int, channels: int, in_unit: bool) -> str:
    """The guess for an array without a declared layer type."""
    if dtype == "uint8" and ndim == 3:
        return "image"
    if ndim == 3 and (dtype.startswith(("int", "uint")) or dtype == "bool"):
        return "segmentation"
    if dtype == "float32" and in_unit:
        return "probability_map"
    if dtype == "float32" and ndim == 4 and channels == 3:
        return "affinity_map"
    return "unknown"


def _decoded(files: DataFrame, decode: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content in zip(p["path"], p["content"]):
                yield decode(path, content)

    return files.select("path", "content").mapInPandas(run, schema)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def array_frame(a: np.ndarray, offset: Triple) -> pd.DataFrame:
    a = np.asarray(a)
    a = a[None] if a.ndim == 2 else a
    z, y, x = np.indices(a.shape).reshape(3, -1)
    return pd.DataFrame({"z": z + offset[0], "y": y + offset[1], "x": x + offset[2], "value": a.ravel().astype(float)})


def load_npy(spark: SparkSession, path: str, *, offset: Triple = (0, 0, 0)) -> DataFrame:
    """Voxels of a three-dimensional .npy array."""
    return _decoded(_binary(spark, path), lambda _, c: array_frame(np.load(io.BytesIO(c), allow_pickle=False), offset), VOXELS)


def load_npy_points(spark: SparkSession, path: str, resolution: Triple = (1, 1, 1)) -> DataFrame:
    """Points (point_id, z, y, x) of an N by 3 .npy array, times the resolution; an empty array gives no rows."""

    def decode(_: str, content: bytes) -> pd.DataFrame:
        a = np.load(io.BytesIO(content), allow_pickle=False).reshape(-1, 3) * np.array(resolution)
        return pd.DataFrame({"point_id": np.arange(len(a)), "z": a[:, 0], "y": a[:, 1], "x": a[:, 2]}).astype({"z": float, "y": float, "x": float})

    return _decoded(_binary(spark, path), decode, "point_id long, z double, y double, x double")


def load_npy_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of an N by 6 .npy array (z0, y0, x0, z1, y1, x1)."""

    def decode(_: str, content: bytes) -> pd.DataFrame:
        a = np.load(io.BytesIO(content), allow_pickle=False).reshape(-1, 6)
        return pd.DataFrame({"task_id": np.arange(len(a))} | {n: a[:, i] for i, n in enumerate(("z0", "y0", "x0", "z1", "y1", "x1"))})

    return _decoded(_binary(spark, path), decode, "task_id long, z0 long, y0 long, x0 long, z1 long, y1 long, x1 long")


def load_text_boxes(spark: SparkSession, path: str, order: str = "zyx") -> DataFrame:
    """Boxes of comma-separated lines; lines that begin with # are comments; order zyx or xyz."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", r"\s*,\s*").alias("v"))
    at = {a: i for i, a in enumerate(order)}
    return rows.select(*[F.element_at("v", 1 + at[a]).cast("long").alias(f"{a}0") for a in AXES], *[F.element_at("v", 4 + at[a]).cast("long").alias(f"{a}1") for a in AXES])


def save_npy(df: DataFrame, path: str, block: Triple) -> None:
    """One .npy payload a block, in a Parquet table (bz, by, bx, z0, y0, x0, content)."""
    from ..operators.blocks import BLOCK, dense, with_halo

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, low = dense(part, 0)
        out = io.BytesIO()
        np.save(out, a)
        return pd.DataFrame([(*key, *low, out.getvalue())], columns=[*BLOCK, "z0", "y0", "x0", "content"])

    with_halo(df.select(*AXES, "value"), block, (0, 0, 0)).groupBy(*BLOCK).applyInPandas(run, ", ".join(f"{n} long" for n in (*BLOCK, "z0", "y0", "x0")) + ", content binary").write.mode("overwrite").parquet(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents as rows of text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def load_synapses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """pre and post of JSON documents {"pre": [[z, y, x], ...], "post": [[pre index, z, y, x], ...]}; an empty document gives no rows."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "pre array<array<long>>, post array<array<long>>").alias("d"))
    pre = doc.select(F.posexplode("d.pre").alias("pre_idx", "p")).select(F.col("pre_idx").cast("long"), *[F.element_at("p", i + 1).alias(a) for i, a in enumerate(AXES)])
    post = doc.select(F.posexplode("d.post").alias("post_idx", "p")).select(F.col("post_idx").cast("long"), F.element_at("p", 1).alias("pre_idx"), *[F.element_at("p", i + 2).alias(a) for i, a in enumerate(AXES)])
    return pre, post


def save_synapses(pre: DataFrame, post: DataFrame, path: str) -> None:
    """Two Parquet tables under path."""
    pre.write.mode("overwrite").parquet(f"{path}/pre")
    post.write.mode("overwrite").parquet(f"{path}/post")


def load_swc(spark: SparkSession, path: str) -> DataFrame:
    """Skeleton nodes of SWC files: object_id (of the file's name), node, kind, x, y, z, radius and parent."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f")).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    v = F.split(F.trim("value"), r"\s+")
    names = (("node", "long"), ("kind", "long"), ("x", "double"), ("y", "double"), ("z", "double"), ("radius", "double"), ("parent", "long"))
    return rows.select(F.regexp_extract("f", r"(\d+)", 1).cast("long").alias("object_id"), *[F.element_at(v, i + 1).cast(k).alias(n) for i, (n, k) in enumerate(names)])


def save_swc(nodes: DataFrame, path: str) -> None:
    """One folder an object, lines in order of node."""
    line = F.concat_ws(" ", *[F.col(n).cast("string") for n in ("node", "kind", "x", "y", "z", "radius", "parent")])
    nodes.repartition("object_id").sortWithinPartitions("object_id", "node").select("object_id", line.alias("value")).write.mode("overwrite").partitionBy("object_id").text(path)


# images: eight-bit greyscale PNG without any further library


def decode_png(content: bytes) -> np.ndarray:
    """The grey values (or first channel) of an eight-bit PNG that is not interlaced."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data = 8, b""
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
    if depth != 8 or laced or colour == 3:
        raise ValueError("only eight-bit PNG without palette or interlacing")
    k = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), "u1").reshape(h, 1 + w * k)
    out = np.zeros((h, w * k), "u1")
    above = np.zeros(w * k, int)
    for y in range(h):
        how, line = raw[y, 0], raw[y, 1:].astype(int)
        if how == 1 or how >= 3:
            left, corner = np.zeros(k, int), np.zeros(k, int)
            for x in range(0, w * k, k):
                up = above[x : x + k]
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    d = np.abs(np.stack([p - left, p - up, p - corner]))
                    guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
                line[x : x + k] = (line[x : x + k] + guess) & 255
                left, corner = line[x : x + k], up
        elif how == 2:
            line = (line + above) & 255
        out[y], above = line, line
    return out.reshape(h, w, k)[:, :, 0]


def encode_png(a: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    a = np.asarray(a, "u1")
    raw = np.concatenate([np.zeros((a.shape[0], 1), "u1"), a], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def load_png(spark: SparkSession, path: str, *, offset: Triple = (0, 0, 0)) -> DataFrame:
    """A stack of PNG sections; z is the last number of a file's name."""

    def decode(name: str, content: bytes) -> pd.DataFrame:
        import re

        z = int(re.findall(r"\d+", name.rsplit("/", 1)[-1])[-1])
        return array_frame(decode_png(content), (offset[0] + z, offset[1], offset[2]))

    return _decoded(_binary(spark, path), decode, VOXELS)


def png_sections(df: DataFrame) -> DataFrame:
    """One row a z section: name (five digits) and PNG content; a section is a task's array."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from ..operators.blocks import dense

        a, _ = dense(part, 0)
        return pd.DataFrame({"name": [f"{int(key[0]):05d}.png"], "content": [encode_png(a[0])]})

    return df.select(*AXES, "value").groupBy("z").applyInPandas(run, "name string, content binary")


# formats that need a library of their own

NEEDS = {"h5": "h5py", "tif": "tifffile", "nrrd": "nrrd"}


def load_with_library(spark: SparkSession, path: str, kind: str, *, offset: Triple = (0, 0, 0), dataset: str = "main") -> DataFrame:
    """HDF5, TIFF or NRRD files, where the format's library is installed; ImportError names it otherwise."""
    import importlib

    importlib.import_module(NEEDS[kind])

    def decode(_: str, content: bytes) -> pd.DataFrame:
        lib = importlib.import_module(NEEDS[kind])
        f = io.BytesIO(content)
        if kind == "h5":
            with lib.File(f) as h:
                a = h[dataset][()]
        elif kind == "tif":
            a = lib.imread(f)
        else:
            a = lib.read_data(f, lib.read_header(f)).T
        return array_frame(a, offset)

    return _decoded(_binary(spark, path), decode, VOXELS)


def load_mrc(spark: SparkSession, path: str, *, offset: Triple = (0, 0, 0)) -> DataFrame:
    """Voxels of MRC files."""
    return _decoded(_binary(spark, path), lambda _, c: array_frame(decode_mrc(c), offset), VOXELS)


LOADERS: dict[str, Callable[..., DataFrame]] = {"npy": load_npy, "png": load_png, "json": load_json, "swc": load_swc, "zarr": load_zarr, "n5": load_n5, "mrc": load_mrc} | {k: (lambda s, p, k=k, **o: load_with_library(s, p, k, **o)) for k in NEEDS}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the path's ending; `#k=v;k=v` after it adds options, and a path without a known ending is a Parquet volume."""
    from ..operators.patches import parse_args

    path, _, extra = path.partition("#")
    options = parse_args(extra) | options
    kind = path.rsplit(".", 1)[-1].rstrip("/")
    return LOADERS[kind](spark, path, **options) if kind in LOADERS else load_volume(spark, path, options.pop("block", (64, 64, 64)), **options)


def task_json(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Task files for the streaming source."""
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.mode("append").text(path)
