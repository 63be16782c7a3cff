"""Chunked array folders (Zarr version 2, N5) and MRC files as voxels; Zarr can be written too.

One row stands for one chunk.  A box becomes a condition on chunk numbers, so chunks outside it aren't opened; a chunk without a file
has the fill value.  Chunks are opened where they are decoded, through Arrow's file systems, and a chunk is what a task holds.
"""

from __future__ import annotations

import gzip
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXES, Triple, floor_div, inside

VOXELS = "z long, y long, x long, value double"
MRC_TYPES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}


@dataclass(frozen=True)
class Layout:
    """A folder's array in z, y, x order; kind is zarr or n5."""

    kind: str
    shape: Triple
    chunks: Triple
    dtype: str
    codec: str = "raw"
    fill: float = 0
    order: str = "C"
    separator: str = "."

    def name(self, at: Triple) -> str:
        return self.separator.join(map(str, at if self.kind == "zarr" else at[::-1]))

    def array(self, content: bytes) -> np.ndarray:
        """A chunk of a file; Zarr chunks are whole, those of N5 state their own size."""
        if self.kind == "n5":
            mode, n = np.frombuffer(content[:4], ">u2").tolist()
            size = np.frombuffer(content[4 : 4 + 4 * n], ">u4").tolist()
            body = content[4 + 4 * n + (4 if mode else 0) :]
            return np.frombuffer(unpacked(body, self.codec), self.dtype)[: math.prod(size)].reshape(size[::-1])
        return np.frombuffer(unpacked(content, self.codec), self.dtype).reshape(self.chunks, order=self.order)


def unpacked(content: bytes, codec: str) -> bytes:
    if codec == "raw":
        return content
    if codec == "gzip":
        return gzip.decompress(content)
    if codec == "zlib":
        return zlib.decompress(content)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    raise ValueError(f"unknown compression {codec}")


def packed(content: bytes, codec: str) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.compress(content)
    if codec not in ("raw", "gzip", "zlib"):
        raise ValueError(f"unknown compression {codec}")
    return {"raw": bytes, "gzip": gzip.compress, "zlib": zlib.compress}[codec](content)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _read(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read()


def layout(path: str, kind: str) -> Layout:
    """The layout that a folder's own metadata states; only three-dimensional arrays."""
    if kind == "zarr":
        m = json.loads(_read(f"{path}/.zarray"))
        if m.get("filters"):
            raise ValueError("Zarr arrays with filters aren't supported")
        fill = float(m["fill_value"] or 0)
        got = Layout("zarr", tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], (m.get("compressor") or {"id": "raw"})["id"], fill, m.get("order", "C"), m.get("dimension_separator", "."))
    else:
        m = json.loads(_read(f"{path}/attributes.json"))
        codec = m.get("compression", m.get("compressionType", "raw"))
        got = Layout("n5", tuple(m["dimensions"][::-1]), tuple(m["blockSize"][::-1]), np.dtype(m["dataType"]).newbyteorder(">").str, codec["type"] if isinstance(codec, dict) else codec, separator="/")
    if len(got.shape) != 3:
        raise ValueError(f"{len(got.shape)} axes, not 3")
    return got


def _voxels(parts: Iterator[pd.DataFrame], path: str, form: Layout, offset: Triple) -> Iterator[pd.DataFrame]:
    store, root = _store(path)
    for part in parts:
        for at in part[["cz", "cy", "cx"]].itertuples(index=False):
            name = f"{root}/{form.name(tuple(at))}"
            first = [i * n for i, n in zip(at, form.chunks)]
            size = [min(n, s - f) for n, s, f in zip(form.chunks, form.shape, first)]
            if store.get_file_info(name).type == fs.FileType.NotFound:
                a = np.full(size, form.fill)
            else:
                with store.open_input_stream(name, compression=None) as f:
                    a = form.array(f.read())[tuple(map(slice, size))]
            z, y, x = np.indices(a.shape).reshape(3, -1)
            yield pd.DataFrame({k: v + f + o for k, v, f, o in zip(AXES, (z, y, x), first, offset)} | {"value": a.ravel().astype(float)})


def load_array(spark: SparkSession, path: str, kind: str, *, offset: Triple = (0, 0, 0), start: Triple | None = None, stop: Triple | None = None) -> DataFrame:
    """Voxels of a Zarr or N5 folder, or of the box from start to stop of it (in the coordinates that offset gives)."""
    form = layout(path, kind)
    n = [-(-s // c) for s, c in zip(form.shape, form.chunks)]
    i = F.col("id")
    cells = spark.range(math.prod(n)).select(F.floor(i / (n[1] * n[2])).alias("cz"), F.pmod(F.floor(i / n[2]), F.lit(n[1])).alias("cy"), F.pmod(i, F.lit(n[2])).alias("cx"))
    if start is None:
        return cells.mapInPandas(partial(_voxels, path=path, form=form, offset=offset), VOXELS)
    for a, c, s, e, o in zip(AXES, form.chunks, start, stop, offset):
        cells = cells.filter(F.col(f"c{a}").between((s - o) // c, (e - 1 - o) // c))
    return cells.mapInPandas(partial(_voxels, path=path, form=form, offset=offset), VOXELS).filter(inside(start, stop))


def load_zarr(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_array(spark, path, "zarr", **options)


def load_n5(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_array(spark, path, "n5", **options)


def _write_chunk(key: tuple, part: pd.DataFrame, path: str, form: Layout) -> pd.DataFrame:
    a = np.full(form.chunks, form.fill).astype(form.dtype)
    a[tuple((part[k] - i * n).to_numpy() for k, i, n in zip(AXES, key, form.chunks))] = part["value"]
    store, root = _store(path)
    name, own = f"{root}/{form.name(key)}", f"{root}/.{form.name(key)}.{np.random.default_rng().integers(2**62)}"
    with store.open_output_stream(own, compression=None) as f:
        f.write(packed(a.tobytes(), form.codec))
    store.move(own, name)  # a chunk appears whole; a task that runs again replaces it by the same bytes
    return pd.DataFrame({"n": [len(part)]})


def save_zarr(df: DataFrame, path: str, shape: Triple, chunks: Triple, *, dtype: str = "<f8", codec: str = "zlib", fill: float = 0) -> int:
    """Writes the voxels from (0, 0, 0) to shape as a Zarr folder, chunk by chunk; returns how many were written.

    The path is one that every executor reaches.  Chunks without voxels get no file and read as the fill value; a second write into
    the same folder replaces the chunks that it has, whole.
    """
    packed(b"", codec)
    form = Layout("zarr", tuple(shape), tuple(chunks), np.dtype(dtype).str, codec, fill)
    store, root = _store(path)
    store.create_dir(root)
    compressor = None if codec == "raw" else {"id": codec, "level": 1}
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": form.dtype, "compressor": compressor, "fill_value": fill, "order": "C", "filters": None}
    with store.open_output_stream(f"{root}/.zarray", compression=None) as f:
        f.write(json.dumps(meta).encode())
    cells = df.filter(inside((0, 0, 0), shape)).select(*AXES, "value", *[floor_div(a, n).alias(f"c{a}") for a, n in zip(AXES, chunks)])
    done = cells.groupBy("cz", "cy", "cx").applyInPandas(partial(_write_chunk, path=path, form=form), "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def decode_mrc(content: bytes) -> np.ndarray:
    """The array of an MRC file of modes 0, 1, 2, 6 and 12."""
    end = ">" if content[212:213] == b"\x11" else "<"
    x, y, z, mode = np.frombuffer(content[:16], f"{end}i4").tolist()
    if mode not in MRC_TYPES:
        raise ValueError(f"MRC mode {mode}")
    extra = int(np.frombuffer(content[92:96], f"{end}i4")[0])
    return np.frombuffer(content, end + MRC_TYPES[mode], x * y * z, 1024 + extra).reshape(z, y, x)
