"""Kernels on blocks: neighbourhood filters, connected components, peaks, hole filling and validation.

A volume of voxels is dealt into blocks with a halo (`with_halo`), each block is a dense array in one task, and what a kernel
computes in the block's own part comes back as voxels.  Blocks bound a task's memory whatever the volume's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, Triple, floor_div

BLOCK = ("bz", "by", "bx")
VOXELS = "z long, y long, x long, value double"


def with_halo(df: DataFrame, block: Triple, halo: Triple) -> DataFrame:
    """df with bz, by, bx; a voxel within halo of a further block appears there too."""
    for a, b, n, h in zip(AXES, BLOCK, block, halo):
        df = df.withColumn(b, F.explode(F.sequence(floor_div(F.col(a) - h, n), floor_div(F.col(a) + h, n))) if h else floor_div(a, n))
    return df


def dense(part: pd.DataFrame, fill: float = np.nan) -> tuple[np.ndarray, np.ndarray]:
    """The array of a block's voxels and the coordinates of its first corner."""
    at = part[list(AXES)].to_numpy()
    low = at.min(axis=0)
    out = np.full(at.max(axis=0) - low + 1, float(fill))
    out[tuple((at - low).T)] = part["value"].to_numpy(float)
    return out, low


def sparse(values: np.ndarray, low: np.ndarray, keep: np.ndarray) -> pd.DataFrame:
    z, y, x = np.nonzero(keep)
    return pd.DataFrame({"z": z + low[0], "y": y + low[1], "x": x + low[2], "value": values[keep].astype(float)})


def own_part(shape: tuple, low: np.ndarray, key: tuple, block: Triple) -> np.ndarray:
    inside = [(np.arange(s) + o) // n == k for s, o, n, k in zip(shape, low, block, key)]
    return inside[0][:, None, None] & inside[1][None, :, None] & inside[2][None, None]


def stencil(df: DataFrame, block: Triple, halo: Triple, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel(array) on each block with its halo; the volume must be dense."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, low = dense(part)
        return sparse(kernel(a), low, own_part(a.shape, low, key, block) & ~np.isnan(a))

    return with_halo(df.select(*AXES, "value"), block, halo).groupBy(*BLOCK).applyInPandas(run, VOXELS)


def dilated(df: DataFrame, block: Triple, margin: int) -> DataFrame:
    """The largest value within `margin` steps along the axes of each voxel; the volume must be dense."""

    def kernel(a: np.ndarray) -> np.ndarray:
        for _ in range(margin):
            grown = a.copy()
            for axis in range(3):
                here, there = np.moveaxis(grown, axis, 0), np.moveaxis(a, axis, 0)
                np.fmax(here[1:], there[:-1], out=here[1:])
                np.fmax(here[:-1], there[1:], out=here[:-1])
            a = grown
        return a

    return stencil(df, block, (margin,) * 3, kernel)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def convolved(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Along one axis, mirrored at the ends with the edge repeated."""
    r = len(weights) // 2
    pad = [(r, r) if i == axis else (0, 0) for i in range(a.ndim)]
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, "symmetric"), len(weights), axis) @ weights


def gaussian_filter(df: DataFrame, sigma: float) -> DataFrame:
    """Each z section filtered in y and x; a section is a block, so its edges are the volume's."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a, low = dense(part)
        w = gaussian_weights(sigma)
        return sparse(convolved(convolved(a, w, 1), w, 2), low, ~np.isnan(a))

    return df.select(*AXES, "value").groupBy("z").applyInPandas(run, VOXELS)


def median_z(df: DataFrame) -> DataFrame:
    """Median of three voxels in z, the edge repeated: windows of lines along z, no Python."""
    w = W.partitionBy("y", "x").orderBy("z")
    v = F.col("value")
    a, b = F.coalesce(F.lag(v).over(w), v), F.coalesce(F.lead(v).over(w), v)
    return df.withColumn("value", F.greatest(F.least(a, b), F.least(F.greatest(a, b), v)))


def median_filter(df: DataFrame, size: Triple, block: Triple) -> DataFrame:
    """Median of an odd-sized neighbourhood, mirrored at the volume's edges."""
    r = tuple(s // 2 for s in size)

    def kernel(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, [(k, k) for k in r], "symmetric")
        return np.median(np.lib.stride_tricks.sliding_window_view(p, size).reshape(*a.shape, -1), axis=3)

    return stencil(df, block, r, kernel)


# connected components

STEPS = {6: 1, 18: 2, 26: 3}


def offsets(connectivity: int) -> list[Triple]:
    """Half of the neighbours: those after a voxel in z, y, x order."""
    most = STEPS[connectivity]
    return [(z, y, x) for z in (0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0) and abs(z) + abs(y) + abs(x) <= most]


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' class under pairs."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        np.minimum.at(label, label[pairs[:, 0]], low)
        np.minimum.at(label, label[pairs[:, 1]], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def connected_components(df: DataFrame, extent: Triple, block: Triple, connectivity: int = 6) -> DataFrame:
    """value: 1 + place (z-major in the box from 0 to extent) of the first voxel of its component of equal values; 0 stays 0.

    Blocks are labelled on their own, neighbours across blocks give links between their labels, links are contracted by
    smallest labels with pointer jumping until nothing changes, and the labels are joined back.  No step holds more than a block.
    """
    sizes = (extent[1] * extent[2], extent[2], 1)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["value"] != 0].reset_index(drop=True)
        at = part[list(AXES)].to_numpy()
        place = at @ np.array(sizes)
        order = np.argsort(place)
        at, place, value = at[order], place[order], part["value"].to_numpy()[order]
        pairs = []
        for o in offsets(connectivity):
            to = at + np.array(o)
            there = to @ np.array(sizes)
            j = np.minimum(np.searchsorted(place, there), max(0, len(place) - 1))
            ok = ((to >= 0) & (to < np.array(extent))).all(axis=1) & (place[j] == there) & (value[j] == value) if len(place) else np.zeros(0, bool)
            pairs.append(np.stack([np.flatnonzero(ok), j[ok]], axis=1))
        label = roots(len(place), np.concatenate(pairs)) if len(place) else np.zeros(0, int)
        return pd.DataFrame({"z": at[:, 0], "y": at[:, 1], "x": at[:, 2], "value": value, "label": place[label] + 1})

    kind = dict(df.dtypes)["value"]
    own = with_halo(df.select(*AXES, "value"), block, (0, 0, 0)).groupBy(*BLOCK).applyInPandas(local, f"z long, y long, x long, value {kind}, label long")
    own = _kept(own)
    # voxels next to another block
    faces = own.filter(reduce(lambda p, q: p | q, [F.pmod(a, F.lit(n)).isin(0, n - 1) for a, n in zip(AXES, block)]))
    near = faces.select(*AXES, "value", "label", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(o, "ijk")]) for o in offsets(connectivity)])).alias("o"))
    near = near.select((F.col("z") + F.col("o.i")).alias("z"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("x") + F.col("o.k")).alias("x"), "value", F.col("label").alias("other"))
    links = _kept(near.join(faces, [*AXES, "value"]).filter("label <> other").select(F.col("label").alias("u"), F.col("other").alias("v")).distinct())
    labels = contracted(links)
    out = own.join(labels, own["label"] == labels["id"], "left").select(*AXES, F.coalesce("comp", "label").alias("label"))
    return df.select(*AXES).join(out, list(AXES), "left").select(*AXES, F.coalesce("label", F.lit(0)).alias("value"))


def _shared(context) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, for a local master only, whose driver is its only executor."""
    found = context.getConf().get("spark.checkpoint.dir")
    if not found and re.fullmatch(r"local(\[.*\])?", context.master):
        found = f"file://{tempfile.mkdtemp(prefix='volume-')}"
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found


def _kept(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder spark.checkpoint.dir names, which all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_shared(context))
    return df.checkpoint()


def contracted(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that links (u, v) connect each id with."""
    both = _kept(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = _kept(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    while True:
        told = both.join(labels, both["u"] == labels["id"]).select(F.col("v").alias("id"), "comp", F.lit(None).cast("long").alias("own"))
        told = told.unionByName(labels.select("id", "comp", F.col("comp").alias("own"))).groupBy("id").agg(F.min("comp").alias("comp"), F.min("own").alias("own"))
        step = labels.select(F.col("id").alias("r"), F.col("comp").alias("c"))
        new = _kept(told.join(step, told["comp"] == step["r"], "left").select("id", F.least("comp", "c").alias("comp"), "own"))
        labels = new.select("id", "comp")
        if new.filter("comp <> own").isEmpty():
            return labels


def fill_holes(df: DataFrame, extent: Triple, block: Triple) -> DataFrame:
    """Background that touches no face of the box takes the least label next to its component."""
    back = connected_components(df.withColumn("value", (F.col("value") == 0).cast("long")), extent, block).filter("value <> 0").withColumnRenamed("value", "part")
    rim = reduce(lambda p, q: p | q, [(F.col(a) == 0) | (F.col(a) == n - 1) for a, n in zip(AXES, extent)])
    open_ = back.filter(rim).select(F.col("part").alias("o")).distinct()
    holes = back.join(open_, back["part"] == F.col("o"), "left_anti")
    around = None
    for a in AXES:
        for s in (-1, 1):
            moved = holes.withColumn(a, F.col(a) + s)
            around = moved if around is None else around.unionByName(moved)
    filled = around.join(df.filter("value <> 0"), list(AXES)).groupBy("part").agg(F.min("value").alias("fill"))
    own = holes.join(filled, "part").select(*AXES, "fill")
    return df.join(own, list(AXES), "left").select(*AXES, F.coalesce("fill", "value").alias("value"))


def detect_points(df: DataFrame, extent: Triple, block: Triple, *, min_distance: int = 1, threshold: float = 0.0, num_peaks: int | None = None) -> DataFrame:
    """Local maxima (z, y, x, value): values less their mean, clipped at 0 and divided by the largest; a peak is the largest of its neighbourhood and above threshold, and not within min_distance of the box's faces.

    With num_peaks the strongest ones (ties in z, y, x order).
    """
    mean = df.agg(F.avg("value").alias("m"))
    level = df.crossJoin(F.broadcast(mean)).select(*AXES, F.greatest(F.col("value") - F.col("m"), F.lit(0.0)).alias("value"))  # one row is broadcast
    top = level.agg(F.max("value").alias("t"))
    level = level.crossJoin(F.broadcast(top)).select(*AXES, F.when(F.col("t") > 0, F.col("value") / F.col("t")).otherwise(0.0).alias("value"))
    d = min_distance

    def kernel(a: np.ndarray) -> np.ndarray:
        out = np.where(np.isnan(a), -np.inf, a)
        for axis in range(3):
            pad = [(d, d) if i == axis else (0, 0) for i in range(3)]
            out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, constant_values=-np.inf), 2 * d + 1, axis).max(axis=3)
        return np.where((a == out) & (a > threshold), a, 0.0)

    peaks = stencil(level, block, (d, d, d), kernel).filter("value > 0")
    inner = reduce(lambda p, q: p & q, [F.col(a).between(d, n - 1 - d) for a, n in zip(AXES, extent)])
    peaks = peaks.filter(inner)
    return peaks.orderBy(F.desc("value"), *AXES).limit(num_peaks) if num_peaks else peaks


# validation

SPAN = (2, 7, 7)


def templates() -> list[np.ndarray]:
    """Six steps from bright to dark: along each axis in both directions."""
    out = []
    for axis in range(3):
        t = np.zeros(SPAN)
        half = [slice(None)] * 3
        half[axis] = slice(0, SPAN[axis] // 2)
        t[tuple(half)] = 1.0
        out += [t, t[tuple(slice(None, None, -1) if i == axis else slice(None) for i in range(3))]]
    return out


def correlation(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Normalised cross correlation of t at each place where it fits; 0 where the volume is flat."""
    w = np.lib.stride_tricks.sliding_window_view(a.astype(float), t.shape).reshape(*(s - k + 1 for s, k in zip(a.shape, t.shape)), -1)
    t = t.ravel() - t.mean()
    centred = w - w.mean(axis=3, keepdims=True)
    norm = np.sqrt((centred**2).sum(axis=3)) * np.sqrt((t**2).sum())
    return np.where(norm > 1e-9, centred @ t / np.where(norm > 1e-9, norm, 1), 0.0)


def validate(df: DataFrame, block: Triple, *, least: float = 0.9, sites: int = 100, most: int = 4) -> DataFrame:
    """One row, valid: false if more than `most` of six box-face templates correlate above `least` at more than `sites` places, which a black box in an image does."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, low = dense(part)
        first = [k * n - o for k, n, o in zip(key, block, low)]
        counts = []
        for i, t in enumerate(templates()):
            if all(s >= k for s, k in zip(a.shape, t.shape)):
                hit = correlation(np.nan_to_num(a), t) > least
                hit = hit[tuple(slice(max(0, f), f + n) for f, n in zip(first, block))]  # each place in one block
                counts.append((i, int(hit.sum())))
        return pd.DataFrame(counts, columns=["template", "n"])

    # a block needs the voxels after it that a template reaches
    wide = df.select(*AXES, "value")
    for a, b, n, s in zip(AXES, BLOCK, block, SPAN):
        wide = wide.withColumn(b, F.explode(F.sequence(floor_div(F.col(a) - s + 1, n), floor_div(a, n))))
    hits = wide.groupBy(*BLOCK).applyInPandas(run, "template int, n long").groupBy("template").agg(F.sum("n").alias("n"))
    return hits.agg((F.coalesce(F.sum((F.col("n") > sites).cast("int")), F.lit(0)) <= most).alias("valid"))


# block payloads


def to_blocks(df: DataFrame, block: Triple, dtype: str = "float64") -> DataFrame:
    """One row a block: bz, by, bx, first corner, shape and payload (little-endian, z-major)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, low = dense(part, 0)
        return pd.DataFrame([(*key, *low, *a.shape, np.ascontiguousarray(a.astype(np.dtype(dtype).newbyteorder("<"))).tobytes())], columns=[*BLOCK, "z0", "y0", "x0", "nz", "ny", "nx", "payload"])

    schema = ", ".join(f"{n} long" for n in (*BLOCK, "z0", "y0", "x0", "nz", "ny", "nx")) + ", payload binary"
    return with_halo(df.select(*AXES, "value"), block, (0, 0, 0)).groupBy(*BLOCK).applyInPandas(run, schema)


def to_voxels(blocks: DataFrame, dtype: str = "float64") -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                a = np.frombuffer(r.payload, np.dtype(dtype).newbyteorder("<")).reshape(r.nz, r.ny, r.nx)
                yield sparse(a, np.array([r.z0, r.y0, r.x0]), np.ones(a.shape, bool))

    return blocks.mapInPandas(run, VOXELS)
