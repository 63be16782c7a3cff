"""Patch-wise inference and plug-ins: overlapping patches through a model, blended with weights.

Patches are made by exploding voxels to the patches that hold them; a patch is one task's array; the blend is a grouped
sum of weight times value over the sum of weights, which Spark aggregates partially before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, Triple

#: name to a function from an array (z, y, x) to an array (c, z, y, x)
MODELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"identity": lambda a: a[None]}
#: name to a function from a DataFrame and keyword arguments to a DataFrame
PLUGINS: dict[str, Callable[..., DataFrame]] = {}


def register_model(name: str, f: Callable[[np.ndarray], np.ndarray]) -> None:
    MODELS[name] = f


def register_plugin(name: str, f: Callable[..., DataFrame]) -> None:
    PLUGINS[name] = f


def plugin(df: DataFrame, name: str, args: str = "") -> DataFrame:
    """Runs a registered plug-in; args is `k=v;k=v`, numbers as numbers."""
    return PLUGINS[name](df, **parse_args(args))


def parse_args(args: str) -> dict:
    out = {}
    for pair in filter(None, args.split(";")):
        k, _, v = pair.partition("=")
        try:
            out[k] = int(v)
        except ValueError:
            try:
                out[k] = float(v)
            except ValueError:
                out[k] = v
    return out


def starts(n: int, patch: int, overlap: int) -> list[int]:
    """Patch starts along an axis of n; the last patch is moved inward so that it ends with the axis."""
    if n <= patch:
        return [0]
    out = list(range(0, n - patch, patch - overlap))
    return [*out, n - patch]


def bump(patch: Triple) -> np.ndarray:
    """Weights that fall from the centre to the edges: exp of the sum of -1 / (1 - t^2), brought to 1 to 1e6."""
    axes = [(np.arange(n) + 1) / (n + 1) * 2 - 1 for n in patch]
    one = [-1 / (1 - t * t) for t in axes]
    w = np.exp(one[0][:, None, None] + one[1][None, :, None] + one[2][None, None])
    low, high = w.min(), w.max()
    return np.ones(patch) if high == low else 1 + (w - low) / (high - low) * (1e6 - 1)


def augmented(model: Callable[[np.ndarray], np.ndarray], a: np.ndarray) -> np.ndarray:
    """Mean over eight variants: y and x swapped or not, each mirrored or not."""
    out = []
    for swap in (False, True):
        for fy in (False, True):
            for fx in (False, True):
                v = a.swapaxes(1, 2) if swap else a
                v = v[:, ::-1] if fy else v
                v = v[:, :, ::-1] if fx else v
                r = model(np.ascontiguousarray(v))
                r = r[:, :, :, ::-1] if fx else r
                r = r[:, :, ::-1] if fy else r
                out.append(r.swapaxes(2, 3) if swap else r)
    return np.mean(out, axis=0)


def _holds(axis: str, patch: int) -> Callable:
    return lambda start: (start <= F.col(axis)) & (F.col(axis) < start + patch)


def infer(df: DataFrame, extent: Triple, patch: Triple, overlap: Triple, *, model: str = "identity", dtype: str = "float", augment: bool = False) -> DataFrame:
    """c, z, y, x and value of a model over a dense volume from 0 to extent; uint8 input is divided by 255.

    Patches without a voxel other than zero are not run: their output is zero.
    """
    f = MODELS[model]
    at = [starts(n, p, o) for n, p, o in zip(extent, patch, overlap)]
    value = F.col("value") / 255 if dtype == "uint8" else F.col("value").cast("double")
    df = df.select(*AXES, value.alias("value"))
    for a, s, p in zip(AXES, at, patch):
        # the patches of a coordinate are few: a fixed list of starts an axis
        all_ = F.array(*[F.lit(v).cast("long") for v in s])
        df = df.withColumn(f"p{a}", F.explode(F.filter(all_, _holds(a, p))))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        size = tuple(min(p, n) for p, n in zip(patch, extent))
        a = np.zeros(size)
        i = part[list(AXES)].to_numpy() - np.array(key)
        a[tuple(i.T)] = part["value"].to_numpy()
        w = bump(size)
        out = (augmented(f, a) if augment else f(a)) if a.any() else np.zeros((1, *size))
        c, z, y, x = np.indices(out.shape).reshape(4, -1)
        return pd.DataFrame({"c": c, "z": z + key[0], "y": y + key[1], "x": x + key[2], "wv": (out * w).ravel(), "w": np.broadcast_to(w, out.shape).ravel()})

    made = df.groupBy("pz", "py", "px").applyInPandas(run, "c long, z long, y long, x long, wv double, w double")
    return made.groupBy("c", *AXES).agg((F.sum("wv") / F.sum("w")).alias("value"))
