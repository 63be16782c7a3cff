"""Maps, filters and joins on voxels (z, y, x, value; with channels also c).

All are lazy DataFrame expressions.  Joins are on coordinates; a mask is joined on coarsened coordinates, never upsampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXES, Triple, floor_div, inside

#: fixed largest values of integer types
TOP = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1}


def grid(spark: SparkSession, start: Triple, size: Triple) -> DataFrame:
    """Every voxel of a box."""
    n = size[0] * size[1] * size[2]
    i = F.col("id")
    z, y, x = F.floor(i / (size[1] * size[2])), F.pmod(F.floor(i / size[2]), F.lit(size[1])), F.pmod(i, F.lit(size[2]))
    return spark.range(n).select(*[(v + s).cast("long").alias(a) for v, s, a in zip((z, y, x), start, AXES)])


def create(spark: SparkSession, size: Triple, *, pattern: str = "sin", dtype: str = "uint8", start: Triple = (0, 0, 0), seed: int = 0) -> DataFrame:
    """A synthetic volume.

    pattern `sin` is |sin(4 (u + v + w))| with u, v and w from 0 to 1 along the axes; `zero` and `random` speak for themselves.
    dtype uint8 scales to 0 to 255, other integers give value > 0.5, floats stay.
    """
    df = grid(spark, start, size)
    if pattern == "zero":
        v = F.lit(0.0)
    elif pattern == "random":
        v = F.rand(seed)
    elif pattern == "sin":
        unit = [(F.col(a) - s) / F.lit(float(max(1, n - 1))) for a, s, n in zip(AXES, start, size)]
        v = F.abs(F.sin(4 * (unit[0] + unit[1] + unit[2])))
    else:
        raise ValueError(f"unknown pattern {pattern}")
    if dtype == "uint8":
        v = F.floor(v * 255)
    elif dtype in TOP:
        v = (v > 0.5).cast("long")
    return df.withColumn("value", v)


def fill_dense(df: DataFrame, spark: SparkSession, start: Triple, size: Triple, fill: float = 0) -> DataFrame:
    """df on every voxel of the box; missing ones get fill."""
    return grid(spark, start, size).join(df, list(AXES), "left").withColumn("value", F.coalesce("value", F.lit(fill)))


# maps


def threshold(value: Column, t: float) -> Column:
    """1 above t, else 0."""
    return (value > t).cast("long")


def normalize_intensity(value: Column) -> Column:
    """0 to 255 becomes -1 to 1."""
    return value / 127.5 - 1


def inverse(value: Column, dtype: str = "uint8") -> Column:
    return F.lit(TOP[dtype] if dtype in TOP else 1) - value


def map_to_01(value: Column, dtype: str = "uint8") -> Column:
    """uint8 by 255; values from -1 to 1 by (v + 1) / 2."""
    return value / 255 if dtype == "uint8" else (value + 1) / 2


def stretch(value: Column, low: float, high: float) -> Column:
    """low to high becomes 0 to 255, whole numbers, clipped."""
    return F.floor(F.least(F.greatest((value - low) / F.lit(float(high - low)), F.lit(0.0)), F.lit(1.0)) * 255)


def rescale(value: Column, low: float, high: float, to: tuple[float, float] = (0.0, 255.0)) -> Column:
    """low to high becomes `to`, unclipped beyond the ends' own clipping of the input."""
    v = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return (v - low) / F.lit(float(high - low)) * (to[1] - to[0]) + to[0]


def window_level(value: Column, half_window: float, level: float) -> Column:
    """level - half_window becomes 0 and level + half_window 1."""
    return (value - (level - half_window)) / F.lit(2.0 * half_window)


def adjust_gamma(value: Column, gamma: float) -> Column:
    """Values clipped to 0 to 1, to the power gamma."""
    return F.pow(F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(float(gamma)))


def astype(value: Column, dtype: str) -> Column:
    """Whole numbers by truncation for integer types; float for 32 bits and double for 64."""
    return {"float32": value.cast("float"), "float64": value.cast("double")}.get(dtype, F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long"))


def saved(value: Column, stored: str, wanted: str) -> Column:
    """The conversion of a write: uint8 to float by 255, float to uint8 by 255 with truncation."""
    if stored == "uint8" and wanted.startswith("float"):
        return value / 255
    if stored.startswith("float") and wanted == "uint8":
        return F.floor(value * 255)
    return astype(value, wanted)


def mapped(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("value", value)


def transpose(df: DataFrame) -> DataFrame:
    """All axes reversed."""
    return df.select(F.col("x").alias("z"), "y", F.col("z").alias("x"), *[k for k in df.columns if k not in AXES])


def multiply(df: DataFrame, by: DataFrame) -> DataFrame:
    """Voxel by voxel product with by (z, y, x, value)."""
    m = by.select(*AXES, F.col("value").alias("__by"))
    return df.join(m, list(AXES)).withColumn("value", F.col("value") * F.col("__by")).drop("__by")


def quantize_affinity(df: DataFrame, *, use: str = "xy") -> DataFrame:
    """Of channels x, y, z the mean of the first two, or the last (use `z`), as 0 to 255."""
    channel = F.col("c")
    if use == "z":
        return df.filter(channel == 2).select(*AXES, F.floor(F.col("value") * 255).alias("value"))
    return df.filter(channel < 2).groupBy(*AXES).agg(F.floor(F.sum("value") / 2 * 255).alias("value"))


# filters


def cutout(df: DataFrame, start: Triple, stop: Triple) -> DataFrame:
    return df.filter(inside(start, stop))


def blackout(df: DataFrame, sections: list[int]) -> DataFrame:
    """Listed z sections as zeros."""
    return df.withColumn("value", F.when(F.col("z").isin(sections), F.lit(0)).otherwise(F.col("value"))) if sections else df


def crop_margin(df: DataFrame, box: tuple[Triple, Triple], margin: Triple | tuple[int, ...]) -> DataFrame:
    """df without margin (three values for both sides, or three low and three high ones) of its box."""
    low, high = (margin, margin) if len(margin) == 3 else (margin[:3], margin[3:])
    return cutout(df, tuple(a + m for a, m in zip(box[0], low)), tuple(b - m for b, m in zip(box[1], high)))


def where(df: DataFrame) -> DataFrame:
    """Coordinates of voxels that are not zero."""
    return df.filter(F.col("value") != 0).select(*AXES)


def not_all_zero(df: DataFrame, task: list[str]) -> DataFrame:
    """Tasks that have a voxel other than zero."""
    return df.groupBy(*task).agg(F.max((F.col("value") != 0).cast("int")).alias("__some")).filter("__some = 1").select(*task)


def mask_out_objects(df: DataFrame, *, dust: int = 0, keep: list[int] | None = None) -> DataFrame:
    """Labels with at most dust voxels, and labels not in keep, become 0."""
    sizes = df.filter(F.col("value") != 0).groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dust)
    if keep is not None:
        sizes = sizes.filter(F.col("value").isin(keep))
    large = sizes.select(F.col("value").alias("__label"))
    return df.join(large, F.col("value") == F.col("__label"), "left").withColumn("value", F.when(F.col("__label").isNotNull(), F.col("value")).otherwise(F.lit(0))).drop("__label")


# joins


def mask(df: DataFrame, by: DataFrame, factor: Triple, *, inverse: bool = False) -> DataFrame:
    """Values where the mask (z, y, x, value in voxels factor times as large) is not 0 (inverse: is 0); others become 0.

    The join is on floor(coordinate / factor); voxels outside the mask count as masked by 0.
    """
    on = by.select(*[F.col(a).alias(f"__{a}") for a in AXES], (F.col("value") != 0).alias("__on"))
    cond = F.lit(True)
    for a, f in zip(AXES, factor):
        cond &= floor_div(a, f) == F.col(f"__{a}")
    stays = F.coalesce(F.col("__on"), F.lit(False))
    stays = ~stays if inverse else stays
    out = df.join(on, cond, "left").withColumn("value", F.when(stays, F.col("value")).otherwise(F.lit(0)))
    return out.select(*df.columns)


def candidate_blocks(by: DataFrame, factor: Triple, block: Triple) -> DataFrame:
    """bz, by, bx of fine blocks that have a mask voxel other than zero."""
    out = by.filter(F.col("value") != 0)
    for a, f, n in zip(AXES, factor, block):
        low, high = floor_div(F.col(a) * f, n), floor_div(F.col(a) * f + f - 1, n)
        out = out.withColumn(f"b{a}", F.explode(F.sequence(low, high)))
    return out.select("bz", "by", "bx").distinct()


def blend(parts: DataFrame) -> DataFrame:
    """Overlapping parts added up."""
    return parts.groupBy(*[k for k in parts.columns if k != "value"]).agg(F.sum("value").alias("value"))


def save_into(df: DataFrame, part: DataFrame) -> DataFrame:
    """df with the voxels of part in place of its own."""
    p = part.select(*AXES, F.col("value").alias("__new"))
    return df.join(p, list(AXES), "left").withColumn("value", F.coalesce("__new", "value")).drop("__new")


def points_in_objects(points: DataFrame, labels: DataFrame) -> DataFrame:
    """points (z, y, x, ...) with the label of their voxel (null outside)."""
    return points.join(labels.select(*AXES, F.col("value").alias("label")), list(AXES), "left")
