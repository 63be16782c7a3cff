"""Boxes and coordinates as columns, always in the order z, y, x.

A box is six integer columns: z0, y0, x0 (start) and z1, y1, x1 (stop, not inside).  Every function returns columns or adds them; all are Catalyst
expressions.  Floor division is floor(a / b), so negative offsets go down as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
START = ("z0", "y0", "x0")
STOP = ("z1", "y1", "x1")
Triple = tuple[int, int, int]
#: fixed text form of a box; it may stand anywhere in a name
BOX_PATTERN = r"(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_div(a: str | Column, b: int) -> Column:
    return F.floor(c(a) / F.lit(b)).cast("long")


def ceil_div(a: str | Column, b: int) -> Column:
    return F.ceil(c(a) / F.lit(b)).cast("long")


def parse_box(df: DataFrame, text: str | Column) -> DataFrame:
    """df with the six columns of a box named in text; nulls where there is none."""
    found = [F.regexp_extract(c(text), BOX_PATTERN, i + 1) for i in range(6)]
    names = [n for pair in zip(START, STOP) for n in pair]
    return df.withColumns({n: F.when(f != "", f.cast("long")) for n, f in zip(names, found)})


def format_box() -> Column:
    """z0-z1_y0-y1_x0-x1."""
    return F.concat_ws("_", *[F.concat(F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string")) for a, b in zip(START, STOP)])


def all_less(a: tuple, b: tuple, *, equal: bool = False) -> Column:
    """The partial order of points: true only if every component is below (or equal)."""
    out = F.lit(True)
    for p, q in zip(a, b):
        out &= (c(p) <= c(q)) if equal else (c(p) < c(q))
    return out


def adjust(df: DataFrame, start: Triple, stop: Triple) -> DataFrame:
    """Adds start to the starts and stop to the stops."""
    return df.withColumns({n: F.col(n) + d for n, d in zip(START + STOP, start + stop)})


def union_box(a: str, b: str) -> list[Column]:
    """The smallest box around boxes whose columns begin with the prefixes a and b."""
    return [F.least(f"{a}{n}", f"{b}{n}").alias(n) for n in START] + [F.greatest(f"{a}{n}", f"{b}{n}").alias(n) for n in STOP]


def intersection_box(a: str, b: str) -> list[Column]:
    """The common part, which may be empty (stop not above start)."""
    return [F.greatest(f"{a}{n}", f"{b}{n}").alias(n) for n in START] + [F.least(f"{a}{n}", f"{b}{n}").alias(n) for n in STOP]


def from_centre(centre: Triple, extent: Triple) -> tuple[Triple, Triple]:
    """The box that reaches extent to either side of a voxel."""
    return tuple(a - e for a, e in zip(centre, extent)), tuple(a + e + 1 for a, e in zip(centre, extent))


def aligned(size: Triple) -> Column:
    """Whether a box starts and stops on multiples of size."""
    out = F.lit(True)
    for n, s in zip(START + STOP, size + size):
        out &= F.pmod(F.col(n), F.lit(s)) == 0
    return out


def contains(start: Triple, stop: Triple, point: tuple = AXES) -> Column:
    """Whether a point is in a box, both ends included."""
    out = F.lit(True)
    for p, a, b in zip(point, start, stop):
        out &= c(p).between(a, b)
    return out


def inside(start: Triple, stop: Triple, point: tuple = AXES) -> Column:
    """Whether a voxel is in a half-open box."""
    out = F.lit(True)
    for p, a, b in zip(point, start, stop):
        out &= (c(p) >= a) & (c(p) < b)
    return out


def rescaled(factor: Triple, *, coarser: bool) -> list[Column]:
    """A box in voxels `factor` times as large (starts and stops go down), or as small."""
    return [(floor_div(n, f) if coarser else F.col(n) * f).alias(n) for n, f in zip(START + STOP, factor + factor)]


def decompose(df: DataFrame, size: Triple, *, mode: str) -> DataFrame:
    """One row for each block of a box: its columns with z0 to x1 of the block.

    mode: `full` keeps whole blocks from the start on and drops the rest, `aligned` gives blocks of the grid that
    overlap the box, `clamped` lets the last block end with the box.
    """
    if mode not in ("full", "aligned", "clamped"):
        raise ValueError(f"unknown mode {mode}")
    for a, b, s in zip(START, STOP, size):
        first = floor_div(a, s) * s if mode == "aligned" else F.col(a)
        last = F.col(b) - (s if mode == "full" else 1)
        some = F.when(last >= first, F.sequence(first, last, F.lit(s).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        df = df.withColumn("__first", F.explode(some))
        stop = F.col("__first") + s
        df = df.withColumn(b, F.least(stop, F.col(b)) if mode == "clamped" else stop).withColumn(a, F.col("__first")).drop("__first")
    return df


def left_neighbors(df: DataFrame) -> DataFrame:
    """One row for each axis and box: axis and the box of the same size that ends along it where the box starts."""
    out = df.withColumn("axis", F.explode(F.array(*map(F.lit, AXES))))
    moved = {}
    for a, s, e in zip(AXES, START, STOP):
        here = F.col("axis") == a
        moved |= {s: F.when(here, 2 * F.col(s) - F.col(e)).otherwise(F.col(s)), e: F.when(here, F.col(s)).otherwise(F.col(e))}
    return out.withColumns(moved)


def grid_boxes(spark: SparkSession, start: Triple, stop: Triple, size: Triple, *, overlap: Triple = (0, 0, 0), align: Triple | None = None, bounded: bool = False, respect_stop: bool = False) -> DataFrame:
    """Tasks that cover a region: task_id (z-major), the six columns and bbox.

    align moves start down and stop up to multiples; bounded keeps boxes that end within the region; respect_stop cuts boxes at its end.
    """
    if align:
        start, stop = tuple(a // n * n for a, n in zip(start, align)), tuple(-(-b // n) * n for b, n in zip(stop, align))
    stride = [s - o for s, o in zip(size, overlap)]
    counts = [max(0, -(-(b - a - o) // d)) for a, b, o, d in zip(start, stop, overlap, stride)]
    n = counts[0] * counts[1] * counts[2]
    df = spark.range(n).withColumnRenamed("id", "task_id")
    index = (F.floor(F.col("task_id") / (counts[1] * counts[2] or 1)), F.pmod(F.floor(F.col("task_id") / (counts[2] or 1)), F.lit(counts[1] or 1)), F.pmod("task_id", F.lit(counts[2] or 1)))
    df = df.withColumns({a: (F.lit(s) + i * d).cast("long") for a, s, i, d in zip(START, start, index, stride)})
    df = df.withColumns({b: F.least(F.col(a) + s, F.lit(e)).cast("long") if respect_stop else (F.col(a) + s).cast("long") for a, b, s, e in zip(START, STOP, size, stop)})
    if bounded:
        df = df.filter(all_less(tuple(F.col(b) for b in STOP), tuple(F.lit(e) for e in stop), equal=True))
    return df.withColumn("bbox", format_box())
