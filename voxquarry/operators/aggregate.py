"""Aggregations over voxels: downsampling, voting, label statistics, contrast.  Partial aggregation runs before every shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import AXES, Triple, floor_div


def _cells(factor: Triple) -> list[Column]:
    return [floor_div(a, f).alias(a) for a, f in zip(AXES, factor)]


def nonzero(x: Column) -> Column:
    """Null in place of 0, so that a division gives null."""
    return F.nullif(x, F.lit(0))


def downsample(df: DataFrame, factor: Triple, method: str = "average") -> DataFrame:
    """Cells of factor voxels: their average, max, first voxel (`stride`) or most frequent value (`mode`, ties to the smaller).

    Edge cells count the voxels that they have.
    """
    if method == "stride":
        first = F.lit(True)
        for a, f in zip(AXES, factor):
            first &= F.pmod(F.col(a), F.lit(f)) == 0
        return df.filter(first).select(*_cells(factor), "value")
    if method == "mode":
        counts = df.groupBy(*_cells(factor), "value").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*AXES).agg(F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("m")).select(*AXES, (-F.col("m.v")).alias("value"))
    agg = {"average": F.avg, "max": F.max}[method]
    return df.groupBy(*_cells(factor)).agg(agg("value").alias("value"))


def method_for(layer_type: str) -> str:
    """The method that suits a layer."""
    return {"image": "average", "segmentation": "mode", "probability_map": "max", "affinity_map": "average"}.get(layer_type, "stride")


def _quads(df: DataFrame) -> DataFrame:
    """z, y, x of 2 x 2 cells in y and x, and their samples a, b, c, d in order (y, x); missing samples count as 0."""
    at = F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))
    own = [F.coalesce(F.max(F.when(at == i, F.col("value"))), F.lit(0)) for i in range(4)]
    return df.groupBy("z", floor_div("y", 2).alias("y"), floor_div("x", 2).alias("x")).agg(*[o.alias(n) for o, n in zip(own, "abcd")])


def countless(df: DataFrame) -> DataFrame:
    """2 x 2 cells in y and x of labels by pairs: of samples a, b, c, d in order (y, x), a if a = b or a = c, b if b = c, else d."""
    a, b, third, d = (F.col(n) for n in "abcd")
    return _quads(df).select("z", "y", "x", F.when((a == b) | (a == third), a).when(b == third, b).otherwise(d).alias("value"))


def stippled(df: DataFrame) -> DataFrame:
    """As `countless`, but 0 is background: where it would give 0, the first label that isn't 0 of d, a, b, c, so lone voxels stay."""
    a, b, third, d = (F.col(n) for n in "abcd")
    pair = F.when((a == b) | (a == third), a).when(b == third, b)
    value = F.coalesce(*[nonzero(v) for v in (pair, d, a, b, third)], F.lit(0))
    return _quads(df).select("z", "y", "x", value.alias("value"))


def countless_3d(df: DataFrame, levels: int = 1) -> DataFrame:
    """2 x 2 x 2 cells of labels, `levels` times: a label of four samples or more, else one of three, else one of two
    among the first seven (in order z, y, x), else the last sample.  Ties go to the label that comes first.

    Sides should be even at each level; cells that lack voxels take the samples that they have, and the earliest where no rule holds.
    """
    for _ in range(levels):
        at = F.pmod("z", F.lit(2)) * 4 + F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))
        counts = df.groupBy(*_cells((2, 2, 2)), "value").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"), F.max(at).alias("last"))
        pair = (F.col("n") - (F.col("last") == 7).cast("int")) >= 2
        rank = F.when(F.col("n") >= 3, F.least("n", F.lit(4))).when(pair, 2).when(F.col("last") == 7, 1).otherwise(0)
        best = F.max_by("value", F.struct(rank.alias("rank"), (-F.col("at")).alias("first")))
        df = counts.groupBy(*AXES).agg(best.alias("value"))
    return df


def pyramid(df: DataFrame, factor: Triple, levels: int, method: str = "average") -> list[DataFrame]:
    """df at level 0 and each further level from the one before."""
    out = [df]
    for _ in range(levels):
        out.append(downsample(out[-1], factor, method))
    return out


def scales(size: Triple, voxel: tuple[float, float, float], levels: int) -> list[Triple]:
    """Factors from level to level that bring voxels nearer to cubes: axes within twice the smallest voxel edge are halved."""
    out = []
    for _ in range(levels):
        low = min(voxel)
        f = tuple(2 if v < 2 * low and n > 1 else 1 for v, n in zip(voxel, size))
        size, voxel = tuple(-(-n // k) for n, k in zip(size, f)), tuple(v * k for v, k in zip(voxel, f))
        out.append(f)
    return out


def channel_voting(df: DataFrame) -> DataFrame:
    """The strongest channel of each voxel, counted from 1; ties to the first."""
    best = df.groupBy(*AXES).agg(F.max(F.struct("value", (-F.col("c")).alias("c"))).alias("m"))
    return best.select(*AXES, (1 - F.col("m.c")).cast("long").alias("value"))


def mask_using_last_channel(df: DataFrame, t: float) -> DataFrame:
    """Other channels, kept where the last one is below t and else 0."""
    last = df.groupBy(*AXES).agg(F.max(F.struct("c", "value")).alias("m")).select(*AXES, F.col("m.c").alias("__c"), F.col("m.value").alias("__last"))
    out = df.join(last, list(AXES)).filter(F.col("c") < F.col("__c"))
    return out.select("c", *AXES, F.when(F.col("__last") < t, F.col("value")).otherwise(F.lit(0.0)).alias("value"))


def label_sizes(df: DataFrame) -> DataFrame:
    """value and number of voxels of each label but 0."""
    return df.filter(F.col("value") != 0).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.count_distinct("value").alias("n_values"), F.sum((F.col("value") != 0).cast("long")).alias("n_nonzero"))


def ranked_labels(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Labels by size from start to stop (rank from 0, ties to the smaller label); the smallest label is background and takes no part."""
    sizes = df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    low = sizes.agg(F.min("value").alias("low"))
    top = sizes.join(F.broadcast(low), F.col("value") > F.col("low")).orderBy(F.desc("n"), "value").limit(stop)  # one row is broadcast
    rank = F.row_number().over(W.orderBy(F.desc("n"), "value")) - 1
    return top.select("value", "n", rank.cast("long").alias("rank")).filter(F.col("rank") >= start)


def histogram(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def normalize_contrast(df: DataFrame, *, lower: float = 0.01, upper: float = 0.01, minval: int = 1, maxval: int = 255, per_section: bool = True) -> DataFrame:
    """uint8 values stretched between two points of the histogram without bin 0, by section or as a whole.

    The low point is the last value before the cumulative share exceeds lower, the high one the last before it exceeds 1 - upper; if they are equal nothing changes.
    Only histograms (256 rows a section) meet in a window.
    """
    groups = ["z"] if per_section else []
    by = groups or [F.lit(0).alias("g")]
    counts = histogram(df, groups).withColumn("n", F.when(F.col("value") == 0, 0).otherwise(F.col("n")))
    bins = F.explode(F.sequence(F.lit(0), F.lit(255))).alias("value")
    dense = (counts.select(*groups).distinct() if groups else df.sparkSession.range(1)).select(*groups, bins)
    dense = dense.join(counts, [*groups, "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy(*by)
    share = F.sum("n").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0)) / nonzero(F.sum("n").over(w))
    curve = dense.withColumn("share", F.coalesce(share, F.lit(0.0)))
    at = lambda p: F.coalesce(F.max(F.when(F.col("share") <= p, F.col("value"))), F.lit(0))
    total = F.sum("n") == 0
    points = curve.groupBy(*groups).agg(F.when(total, 0).otherwise(at(lower)).alias("__low"), F.when(total, 0).otherwise(at(1 - upper)).alias("__high"))
    out = df.join(points, groups) if groups else df.crossJoin(F.broadcast(points))  # one row is broadcast
    new = F.bround(F.least(F.greatest((F.col("value") - F.col("__low")) * F.lit(float(maxval)) / nonzero(F.col("__high") - F.col("__low")), F.lit(float(minval))), F.lit(float(maxval)))).cast("long")
    return out.withColumn("value", F.when(F.col("__low") == F.col("__high"), F.col("value")).otherwise(new)).select(*df.columns)


def normalize_section_shang(df: DataFrame, *, low: float = 0.0, high: float = 255.0, clip: bool = True) -> DataFrame:
    """Each section rescaled so that its least and largest values, other than the section's own extremes, become low and high."""
    ends = df.groupBy("z").agg(F.min("value").alias("__a"), F.max("value").alias("__b"))
    inner = (F.col("value") != F.col("__a")) & (F.col("value") != F.col("__b"))
    span = df.join(ends, "z").filter(inner).groupBy("z").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    new = (F.col("value") - F.col("__lo")) / nonzero(F.col("__hi") - F.col("__lo")) * (high - low) + low
    if clip:
        new = F.least(F.greatest(new, F.lit(float(low))), F.lit(float(high)))
    same = F.col("__lo").isNull() | (F.col("__lo") == F.col("__hi"))
    return df.join(span, "z", "left").withColumn("value", F.when(same, F.col("value").cast("double")).otherwise(new)).select(*df.columns)


def clip_percentile(df: DataFrame, low: float = 0.01, high: float = 0.01) -> DataFrame:
    """uint8 values stretched to 0 to 255 between the values below which a share of low, and above which one of high, of the voxels is."""
    counts = histogram(df, [])
    share = F.sum("n").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy())  # at most 256 rows
    curve = counts.withColumn("share", share)
    ends = curve.agg(F.min(F.when(F.col("share") >= low, F.col("value"))).alias("__lo"), F.min(F.when(F.col("share") >= 1 - high, F.col("value"))).alias("__hi"))
    v = F.floor(F.least(F.greatest((F.col("value") - F.col("__lo")) * 255.0 / nonzero(F.col("__hi") - F.col("__lo")), F.lit(0.0)), F.lit(255.0)))
    return df.crossJoin(F.broadcast(ends)).withColumn("value", F.when(F.col("__lo") == F.col("__hi"), F.col("value")).otherwise(v)).select(*df.columns)  # one row is broadcast
