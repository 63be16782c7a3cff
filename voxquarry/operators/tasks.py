"""Task tables (task_id, z0 to x1, bbox) and what decides whether a task still has to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import START, STOP, Triple, decompose, floor_div, format_box, grid_boxes, parse_box


def create_bbox(spark: SparkSession, start: Triple, *, stop: Triple | None = None, size: Triple | None = None) -> DataFrame:
    """One task, from start to stop or of a size."""
    stop = stop or tuple(a + s for a, s in zip(start, size))
    return spark.createDataFrame([(0, *start, *stop)], "task_id long, " + ", ".join(f"{n} long" for n in START + STOP)).withColumn("bbox", format_box())


generate = grid_boxes


def from_names(names: DataFrame, name_col: str = "bbox") -> DataFrame:
    """Tasks of names that hold a box; others are left out."""
    return parse_box(names, name_col).filter(F.col("z0").isNotNull())


def fetch(tasks: DataFrame, job: int, granularity: int) -> DataFrame:
    """The tasks of one job: `granularity` in a row."""
    return tasks.filter(F.floor(F.col("task_id") / granularity) == job)


def sliced(tasks: DataFrame, start: int, stop: int) -> DataFrame:
    return tasks.filter((F.col("task_id") >= start) & (F.col("task_id") < stop))


def _name(prefix: str, suffix: str):
    return F.concat(F.lit(prefix), F.col("bbox"), F.lit(suffix))


def skip_by_file(tasks: DataFrame, files: DataFrame, *, prefix: str = "", suffix: str = "", mode: str = "exist") -> DataFrame:
    """Tasks that remain; files has path and length.  mode: drop a task if its file exists (`exist`), is missing (`missing`), or is missing or empty (`empty`)."""
    f = files.filter(F.col("length") > 0) if mode == "empty" else files
    f = f.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("__file"))
    return tasks.join(f, _name(prefix, suffix) == F.col("__file"), {"exist": "left_anti", "missing": "left_semi", "empty": "left_semi"}[mode])


def skip_by_blocks(tasks: DataFrame, stored: DataFrame, block: Triple) -> DataFrame:
    """Tasks with a block that is not stored (bz, by, bx)."""
    cells = decompose(tasks, block, mode="aligned").select("task_id", *[floor_div(a, n).alias(f"b{a[0]}") for a, n in zip(START, block)])
    have = stored.select("bz", "by", "bx").distinct()
    missing = cells.join(have, ["bz", "by", "bx"], "left_anti").select(F.col("task_id").alias("__task")).distinct()
    return tasks.join(missing, F.col("task_id") == F.col("__task"), "left_semi")


def skip_none(tasks: DataFrame, name: str) -> DataFrame:
    return tasks.filter(F.col(name).isNotNull())


def mark_complete(tasks: DataFrame, path: str) -> None:
    """Adds the boxes of finished tasks to the completion table at path."""
    tasks.select("bbox").write.mode("append").parquet(path)


def not_complete(tasks: DataFrame, done: DataFrame) -> DataFrame:
    return tasks.join(done.select(F.col("bbox").alias("__done")), F.col("bbox") == F.col("__done"), "left_anti")


def log_summary(log: DataFrame) -> DataFrame:
    """Mean, max, min, sum and count of the seconds of each operator on each device; log: operator, seconds, compute_device."""
    s = F.col("seconds")
    return log.groupBy("compute_device", "operator").agg(F.avg(s).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"), F.sum(s).alias("sum"), F.count(s).alias("n"))


def speed(log: DataFrame, voxels_a_task: int) -> DataFrame:
    """Thousands of voxels a second on each device, from the seconds of whole tasks."""
    tasks = log.groupBy("compute_device", "task_id").agg(F.sum("seconds").alias("s"))
    return tasks.groupBy("compute_device").agg((F.lit(float(voxels_a_task)) * F.count(F.lit(1)) / F.sum("s") / 1e3).alias("kvoxels_per_s"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """operator, seconds, compute_device and bbox of JSON logs with a timer map."""
    raw = spark.read.schema("timer map<string,double>, bbox string, compute_device string").option("multiLine", True).json(path)
    return raw.select(F.explode("timer").alias("operator", "seconds"), "compute_device", "bbox")


def plan_patches(spark: SparkSession, ram_bytes: float, patch: Triple, overlap: Triple, channels: int, most: int = 64) -> DataFrame:
    """The number of patches (n_z, n_y, n_x), at most `most` an axis, whose float32 output uses most of half the memory; ties to the smaller counts."""
    n = spark.range(1, most + 1)
    size = lambda i, name: F.col(name) * (patch[i] - overlap[i]) + overlap[i]
    grid = n.select(F.col("id").alias("n_z")).crossJoin(n.select(F.col("id").alias("n_y")))  # most * most rows
    # y and x get the same number
    grid = grid.withColumn("n_x", F.col("n_y")).withColumn("bytes", size(0, "n_z") * size(1, "n_y") * size(2, "n_x") * (4 * channels))
    fits = grid.filter(F.col("bytes") <= ram_bytes / 2)
    return fits.agg(F.max(F.struct("bytes", (-F.col("n_z")).alias("z"), (-F.col("n_y")).alias("y"))).alias("m")).select((-F.col("m.z")).alias("n_z"), (-F.col("m.y")).alias("n_y"), (-F.col("m.y")).alias("n_x"), F.col("m.bytes").alias("bytes"))
