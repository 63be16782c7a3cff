"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where it is unset, a session with a local master, whose driver is its only executor, gets a temporary one; any other raises an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a `written` whose tables are removed at the end of the block: for what no result reads."""
    paths: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        out, path = _stored(df)
        paths.append(path)
        return out

    try:
        yield put
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, giving freed memory back to the system when a task ends: a worker lives on and later stages need room."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trimmed()

    return tidied


def trimmed() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_of(column: str | Column = "text") -> Column:
    """Null text as empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ranked(df: DataFrame, groups: list[str], order: list[str], bucket: Column, rank: str) -> DataFrame:
    """Adds rank (long, from 0) of each row within groups, ordered by bucket first and order next.

    bucket is an integer that never falls as order rises.  Counts of buckets are summed before any row is
    numbered, and rows are numbered within one bucket of one group, so no task has to hold a whole group:
    only (group, bucket) counts meet in a window.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = W.partitionBy(*groups, "__bucket").orderBy(*order)
    df = df.withColumn("__row", F.row_number().over(own) - 1)
    on = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = df.join(counts, on, "left").withColumn(rank, F.col("__base") + F.col("__row"))
    return out.drop("__bucket", "__row", "__b", "__base", *[f"__g{i}" for i in range(len(groups))])
