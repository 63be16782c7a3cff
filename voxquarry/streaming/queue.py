"""A task queue as Structured Streaming: task files arrive in a folder, each micro-batch is worked and its boxes are recorded.

The checkpoint holds what was read, so a task is worked at least once; work must be idempotent (block overwrites are), and
boxes that are recorded already are dropped, so a second delivery does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import parse_box


def read_tasks(spark: SparkSession, folder: str, files_a_batch: int = 10) -> DataFrame:
    """A stream of tasks (bbox and its six columns) from JSON lines with a field bbox; lines without a box are left out."""
    lines = spark.readStream.schema("bbox string").option("maxFilesPerTrigger", files_a_batch).json(folder)
    return parse_box(lines, "bbox").filter(F.col("z0").isNotNull())


def work(spark: SparkSession, folder: str, state: str, handle: Callable[[DataFrame], None]) -> StreamingQuery:
    """Works all tasks that are there and ends; handle gets a batch's open tasks, and the boxes go to `state`/done afterwards."""
    done = f"{state}/done"

    def batch(tasks: DataFrame, number: int) -> None:
        own = tasks.dropDuplicates(["bbox"])
        seen = spark.read.schema("bbox string").parquet(done) if _there(spark, done) else None
        if seen is not None:
            own = own.join(seen.select(F.col("bbox").alias("__b")), F.col("bbox") == F.col("__b"), "left_anti")
        handle(own)
        own.select("bbox").write.mode("append").parquet(done)

    return read_tasks(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
