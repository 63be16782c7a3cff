"""Sharding by proportional stratified interleaving.

Rows of each source are put into a seeded pseudo-random order; a row's fractional rank is its middle position
in that order over the source's size.  Ordered by fractional rank, every stretch of rows holds each source in
proportion, so cutting that order into equal counts gives shards that match the mixture (to within about a row a source).

The law kept is `rows`: counts of shards differ by one at most.  The method forms no groups of equal texts: copies
are rows like any other and are spread like the rest of their source.

Scale: ranks come from counts of buckets of the shuffle key and row numbers within one bucket, so neither a
source with a third of all rows nor the whole table is ever sorted in one task.  The number of buckets follows
the number of rows up to 65536, which bounds the counts that meet in one window.  Only ids, sizes and checksums are shuffled, not texts.

Defined cases: a null text has size 8 and checksum 0; a null source is a stratum; null and repeated doc_ids are
ordered by size and checksum next; rows equal in all of these may swap places, which the result does not show;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import ranked, text_of


def shard(docs: DataFrame, shards: int, *, seed: int = 42, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text", rows_a_bucket: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, stratum, shard and slot (gapless from 0 within the shard)."""
    total = docs.count()
    buckets = max(1, min(1 << 16, -(-total // rows_a_bucket)))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text_of(text_col)) + 8).cast("long").alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        F.col(stratum).cast("string").alias("stratum"),
    ).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    # the first 8 hexadecimal digits rise with the key
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    order = ["key", "doc_id", "size", "text_crc32"]
    rows = ranked(rows, ["stratum"], order, F.floor(high * buckets / F.lit(2**32)), "rank")
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("stratum", "s")
    rows = rows.join(sizes, F.col("stratum").eqNullSafe(F.col("s"))).withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("n")))
    rows = rows.withColumn("all", F.lit(0))
    rows = ranked(rows, ["all"], ["fraction", "stratum", *order], F.floor(F.col("fraction") * buckets), "place")
    # exact in integers: shard s starts at ceil(s * total / shards)
    at = F.expr(f"cast(place * {shards}L div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return rows.withColumn("shard", at).withColumn("slot", F.col("place") - first).select("doc_id", "size", "text_crc32", "stratum", "shard", "slot")
