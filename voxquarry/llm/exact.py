"""Exact dedup by two-pass Bloom filtering.

Pass one hashes every text into a Bloom filter whose cells count to two, and keeps the cells that were hit at
least twice.  Pass two looks every text up: a text with a cell that was hit once only cannot repeat and passes
straight through; the others (true repeats and the filter's few errors) are shuffled and settled by SHA-256, so
the result never depends on the filter's errors.

Scale: each task sorts and counts the cells of its own rows first, some hundred thousand at a time.  Cells meet by segment of the filter,
sorted by Spark, and are read in a stream into two bitmaps of a segment, so a task holds those and one list, whatever the corpus.  The filter
that goes to every worker has a fixed upper size (max_bits; 64 MB by default):
beyond it only more rows shuffle, and those rows carry ids and digests, never texts.  The possible repeats
are written once to the shared folder.  Keys with over a thousandth of them are at most a thousand, so
they are joined by broadcast; their rows are dealt over all tasks, and no group of copies meets in one task.

Defined cases: null text counts as empty, so null and empty texts are equal; of equal texts the largest doc_id stays, null
the smallest; of rows that repeat a doc_id and text, one stays and each counts in group_size; very long texts are hashed where they are
read; an empty table gives no rows; extra columns, whatever their names, are ignored by `duplicates` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import LOWEST, text_of, tidy, written

HASHES = 3
SEGMENT_BITS = 20
#: hashes that a task counts at a time
AT_ONCE = 1 << 18
HOT = 1000


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES cells of each 64-bit hash in a filter of 2**bits cells (double hashing)."""
    a = h.astype("u8")
    b = (a >> np.uint64(32)) | np.uint64(1)
    mixed = a * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([(mixed + np.uint64(i) * b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits) for i in range(HASHES)])


def longs(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield b.column(0).to_numpy(zero_copy_only=False)


def hit_cells(rows: DataFrame, bits: int, least: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = longs) -> np.ndarray:
    """The filter's bits (packed, 2**bits of them) of cells that were hit `least` times (1 or 2) or more, by what `hashes` gives of rows: by default their one column of longs."""
    low = min(SEGMENT_BITS, bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for h in hashes(b):
                for f in range(0, len(h), AT_ONCE):
                    held.append(h[f : f + AT_ONCE])
                    n += len(held[-1])
                    if n >= AT_ONCE:
                        yield counted(held)
                        held, n = [], 0
        if n:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        # a text's own cells count once each
        c = np.sort(cells(np.concatenate(held), bits), axis=0)
        fresh = np.concatenate([np.ones((1, c.shape[1]), bool), c[1:] != c[:-1]])
        found, times = np.unique(c[fresh], return_counts=True)
        seg = (found >> np.uint64(low)).astype("i8")
        cut = np.flatnonzero(np.diff(seg)) + 1
        groups = [(int(s[0]), f.astype("u4").tobytes(), np.packbits(t >= least).tobytes()) for s, f, t in zip(np.split(seg, cut), np.split(found & np.uint64((1 << low) - 1), cut), np.split(times, cut))]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*groups), (pa.int64(), pa.binary(), pa.binary()))], ["segment", "cells", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(1 << low, bool), np.zeros(1 << low, bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

        for b in batches:
            for s, c, t in zip(*b.columns):
                if s.as_py() != at:
                    if at is not None:
                        yield done()
                    at = s.as_py()
                    once[:] = twice[:] = False
                c = np.frombuffer(c.as_py(), "u4")
                again = np.unpackbits(np.frombuffer(t.as_py(), "u1"), count=len(c)).astype(bool)
                twice[c] |= again | (once[c] if least > 1 else False)
                once[c] = True
        if at is not None:
            yield done()

    parts = rows.mapInArrow(tidy(local), "segment long, cells binary, twice binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(tidy(merged), "segment long, bits binary")
    out = np.zeros(1 << bits >> 3, "u1")
    width = 1 << low >> 3
    for s, found in zip(*parts.toArrow().columns):  # 2**bits bits in all, at most 64 MB by default
        out[s.as_py() * width : (s.as_py() + 1) * width] = np.frombuffer(found.as_py(), "u1")
    return out


def bits_for(n: int, max_bits: int) -> int:
    return int(np.clip(int(16 * n).bit_length(), 16, max_bits))


def in_cells(filled: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether all cells of each hash are set."""
    c = cells(h, bits)
    return np.all((filled[c >> np.uint64(3)] >> (7 - (c & np.uint64(7))).astype("u1")) & 1, axis=0)


def maybe_repeated(docs: DataFrame, key: Column, max_bits: int) -> Column:
    """A boolean column: false where key (a string) is surely alone in docs."""
    return _looked_up(docs.select(F.xxhash64(key).alias("h")), F.xxhash64(key), max_bits, 2)


def holds(hashes: DataFrame, h: Column, max_bits: int = 29) -> Column:
    """A boolean column: false where the hash h is surely not in hashes (one column of longs)."""
    return _looked_up(hashes, h, max_bits, 1)


def _looked_up(hashes: DataFrame, h: Column, max_bits: int, least: int) -> Column:
    bits = bits_for(hashes.count(), max_bits)
    filled = hashes.sparkSession.sparkContext.broadcast(hit_cells(hashes, bits, least))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(in_cells(filled.value, h.to_numpy(), bits))

    return maybe(h)


def _settled(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> tuple[Column, DataFrame]:
    """The filter's verdict, and of the possible repeats (id, sha, keep, n, stays, alike): stays for the row that stays, which has so many alike in id and text."""
    key = text_of(text_col)
    maybe = maybe_repeated(docs, key, max_bits)
    some = written(docs.filter(maybe).select(F.col(id_col).cast("long").alias("id"), F.sha2(key, 256).alias("sha"), F.monotonically_increasing_id().alias("row")))
    alike = some.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("c"), F.max("row").alias("row"))
    groups = written(alike.groupBy("sha").agg(F.max(F.struct("id", "c", "row")).alias("k"), F.sum("c").alias("n")).select("sha", F.col("k.id").alias("keep"), F.col("k.c").alias("alike"), F.col("k.row").alias("keep_row"), "n"))
    hot = groups.filter(F.col("n") * HOT > max(some.count(), HOT))
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in groups.columns])
    some = some.join(F.broadcast(named(hot, "hot")), F.col("sha") == F.col("hot_sha"), "left")
    # rows of hot keys look for a key that no group has, so that they are dealt evenly
    rest = F.when(F.col("hot_sha").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    out = some.withColumn("cold_key", rest).join(named(groups, "cold"), F.col("cold_key") == F.col("cold_sha"), "left")
    of = lambda c: F.when(F.col("hot_sha").isNull(), F.col(f"cold_{c}")).otherwise(F.col(f"hot_{c}"))
    return maybe, out.select("id", "sha", of("keep").alias("keep"), of("n").alias("n"), (F.col("row") == of("keep_row")).alias("stays"), of("alike").alias("alike"))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 29) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    maybe, some = _settled(docs, id_col, text_col, max_bits)
    alone = docs.filter(~maybe).select(F.col(id_col).cast("long").alias("doc_id"), F.col(id_col).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2(text_of(text_col), 256).alias("text_sha256"))
    copies = some.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("stays").alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(copies)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 29) -> DataFrame:
    """docs without the rows that `duplicates` drops.  Texts of possible repeats are shuffled, all others stay where they are read."""
    maybe, some = _settled(docs, id_col, text_col, max_bits)
    keep = some.filter("stays").select(F.coalesce("id", F.lit(LOWEST)).alias("keep_id"), F.col("sha").alias("keep_sha"), F.col("alike"))
    # a row's columns go as one, so their names can't clash with those in use here
    own = docs.filter(maybe).select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("own_id"), F.sha2(text_of(text_col), 256).alias("own_sha"))
    kept = own.join(keep, (F.col("own_id") == F.col("keep_id")) & (F.col("own_sha") == F.col("keep_sha")))
    single = kept.filter(F.col("alike") == 1)
    again = kept.filter(F.col("alike") > 1).dropDuplicates(["own_id", "own_sha"])
    return docs.filter(~maybe).unionAll(single.select("row.*")).unionAll(again.select("row.*"))
