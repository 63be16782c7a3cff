"""Exact top-k inner-product search by the three-phase uniform threshold algorithm.

Vectors are quantised to integers (floor(256 x)), so scores are exact: blocks of vectors whose scores could leave 62 bits are
multiplied as Python integers.  The dimensions are cut into a few lists; a
vector's score is the sum of its entries in the lists.  Queries are taken in blocks of at most `block_bytes`:

1. every task gathers, from each list, its k highest entries for each query and scores those vectors in full; the
   k-th best of them over all tasks is a safe cutoff t: the true k-th best cannot be lower;
2. t goes to all tasks; a vector whose entry in every one of the m lists is below t / m scores below t, so the
   vectors with some entry of at least t / m are sufficient;
3. the remaining entries of those vectors are added, and the best k of each task, at least t, are merged exactly.

Scale: a block's queries and cutoffs are all that is broadcast (`block_bytes`, whatever the table's
size), each task keeps and sends the k best rows a query at most, and these meet where the best are merged, after a
map-side limit.  There is no join of vectors with vectors.  The table is read twice for each block of queries; both phases
multiply every vector with every query of the block, and the cutoff saves what is sent and sorted, not products.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no
part, nor do null ids; a score among the k best that is no 64-bit integer raises an error; vectors of another length than the query's are no candidates for it; a query's candidates are the rows with
other ids; rows that share an id are one candidate with the score of
its best vector, and one query, for which the largest vector (in array order) stands;
fewer candidates than k give fewer rows; ties go to the smaller id; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .util import tidy

#: quantised components from here on are wide: their vectors are multiplied apart, so that they don't slow others down
LIMIT = 2**27
#: sums of products below this are left to 64-bit integers, and are above LOW
SAFE = 2**61
LOW, LOWER = -SAFE, -(1 << 4096)
TOO_LARGE = "a score among the k best is no 64-bit integer"


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and q (array of doubles): floor(256 x) / 256 of each vector that takes part, which is exact for every finite x."""
    # from 2**45 on 256 x is an integer as it stands
    step = lambda x: F.when(F.abs(x) < 2.0**45, F.floor(F.lit(256.0) * x).cast("double") / 256.0).otherwise(x)
    scaled = F.transform(F.col(vec_col), lambda x: step(x.cast("double")))
    top = sys.float_info.max
    finite = F.forall(F.col(vec_col), lambda x: F.coalesce(x.cast("double").between(-top, top), F.lit(False)))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), scaled.alias("q"))


def _matrix(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of quantised components) for each length of vector, wide vectors apart as Python integers."""
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        m = flat[offsets[at][:, None] + np.arange(d)]
        wide = np.abs(m).max(axis=1, initial=0) >= LIMIT / 256
        if not wide.all():
            out.append((at[~wide], (m[~wide] * 256).astype("i8")))
        if wide.any():
            exact = [[int(x * 256) if abs(x) < 2.0**1000 else int(x) * 256 for x in row] for row in m[wide].tolist()]
            out.append((at[wide], np.array(exact, object).reshape(int(wide.sum()), d)))
    return out


def top_of(m: np.ndarray) -> int:
    return int(np.abs(m).max(initial=0))


def entries_of(a: np.ndarray, b: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Exact a @ b.T over each list of dimensions: by floating point where every sum stays below 2**53, by Python integers where 64 bits could be left."""
    top = top_of(a) * top_of(b) * max(1, a.shape[1])
    kind = "f8" if top < 2**53 else "i8" if top < SAFE else object
    a, b = a.astype(kind), b.astype(kind)
    return [(a[:, d] @ b[:, d].T).astype(object if kind is object else "i8") for d in cuts]


def sent(score: np.ndarray) -> pa.Array:
    """Scores as longs.  Whatever the other rows, one above them has none but such above it; one below them is null, after all others."""
    if score.dtype != object:
        return pa.array(score, pa.int64())
    if any(x >= 2**63 for x in score):
        raise OverflowError(TOO_LARGE)
    return pa.array([int(x) if x >= -(2**63) else None for x in score], pa.int64())


def local_best(row: np.ndarray, col: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (row, col, score) the best k of each column, ties to smaller ids."""
    order = np.lexsort((ids[row], -score, col))
    row, col, score = row[order], col[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])) if len(col) else np.zeros(0, int)
    place = np.arange(len(col)) - np.repeat(starts, np.diff(np.append(starts, len(col))))
    return row[place < k], col[place < k], score[place < k]


def search(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = 4, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each query row; is_query is a condition on the table's own columns."""
    spark = vectors.sparkSession
    wanted = quantised(vectors.filter(is_query), id_col, vec_col).groupBy("id").agg(F.max("q").alias("q"))
    total, longest = wanted.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    block = max(1, block_bytes // (8 * max(1, longest or 1)))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // block)))))
    rows = quantised(vectors, id_col, vec_col)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for b in range(max(1, -(-total // block))):
        some = wanted.filter(F.col("block") == b).orderBy("id").select("id", "q").toArrow()
        if not some.num_rows:
            continue
        qids = some.column(0).to_numpy()
        groups = [(at, m) for at, m in _matrix(some.column(1).combine_chunks())]
        queries = spark.sparkContext.broadcast((qids, groups))
        best = rows.mapInArrow(_phase(queries, None, k, lists), schema)
        own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("t"), F.count("score").alias("n")).filter(F.col("n") == k).toArrow()
        cut = spark.sparkContext.broadcast(dict(zip(kth.column("query_id").to_pylist(), kth.column("t").to_pylist())))
        found = rows.mapInArrow(_phase(queries, cut, k, lists), schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        out = out.unionByName(found.select("query_id", "rank", "vec_id", F.coalesce("score", F.raise_error(F.lit(TOO_LARGE)).cast("long")).alias("score")))
    return out


def _phase(queries, cut, k: int, lists: int):
    """cut None: phase one.  Otherwise phases two and three with the cutoffs by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, groups = queries.value
        # for each group of queries the best so far: query's place in it, vec_id and score
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids_all = batch.column(0).to_numpy()
            for at, c in _matrix(batch.column(1)):
                for n, (qat, q) in enumerate(groups):
                    if q.shape[1] == c.shape[1]:
                        for found in scored(ids_all[at], c, qids[qat], q):
                            if n in best:
                                found = tuple(map(np.concatenate, zip(best[n], found)))
                            row, col, score = local_best(np.arange(len(found[0])), found[0], found[2], found[1], k)
                            best[n] = col, found[1][row], score
        for n, (col, own, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(qids[groups[n][0]][col]), pa.array(own), sent(score)], ["query_id", "vec_id", "score"])

    def scored(ids: np.ndarray, c: np.ndarray, qid: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cuts = np.array_split(np.arange(c.shape[1]), min(lists, max(1, c.shape[1])))
        for f in range(0, len(qid), 512):
            part_id, part = qid[f : f + 512], q[f : f + 512]
            for g in range(0, len(ids), 4096):
                own, rows = ids[g : g + 4096], c[g : g + 4096]
                entries = entries_of(rows, part, cuts)
                kind, low = (object, LOWER) if entries[0].dtype == object else ("i8", LOW)
                same = own[:, None] == part_id[None]
                if cut is None:
                    at = np.concatenate([np.argpartition(np.where(same, low, e), max(0, len(own) - k), axis=0)[-k:] for e in entries])
                    seen = np.zeros(same.shape, bool)
                    np.put_along_axis(seen, at, True, axis=0)
                    row, col = np.nonzero(seen & ~same)
                    score = sum(e[row, col] for e in entries)
                else:
                    # a query with fewer than k rows gathered has no cutoff: all its rows are collected
                    t = np.array([cut.value.get(int(x), low) for x in part_id], kind)
                    some = np.zeros(same.shape, bool)
                    for e in entries:
                        some |= e >= -(-t // len(entries))
                    row, col = np.nonzero(some & ~same)
                    score = sum(e[row, col] for e in entries)
                    row, col, score = (x[score >= t[col]] for x in (row, col, score))
                row, col, score = local_best(row, col, score, own, k)
                yield col + f, own[row], score

    return tidy(run)
