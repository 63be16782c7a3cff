"""Near-duplicate detection by BagMinHash.

A document is the bag (multiset) of its five-word shingles.  The weight axis is discretised into unit levels, and
levels are gathered in a hierarchy of blocks [0, 1), [1, 2), [2, 4), [4, 8), ...; each block of each shingle has a Poisson
process whose rate is the block's width times the signature's size.  A point carries a component and a level of
the block, and counts only where the level is below the shingle's weight, so the earliest point of a
component is an unbiased sample of the weighted union: two documents agree in a component with the
probability of their weighted Jaccard similarity.  Points are made in rising order and only as far as the
signature can still change: processes stop at a reach within which almost every signature is full, and documents
whose signature is not full go on with twice the reach.

Signatures are cut into bands; documents that share a band are candidates, and a pair is a link if the overlap of the
two bags (sum of smaller over sum of larger counts) is `threshold` or more.  Classes are the connected components of
links.  Equal texts are one text from the start, whatever their number.

Candidates are not all pairs of a bucket.  In a first round every text of a bucket is compared with the bucket's
smallest; buckets whose texts are then connected are settled.  Texts of the others are weighed by the shingles that any other of them may
have (a filter that counts to two finds those that surely are in one text only).  Two bounds follow: the overlap of a pair is at
most the weight s of the lesser text's shared shingles; and if those are dealt by hash over cells, it is at
most the sum over cells of the lesser weight.  In a second round each bucket's text with the largest s is compared
with all others that the bounds allow, in a third `CENTRES` texts drawn by hash; then all pairs of a bucket that are of different classes
still and that the bounds allow.  So each pair that shares a band is compared, connected already, or below the
threshold by a bound: no link between classes is lost, and no number of texts or pairs is capped.

Scale: band keys and ids are shuffled, never signatures; a hot bucket or a hot class is joined from
written tables, whose large partitions Spark splits.  Texts are shuffled only for texts in shared buckets, which a
Bloom filter of bounded size finds.  Components propagate the smallest label with pointer jumping; labels live in written tables.
The number of driver's steps doesn't depend on the size of a bucket.  Copies with different edits are dense in one bucket and yet not
linked; the bounds see that they lack different shingles, so few of their pairs are made.  In the last round the texts that are left of an
unsettled bucket meet in blocks of some `BLOCK`, and a matrix product gives the bounds of a pair of blocks: it takes time by the square of what
is left, over all tasks, but rows come out for close pairs only.

Defined cases: null and empty texts, and texts without words, have no bag and are alone unless their texts are equal;
texts of one to four words are one shingle; null doc_ids are smaller than none: a class is named by its smallest
doc_id that is not null; repeated rows are copies like any other; an empty table gives no rows; very long texts are one batch
each and take memory by their length; extra columns, whatever their names, are ignored by `classes` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import bits_for, hit_cells, holds, in_cells
from .substring import BASES, mixed, portions, spans_hash, words_of
from .util import LOWEST, scratch, text_of, tidy, written

U = np.uint64
GOLD = 0x9E3779B97F4A7C15
#: Centres that an unsettled bucket gets in the third round.
CENTRES = 4
#: Cells over which the shared shingles of a text are dealt: the first number up to so many shingles, the second beyond.
CELLS = (128, 1024)
OWN = ("w", "s", "v")
#: Texts of a bucket that are compared at a time in the last round (on average).
BLOCK = 512
PORTION = 1 << 20


def bags(words: np.ndarray, edges: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle hash (44 bits) and count of the bags of up to 2**20 documents whose words begin at edges."""
    n = np.diff(edges)
    times = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), times)
    start = edges[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
    h = spans_hash(words, start, np.minimum(start + shingle, edges[1:][doc]), BASES[1])
    key = np.sort(doc.astype(U) << U(44) | h >> U(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U(44)).astype("i8"), key[at] & U((1 << 44) - 1), np.diff(np.append(at, len(key)))


def _points(doc: np.ndarray, h: np.ndarray, c: np.ndarray, reach: np.ndarray, sig: np.ndarray) -> None:
    """Lowers sig to the points within reach of the processes of shingles (doc, h) with counts c."""
    size = sig.shape[1]
    blocks = 1 + np.ceil(np.log2(c)).astype("i8")
    at = np.repeat(np.arange(len(c)), blocks)
    j = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    doc, c = doc[at], c[at]
    low = np.where(j > 0, 1 << np.maximum(j - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mixed(h[at] + j.astype(U) * U(0xD1342543DE82EF95))
    x, k = np.zeros(len(at)), 0
    flat = sig.reshape(-1)
    while len(x):
        u = ((mixed(seed + U((2 * k + 1) * GOLD % 2**64)) >> U(11)).astype("f8") + 0.5) * 2.0**-53
        x = x - np.log(u) / (width * size)
        near = np.flatnonzero(x <= reach[doc])
        x, doc, c, low, width, seed = (a[near] for a in (x, doc, c, low, width, seed))
        mark = mixed(seed + U((2 * k + 2) * GOLD % 2**64))
        part = ((mark >> U(32)) * U(size) >> U(32)).astype("i8")
        level = (mark & U(0xFFFFFFFF)).astype("i8") & (width - 1)
        ok = low + level < c
        np.minimum.at(flat, doc[ok] * size + part[ok], x[ok])
        k += 1


def signatures(doc: np.ndarray, h: np.ndarray, c: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures (n_docs by size); documents without shingles have infinite components."""
    sig = np.full((n_docs, size), np.inf)
    weight = np.bincount(doc, c, n_docs)
    todo = weight > 0
    reach = (np.log(size) + 3) / np.maximum(weight, 1)
    while todo.any():
        pick = todo[doc]
        _points(doc[pick], h[pick], c[pick], reach, sig)
        todo &= ~np.isfinite(sig).all(axis=1)
        reach = reach * 2
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = sig.view(U).reshape(len(sig), bands, -1)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1).astype(U) * U(GOLD)), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mixed(key * U(BASES[1]) + bits[:, :, i])
    return key


def _signed(bands: int, rows: int, shingle: int):
    names = ["doc_id", "h1", "h2", "w", *[f"b{i}" for i in range(bands)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 3, PORTION):
            words, edges = words_of(b.column(3))
            bag = bags(words, edges, shingle)
            sig = signatures(*bag, len(b), bands * rows)
            keys = band_keys(sig, bands).view("i8")
            none = ~np.isfinite(sig[:, 0])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.bincount(bag[0], bag[2], len(b)).astype("i8")), *[pa.array(keys[:, i], mask=none) for i in range(bands)]], names)

    return tidy(run), ", ".join(f"{n} long" for n in names)


def overlaps(a: pa.BinaryArray, b: pa.BinaryArray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of smaller and of larger counts of the bags of each pair of texts."""
    (da, ha, ca), (db, hb, cb) = (bags(*words_of(t), shingle) for t in (a, b))
    n = len(a)
    both = np.bincount(da, ca, n) + np.bincount(db, cb, n)
    key, c = np.concatenate([da.astype(U) << U(44) | ha, db.astype(U) << U(44) | hb]), np.concatenate([ca, cb])
    o = np.argsort(key, kind="stable")
    key, c = key[o], c[o]
    same = np.flatnonzero(key[1:] == key[:-1])
    d = (key >> U(44)).astype("i8")
    common = np.bincount(d[same], np.minimum(c[same], c[same + 1]), n)
    return common, both - common


def _verified(threshold: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2, 1 << 20):
            for p in portions([b], 3, 2 << 20):
                common, union = overlaps(p.column(2), p.column(3), shingle)
                link = pa.array((union > 0) & (common >= threshold * union - 1e-9))
                yield pa.RecordBatch.from_arrays([p.column(0).filter(link), p.column(1).filter(link)], ["a", "b"])

    return tidy(run)


def components(links: DataFrame, put: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(id, comp) of the ends of links (a, b), a table that `put` writes: comp is the smallest id of the connected component."""
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = put(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = put(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    while True:
        told = both.join(labels, both["u"] == labels["id"]).select(F.col("v").alias("id"), "comp", F.lit(None).cast("long").alias("own"))
        told = told.unionByName(labels.select("id", "comp", F.col("comp").alias("own"))).groupBy("id").agg(F.min("comp").alias("comp"), F.min("own").alias("own"))
        roots = labels.select(F.col("id").alias("r_id"), F.col("comp").alias("r_comp"))
        new = put(told.join(roots, told["comp"] == roots["r_id"], "left").select("id", F.least("comp", "r_comp").alias("comp"), "own"))
        labels = new.select("id", "comp")
        if new.filter("comp <> own").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """labels (id, comp) with the classes that links (a, b), a written table, connect: only links between classes are looked at."""
    ends = links
    for end in ("a", "b"):
        of = labels.select(F.col("id").alias("of_id"), F.col("comp").alias("of_comp"))
        ends = ends.join(of, F.col(end) == F.col("of_id"), "left").withColumn(end, F.coalesce("of_comp", end)).select("a", "b")
    ends = put(ends.filter("a <> b").distinct())
    if ends.isEmpty():
        return labels
    new = components(ends, put)
    told = new.select(F.col("id").alias("n_id"), F.col("comp").alias("n_comp"))
    old = labels.join(told, F.col("comp") == F.col("n_id"), "left").select("id", F.coalesce("n_comp", "comp").alias("comp"))
    return put(old.unionByName(new.join(labels.select(F.col("id").alias("l_id")), F.col("id") == F.col("l_id"), "left_anti")))


def _weighed(shingle: int, shared, bits: int):
    """(b_tid, w, s, v) of rows (tid, text): weights of the bag and of its shingles that are in the broadcast filter, and the latter's weights by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1, PORTION):
            d, h, c = bags(*words_of(b.column(1)), shingle)
            weights = np.bincount(d, c, len(b)).astype("i8")
            kept = in_cells(shared.value, mixed(h), bits)
            d, h, c = d[kept], h[kept], c[kept]
            cells = np.array(CELLS)[(weights > 8 * CELLS[0]).astype("i8")]
            ends = np.concatenate([[0], np.cumsum(cells)])
            v = np.bincount(ends[d] + (h % cells[d].astype(U)).astype("i8"), c, int(ends[-1])).astype("i4")
            sums = [weights, np.bincount(d, c, len(b)).astype("i8")]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums), pa.ListArray.from_arrays(ends.astype("i4"), v)], ["b_tid", *OWN])

    return tidy(run)


def _open(rest: DataFrame, put) -> DataFrame:
    """The rows of rest (key, tid, comp, ...) whose bucket has texts of more than one class; rest must be a written table."""
    keys = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(F.col("key").alias("o_key"))
    return put(rest.join(keys, rest["key"] == keys["o_key"]).drop("o_key"))


def _shares(members: DataFrame, texts: DataFrame, shingle: int, put) -> DataFrame:
    """(b_tid, w, s, v) of the texts of members, see `_weighed`."""

    def hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for p in portions([b], 0, PORTION):
            yield mixed(bags(*words_of(p.column(0)), shingle)[1])

    ids = members.select(F.col("tid").alias("m_tid")).distinct()
    own = put(texts.join(ids, texts["tid"] == ids["m_tid"]).select("tid", "text", "w"))
    bits = bits_for(own.agg(F.sum("w")).first()[0] or 0, 29)
    shared = own.sparkSession.sparkContext.broadcast(hit_cells(own.select("text"), bits, 2, hashes))
    return own.select("tid", "text").mapInArrow(_weighed(shingle, shared, bits), "b_tid long, " + ", ".join(f"{c} long" for c in OWN[:-1]) + ", v array<int>")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (tid, comp, ...) with the classes of labels."""
    rows = rows.drop("comp")
    return rows.join(labels, rows["tid"] == labels["id"], "left").withColumn("comp", F.coalesce("comp", "tid")).drop("id")


def _near(threshold: float):
    """Whether the bounds allow a link between columns (w, s, v) and (c_w, c_s, c_v)."""
    least, w = F.least("s", "c_s"), F.col("w") + F.col("c_w")
    enough = lambda common: common >= threshold * (w - common) - 1e-9
    alike = F.aggregate(F.zip_with("v", "c_v", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    return enough(least) & ((F.size("v") != F.size("c_v")) | enough(alike))


def sum_of_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum over columns of the lesser of a's and b's entries, for each row of a and each of b."""
    most = int(min(a.max(initial=0), b.max(initial=0)))
    if most > 64:
        out = np.zeros((len(a), len(b)), "i8")
        for x, y in zip(a.T, b.T):
            out += np.minimum(x[:, None], y[None])
        return out
    out = np.zeros((len(a), len(b)), "f4")
    for k in range(1, most + 1):  # both have k at least
        x, y = a >= k, b >= k
        use = x.any(axis=0) & y.any(axis=0)
        out += x[:, use].astype("f4") @ y[:, use].astype("f4").T
    return out


def _compared(threshold: float):
    """Pairs (tid, c_id) of different classes that the bounds allow, of rows (tid, comp, w, s, v of one block, the same of another, whether they are one)."""

    def side(columns: list, i: int) -> tuple[np.ndarray, ...]:
        *flat, v = (c[i].values for c in columns)
        return *(x.to_numpy(zero_copy_only=False) for x in flat), np.asarray(v.offsets), v.values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                (t, comp, w, s, ends, v), (u, other, x, z, edges, y) = side(b.columns[:5], i), side(b.columns[5:10], i)
                need = threshold / (1 + threshold) * (w[:, None] + x[None]) - 1e-9
                can = (np.minimum(s[:, None], z[None]) >= need) & (comp[:, None] != other[None])
                if b.column(10)[i].as_py():
                    can &= t[:, None] < u[None]
                for n in CELLS:
                    rows = np.flatnonzero((np.diff(ends) == n) & can.any(axis=1))
                    cols = np.flatnonzero((np.diff(edges) == n) & can.any(axis=0))
                    if len(rows) and len(cols):
                        at = np.ix_(rows, cols)
                        can[at] &= sum_of_least(v[ends[rows][:, None] + np.arange(n)], y[edges[cols][:, None] + np.arange(n)]) >= need[at]
                rows, cols = np.nonzero(can)
                yield pa.RecordBatch.from_arrays([pa.array(t[rows]), pa.array(u[cols])], ["tid", "c_id"])

    return tidy(run)


def _blocks(members: DataFrame, threshold: float, put) -> DataFrame:
    """Pairs (tid, c_id) of each bucket that are of different classes and that the bounds allow; the texts of a bucket meet in blocks."""
    sizes = members.groupBy(F.col("key").alias("n_key")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n"))
    dealt = members.join(sizes, F.col("key") == F.col("n_key")).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("n")))
    dealt = put(dealt.groupBy("key", "block").agg(F.collect_list(F.struct("tid", "comp", *OWN)).alias("m")))
    other = dealt.select(F.col("key").alias("o_key"), F.col("block").alias("o_block"), F.col("m").alias("o"))
    met = dealt.join(other, (F.col("key") == F.col("o_key")) & (F.col("block") <= F.col("o_block")))
    met = met.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("m", "o") for c in ("tid", "comp", *OWN)], (F.col("block") == F.col("o_block")).alias("one"))
    return met.mapInArrow(_compared(threshold), "tid long, c_id long")


def _links(multi: DataFrame, texts: DataFrame, threshold: float, shingle: int, put) -> DataFrame:
    """(id, comp) of the texts that have links; multi: (key, tid) of shared buckets, texts: (tid, text, w)."""
    side = lambda n: texts.select(F.col("tid").alias(f"{n}_id"), F.col("text").alias(f"{n}_text"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("tid", "c_id").alias("a"), F.greatest("tid", "c_id").alias("b")).distinct()
        full = pairs.join(side("b"), F.col("b") == F.col("b_id")).join(side("a"), F.col("a") == F.col("a_id"))
        return put(full.select("a", "b", "a_text", "b_text").mapInArrow(_verified(threshold, shingle), "a long, b long"))

    def left(members: DataFrame, centres: DataFrame) -> DataFrame:
        """What was compared with all others of its bucket leaves it."""
        used = centres.select(F.col("c_key").alias("u_key"), F.col("c_id").alias("u_id"))
        return members.join(used, (F.col("key") == F.col("u_key")) & (F.col("tid") == F.col("u_id")), "left_anti")

    def chosen(best: DataFrame) -> DataFrame:
        return put(best.select(F.col("key").alias("c_key"), *[F.col(f"c.{x}").alias(f"c_{y}") for x, y in (("tid", "id"), ("comp", "comp"), *zip(OWN, OWN))]))

    def met(members: DataFrame, centres: DataFrame) -> DataFrame:
        return members.join(centres, (F.col("key") == F.col("c_key")) & (F.col("tid") != F.col("c_id")) & (F.col("comp") != F.col("c_comp")) & _near(threshold)).select("tid", "c_id")

    # first round: the bucket's smallest text against all others
    members = multi.select("key", "tid", F.col("tid").alias("comp"))
    centres = put(members.groupBy("key").agg(F.min("tid").alias("c_id")).select(F.col("key").alias("c_key"), "c_id"))
    labels = components(linked(members.join(centres, (F.col("key") == F.col("c_key")) & (F.col("tid") != F.col("c_id")))), put)
    members = _open(put(_relabelled(left(members, centres), labels)), put)
    if members.isEmpty():
        return labels
    # each bucket's text with the largest s against all others
    shares = _shares(members, texts, shingle, put)
    members = put(members.join(shares, F.col("tid") == F.col("b_tid")).select("key", "tid", "comp", *OWN))
    least = members.groupBy(F.col("key").alias("l_key")).agg(F.min("w").alias("low"))
    other = F.when(F.col("low") >= F.col("s"), F.col("low")).otherwise(F.col("s"))
    can = F.col("s") >= threshold * (F.col("w") + other - F.col("s")) - 1e-9
    members = put(members.join(least, F.col("key") == F.col("l_key")).filter(can).select("key", "tid", "comp", *OWN))
    centre = lambda first: F.min(F.struct(first.alias("first"), "tid", "comp", *OWN)).alias("c")
    centres = chosen(members.groupBy("key").agg(centre(-F.col("s"))))
    labels = merged(labels, linked(met(members, centres)), put)
    members = _open(put(_relabelled(left(members, centres), labels)), put)
    if members.isEmpty():
        return labels
    centres = chosen(members.groupBy("key", F.pmod(F.xxhash64("tid"), F.lit(CENTRES)).alias("slot")).agg(centre(F.xxhash64("tid", F.lit(1)))))
    labels = merged(labels, linked(met(members, centres)), put)
    members = _open(put(_relabelled(left(members, centres), labels)), put)
    return labels if members.isEmpty() else merged(labels, linked(_blocks(members, threshold, put)), put)


def _hashes(text_col: str) -> list:
    text = text_of(text_col)
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, h1, h2, ...) of each row, and of each text (h1, h2, low_id, n, class_id, class_size, class_texts, first): first for the text that stays."""
    run, schema = _signed(bands, rows, shingle)
    signed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_hashes(text_col), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    names = [f"b{i}" for i in range(bands)]
    with scratch(docs.sparkSession) as put:
        signed = put(signed)
        texts = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("n"), F.min("w").alias("w"), *[F.min(b).alias(b) for b in names])
        texts = put(texts.withColumn("tid", F.monotonically_increasing_id()))
        spread = texts.filter(F.col("b0").isNotNull()).select(F.explode(F.array(*names)).alias("key"), "tid")
        shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("s_key"))
        multi = put(spread.join(shared, spread["key"] == shared["s_key"]).select("key", "tid"))
        ids = multi.select(F.col("tid").alias("m_tid")).distinct()
        wanted = put(texts.join(ids, texts["tid"] == ids["m_tid"]).select("tid", "w", F.col("h1").alias("w1"), F.col("h2").alias("w2")))
        some = docs.filter(holds(wanted.select("w1"), F.xxhash64(text_of(text_col)))).select(*_hashes(text_col), text_of(text_col).cast("binary").alias("text"))
        some = some.groupBy("h1", "h2").agg(F.first("text").alias("text"))
        found = put(wanted.join(some, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))).select("tid", "text", "w"))
        labels = _links(multi, found, threshold, shingle, put)
        own = texts.select("tid", "h1", "h2", "low_id", "n").join(labels, texts["tid"] == labels["id"], "left").withColumn("class", F.coalesce("comp", "tid"))
        own = put(own.select("tid", "h1", "h2", "low_id", "n", "class"))
        order = F.struct(F.col("low_id").isNull(), F.col("low_id"), F.col("tid"))
        sums = put(own.groupBy(F.col("class").alias("g")).agg(F.min("low_id").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("class_texts"), F.min(order).getField("tid").alias("stays")))
        out = own.join(sums, own["class"] == sums["g"]).select("h1", "h2", "low_id", "n", "class_id", "class_size", "class_texts", (F.col("tid") == F.col("stays")).alias("first"))
        return written(signed.select("doc_id", "h1", "h2")), written(out)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, bands: int = 25, rows: int = 5) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size (documents), class_texts (different texts) of every row."""
    signed, texts = _classed(docs, id_col, text_col, threshold, shingle, bands, rows)
    texts = texts.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), "class_id", "class_size", "class_texts")
    return signed.join(texts, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2"))).select("doc_id", "class_id", "class_size", "class_texts")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, bands: int = 25, rows: int = 5) -> DataFrame:
    """docs with one row of each class: the one with the smallest doc_id.  Rows of classes of one document stay where they are read."""
    _, texts = _classed(docs, id_col, text_col, threshold, shingle, bands, rows)
    several = written(texts.filter("class_size > 1").select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), "low_id", "first"))
    maybe = holds(several.select("t1"), F.xxhash64(text_of(text_col)))
    # a row's columns go as one, so their names can't clash with those in use here
    own = docs.filter(maybe).select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("low"), *_hashes(text_col))
    here = (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2"))
    alone = own.join(several, here, "left_anti")
    stays = several.filter("first").select("t1", "t2", F.coalesce("low_id", F.lit(LOWEST)).alias("t_low"))
    kept = own.join(stays, here & (F.col("low") == F.col("t_low"))).dropDuplicates(["h1", "h2"])
    return docs.filter(~maybe).unionAll(alone.select("row.*")).unionAll(kept.select("row.*"))
