"""Substring dedup by level-wise doubling.

A window is `window` consecutive words.  Words covered by a window whose word sequence also starts earlier
(smaller doc_id, or earlier in the same document) are removed; windows are judged on the input.

Levels: the first looks at sequences of half the length, the second at twice that.  On the first level, not every
position is looked at: every window holds ten or so half-length sequences, and the one with the smallest hash (the
leftmost of equals) is its anchor.  Equal windows have the same anchor at the same place, so an anchor that does
not repeat settles all its windows.  Consecutive windows with one anchor make a run of under twice the length.  Of
repeated anchors, runs that repeat as a whole are settled too: all but the first are removed.  Only runs that share an anchor but
differ are extended to single windows of the full length on the second level, where the last candidates are
settled.  There are these two levels only, so one doubling; repeats longer than a window are found as windows that overlap.

Scale: a task sends a row for each different anchor of its own rows, so an anchor that a third of all documents share costs a row a
task; whatever a task can settle alone goes along as a decision.  What meets is sorted by Spark (which
spills) and read in a stream of which a few rows are carried on, so no group is held in memory.  Texts are shuffled by document only where windows have to be
cut and where words are removed.  Hashes of windows have 128 bits.

Defined cases: null and empty texts have no words and give an empty kept text; a null doc_id is smaller than every number; rows
that share a doc_id are told apart, and put in order, by a 64-bit hash of their text, so rows alike in both are one document and get the same result
each; a very long text is one batch and takes memory by its length; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import LOWEST, text_of, tidy, written

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: kinds of rows: a sequence to compare, one that is known to have differing runs, a run to cut, a decision
PROBE, VARIED, CUT, SPAN = range(4)
PIECE = 1 << 20
FLUSH = 1 << 19
PORTION = 2 << 20


@lru_cache(None)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 to base**n modulo 2**64, and their inverses."""

    def up(b: int) -> np.ndarray:
        x = np.full(n + 1, b, U)
        x[0] = 1
        return np.cumprod(x)

    return up(base), up(pow(base, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans_hash(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[start:stop] for each pair; start and stop rise."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(stop, low + PIECE, "right")))
        high = int(stop[to - 1])
        n = high - low
        p, inv = powers(base, 1 << max(10, n.bit_length()))
        sums = np.zeros(n + 1, U)
        np.cumsum((values[low:high].astype(U) + U(1)) * p[:n], out=sums[1:])
        a, b = start[at:to] - low, stop[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * inv[a] + (b - a).astype(U) * U(base)
        at = to
    return mixed(out)


def words_of(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and where each text's words begin and end."""
    edges = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, "u1")
    edges = edges - edges[0]
    ink = ~SPACE[data]
    before, after = np.zeros(len(ink), bool), np.zeros(len(ink), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    before[edges[:-1][edges[:-1] < len(ink)]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    start, stop = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return spans_hash(data, start, stop, BASES[0]), np.searchsorted(start, edges)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts in one take about `size` bytes (one text may take more), with 32-bit offsets."""
    for b in batches:
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype("i8"))])
        large = [i for i, t in enumerate(b.schema.types) if pa.types.is_large_binary(t) or pa.types.is_large_string(t)]
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + size, "right")) - 1)
            out = b.slice(at, to - at)
            for i in large:
                out = out.set_column(i, b.schema.names[i], out.column(i).cast(pa.binary() if pa.types.is_large_binary(b.schema.types[i]) else pa.string()))
            yield out
            at = to


def sequences(words: np.ndarray, length: int, which: int = 1) -> np.ndarray:
    n = max(0, len(words) - length + 1)
    return spans_hash(words, np.arange(n), np.arange(n) + length, BASES[which])


def runs(words: np.ndarray, edges: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: document, first and last window, the anchor's hash and the hash of the run."""
    half = window // 2
    g = sequences(words, half)
    wide = window - half + 1
    n = max(0, len(words) - window + 1)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:n]
    ok = np.arange(n) + window <= edges[1:][doc]
    anchor = np.empty(n, "i8")
    for f in range(0, n, PIECE):
        part = np.lib.stride_tricks.sliding_window_view(g[f : f + PIECE + wide - 1], wide)[: min(PIECE, n - f)]
        anchor[f : f + len(part)] = part.argmin(axis=1) + np.arange(f, f + len(part))
    at = np.flatnonzero(ok)
    anchor = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[at][1:] != doc[at][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    low, high, p = at[first], at[last], anchor[first]
    whole = spans_hash(words, low, high + window, BASES[2])
    return doc[low], low, high, g[p], mixed(whole ^ (p - low).astype(U) * U(BASES[0]))


def packed(low: np.ndarray, more: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
    """Word position, windows after the first (12 bits) and kind (2 bits) in one number that rises with position."""
    return low.astype("i8") << 14 | more.astype("i8") << 2 | kind


SENT = ("h", "c", "key", "tag", "at")


def once(h: np.ndarray, c: np.ndarray, key: np.ndarray, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows in order, those that aren't like the row before in h, c, document and place: such come from repeated rows of one document, and repeat nothing."""
    own = np.ones(len(h), bool)
    own[1:] = False
    for x in (h, c, key, tag, at >> 14):
        own[1:] |= x[1:] != x[:-1]
    return own


def rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view("i8")) for x in columns], list(SENT))


def starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in some column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def settled_here(h, c, key, tag, at, level: int) -> pa.RecordBatch:
    """What a task sends of its rows (h, c, key, tag, at): what it can settle becomes decisions, and one row is left of each h."""
    o = np.lexsort((at, tag, key, c, h))
    o = o[once(*(x[o] for x in (h, c, key, tag, at)))]
    h, c, key, tag, at = (x[o] for x in (h, c, key, tag, at))
    new_h, new = starts(h), starts(h, c)
    if level == 2:
        return rows(*dealt(h, c, key, tag, at & ~3 | np.where(new, PROBE, SPAN)))
    group = np.cumsum(new_h) - 1
    several = (np.bincount(group, new) > 1)[group]
    kind = np.where(~new, SPAN, np.where(several, CUT, PROBE))
    more = new_h & several
    # of each h with differing runs one more row tells other tasks; it has the least c, so it comes first
    least = np.full(int(more.sum()), LOWEST, "i8").view(U)
    told = ((h, h[more]), (c, least), (key, key[more]), (tag, tag[more]), (at & ~3 | kind, at[more] & ~3 | VARIED))
    return rows(*dealt(*map(np.concatenate, told)))


def dealt(h, c, key, tag, at) -> tuple[np.ndarray, ...]:
    """Rows of which the kind is settled need not meet others of their h: they are dealt evenly."""
    kind = at & 3
    return np.where((kind == CUT) | (kind == SPAN), mixed(key.view(U) ^ mixed(at.view(U))), h), c, key, tag, at


def judged(level: int):
    """Of rows in order of (h, c, key, tag, at): (key, tag, at) of decisions and, on level one, of runs to cut.

    Of the last h, which may go on, three rows at most are carried on: its mark as varied, its first row and its last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, np.zeros(0, bool)  # told: what is settled about a carried row already
        for b in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            kind = x[4] & 3
            passed = (kind == CUT) | (kind == SPAN)
            out = [tuple(c[passed] for c in x[2:])]
            x = [c[~passed] for c in x]
            if held is not None:
                x = [np.concatenate(p) for p in zip(held, x)]
            done = np.concatenate([told, np.zeros(len(x[0]) - len(told), bool)])
            h, c, key, tag, at = x
            if len(h):
                mark = (at & 3) == VARIED
                new_h = starts(h)
                g = np.cumsum(new_h) - 1
                probe = np.flatnonzero(~mark)
                probe = probe[once(*(v[probe] for v in x))]
                new = np.zeros(len(h), bool)
                new[probe] = starts(h[probe], c[probe])
                spans = np.zeros(len(h), bool)
                spans[probe] = ~new[probe]
                spans &= ~done
                out.append((key[spans], tag[spans], at[spans] & ~3 | SPAN))
                cut = np.zeros(len(h), bool)
                if level == 1:
                    differ = (np.bincount(g, mark) > 0) | (np.bincount(g, new) > 1)
                    cut = new & differ[g] & ~done
                    out.append((key[cut], tag[cut], at[cut] & ~3 | CUT))
                last = g == g[-1]
                own = probe[last[probe]]
                carried = [*np.flatnonzero(last & mark)[:1], *dict.fromkeys([*own[:1], *own[-1:]])]
                held = [v[carried] for v in x]
                told = np.array([bool(done[i] or cut[i] or spans[i] or i not in own[:1]) for i in carried], bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], ["key", "tag", "at"])

    return tidy(run)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))


def _by_document(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.col("key").alias("f_key"), F.col("tag").alias("f_tag"), "at").groupBy("f_key", "f_tag").agg(F.collect_list("at").alias(name)).hint("shuffle_hash")


def _level(level: int, found: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]):
    """What tasks send of the rows (h, c, key, tag, at) that `found` makes of batches with texts in column 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for b in portions(batches, 2, PORTION):
            held.append(found(b))
            n += len(held[-1][0])
            if n > FLUSH:
                yield settled_here(*map(np.concatenate, zip(*held)), level)
                held, n = [], 0
        if held:
            yield settled_here(*map(np.concatenate, zip(*held)), level)

    return tidy(run)


def runs_of(window: int) -> Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]:
    def found(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        words, edges = words_of(b.column(2))
        doc, low, high, h, c = runs(words, edges, window)
        return h, c, b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc], packed(low - edges[doc], high - low, 0)

    return found


def windows_at(b: pa.RecordBatch, lengths: int) -> tuple[np.ndarray, ...]:
    """Hashes, key, tag and position of the windows asked for in column 3; columns 0 to 2 are key, tag and text."""
    words, edges = words_of(b.column(2))
    asked = b.column(3)
    ends = np.asarray(asked.offsets)
    at = asked.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    doc = np.repeat(np.arange(len(b)), np.diff(ends))
    times = (at >> 2 & 0xFFF) + 1
    start = np.repeat((at >> 14) + edges[doc], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc = np.repeat(doc, times)
    fits = start + lengths <= edges[1:][doc]
    start, doc = start[fits], doc[fits]
    o = np.argsort(start, kind="stable")
    start, doc = start[o], doc[o]
    a, z = (spans_hash(words, start, start + lengths, BASES[i]) for i in (1, 2))
    return a, z, b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc], packed(start - edges[doc], np.zeros(len(doc), "i8"), 0)


def _judge(sent: DataFrame, level: int) -> DataFrame:
    return sent.repartition("h").sortWithinPartitions(*SENT).mapInArrow(judged(level), "key long, tag long, at long")


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1, PORTION):
            out = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = text.split()
                n = len(words)
                gone = 0
                if spans.is_valid:
                    at = spans.values.to_numpy(zero_copy_only=False)
                    change = np.zeros(n + 1, "i8")
                    np.add.at(change, at >> 14, 1)
                    np.add.at(change, np.minimum((at >> 14) + (at >> 2 & 0xFFF) + window, n), -1)
                    stay = np.cumsum(change[:-1]) == 0
                    gone = n - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay)]
                out.append((doc, n, gone, b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_words", "n_removed", "kept"])

    return tidy(run)


def remove_repeats(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row; window is from 2 to 4000."""
    if not 2 <= window <= 4000:
        raise ValueError("window must be from 2 to 4000")
    keyed = _keyed(docs, id_col, text_col)
    sent = ", ".join(f"{c} long" for c in SENT)
    found = written(_judge(keyed.select("key", "tag", "text").mapInArrow(_level(1, runs_of(window)), sent), 1))
    kind = F.col("at").bitwiseAND(F.lit(3))
    cut = _by_document(found.filter(kind == CUT), "asked")
    here = (F.col("key") == F.col("f_key")) & (F.col("tag") == F.col("f_tag"))
    asked = keyed.join(cut, here).select("key", "tag", "text", "asked").mapInArrow(_level(2, lambda b: windows_at(b, window)), sent)
    spans = found.filter(kind == SPAN).unionByName(_judge(asked, 2))
    out = keyed.join(_by_document(spans, "spans"), here, "left").select("doc_id", "text", "spans")
    out = out.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
