"""SentencePiece encoding and decoding, driven by an Aho-Corasick automaton over the pieces.

One pass over a normalised text feeds the automaton; at each position its output links name every piece that ends
there, and each of them relaxes the best segmentation of the prefix.  For unigram models this is Viterbi by the sum of scores.
For BPE models the sum of scores isn't what defines the library's encoding (merges are), so there the same pass relaxes by
merge order, unless `encode` is asked for `scored` columns too, where the same pieces and scores are read as a unigram model.  By merge order: of the pieces that end at a position, the one is taken that the merges would leave next to the last piece of
the prefix before it.  Which pairs stay apart depends on the two pieces alone and is kept.  Both give the ids of the model's own library
(unigram: of segmentations with equal sums either may stand).

Characters without a piece become their UTF-8 bytes where the model has byte pieces, else the unknown id, one for a run.

Words are encoded apart where no piece goes on after a word's end, and ids of short words are kept, at most
`KEPT_WORDS` a task, so memory stays bounded.  New short words of a batch go through the automaton side by side, a
character of each at a time; longer words and whole texts go through alone and take memory in proportion to one text.

Scale: rows are mapped where they are read; the model's path is all that is sent; nothing is shuffled.

Defined cases: null and empty texts have no ids and decode to an empty text; repeated rows are encoded each; an empty table gives no
rows; extra columns are ignored.  Models with user-defined symbols are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import text_of

KEPT_WORDS = 600_000
#: Longest word that goes through the automaton beside others.
SHORT = 64
#: Characters of a batch whose words are looked up together.
TOGETHER = 4 << 20
SPACE = "▁"
#: What the library takes off the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2


class Index:
    """Positions of different non-negative keys, found by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.shift, self.slots = keys, np.uint64(64 - bits), np.full(1 << bits, -1, "i8")
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of keys that meet here one stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype("i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, "i8")
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.slots) - 1)
            found = self.slots[at]
            out[todo] = found
            on = (found >= 0) & (self.keys[found] != keys[todo])
            todo, at = todo[on], at[on]
        return out


class Automaton:
    """Aho-Corasick automaton in arrays: goto edges by state and character, failure and output links."""

    def __init__(self, pieces: dict[str, int]):
        to: list[dict[str, int]] = [{}]
        out, depth = [-1], [0]
        for piece, i in pieces.items():
            s = 0
            for c in piece:
                if c not in to[s]:
                    to[s][c] = len(to)
                    to.append({})
                    out.append(-1)
                    depth.append(depth[s] + 1)
                s = to[s][c]
            out[s] = i
        fail, link, queue = [0] * len(to), [0] * len(to), [0]
        for s in queue:
            for c, t in to[s].items():
                f = fail[s]
                while s and f and c not in to[f]:
                    f = fail[f]
                fail[t] = to[f].get(c, 0) if s else 0
                link[t] = fail[t] if out[fail[t]] >= 0 else link[fail[t]]
                queue.append(t)
        edges = [(s << 21 | ord(c), t) for s, e in enumerate(to) for c, t in e.items()]
        self.edges, self.to = Index(np.array([e[0] for e in edges], "i8")), np.array([e[1] for e in edges], "i8")
        self.fail, self.link, self.out, self.depth = (np.array(x, "i8") for x in (fail, link, out, depth))

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """States after one more character each."""
        new = np.zeros(len(state), "i8")
        todo = np.arange(len(state))
        while len(todo):
            at = self.edges.find(state << 21 | char)
            hit = at >= 0
            new[todo[hit]] = self.to[at[hit]]
            on = np.flatnonzero(~hit & (state != 0))
            todo, state, char = todo[on], self.fail[state[on]], char[on]
        return new


class Codec(dict):
    """Encodes and decodes with one model; as a dict it keeps the ids (little-endian unsigned 32-bit) of words."""

    def __init__(self, path: str, kind: int | None = None):
        """`kind` takes the place of the model's own (UNIGRAM: the best sum of the same pieces' scores)."""
        super().__init__()
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece.Type
        self.kind = model.trainer_spec.model_type if kind is None else kind
        if self.kind not in (UNIGRAM, BPE) or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("unigram and BPE models without user-defined symbols are supported")
        self.rules, self.library, self.path = model.normalizer_spec, None, path
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.surface = model.trainer_spec.unk_surface
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.bytes = {i: int(p.piece[3:-1], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        # a byte below 0x80 is a character of its own
        self.plain_of = [chr(self.bytes[i]) if self.bytes.get(i, 128) < 128 else p for i, p in enumerate(self.pieces)]
        self.special = np.zeros(len(self.pieces), bool)
        self.special[[*self.control, *(i for i, b in self.bytes.items() if b > 127), self.unknown]] = True
        self.of_byte = {b: i for i, b in self.bytes.items()}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.apart: dict[tuple[int, int], bool] = {}
        self.pairs, self.pair_ok = Index(np.zeros(0, "i8")), np.zeros(0, bool)
        self.recent, self.recent_ok = Index(np.zeros(0, "i8")), np.zeros(0, bool)
        self.side_by_side = Automaton(self.ids)
        self.score_of = np.array(self.scores)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        if self.ids:
            self.automaton.make_automaton()
        ends_open = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: texts whose words (spaces, then other characters) can be encoded apart
        self.by_word = not ends_open and self.rules.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.plain = not self.rules.precompiled_charsmap and not self.rules.remove_extra_whitespaces and self.rules.add_dummy_prefix

    def normalised(self, text: str) -> str:
        if self.plain:
            return (" " + text).replace(" ", SPACE) if text else ""
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self.library.normalize(text)

    def merged(self, text: str) -> list[str]:
        """The merges one by one, for texts of two pieces."""
        parts = list(text)
        while True:
            found = [(-self.scores[self.ids[x]], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.ids]
            if not found:
                return parts
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stay(self, last: int, piece: int) -> bool:
        """Whether merges leave `piece` whole next to `last` (-1: at a start)."""
        key = (last, piece)
        if key not in self.apart:
            if len(self.apart) > KEPT_WORDS:
                self.apart.clear()
            pair = [*([self.pieces[last]] if last >= 0 else []), self.pieces[piece]]
            self.apart[key] = self.merged("".join(pair)) == pair
        return self.apart[key]

    def segmented(self, text: str) -> list[tuple[int, str]]:
        """(id, piece) in order; id -1 for a character without a piece."""
        n = len(text)
        start, last, score = [0] * (n + 1), [-1] * (n + 1), [0.0] + [float("-inf")] * n
        done = 0

        def close(to: int) -> None:
            """Positions up to `to` get no further piece."""
            nonlocal done
            while done < to:
                done += 1
                if self.kind == UNIGRAM:
                    alone = score[done - 1] + self.low
                    if score[done] < alone and text[done - 1] not in self.ids:
                        start[done], last[done], score[done] = done - 1, -1, alone
                elif score[done] < 0:
                    start[done], last[done], score[done] = done - 1, -1, 0.0

        for end, (size, i) in self.automaton.iter(text) if self.ids else ():
            close(end)
            at, to = end + 1 - size, end + 1
            if self.kind == UNIGRAM:
                if score[at] + self.scores[i] > score[to]:
                    start[to], last[to], score[to] = at, i, score[at] + self.scores[i]
            elif score[to] < 0 and self.stay(last[at], i):
                start[to], last[to], score[to] = at, i, 0.0
        close(n)
        out, at = [], n
        while at:
            out.append((last[at], text[start[at] : at]))
            at = start[at]
        return out[::-1]

    def pairs_stay(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """`stay` of many pairs; known ones are looked up, first among many, then among recent ones."""
        key = (last + 1) << 20 | piece
        at = self.pairs.find(key)
        rest = np.flatnonzero(at < 0)
        out = self.pair_ok[at] if len(self.pair_ok) else np.zeros(len(key), bool)
        if len(rest):
            late = self.recent.find(key[rest])
            if late.min() < 0:
                new = np.unique(key[rest][late < 0])
                ok = np.array([self.stay(int(k >> 20) - 1, int(k & 0xFFFFF)) for k in new], bool)
                keys, oks = np.concatenate([self.recent.keys, new]), np.concatenate([self.recent_ok, ok])
                if len(keys) > 1000 + len(self.pair_ok) // 8:
                    if len(self.pair_ok) < KEPT_WORDS:
                        self.pairs, self.pair_ok = Index(np.concatenate([self.pairs.keys, keys])), np.concatenate([self.pair_ok, oks])
                    else:
                        self.pairs, self.pair_ok = Index(keys), oks
                    self.recent, self.recent_ok = Index(np.zeros(0, "i8")), np.zeros(0, bool)
                    return self.pairs_stay(last, piece)
                self.recent, self.recent_ok = Index(keys), oks
                late = self.recent.find(key[rest])
            out[rest] = self.recent_ok[late]
        return out

    def short_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of the short words (without their first space) with its ids."""
        words = sorted(words, key=len, reverse=True)
        for f in range(0, len(words), 1 << 16):
            part = words[f : f + (1 << 16)]
            size = np.array([len(w) + 1 for w in part])
            n, wide = len(part), int(size[0])
            chars = np.zeros((wide, n), "i8")
            inside = np.arange(wide)[:, None] < size[None]
            chars.T[inside.T] = np.frombuffer("".join(SPACE + w for w in part).encode("utf-32-le"), "<u4")
            last, start = np.full((wide + 1, n), -1, "i8"), np.zeros((wide + 1, n), "i8")
            score = np.zeros((wide + 1, n))
            state = np.zeros(n, "i8")
            for p in range(wide):
                on = int(np.searchsorted(-size, -p))  # words that have a character here
                state = a = self.side_by_side.step(state[:on], chars[p, :on])
                rows = np.arange(on)
                start[p + 1, :on] = p
                alone = score[p, :on] + self.low
                score[p + 1, :on] = -np.inf
                a = np.where(self.side_by_side.out[a] >= 0, a, self.side_by_side.link[a])
                while True:
                    some = np.flatnonzero(a)
                    if not len(some):
                        break
                    a, rows = a[some], rows[some]
                    piece, at = self.side_by_side.out[a], p + 1 - self.side_by_side.depth[a]
                    before = last[at, rows]
                    if self.kind == UNIGRAM:
                        sums = score[at, rows] + self.score_of[piece]
                        ok = sums > score[p + 1, rows]
                        score[p + 1, rows[ok]] = sums[ok]
                    else:
                        ok = self.pairs_stay(before, piece)
                        score[p + 1, rows[ok]] = 0.0
                    last[p + 1, rows[ok]], start[p + 1, rows[ok]] = piece[ok], at[ok]
                    a = self.side_by_side.link[a]
                    if self.kind == BPE:  # one piece stays at most
                        a, rows = a[~ok], rows[~ok]
                bare = score[p + 1, :on] == -np.inf
                score[p + 1, :on][bare] = alone[bare] if self.kind == UNIGRAM else 0.0
            found, at, rows = [], size.copy(), np.arange(n)
            unknown = np.zeros(n, bool)
            while len(rows):
                piece = last[at, rows]
                unknown[rows[piece < 0]] = True
                # a character without a piece goes along as a negative number
                found.append((rows, np.where(piece < 0, -1 - chars[at - 1, rows], piece)))
                at = start[at, rows]
                on = at > 0
                at, rows = at[on], rows[on]
            who, what = (np.concatenate(x[::-1]) for x in zip(*found)) if found else (np.zeros(0, "i8"),) * 2
            o = np.argsort(who, kind="stable")
            flat, ends = what[o], np.cumsum(np.bincount(who, minlength=n))
            blob = flat.astype("<u4").tobytes()
            for w, u, a, z in zip(part, unknown.tolist(), (ends - np.diff(ends, prepend=0)).tolist(), ends.tolist()):
                yield w, np.fromiter(self.written(flat[a:z].tolist()), "<u4").tobytes() if u else blob[4 * a : 4 * z]

    def written(self, found: Iterable[int]) -> Iterator[int]:
        """Ids of pieces and, as -1 - code point, of characters without one."""
        was_unknown = False
        for i in found:
            if i >= 0:
                yield i
            elif self.of_byte:
                yield from (self.of_byte[b] for b in chr(-1 - i).encode())
            elif not was_unknown:
                yield self.unknown
            was_unknown = i < 0

    def numbers(self, text: str) -> Iterator[int]:
        return self.written(i if i >= 0 else -1 - ord(piece) for i, piece in self.segmented(text))

    def __missing__(self, word: str) -> bytes:
        return np.fromiter(self.numbers(SPACE + word), "<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """The words of a text, each without its first space, or None if the text must be encoded as a whole."""
        if not text:
            return []
        if self.by_word and self.plain and SPACE not in text and "" not in (words := text.split(" ")):
            return words
        text = self.normalised(text)
        return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", text)] if self.by_word and text.startswith(SPACE) else None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        held: list[tuple[str, list[str] | None]] = []
        size = 0
        for k, t in enumerate(texts):
            held.append((t, self.words(t)))
            size += len(t)
            if size < TOGETHER and k + 1 < len(texts):
                continue
            new = set().union(*[w for _, w in held if w]).difference(self)
            before = len(self)
            self.update(self.short_words([w for w in new if len(w) < SHORT]))
            out += [np.fromiter(self.numbers(self.normalised(t)), "<u4").tobytes() if w is None else b"".join(map(self.__getitem__, w)) for t, w in held]
            while len(self) > max(before, KEPT_WORDS):
                self.popitem()  # the latest
            held, size = [], 0
        return out

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.asarray(ids, "i8")
        numbers = ids.tolist()
        first = next((i for i in numbers if i not in self.control), None)
        if self.special[ids].any():
            text = "".join(self._joined(numbers))
        else:
            text = "".join(map(self.plain_of.__getitem__, numbers))
        text = text.replace(SPACE, " ")
        return text[1:] if self.rules.add_dummy_prefix and first is not None and self.pieces[first].startswith(SPACE) else text

    def _joined(self, ids: list[int]) -> Iterator[str]:
        held = bytearray()
        for i in ids:
            b = self.bytes.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                yield _characters(held)
                held = bytearray()
            yield "" if i in self.control else self.surface if i == self.unknown else self.pieces[i]
        yield _characters(held)


def _characters(held: bytes) -> str:
    """Bytes as characters; each byte that is no part of one becomes U+FFFD."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(held):
            for n in (4, 3, 2, 1):
                try:
                    c = bytes(held[at : at + n]).decode()
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    out.append(c)
                    at += n
                    break
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(2)
def codec_of(path: str, kind: int | None = None) -> Codec:
    """One codec a worker and kind, with the words it has kept."""
    return Codec(path, kind)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, scored: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), decoded (the ids' text) and, with_ids, ids.

    scored adds best_n_ids, best_ids_crc32 and best_score: the segmentation with the best sum of scores, and that sum over its pieces
    (bytes and the unknown id add their own scores).  Empty texts have the sum 0.
    """
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded string" + (", ids array<int>" if with_ids else "")
    schema += ", best_n_ids long, best_ids_crc32 long, best_score double" if scored else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                coded = codec.encode_all(part.column(1).to_pylist())
                ids = [np.frombuffer(c, "<i4") for c in coded]
                columns = [part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array([codec.decode(i) for i in ids], pa.string())]
                names = ["doc_id", "n_ids", "ids_crc32", "decoded"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                if scored:
                    best = codec_of(model, UNIGRAM)
                    coded = best.encode_all(part.column(1).to_pylist())
                    sums = [float(best.score_of[np.frombuffer(c, "<i4")].sum()) for c in coded]
                    columns += [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(sums, pa.float64())]
                    names += ["best_n_ids", "best_ids_crc32", "best_score"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of ids_col (array of ints; null counts as empty) as text_col."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(model)
        for s in batches:
            yield s.map(lambda ids: codec.decode([] if ids is None else [int(i) for i in ids])).astype(object)

    return rows.withColumn(text_col, run(F.col(ids_col)))
