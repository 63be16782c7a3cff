"""Packing by power-of-two decomposition.

A document's tokens, with the separator at their end, are cut into pieces whose lengths are powers of two: as
many of `size` as fit, then one for each set bit of the rest, longest first.  A piece is a sequence of its own,
and sequences of one length make one bucket: their ids are one range, bucket by bucket, and `write` puts each bucket in a folder of its own, so a
training batch has one shape, no sequence crosses documents and nothing is padded.

The job only maps: rows are tokenised where they are read, and nothing is shuffled or gathered.  Sequence ids
are numbered within each partition above the partition's own range (up to 2**26 partitions), and that above the bucket's, so they are unique in a run without any
exchange; a partition that is computed again yields the same rows in the same order.

Defined cases: a null text counts as empty; an empty text is the separator alone (one piece of length 1);
repeated rows and repeated or null doc_ids are packed like any other row; a very long text is tokenised in one call and takes memory by its
length; an empty table gives no pieces; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import portions
from .util import text_of, tidy

#: Words whose tokens a worker keeps; further words are encoded each time, so memory stays bounded.
KEPT_WORDS = 100_000
#: Bytes of texts that are taken from a batch at a time.
PORTION = 2 << 20
SPECIAL = "<|endoftext|>"
#: A space inside a run of white space belongs to the run's token; such texts are encoded in one call.
RUN = re.compile(r"\s (?!\S)")


class Encoder(dict):
    """Byte-level BPE ids of texts as little-endian unsigned 32-bit bytes.

    Word tokens start at spaces, so the ids of a text are those of its space-separated parts, which repeat
    and are kept.  Special strings in a text mean what the tokenizer's file says, as with its own library.
    """

    def __init__(self, model: str, ranks: str):
        super().__init__()
        import tiktoken
        from public_tokenizers import PATTERN

        self.model, self.whole = model, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.bpe(" " + word), "<u4").tobytes()
        if len(self) < KEPT_WORDS and len(word) < 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.model)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if RUN.search(text):
            return np.array(self.bpe(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return np.array(self.bpe(head), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


def lengths(n: int, size: int) -> list[int]:
    """The binary lengths of n tokens: size as often as it fits, then the set bits of the rest."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, model: str, ranks: str, *, size: int = 1024, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids_crc32, bucket (length is 2**bucket), sequence_id, offset and, with_ids, the ids themselves.

    size must be a power of two up to 32768.  ids_crc32 is the checksum of the piece's ids as little-endian unsigned 32-bit numbers.
    """
    if not 1 <= size <= 1 << 15 or size & (size - 1):
        raise ValueError("size must be a power of two up to 32768")
    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([separator], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, ranks)
        for batch in portions(batches, 1, PORTION):
            rows: list[tuple] = []
            blobs: list[bytes] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                total, at = len(ids) // 4, 0
                for n in lengths(total, size):
                    blob = ids[4 * at : 4 * (at + n)]
                    rows.append((doc, at, n, total, zlib.crc32(blob)))
                    if with_ids:
                        blobs.append(blob)
                    at += n
                held += len(ids)
                if held > 4 << 20:
                    yield to_batch(rows, blobs)
                    rows, blobs, held = [], [], 0
            if rows:
                yield to_batch(rows, blobs)

    def to_batch(rows: list[tuple], blobs: list[bytes]) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in zip(*rows)]
        names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype("i4")
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4"))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidy(pieces), schema)
    cut = cut.withColumn("bucket", F.round(F.log2("length")).cast("int"))
    return cut.withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 59) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write(packed: DataFrame, path: str) -> None:
    """packed as Parquet with a folder for each bucket, so that what reads a folder gets sequences of one length."""
    packed.write.partitionBy("bucket").parquet(path)
