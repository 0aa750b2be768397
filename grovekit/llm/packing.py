"""Harmonic packing of token ids into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of more than C/(k+1) and at most C/k ids, and a
sequence of class k takes exactly k pieces. Each worker fills its own sequences, so nothing is exchanged. A document
is cut first: as long as what remains is long, a piece of exactly C/k ids (rounded down) is taken, k being the
smallest class whose size is not above what remains; a short rest goes whole into its class. So a sequence of a
low class lacks at most k-1 ids, and one of a high class less than a share of 1/(k+1). What a worker's unfilled
sequences hold at its end is laid end to end, cut at the capacity, and the last stretch is cut into powers of two."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import documents, text_batches, tidied
from grovekit.llm.encoders import word_ids

CAPACITY = 4096
END_ID = 2
#: Rests of at most this share of the capacity are not cut further.
WHOLE_SHARE = 32
ENCODE_CHARS = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """The (class, length) of each piece of a document of n ids, in order."""
    out = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    while rest > capacity // WHOLE_SHARE:
        k = -(-capacity // rest)
        while capacity // k > rest:  # rounding down may leave a class too large
            k += 1
        out.append((k, capacity // k))
        rest -= capacity // k
    if rest:
        out.append((capacity // rest, rest))
    return out


class Packer:
    """The sequences of one worker. It holds fewer than k pieces of each class k, so at most the capacity a class."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, worker << 40
        self.open: dict[int, list[tuple[int | None, int, int, np.ndarray]]] = {}

    def _sequence(self, pieces) -> Iterator[tuple]:
        at = 0
        for doc, start, total, ids in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for k, n in cuts(len(ids), self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, len(ids), ids[start : start + n].copy() if k > 1 else ids[start : start + n]))
            start += n
            if len(bin_) == k:
                yield from self._sequence(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        """What the unfilled sequences hold, end to end."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        total = sum(len(p[3]) for p in left)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        left.reverse()
        for size in sizes:
            taken = []
            while size:
                doc, start, tokens, ids = left.pop()
                taken.append((doc, start, tokens, ids[:size]))
                if len(ids) > size:
                    left.append((doc, start + size, tokens, ids[size:]))
                size -= len(taken[-1][3])
            yield from self._sequence(taken)


def _pack(model_path: str, capacity: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(model_path), Packer(TaskContext.get().partitionId(), capacity)
        end = np.array([END_ID], np.uint32)

        def flush(part):
            for doc, ids in zip((d for d, _ in part), words.ids([t for _, t in part])):
                yield from packer.add(doc, np.concatenate([ids, end]))

        for batch in batches:
            found, part, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                part.append((doc, text.as_py()))
                size += len(part[-1][1])
                if size >= ENCODE_CHARS:
                    found += flush(part)
                    part, size = [], 0
            found += flush(part)
            yield rows(found)
        yield rows(list(packer.close()))

    return tidied(run, keeps_caches=True)


def pack_documents(docs: DataFrame, model_path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. Null ids stay null, repeated rows are documents of
    their own, other columns are ignored. A long text gives as many full sequences as it fills. No exchange: each
    task packs the rows that it reads, and a lost task gives the same rows when it runs again."""
    text_batches(docs.sparkSession)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return body.mapInArrow(_pack(model_path, capacity), SCHEMA)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
