"""Best-fit packing of tokenized documents into sequences of bounded length.

A document's ids end with an end id.  A document longer than a sequence is cut
into full-length pieces, of which the first takes what is left over; others stay
whole.  Pieces are packed online into a fixed number of open bins: a bitset has a
bit for every amount of free space that some open bin has, so the best fit, the
open bin with the least free space that is enough, is the lowest set bit above the
piece's length.  A full bin closes at once; where a new bin is needed and all are
open, the fullest closes first.

Scale: tokenizing is map-only and only (doc_id, piece, length, crc) rows are
dealt out in turn to packers of about ``PIECES`` pieces each; a packer takes its pieces
as they arrive, in an order by a hash that knows nothing of lengths and is the same when a task
runs again.  Memory of a packer is its open bins.

Cases: a null text is an empty one: its only id is the end id; repeated rows are
packed as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import tokens
from heddle.session import cut

OPEN_BINS, PIECES = 1024, 100_000


class Bins:
    """Bounded-space best fit over bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, found = self.capacity, self.made
            self.made += 1
        if free > length:
            left = free - length
            self.by_free[left].append(found)
            self.mask |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        self.open -= 1
        if not stack:
            self.mask &= ~(1 << free)
        return found


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones after a first that may be shorter."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    """(doc_id, text) to one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.cache(path)
        for batch in batches:
            for lo, hi, ids, lens in cache.encode_column(batch.column("text"), end):
                out: list[list] = [[], [], [], [], []]
                at = 0
                for doc, n in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), lens.tolist()):
                    for k, (s, length) in enumerate(cut_points(n, capacity)):
                        out[0].append(doc)
                        out[1].append(k)
                        out[2].append(s)
                        out[3].append(length)
                        out[4].append(zlib.crc32(ids[at + s : at + s + length]))
                    at += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def pack(found: DataFrame, capacity: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """Piece rows with the sequence each goes to and its place there."""
    found = cut(found)
    packers = max(1, -(-found.count() // PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, part = Bins(capacity, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(placed[:, 0] + (part << 32)), pa.array(placed[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    dealt = found.repartition(packers).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInArrow(run, PIECE_SCHEMA + ", sequence_id long, offset long")


CAPACITY, END = 1024, 2


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, tokens.vocabulary("byte_bpe_50k.json"), END, CAPACITY), CAPACITY)


def op7_best_fit_packing(spark, sf_dir):
    from heddle.sources.tables import load

    return pack_documents(load(spark, sf_dir, "documents"))
