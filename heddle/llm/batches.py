"""Arrow batches in smaller parts, so that a worker holds little text at a time.

Spark bounds a batch by rows and bytes (spark.sql.execution.arrow.maxBytesPerBatch); the session's settings stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_by_hash(df: DataFrame, columns: list[str], n: int, total: int) -> DataFrame:
    """At most n of ``total`` rows, those with the smallest hash of ``columns``.

    Rows that cannot be among them, but for a vanishing chance, are left out where they are read,
    so what a single task sorts does not grow with the input.
    """
    h = F.xxhash64(*columns)
    share = (n + 10 * n**0.5 + 100) / max(total, 1)
    if share < 1:
        df = df.filter(h < F.lit(int(2**64 * share) - 2**63))
    return df.orderBy(h, *columns).limit(n)


def parts(column: pa.Array, chars: int = 1 << 20, rows: int = 1000) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of parts of a text column: about ``chars`` bytes and at most ``rows`` rows, one row at least."""
    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    lo = 0
    while lo < len(column):
        reach = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars, side="right"))
        hi = min(max(lo + 1, reach), lo + rows, len(column))
        yield lo, hi
        lo = hi


def text_parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Every batch in parts, each with its texts."""
    for batch in batches:
        for lo, hi in parts(batch.column(column)):
            part = batch.slice(lo, hi - lo)
            yield part, part.column(column).to_pylist()
        del batch
        pa.default_memory_pool().release_unused()  # a worker lives on after its task
