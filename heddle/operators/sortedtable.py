"""Sorted tables: block packing, sparse block index, Bloom membership, sorted Parquet files.

A sorted table of the log-structured kind covers one range of keys.  Tables are built apart
from each other; within one, items are packed into blocks in key order until a block's
size first exceeds the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.names import fresh
from heddle.session import cut

# Fixed values of the format.
ENTRY_BYTES, TARGET_BYTES, BITS_PER_KEY = 8, 4000, 10
FNV_OFFSET_HIGH, FNV_OFFSET_LOW, FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
LOW32 = 0xFFFFFFFF

MOST_STARTS = 100_000  # rows of 40 bytes and a table's name that are broadcast; more are joined by a shuffle


def item_size(key: Column, value: Column) -> Column:
    return F.lit(ENTRY_BYTES) + F.octet_length(key) + F.octet_length(value)


def entries(sizes: np.ndarray, target: int) -> tuple[list[int], list[int], list[int]]:
    """What a range of a table does to the block that is open before it, whatever that block holds.

    With ``held`` bytes before, the first entry whose limit ``held`` exceeds applies: so many blocks begin in the
    range, and so many bytes are in the last.  Without such an entry none begins.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    m = len(sizes)
    after = np.searchsorted(before, before[:-1] + target, side="right")  # where the block that begins at an item ends
    _, firsts = np.unique(before[: min(int(np.searchsorted(before, target, side="right")) + 1, m)], return_index=True)
    known: dict[int, tuple[int, int]] = {}
    for first in firsts.tolist():
        path, at = [], first
        while at < m and at not in known:
            path.append(at)
            at = int(after[at])
        for i in reversed(path):
            begun, last = known[at] if at < m else (0, int(before[m] - before[i]))
            known[i], at = (begun + 1, last), i
    return [int(target - before[j]) for j in firsts], [known[j][0] for j in firsts.tolist()], [known[j][1] for j in firsts.tolist()]


def pack_blocks(items: DataFrame, table: str, key: str, size: str, target: int = TARGET_BYTES) -> DataFrame:
    """(table, key, size) with the block of each item, from 0 in each table; a null size counts as 0.

    A fold by nature, as every block begins where the one before overflowed; it is folded in key ranges, so a table is
    many tasks.  Each range tells what it does to any block that comes into it (at most ``target`` + 1 cases), one
    pass over these rows, one a range and table, finds what does come in, and the ranges are folded from there.
    """
    part, held, block = fresh(["part_", "held_", "block_"], items)
    rows = items.select(table, key, size).repartitionByRange(table, key).sortWithinPartitions(table, key)
    rows = cut(rows.withColumn(part, F.spark_partition_id()))
    kinds = dict(rows.dtypes)
    own = f"`{part}` int, `{table}` {kinds[table]}"

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sizes = None, []

        def row() -> pd.DataFrame:
            whole = np.concatenate(sizes)
            limits, begun, last = entries(whole, target)
            name = None if pd.isna(current[1]) else current[1]
            return pd.DataFrame({part: [current[0]], table: pd.Series([name], dtype=object), "total": [int(whole.sum())], "limits": [limits], "begun": [begun], "last": [last]})

        for found in batches:
            for at, group in found.groupby([part, table], sort=False, dropna=False):
                if current is not None and not same(current, at):
                    yield row()
                    sizes = []
                current = at
                sizes.append(group[size].fillna(0).to_numpy(dtype=np.int64))
        if sizes:
            yield row()

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, filled, number = None, 0, 0
        for found in batches:
            out = []
            for p, t, total, limits, begun, last in found.itertuples(index=False):
                if current is None or not same(current, (t,)):
                    current, filled, number = (t,), 0, 0
                out.append((p, None if pd.isna(t) else t, filled, number))
                j = next((j for j, limit in enumerate(limits) if filled > limit), None)
                filled, number = (filled + total, number) if j is None else (int(last[j]), number + int(begun[j]))
            yield pd.DataFrame(out, columns=[part, table, held, block]).astype({table: object})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, filled = None, 0, 0
        for found in batches:
            blocks = []
            for p, t, s, into, first in zip(found[part], found[table], found[size].fillna(0), found[held], found[block]):
                if current is None or not same(current, (p, t)):
                    current, number, filled = (p, t), first, into
                if filled > target:
                    number, filled = number + 1, 0
                filled += s
                blocks.append(number)
            yield found[[table, key, size]].assign(block=pd.Series(blocks, index=found.index, dtype="int32"))

    ranges = rows.select(part, table, size).mapInPandas(summarise, f"{own}, total long, limits array<long>, begun array<long>, last array<long>")
    starts = cut(ranges.repartition(table).sortWithinPartitions(table, part).mapInPandas(carry, f"{own}, `{held}` long, `{block}` long"))
    small = starts.count() <= MOST_STARTS
    s = (F.broadcast(starts) if small else starts).withColumnsRenamed({part: f"{part}s", table: f"{table}_s{part}"})
    joined = rows.join(s, (rows[part] == s[f"{part}s"]) & rows[table].eqNullSafe(s[f"{table}_s{part}"]))
    joined = joined if small else joined.repartition(part)
    ordered = joined.select(part, table, key, size, held, block).sortWithinPartitions(part, table, key)
    return ordered.mapInPandas(fold, f"`{table}` {kinds[table]}, `{key}` {kinds[key]}, `{size}` {kinds[size]}, block int")


def same(a: tuple, b: tuple) -> bool:
    """Whether two rows are equal, nulls being equal to each other."""
    return all(x == y or pd.isna(x) and pd.isna(y) for x, y in zip(a, b))


def block_index(packed: DataFrame, table: str, key: str, size: str) -> DataFrame:
    """One row a block: first and last key, items and bytes."""
    return packed.groupBy(table, "block").agg(
        F.min(key).alias("start_key"), F.max(key).alias("end_key"), F.count("*").alias("items"), F.sum(size).cast("long").alias("bytes")
    )


def block_offsets(index: DataFrame, table: str) -> DataFrame:
    """The block index with ``offset``: the bytes of the table's blocks before."""
    before = Window.partitionBy(table).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long"))


def bloom_bits(n: Column, bits_per_key: int = BITS_PER_KEY) -> Column:
    """Bits of a filter for n keys: at least 64, rounded up to whole 64-bit words."""
    bits = F.greatest(n * bits_per_key, F.lit(64))
    return (F.floor((bits + 63) / 64) * 64).cast("long")


def bloom_bytes(n: Column, bits_per_key: int = BITS_PER_KEY) -> Column:
    return (bloom_bits(n, bits_per_key) / 8).cast("long")


def bloom_hashes(bits_per_key: int = BITS_PER_KEY) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def fnv1(key: Column) -> Column:
    """64-bit FNV-1 of a string's bytes as a struct of its 32-bit halves (hi, lo).

    The prime is 2^40 + 435, so a product needs only 64-bit arithmetic on halves.
    """
    text = F.decode(F.encode(key, "UTF-8"), "ISO-8859-1")  # a character a byte
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(FNV_OFFSET_HIGH).cast("long").alias("hi"), F.lit(FNV_OFFSET_LOW).cast("long").alias("lo"))

    def step(h: Column, at: Column) -> Column:
        byte = F.ascii(F.substring(text, at, F.lit(1))).cast("long")
        low = h["lo"] * FNV_PRIME_LOW
        high = h["hi"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(h["lo"], 8)
        return F.struct(high.bitwiseAND(F.lit(LOW32)).alias("hi"), low.bitwiseAND(F.lit(LOW32)).bitwiseXOR(byte).alias("lo"))

    return F.aggregate(places, start, step)


def bloom_positions(keys: DataFrame, key: str, bits: Column, hashes: int) -> DataFrame:
    """One row a key and hash number: i and position."""
    (h,) = fresh(["h_"], keys)
    hashed = keys.withColumn(h, fnv1(F.col(key)))
    position = (F.col(f"{h}.lo") + F.col("i") * F.col(f"{h}.hi")) % bits
    return hashed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1)))).withColumn("position", position.cast("long")).drop(h)


def write_sorted(df: DataFrame, key: str, path: str, partitions: int | None = None) -> None:
    """Range-partitioned, sorted Parquet with a Bloom filter on the key; by default AQE sizes the ranges."""
    ranged = df.repartitionByRange(key) if partitions is None else df.repartitionByRange(partitions, key)
    (
        ranged.sortWithinPartitions(key)
        .write.option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", "1000000")
        .mode("overwrite")
        .parquet(path)
    )
