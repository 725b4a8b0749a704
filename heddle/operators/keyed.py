"""Ordered keyed tables: upsert, delete, lookup, range scan, floor and ceiling.

A table is a DataFrame with unique keys; a change log has a key and a sequence number.  All
operators return new DataFrames and leave their inputs as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.names import fresh


def upsert(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """Last write per key wins; ``inserted_at`` is the sequence number of the write that was new.

    One hash aggregate (max_by), combined before the shuffle, so a hot key costs one row a task.
    """
    values = [c for c in log.columns if c != key]
    last = F.max_by(F.struct(*values), F.col(sequence)).alias("last")
    return log.groupBy(key).agg(last, F.min(sequence).alias("inserted_at")).select(key, "last.*", "inserted_at")


def put_flags(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """Every write with ``inserted``: whether the key was new."""
    firsts = log.groupBy(F.col(key).alias("first_key")).agg(F.min(sequence).alias("first_seq"))
    return log.join(firsts, F.col(key).eqNullSafe(F.col("first_key"))).withColumn("inserted", F.col(sequence) == F.col("first_seq")).drop("first_key", "first_seq")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``; only equal keys are deleted."""
    return table.join(keys, key, "left_anti")


def delete_flags(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every key to delete, once, with ``existed``: whether the table had it."""
    (there,) = fresh(["there"], table, keys)
    known = table.select(key).distinct().withColumn(there, F.lit(True))
    return keys.select(key).distinct().join(known, key, "left").select(key, F.coalesce(there, F.lit(False)).alias("existed"))


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value))


def range_scan(table: DataFrame, key: str, low, high) -> DataFrame:
    """Rows from low to high, both inclusive, in key order."""
    return table.filter(F.col(key).between(low, high)).orderBy(key)


def asof(probes: DataFrame, keys: DataFrame, probe: str, key: str, backward: bool, width: Column | None = None) -> DataFrame:
    """Probes with ``match``: the greatest key <= probe (floor) or the least key >= probe (ceiling).

    Probes and keys are merged in order within ranges that the keys are cut into, and what a range
    lacks on its open side comes from the nearest non-empty range, so no task sorts all rows.
    A probe whose value is null stays, without a match; null keys match nothing.
    ``width`` maps a value to the number of its range and must grow with it; without it there is one range.
    """
    cell = (lambda c: F.lit(0)) if width is None else width
    at, own, where, edge, e_where, outside, inside = fresh(["at_", "key_", "cell_", "edge_", "edge_cell_", "outside_", "inside_"], probes)
    both = probes.select(*probes.columns, F.col(probe).alias(at), F.lit(None).cast(dict(keys.dtypes)[key]).alias(own))
    known = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias(at), F.col(key).alias(own)).distinct()
    both = both.unionByName(known, allowMissingColumns=True).withColumn(where, cell(F.col(at)))
    best = F.max if backward else F.min
    edges = both.groupBy(where).agg(best(own).alias(edge))
    around = Window.orderBy(where if backward else F.col(where).desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    edges = edges.select(F.col(where).alias(e_where), F.last(edge, ignorenulls=True).over(around).alias(outside))
    order = [F.col(at).asc() if backward else F.col(at).desc(), F.col(own).asc_nulls_last()]
    within = Window.partitionBy(where).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn(inside, F.last(own, ignorenulls=True).over(within)).join(edges, F.col(where).eqNullSafe(F.col(e_where)))
    found = F.when(F.col(at).isNotNull(), F.coalesce(inside, outside))
    return merged.filter(F.col(own).isNull()).select(*probes.columns, found.alias("match"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by byte order."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
