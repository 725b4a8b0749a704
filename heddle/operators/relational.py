"""Single-table relational operators: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.names import fresh


def project(df: DataFrame, positions: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Positional projection with reorder and duplicates; each output gets a name of its own."""
    return df.select(*[F.col(df.columns[i]).alias(n) for i, n in zip(positions, names, strict=True)])


COMPARE = {"=": Column.__eq__, ">": Column.__gt__, "<": Column.__lt__}


def where(df: DataFrame, column: str, op: str, value: str) -> DataFrame:
    """One comparison of a column with a constant; nulls never qualify."""
    return df.filter(COMPARE[op](F.col(column), F.lit(value)))


def sort(df: DataFrame, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """Order by several columns, all in one direction."""
    return df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in columns])


def top(df: DataFrame, columns: Sequence[str], n: int, descending: bool = False) -> DataFrame:
    """The first n rows of sort(): planned as TakeOrderedAndProject, never a full sort."""
    return sort(df, columns, descending).limit(n)


def shuffled(df: DataFrame, key: str, seed: str, place: str) -> DataFrame:
    """A seeded random order of unique keys: each row with its place from 1.

    Places are counts of the hash prefixes before a row's own, plus a row number within it.
    """
    h, g, n, gg, before, at = fresh(["h_", "g_", "n_", "gg_", "before_", "at_"], df)
    rows = df.withColumn(h, F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))).withColumn(g, F.substring(h, 1, 3))
    earlier = Window.orderBy(g).rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    groups = rows.groupBy(g).agg(F.count("*").alias(n)).select(F.col(g).alias(gg), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(g).orderBy(h, key))
    return rows.withColumn(at, inside).join(groups, F.col(g) == F.col(gg)).select(*df.columns, (F.col(before) + F.col(at)).alias(place))
