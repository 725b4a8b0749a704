"""Matrices as (i, j, v) tables and as row-major arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(rows: DataFrame, row_id: str, values: str) -> DataFrame:
    """One array a row to (i, j, v)."""
    return rows.select(F.col(row_id).alias("i"), F.posexplode(values).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a times b, any shapes that fit: a join on the inner index and a sum, combined before the shuffle."""
    left = a.select(F.col("i").alias("i"), F.col("j").cast("long").alias("inner"), F.col("v").alias("x"))
    right = b.select(F.col("i").cast("long").alias("inner"), F.col("j").alias("j"), F.col("v").alias("y"))
    return left.join(right, "inner").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same cells."""
    differ = a.exceptAll(b).union(b.exceptAll(a))
    return differ.agg((F.count("*") == 0).alias("equal"))


def element(flat: Column, columns: int, r: Column, c: Column) -> Column:
    """m[r, c] of a row-major array."""
    return F.element_at(flat, (r * columns + c + 1).cast("int"))
