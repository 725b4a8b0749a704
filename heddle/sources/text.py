"""Text files and literal rows as sources, and whether a path exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, limit: int = 0, name: str = "value") -> DataFrame:
    """One row a line; at most ``limit`` of them, 0 for all."""
    found = spark.read.text(path).select(F.col("value").alias(name))
    return found.limit(limit) if limit else found


def first_line(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    return lines(spark, path, 1, name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows given in the program, as a table."""
    return spark.createDataFrame(rows, schema)
