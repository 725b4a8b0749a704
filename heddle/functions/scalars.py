"""Scalar, text, encoding and array functions as Column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONE = 1.0471975512  # fixed value: a third of pi


def wrap(x: Column, bits: int) -> Column:
    """x modulo 2^bits, for unsigned arithmetic in longs."""
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def negate(x: Column, bits: int) -> Column:
    """Two's complement negation in ``bits`` bits."""
    return wrap(F.bitwise_not(x) + 1, bits)


def cone_volume(radius: Column, height: Column) -> Column:
    return radius * radius * height * CONE


def sum_to_n(n: Column, bits: int = 8) -> Column:
    """1 + .. + n with a wrap after each step."""
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: wrap(a + x, bits))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def pangram(text: Column) -> Column:
    """Whether all 26 letters occur, in either case; the search stops at the first that does not."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [low.contains(chr(c)) for c in range(ord("a"), ord("z") + 1)])


def detab(text: Column, stop: int = 8) -> Column:
    """Tabs as spaces up to the next stop, columns counted from each line's start."""
    fill = lambda acc, part: F.concat(F.rpad(acc, F.expr(f"{stop}") * (F.floor(F.length(acc) / stop) + 1), " "), part)
    line = lambda x: F.aggregate(F.slice(F.split(x, "\t"), 2, 1 << 30), F.split(x, "\t")[0], fill)
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def entab(text: Column, stop: int = 8) -> Column:
    """Blanks before each tab stop as tabs; a single blank stays; nulls stay null."""

    def line(x: Column) -> Column:
        cells = F.regexp_extract_all(x, F.lit(f"(?s)(.{{{stop}}}|.+)"), F.lit(1))
        return F.array_join(F.transform(cells, lambda c: F.when((F.length(c) == stop) & c.endswith("  "), F.concat(F.rtrim(c), F.lit("\t"))).otherwise(c)), "")

    return F.array_join(F.transform(F.split(detab(text, stop), "\n"), line), "\n")


@F.pandas_udf(T.LongType())
def _bits(values: pd.Series) -> pd.Series:
    return pd.Series(values.to_numpy(dtype=np.float64).view(np.int64))


def float_bits(value: Column) -> Column:
    """The IEEE-754 bits of a double as a long; null for null."""
    return F.when(value.isNotNull(), _bits(value))


def least_value(bits: int) -> int:
    """The least number of two's complement in ``bits`` bits."""
    return -(1 << (bits - 1))


def checked_add(a: Column, b: Column) -> Column:
    """The sum in the columns' own type, null where it does not fit."""
    return F.try_add(a, b)


def fibonacci(n: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    step = lambda acc, _: F.struct(acc["b"].alias("a"), (acc["a"] + acc["b"]).alias("b"))
    steps = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda acc: acc["a"])


def area(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "rect", a * b).otherwise(F.pi() * a * a)


def perimeter(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "rect", 2 * (a + b)).otherwise(2 * F.pi() * a)
