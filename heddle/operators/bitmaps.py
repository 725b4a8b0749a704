"""Integer sets as bitmaps: build, membership, algebra, containers and run-length coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARRAY_LIMIT = 4096  # a container with more entries is a bitmap


def build(values: DataFrame, x: str) -> DataFrame:
    """Bitmaps of 32,768 positions each: bucket and bits; combined before the shuffle."""
    return values.filter(F.col(x).isNotNull()).groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))


def cardinality(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.select("bucket", F.bitmap_count("bits").alias("members"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter("n = 2").drop("n")


def containers(values: DataFrame, x: str) -> DataFrame:
    """Distinct values by their high 16 bits, with the kind of container each bucket needs."""
    member = values.select(F.col(x).alias("v")).distinct()
    counts = member.groupBy(F.shiftright("v", 16).alias("bucket")).agg(
        F.count("*").alias("entries"), F.min(F.col("v").bitwiseAND(F.lit(65535))).alias("low"), F.max(F.col("v").bitwiseAND(F.lit(65535))).alias("high")
    )
    return counts.withColumn("kind", F.when(F.col("entries") > ARRAY_LIMIT, "bitmap").otherwise("array"))


def groups(values: DataFrame, x: str, width: int = 31) -> DataFrame:
    """Non-empty groups of ``width`` bits: group number and word, bit 0 the group's first value."""
    bit = F.expr(f"shiftleft(1L, cast(v % {width} AS int))")
    return values.select(F.col(x).alias("v")).filter("v IS NOT NULL").distinct().groupBy(F.floor(F.col("v") / width).cast("long").alias("grp")).agg(F.bit_or(bit).alias("word"))


def runs(grouped: DataFrame, width: int = 31, slice_groups: int = 1 << 20) -> DataFrame:
    """Word-aligned runs: kind ('fill0', 'fill1', 'literal'), start group, length in groups, word.

    Fills of zeros are the gaps between non-empty groups, so only non-empty groups
    are sorted, in slices of the axis; a table of one row a slice carries the last group before it over.
    """
    full = (1 << width) - 1
    kind = F.when(F.col("word") == full, "fill1").otherwise("literal")
    cell = F.floor(F.col("grp") / slice_groups)
    inside = Window.partitionBy("cell").orderBy("grp")
    rows = grouped.withColumn("cell", cell).withColumn("kind", kind)
    order = Window.orderBy("cell")  # one row a slice
    edges = rows.groupBy("cell").agg(F.max("grp").alias("last"), F.count_if(F.col("kind") == "fill1").alias("ones"))
    edges = edges.select(F.col("cell").alias("e_cell"), F.lag("last").over(order).alias("e_last"), (F.sum("ones").over(order) - F.col("ones")).alias("e_ones"))
    rows = rows.join(edges, F.col("cell") == F.col("e_cell"))
    rows = rows.withColumn("before", F.coalesce(F.lag("grp").over(inside) + 1, F.col("e_last") + 1, F.lit(0)))
    zeros = rows.filter("grp > before").select(F.lit("fill0").alias("kind"), F.col("before").alias("start"), (F.col("grp") - F.col("before")).alias("length"), F.lit(0).cast("long").alias("word"))
    ones = rows.filter("kind = 'fill1'").withColumn("island", F.col("grp") - F.col("e_ones") - F.row_number().over(inside))
    ones = ones.groupBy("island").agg(F.min("grp").alias("start"), F.count("*").alias("length"))
    ones = ones.select(F.lit("fill1").alias("kind"), "start", "length", F.lit(full).cast("long").alias("word"))
    literal = rows.filter("kind = 'literal'").select("kind", F.col("grp").alias("start"), F.lit(1).cast("long").alias("length"), "word")
    return zeros.union(ones).union(literal)


def decode(coded: DataFrame, width: int = 31) -> DataFrame:
    """Values of the runs, as x."""
    held = coded.filter("kind <> 'fill0'").withColumn("grp", F.explode(F.expr("sequence(start, start + length - 1)")))
    bits = held.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return bits.filter(F.expr("shiftright(word, bit) & 1") == 1).select((F.col("grp") * width + F.col("bit")).alias("x"))


def member(x: Column, word: Column) -> Column:
    return F.bit_get(word, x) == 1
