"""Runs do not depend on the slices they are worked on in."""

from heddle.operators import bitmaps


def test_runs_cross_slices(spark):
    values = [*range(0, 31), *range(31 * 45, 31 * 56), 31 * 60 + 3, 31 * 500 + 1]
    coded = bitmaps.runs(bitmaps.groups(spark.createDataFrame([(v,) for v in values], "x long"), "x"), 31, 50)
    got = sorted((r["start"], r["kind"], r["length"]) for r in coded.collect())
    assert got == [(0, "fill1", 1), (1, "fill0", 44), (45, "fill1", 11), (56, "fill0", 4), (60, "literal", 1), (61, "fill0", 439), (500, "literal", 1)]
