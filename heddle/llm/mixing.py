"""Mixing sources to target weights: capped water-filling with seeded repetitions.

Built from DataFrame functions only.  Sources get shares of the total size in
proportion to their weights; a target above ``max_epochs`` times its source's
size is clamped there and the excess goes to the others by weight, until no
target is above its cap.  The fixed point has a closed form: with sources sorted
by cap/weight, a source is clamped exactly if its cap does not exceed its share
of what the sources before it have left.

Each document is taken ``target div source size`` whole times, and the rest of
the target is filled in the source's seeded order of documents; the document in
which the target ends is taken in part.  So a source's taken words are its
target rounded to a whole word.

Scale: the seeded order is a running sum inside (source, key prefix) groups, with
so many prefixes that a group has about ``GROUP`` rows even if one source has all of them; only the
sums of the groups and of the sources are carried across groups: one row a group
of a source in a task, and one row a source in the task that orders sources.  Nothing is collected.

Cases: a null text has size 0 and is taken 0 times; a null source is a source of
its own, last in the order; rows that are repeated in full are separate
documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import cut

GROUP = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str, doc_id: Column, text: Column | None = None) -> Column:
    """A seeded order; with the text, rows that share an id, or have none, are spread as well."""
    parts = [F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))]
    if text is not None:
        parts += [F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    return F.md5(F.concat(*parts).cast("binary"))


def prefix_length(rows: int) -> int:
    """Hexadecimal digits of the order key that make up a group: about ``GROUP`` rows a group, and 4096 groups a source at least."""
    return max(3, math.ceil(math.log(max(rows, 1) / GROUP, 16)))


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(src, source_size) to one row a source with its target.

    Sources in code-point order, null last, get ``weights`` cyclically.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (nth + 1).cast("int")).cast("long")
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two longs need more than 64 bits
    levels = (
        sizes.select("src", "source_size", w.alias("w"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .select(
            "*",
            F.sum("source_size").over(everything).alias("total"),
            F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
            F.sum("w").over(onward).alias("w_onward"),
        )
        .withColumn("clamped", big(F.col("cap")) * big(F.col("w_onward")) <= big(F.col("total") - F.col("cap_before")) * big(F.col("w")))
        .select(
            "*",
            F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0)).alias("cap_all"),
            F.sum(F.when(~F.col("clamped"), F.col("w"))).over(everything).alias("w_free"),
        )
    )
    free = ((F.col("total") - F.col("cap_all")) * F.col("w")).cast("double") / F.col("w_free").cast("double")
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(free)
    return levels.select("src", "source_size", target.alias("target")).withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Columns (id, src, size, key) in; the same with source_size, target and taken out.

    ``key`` is the seeded order: equal keys fall back on id and size.
    """
    sized = cut(sized.select("id", "src", "size", "key"))
    sized = sized.withColumn("grp", F.substring("key", 1, prefix_length(sized.count())))
    groups = sized.groupBy("src", "grp").agg(F.sum("size").alias("group_size"))
    per_source = Window.partitionBy("src")
    earlier = per_source.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        F.col("src").alias("g_src"),
        F.col("grp").alias("g_grp"),
        F.coalesce(F.sum("group_size").over(earlier), F.lit(0)).alias("size_before"),
    )
    plan = source_plan(sized.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    plan = plan.select(F.col("src").alias("p_src"), "source_size", "target", "take")
    offsets = groups.join(plan, F.col("g_src").eqNullSafe(F.col("p_src")))
    inside = Window.partitionBy("src", "grp").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("src").eqNullSafe(F.col("g_src")) & (F.col("grp") == F.col("g_grp"))
    )
    filled = F.col("source_size") > 0
    whole = F.when(filled, F.floor(F.col("take") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("take") - F.col("whole") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("size_before") - F.col("inside"), F.lit(0)), F.col("size"))
    return (
        placed.withColumn("whole", whole)
        .withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long"))
        .select("id", "src", "size", "key", "source_size", "target", "whole", "taken")
    )


SEED = "mix-1"


def op9_mix_sources(spark, sf_dir):
    from heddle.sources.tables import load

    docs = load(spark, sf_dir, "documents")
    sized = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("src"), words(F.col("text")).alias("size"), order_key(SEED, F.col("doc_id"), F.col("text")).alias("key")
    )
    return mix(sized).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY src),
levels AS (
  SELECT src, source_size, w, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_onward
  FROM sources WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, src NULLS LAST)),
clamps AS (SELECT *, cap * w_onward <= (total - cap_before) * w AS clamped FROM levels),
plan AS (
  SELECT src, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST((total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)) * w AS DOUBLE)
                   / CAST(sum(CASE WHEN NOT clamped THEN w END) OVER () AS DOUBLE) END AS target
  FROM clamps),
takes AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take FROM plan),
placed AS (
  SELECT doc_id, size, source_size, target, take,
         coalesce(sum(size) OVER (PARTITION BY s.src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN takes t ON s.src IS NOT DISTINCT FROM t.src)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (take // source_size) * size
            + least(greatest(take % source_size - before, 0), size) END AS BIGINT) AS taken
FROM placed
"""
