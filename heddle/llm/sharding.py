"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; the r-th of n rows (from 0) gets
the fractional rank (2r + 1) / 2n.  All rows are sorted by fractional rank and
the sequence is cut into shards whose row counts differ by one at most (law
``rows``), so each shard holds every source in its share of the whole.

Scale: both global orders are a count of earlier groups plus a row number inside
a group.  The groups are key prefixes within a source and slices of the rank
axis, their number growing with the rows, so no window holds a whole source, and the order key
is of id and text, so rows that share an id are spread too.  Only group counts are carried across groups.

Cases: a null text counts as empty (size 1, crc32 0); a null source is a stratum
of its own; repeated rows are separate rows; an empty table gives an empty
result; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.mixing import order_key, prefix_length
from heddle.session import cut

def interleave(rows: DataFrame, shards: int, keep: list[str]) -> DataFrame:
    """Columns (id, src, key, *keep) in; id, *keep, shard and slot out."""
    rows = cut(rows.select("id", "src", "key", *keep))
    prefix = prefix_length(rows.count())
    cuts = 16**prefix
    rows = rows.withColumn("grp", F.substring("key", 1, prefix))
    earlier = Window.partitionBy("src").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        rows.groupBy("src", "grp")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("src").alias("g_src"),
            F.col("grp").alias("g_grp"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy("src")).alias("of"),
        )
    )
    inside = F.row_number().over(Window.partitionBy("src", "grp").orderBy("key", "id", *keep)) - 1
    ranked = rows.withColumn("inside", inside).join(groups, F.col("src").eqNullSafe(F.col("g_src")) & (F.col("grp") == F.col("g_grp")))
    odd = 2 * (F.col("before") + F.col("inside")) + 1
    ranked = cut(
        ranked.select(
            "id", "src", "key", *keep,
            (odd.cast("double") / (2 * F.col("of")).cast("double")).alias("rank"),
            F.floor((odd * cuts) / (2 * F.col("of"))).cast("long").alias("slice"),
        )
    )
    axis = Window.orderBy("slice")
    slices = (
        ranked.groupBy("slice")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("slice").alias("s_slice"),
            F.coalesce(F.sum("n").over(axis.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("slice_before"),
            F.sum("n").over(axis.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        )
    )
    at = F.row_number().over(Window.partitionBy("slice").orderBy("rank", F.col("src").asc_nulls_last(), "key", "id", *keep)) - 1
    placed = ranked.withColumn("at", at).join(slices, F.col("slice") == F.col("s_slice")).withColumn("pos", F.col("slice_before") + F.col("at"))
    shard = F.expr(f"(pos * {shards}) div total")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("pos") - start).cast("long")).select("id", *keep, F.col("shard").cast("int").alias("shard"), "slot")


SEED, SHARDS = "shard-1", 16


def op5_stratified_shards(spark, sf_dir):
    from heddle.sources.tables import load

    docs = load(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("src"),
        order_key(SEED, F.col("doc_id"), F.col("text")).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = interleave(rows, SHARDS, ["size", "text_crc32"])
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# crc32 by its definition: eight shifts a byte with the reflected polynomial, as a table of 256 entries made by SQL.
OP5_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
sized AS (
  SELECT doc_id, source AS src, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
         CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','),
                 lambda h: CASE WHEN h = '' THEN CAST(-1 AS BIGINT) ELSE CAST('0x' || h AS BIGINT) END)),
             lambda c, b: CASE WHEN b < 0 THEN c ELSE xor(tab[(xor(c, b) & 255) + 1], c >> 8) END), 4294967295) AS text_crc32
  FROM documents, crc_table),
ranked AS (
  SELECT *, CAST(2 * (row_number() OVER (PARTITION BY src ORDER BY key, doc_id, size, text_crc32) - 1) + 1 AS DOUBLE)
            / CAST(2 * count(*) OVER (PARTITION BY src) AS DOUBLE) AS rank
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (ORDER BY rank, src NULLS LAST, key, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * {SHARDS} // total AS INTEGER) AS shard,
       CAST(pos - ((pos * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
