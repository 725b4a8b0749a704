"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Rows are vectors of integer weights, taken as sparse: a term is a position with
a nonzero weight.  A block of rows is turned into postings, per term the rows
that hold it and their weights.  Each query row scatters weight times weight of
its own terms, one term after another, into a dense array of scores, one score a
row of the block; the k best are taken by partial selection and ordered by score
and id.  Winners of the blocks of a query are merged by a bounded window.

Scale: rows fall into row blocks and queries into query blocks by a hash of their
id; each pair of blocks is one bounded task group (``row_block`` x ``query_block``
scores in slices of ``slice_scores``), so neither side is ever collected or
broadcast.  The work is the product of the two sides by definition.  Hot ids or
equal vectors do no harm: blocks are dealt by id, and repeated rows spread by a
hash of id and vector.

Cases: vectors that are null or hold null, NaN or infinite components take no part;
vectors of different lengths share the positions they both have; fewer than k
candidates give fewer rows; ties go to the smaller id; ids of queries and rows that
are null take no part.  Scores are exact: where 64-bit sums could overflow, Python
integers are used and a score outside 64 bits is set to the nearest bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_BLOCK, QUERY_BLOCK = 8192, 2048
LONG = 2**63


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Without rows whose vector is null or holds null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(F.col(vec).isNotNull() & ~F.exists(F.col(vec), bad))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a dense matrix, short lists padded by zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    n = len(lists)
    lens = np.diff(lists.offsets.to_numpy()) if n else np.zeros(0, dtype=int)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(lens.max()) if n else 0
    if n and (lens == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term: the rows that hold it, and their weights."""
    found = [np.nonzero(rows[:, t])[0] for t in range(rows.shape[1])]
    return [(at, rows[at, t]) for t, at in enumerate(found)]


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of one query against a block, term at a time."""
    scores = np.zeros(n, dtype=query.dtype)
    for t in np.nonzero(query)[0]:
        if t < len(lists):
            at, weight = lists[t]
            if len(at) == n:
                scores += query[t] * weight
            else:
                scores[at] += query[t] * weight
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        if scores.dtype == object:
            kth = sorted(scores, reverse=True)[k - 1]
        else:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= kth)[0]
    else:
        at = np.arange(len(scores))
    by_id = at[np.argsort(ids[at], kind="stable")]
    return by_id[np.argsort(-scores[by_id], kind="stable")][:k]


def search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    q_ids, r_ids = queries["id"].to_numpy(), rows["id"].to_numpy()
    q, r = np.floor(256.0 * matrix(queries["vec"]).astype(np.float64)), np.floor(256.0 * matrix(rows["vec"]).astype(np.float64))
    top = lambda m: float(np.abs(m).max()) if m.size else 0.0
    wide = top(q) * top(r) * max(q.shape[1], 1) >= 2.0**62 or top(q) >= 2.0**62 or top(r) >= 2.0**62
    exact = (lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)) if wide else (lambda m: m.astype(np.int64))
    q, r = exact(q), exact(r)
    lists = postings(r)
    out: list[list] = [[], [], []]
    for i, query in enumerate(q):
        scores = accumulate(query, lists, len(r))
        at = best(scores, r_ids, k + 1)
        at = at[r_ids[at] != q_ids[i]] if (r_ids[at] == q_ids[i]).any() else at
        if len(at) < min(k, len(r)) and (r_ids == q_ids[i]).sum() > 1:
            others = np.nonzero(r_ids != q_ids[i])[0]
            at = others[best(scores[others], r_ids[others], k)]
        at = at[:k]
        out[0] += [q_ids[i]] * len(at)
        out[1] += r_ids[at].tolist()
        out[2] += [min(max(int(s), -LONG), LONG - 1) for s in scores[at]]
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, rows: DataFrame, k: int, n_queries: int, n_rows: int) -> DataFrame:
    """(id, vec) against (id, vec): query_id, rank, vec_id and score, the query's own id left out."""
    row_blocks, query_blocks = -(-max(n_rows, 1) // ROW_BLOCK), -(-max(n_queries, 1) // QUERY_BLOCK)
    deal = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "vec", deal(query_blocks).alias("qb"), each(row_blocks).alias("rb"))
    right = rows.select("id", "vec", deal(row_blocks).alias("rb"), each(query_blocks).alias("qb"))
    found = (
        left.groupBy("qb", "rb")
        .cogroup(right.groupBy("qb", "rb"))
        .applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score long")
    )
    return merge(found, k)


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query, ranked from 1; each block sent k at most."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_topk(spark, sf_dir):
    from heddle.sources.tables import load

    rows = usable(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "vec").filter("id IS NOT NULL")
    queries = rows.filter("id % 50 = 0")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % 50 == 0).alias("q")).first()
    return top_k(queries, rows, 5, counts["q"], counts["n"])


OP2_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
  FROM ints q JOIN ints r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
