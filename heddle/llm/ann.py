"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

A tree has random directions, orthogonal to each other, one a level, and splits a node at the median of a
sample.  A query walks all trees at once through one priority queue of nodes: the most promising node
comes out first, by the probability that a neighbour lies below it, taken as a normal around the query's own
projection whose width comes from how near the neighbours of sampled vectors are.  The walk ends when the
probability that no visited leaf holds a neighbour falls to a threshold.  Rows in visited leaves are
candidates, and only they are scored: exactly, in double precision, on the original vectors.

For inner products the forest sees vectors with one more coordinate,
sqrt(M^2 - |x|^2) for rows (M the largest length) and 0 for queries, so the nearest
by angle is the largest by inner product.

Fitting uses a bounded sample: ``SAMPLE`` different vectors at most, those with the smallest hash.
``PROBES`` of them are searched by brute force within the sample, and the threshold is set so that walks
find ``recall`` of their neighbours.  So the work follows the data: vectors without any structure need
a third to a half of all rows, clustered ones a few hundredths.  Every row is indexed.

Scale: rows with equal id and vector are one, and of equal vectors only the k + 1 smallest ids can be
among any query's k, so the others are left out before the join (a window with a group limit:
a task sends k + 1 rows a vector at most).  Each row goes to its leaf in each tree and each query to
the subtrees that it visits; they meet by subtree.  A subtree of more than ``CELL`` values is cut by a hash,
so is one with more than ``QUERIES`` queries; a task holds one such cell of rows and streams queries past it,
and returns at most k rows of a cell for a query.

Cases: vectors that are null, zero or hold null or non-finite components take no part; fewer than k
candidates give fewer rows; ties go to the smaller id; repeated rows are all candidates; queries of one id and
different vectors are one query, a candidate having its best score; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.batches import smallest_by_hash
from heddle.llm.exact_topk import matrix, usable
from heddle.session import cut

TREES, SAMPLE, LEAF, PROBES, RECALL = 12, 16384, 32, 128, 0.95
CELL, QUERIES, HELD, WALKS = 1 << 21, 1 << 16, 1 << 20, 256  # values of a cell, queries of a cell, scores held, queries a task walks


class Forest:
    """Complete binary trees of equal depth over lifted vectors: directions a level, medians in level order."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.depth, self.trees, self.width = min(depth, width), trees, width
        self.directions = np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0][:, : self.depth] for _ in range(trees)])
        self.medians = np.zeros((trees, 2**self.depth - 1))
        for t in range(trees):
            seen, node = sample @ self.directions[t], np.zeros(len(sample), dtype=np.int64)
            for level in range(self.depth):
                order = np.argsort(node, kind="stable")
                for group in np.split(order, np.nonzero(np.diff(node[order]))[0] + 1) if len(order) else []:
                    self.medians[t, 2**level - 1 + node[group[0]]] = np.median(seen[group, level])
                node = self._step(t, level, node, seen)
        self.near, self.missed = 0.5, 0.0

    def _step(self, t: int, level: int, node: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return 2 * node + (seen[:, level] > self.medians[t, 2**level - 1 + node])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: (trees, rows)."""
        out = np.zeros((self.trees, len(rows)), dtype=np.int64)
        for t in range(self.trees):
            seen = rows @ self.directions[t]
            for level in range(self.depth):
                out[t] = self._step(t, level, out[t], seen)
        return out

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(probability that a neighbour has been missed so far, tree, leaf) in the order of visits."""
        seen = (query @ self.directions).tolist()
        spread = math.sqrt(2 * max(1.0 - self.near**2, 1e-6) / self.width)
        last, missed, mass = 2**self.depth - 1, 1.0, [0.0] * self.trees
        queue = [(-1.0, t, 0, 0) for t in range(self.trees)]
        medians = self.medians
        while queue:
            p, t, level, node = heapq.heappop(queue)
            if level == self.depth:
                before = max(1.0 - mass[t], 1e-12)
                mass[t] -= p
                missed *= max(1.0 - mass[t], 1e-12) / before
                yield missed, t, node - last
            else:
                right = 0.5 * math.erfc((medians[t, node] - self.near * seen[t][level]) / spread)
                heapq.heappush(queue, (p * right, t, level + 1, 2 * node + 2))
                heapq.heappush(queue, (p * (1.0 - right), t, level + 1, 2 * node + 1))

    def visit(self, query: np.ndarray) -> np.ndarray:
        """Leaves that one query visits, as flags (trees, leaves)."""
        flags = np.zeros((self.trees, 2**self.depth), dtype=bool)
        for missed, t, leaf in self.walk(query):
            flags[t, leaf] = True
            if missed < self.missed:
                break
        return flags

    def calibrate(self, sample: np.ndarray, k: int, recall: float) -> None:
        """Sets how near neighbours are and when a walk ends, by probes searched within the sample."""
        if recall >= 1 or len(sample) < 2:
            return
        k = min(k, len(sample) - 1)
        probes = lift_query(sample[: min(PROBES, len(sample)), :-1])
        found = probes @ sample.T
        found[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
        best = np.argsort(-found, axis=1)[:, :k]
        self.near = float(np.clip(np.take_along_axis(found, best, axis=1).mean(), 0.05, 0.999))
        at = self.leaves(sample)
        when = []
        for probe, rows in zip(probes, best):
            wanted: dict[tuple[int, int], list[int]] = {}
            for r in rows.tolist():
                for t in range(self.trees):
                    wanted.setdefault((t, int(at[t, r])), []).append(r)
            left = set(rows.tolist())
            for missed, t, leaf in self.walk(probe):
                here = left.intersection(wanted.get((t, leaf), ()))
                when += [missed] * len(here)
                left -= here
                if not left:
                    break
        self.missed = float(np.quantile(when, 1.0 - recall))


def lift(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows scaled by the longest, with the coordinate that makes all lengths 1."""
    rows = rows / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (rows * rows).sum(axis=1, keepdims=True)))
    return np.concatenate([rows, rest], axis=1)


def lift_query(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.concatenate([rows / np.where(lengths > 0, lengths, 1.0), np.zeros((len(rows), 1))], axis=1)


def padded(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


class Cell:
    """Rows of one cell by leaf; queries are searched in the leaves that they visit."""

    def __init__(self, parts: list[pa.RecordBatch], width: int, k: int):
        rows = pa.Table.from_batches(parts)
        leaf = rows["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.k, self.ids, self.rids = k, rows["id"].to_numpy()[order], rows["rid"].to_numpy()[order]
        self.rows = padded(matrix(rows["vec"]).astype(np.float64), width)[order]
        found, starts = np.unique(leaf[order], return_index=True)
        self.leaves = list(zip(found.tolist(), starts.tolist(), [*starts.tolist()[1:], len(leaf)]))
        self.longest = float(np.linalg.norm(self.rows, axis=1).max())

    def search(self, q_ids: np.ndarray, q: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of query, place of row, score): the k best candidates of each query, fewer if the leaves hold fewer."""
        slack = 1e-9 * np.linalg.norm(q, axis=1) * self.longest  # rounding of the rough scores
        worst = np.full(len(q), -np.inf)
        held, n = [], 0
        for leaf, lo, hi in self.leaves:
            who = np.nonzero(seen[:, leaf])[0]
            if len(who):
                rough = q[who] @ self.rows[lo:hi].T
                i, j = np.nonzero(rough >= (worst[who] - slack[who])[:, None])
                held.append((who[i], lo + j, rough[i, j]))
                n += len(i)
                if n > HELD:
                    held, worst = self._best(q_ids, held, slack, worst)
                    n = len(held[0][0])
        i, j, _ = self._best(q_ids, held, slack, worst)[0][0] if held else (np.zeros(0, dtype=np.int64),) * 3
        score = (self.rows[j] * q[i]).sum(axis=1)
        order = np.lexsort((self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        return i[keep], j[keep], score[keep]

    def _best(self, q_ids, held, slack, worst) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """The candidates within rounding of each query's k best, and each query's k-th score."""
        i, j, rough = (np.concatenate(x) for x in zip(*held))
        other = self.ids[j] != q_ids[i]
        i, j, rough = i[other], j[other], rough[other]
        order = np.lexsort((-rough, i))
        i, j, rough = i[order], j[order], rough[order]
        kth = np.arange(len(i)) - np.searchsorted(i, i) == self.k - 1
        worst = worst.copy()
        worst[i[kth]] = rough[kth]
        keep = rough >= worst[i] - slack[i]
        return [(i[keep], j[keep], rough[keep])], worst


def distinct_rows(rows: DataFrame, k: int) -> DataFrame:
    """(id, vec) to (id, vec, copies, rid): equal rows once, and of equal vectors the k + 1 smallest ids."""
    once = rows.groupBy("id", "vec").agg(F.count("*").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return once.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("id", "vec", "copies", F.xxhash64("id", "vec").alias("rid"))


def sampled(pool: DataFrame) -> DataFrame:
    """At most SAMPLE distinct vectors, the smallest by hash."""
    distinct = pool.select("vec").distinct()
    return smallest_by_hash(distinct, ["vec"], SAMPLE, distinct.count())


KEY = ["tree", "cell", "part", "q_part"]
BOTH = "tree int, cell int, part int, q_part int, is_query boolean, id long, rid long, leaf int, seen binary, vec "


def nearest(queries: DataFrame, rows: DataFrame, k: int, recall: float = RECALL) -> DataFrame:
    """(id, vec) queries against (id, vec) rows: query_id, rank, vec_id, score.  ``recall`` 1 visits every leaf."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["vec"]
    pool = cut(distinct_rows(rows, k))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = pool.agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.max(F.size("vec")).alias("width")).first()
    n, longest, width = stats["n"], stats["longest"], stats["width"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = lift(padded(matrix(sampled(pool).toArrow()["vec"]).astype(np.float64), width), longest)
    depth = int(np.log2(max(1, min(n / LEAF, len(sample) / 8))))
    forest = Forest(sample, depth)
    forest.calibrate(sample, max(1, round(k * len(sample) / n)), recall)
    cell_rows = max(1024, CELL // width)
    top = min(forest.depth, max(0, math.ceil(math.log2(n / cell_rows))))  # levels above the subtrees that rows and queries meet by
    below = forest.depth - top
    shared = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaves(lift(padded(matrix(batch.column("vec")).astype(np.float64), width), longest))
            for t, leaf in enumerate(leaves):
                own = pa.array(np.full(len(leaf), t), pa.int32()), pa.array(leaf >> below, pa.int32()), pa.array(leaf & ((1 << below) - 1), pa.int32())
                yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in ("id", "rid", "vec"))], names=["tree", "cell", "leaf", "id", "rid", "vec"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[], [], [], []]
                for i, query in enumerate(lift_query(padded(matrix(part.column("vec")).astype(np.float64), width))):
                    seen = trees.visit(query).reshape(trees.trees, 1 << top, 1 << below)
                    for t, cell in zip(*np.nonzero(seen.any(axis=2))):
                        for column, x in zip(out, (t, cell, i, np.packbits(seen[t, cell]).tobytes())):
                            column.append(x)
                at = pa.array(out[2], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[3], pa.binary()), *(part.column(c).take(at) for c in ("id", "rid", "vec"))],
                    names=["tree", "cell", "seen", "id", "rid", "vec"],
                )

    asked = queries.groupBy("id", "vec").agg(F.count("*").alias("n")).select("id", F.xxhash64("id", "vec").alias("rid"), "vec")
    asked = cut(asked.repartition(-(-asked.count() // WALKS) or 1, "rid").mapInArrow(ask, f"tree int, cell int, seen binary, id long, rid long, vec {kind}"))
    indexed = pool.select("id", "rid", "vec").mapInArrow(index, f"tree int, cell int, leaf int, id long, rid long, vec {kind}")
    # At most a row a subtree of the forest; cells of one part need no entry.
    count = lambda df, most: df.groupBy("tree", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("n")).filter("n > 1").collect()
    row_parts = {(r["tree"], r["cell"]): r["n"] for r in count(indexed, cell_rows)}
    query_parts = {(r["tree"], r["cell"]): r["n"] for r in count(asked, QUERIES)}

    def parts(of: dict) -> F.Column:
        flat = [F.when((F.col("tree") == t) & (F.col("cell") == c), F.lit(m)) for (t, c), m in sorted(of.items())]
        return F.coalesce(*flat, F.lit(1))

    mine = lambda m: F.pmod("rid", m).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    none = lambda t: F.lit(None).cast(t)
    left = indexed.select("tree", "cell", mine(parts(row_parts)).alias("part"), each(parts(query_parts)).alias("q_part"), F.lit(False).alias("is_query"), "id", "rid", "leaf", none("binary").alias("seen"), "vec")
    right = asked.select("tree", "cell", each(parts(row_parts)).alias("part"), mine(parts(query_parts)).alias("q_part"), F.lit(True).alias("is_query"), "id", "rid", none("int").alias("leaf"), "seen", "vec")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each cell's rows, then its queries as they come."""
        held: list[pa.RecordBatch] = []
        cell, key = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in KEY] + [batch.column("is_query").to_numpy(zero_copy_only=False)])
            edges = np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1, [batch.num_rows]]) if batch.num_rows else [0]
            for lo, hi in zip(edges, edges[1:]):
                part, here = batch.slice(lo, hi - lo), tuple(keys[:-1, lo])
                if here != key:
                    held, cell, key = [], None, here
                if not keys[-1, lo]:
                    held.append(part)
                elif held:
                    cell = cell or Cell(held, width, k)
                    q_ids = part.column("id").to_numpy()
                    seen = np.unpackbits(np.frombuffer(b"".join(part.column("seen").to_pylist()), np.uint8).reshape(len(q_ids), -1), axis=1)
                    i, j, score = cell.search(q_ids, padded(matrix(part.column("vec")).astype(np.float64), width), seen)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(cell.ids[j]), pa.array(cell.rids[j]), pa.array(score)], names=["query_id", "vec_id", "rid", "score"])

    met = left.union(right).repartition((forest.trees << top) + sum(row_parts.values()) + sum(query_parts.values()), *KEY).sortWithinPartitions(*KEY, "is_query")
    found = met.mapInArrow(search, "query_id long, vec_id long, rid long, score double")
    found = found.groupBy("query_id", "vec_id", "rid").agg(F.max("score").alias("score"))  # a row is found in several trees
    return merged(found, pool, k)


def merged(found: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1, rows that are repeated as often as they are."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "rid")
    best = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    repeated = pool.filter("copies > 1").select(F.col("rid").alias("r_rid"), F.least("copies", F.lit(k)).cast("int").alias("copies"))
    best = best.join(repeated, F.col("rid") == F.col("r_rid"), "left").select("query_id", "vec_id", "rid", "score", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))).alias("copy"))
    rank = F.row_number().over(order)
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir):
    from heddle.sources.tables import load

    rows = usable(load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")), "vec")
    rows = rows.filter(F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0))
    return nearest(rows.filter("id % 20 = 0"), rows, 20)
