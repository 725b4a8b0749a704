"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint sets each of 64 bits that more than half of a text's shingle hashes
set.  Texts are linked where fingerprints differ in at most ``budget`` bits, and a
component is what links reach.

The join: fingerprints in order are a binary trie, a node being a range of them.
Pairs of nodes are taken down together one bit a level; taking different
branches costs one differing bit, and a pair of nodes that has spent more than the budget
is pruned with all below it.  Levels are worked on as arrays, many tries at once.

Scale: equal fingerprints are first made one (combined before the shuffle), so copies cost
nothing.  Of budget + 2 bit blocks, two fingerprints within the budget agree on two at least, so each
is dealt to the tries of its values in every pair of blocks: 32 bits a value for a budget of 2, 25 for 3, so that few
fingerprints share one that are not near.  A value with more than ``CELL``
fingerprints is split: its fingerprints fall into subsets, and every pair of subsets is a trie of
its own, so no task holds more and no link is lost.  A trie returns a spanning
forest of its links, never all pairs.  Components are found by grouped minima and joins (graph.py).

Cases: a null or blank text has fingerprint zero and is linked like any other; one
or two words are one shingle; repeated rows share a component; a null doc_id
takes part, but a component is named by its least id that is not null; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.batches import text_parts
from heddle.llm.graph import components
from heddle.session import cut

CELL, FRONTIER, SEED = 4096, 1 << 18, 42


MIX_A, MIX_B, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1  # odd constants that turn one hash into others


def fingerprint_tables(text: str | None, width: int = 3, tables: int = 1) -> np.ndarray:
    """64-bit SimHashes of a text's ``width``-word shingles, A-Z lower-cased, one a table.

    The first is of the shingles' hashes themselves, others of these hashes mixed anew.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(tables, dtype=np.uint64)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    span = min(width, len(words)) - 1
    first = starts[: len(words) - span].tolist()
    last = (starts + lens)[span:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")
    ones = np.zeros((tables, 64), dtype=np.int64)
    step = max(1, (1 << 14) // tables)
    for lo in range(0, len(hashes), step):
        mixed = np.stack([mix(hashes[lo : lo + step], t) for t in range(tables)])
        ones += np.unpackbits(mixed.view(np.uint8).reshape(tables, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def mix(hashes: np.ndarray, table: int) -> np.ndarray:
    if not table:
        return hashes
    x = hashes * np.uint64((MIX_A * (2 * table + 1)) & MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(29))


def fingerprint(text: str | None, width: int = 3) -> int:
    return int(fingerprint_tables(text, width)[0])


def fingerprints(docs: DataFrame, width: int = 3, tables: int = 1) -> DataFrame:
    """(doc_id, text) to (doc_id, fps), fps signed longs, one a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_parts(batches):
            fps = np.stack([fingerprint_tables(t, width, tables) for t in texts]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * tables), pa.array(fps.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fps array<long>")


def near_pairs(fps: np.ndarray, bounds: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of linked fingerprints within each trie, in chunks.

    ``fps`` are unsigned and ascending within each trie bounds[k]:bounds[k + 1].
    """
    lo, hi = bounds[:-1], bounds[1:]
    keep = hi - lo > 1
    root = np.stack([lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(keep.sum(), dtype=np.int64)])
    stack = [(63, root)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        level, nodes = stack.pop()
        single = (nodes[1] - nodes[0] == 1) & (nodes[3] - nodes[2] == 1)
        if level < 0:
            single[:] = True
        if single.any():
            i, j = nodes[0][single], nodes[2][single]
            near = (np.bitwise_count(fps[i] ^ fps[j]) <= budget) & (i != j)
            yield i[near], j[near]
            nodes = nodes[:, ~single]
        if not nodes.shape[1]:
            continue
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(level, nodes[:, :half]), (level, nodes[:, half:])]
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((fps >> np.uint64(level)) & np.uint64(1))]).astype(np.int64)
        count = ones[level]
        a, b, c, d, spent = nodes
        m, n = b - (count[b] - count[a]), d - (count[d] - count[c])
        own = a == c
        down = [
            np.stack([a, m, c, n, spent]),
            np.stack([m, b, n, d, spent]),
            np.stack([a, m, n, d, spent + 1]),
            np.stack([m, b, c, n, spent + 1])[:, ~own],
        ]
        nodes = np.concatenate(down, axis=1)
        w1, w2 = nodes[1] - nodes[0], nodes[3] - nodes[2]
        useful = (w1 > 0) & (w2 > 0) & (nodes[4] <= budget) & ~((nodes[0] == nodes[2]) & (w1 == 1))
        stack.append((level - 1, nodes[:, useful]))


def forest(fps: np.ndarray, bounds: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, root place) of every linked fingerprint that is not the first of its links' component."""
    parent = np.arange(len(fps))
    for i, j in near_pairs(fps, bounds, budget):
        while len(i):
            pi, pj = parent[i], parent[j]
            differ = pi != pj
            if not differ.any():
                break
            i, j, pi, pj = i[differ], j[differ], pi[differ], pj[differ]
            np.minimum.at(parent, np.maximum(pi, pj), np.minimum(pi, pj))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    moved = np.nonzero(parent != np.arange(len(fps)))[0]
    return moved, parent[moved]


def masks(budget: int) -> list[int]:
    """The bits of every two of budget + 2 blocks that cover 64 bits, as signed longs."""
    edges = [64 * k // (budget + 2) for k in range(budget + 3)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [x - (1 << 64) if x >> 63 else x for x in (a | b for a, b in combinations(each, 2))]


def links(distinct: DataFrame, budget: int = 2, cell: int = CELL) -> DataFrame:
    """(tab, fp, node), fp without repeats in a table, to (a, b): pairs of linked nodes that span every component within a trie."""
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks(budget))])
    dealt = distinct.select("tab", "fp", "node", F.explode(values).alias("at"))
    dealt = dealt.select("fp", "node", (F.col("tab") * len(masks(budget)) + F.col("at.k")).alias("block"), "at.value")
    sizes = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select(F.col("block").alias("s_block"), F.col("value").alias("s_value"), F.ceil(F.col("n") / F.lit(cell / 2)).cast("int").alias("parts"), (F.col("n") > cell).alias("hot"))
    dealt = dealt.join(sizes, (F.col("block") == F.col("s_block")) & (F.col("value") == F.col("s_value")))
    parts = F.when(F.col("hot"), F.col("parts")).otherwise(1)
    dealt = dealt.select("fp", "node", "block", "value", parts.alias("parts")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.select("fp", "node", "block", "value", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("fp", "node", "block", "value", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    key = ["block", "value", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), dtype=np.int64)
        for rows in chain(_columns(batches, key), [None]):  # a trie may begin in one batch and end in a later one
            if rows is None:
                ready = held
            else:
                both = np.concatenate([held, rows], axis=1)
                last = (both[2:] == both[2:, -1:]).all(axis=0) if both.shape[1] else np.zeros(0, dtype=bool)
                ready, held = both[:, ~last], both[:, last]
            if ready.shape[1] < 2:
                continue
            new = np.concatenate([[True], (ready[2:, 1:] != ready[2:, :-1]).any(axis=0)])
            bounds = np.concatenate([np.nonzero(new)[0], [ready.shape[1]]])
            fps = ready[0].view(np.uint64)
            order = np.lexsort((fps, np.cumsum(new)))
            node = ready[1][order]
            moved, root = forest(fps[order], bounds, budget)
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root])], names=["a", "b"])

    return dealt.repartition(*key).sortWithinPartitions(*key).select("fp", "node", *key).mapInArrow(run, "a long, b long").distinct()


def _columns(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "node", *key)])


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, text) to (doc_id, fp, component_id), a row a document."""
    found = cut(fingerprints(docs, width).select("doc_id", F.col("fps")[0].alias("fp")))
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select(F.lit(0).alias("tab"), "fp", F.col("fp").alias("node")), budget))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(names.withColumnRenamed("root", "n_root"), F.col("root") == F.col("n_root")).select(F.col("fp").alias("l_fp"), "component_id")
    return found.join(labelled, F.col("fp") == F.col("l_fp")).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, width: int = 3, budget: int = 3, tables: int = 12) -> DataFrame:
    """(doc_id, text), ids not null, to the least doc_id of each component, and how many rows have it.

    Documents are linked where any of several independent fingerprints are within the budget: one
    fingerprint of a pair with similarity 0.9 differs in more than 3 of 64 bits more often than
    not, all twelve hardly ever.
    """
    found = cut(fingerprints(docs, width, tables))
    same = cut(found.groupBy("fps").agg(F.min("doc_id").alias("node")))
    spread = same.select("node", F.posexplode("fps").alias("tab", "fp"))
    shared = spread.groupBy("tab", "fp").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    met = shared.filter("n > 1").select(F.col("tab").alias("m_tab"), F.col("fp").alias("m_fp"), F.col("node").alias("b"))
    equal = spread.join(met, (F.col("tab") == F.col("m_tab")) & (F.col("fp") == F.col("m_fp"))).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    moved = components(links(shared.select("tab", "fp", "node"), budget).union(equal)).select("node")
    kept = same.select("node").join(moved, "node", "left_anti")
    counts = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    return counts.join(kept, F.col("doc_id") == F.col("node"), "left_semi")


def op6_simhash_components(spark, sf_dir):
    from heddle.sources.tables import load

    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
