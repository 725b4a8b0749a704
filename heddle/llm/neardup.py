"""Near-duplicates by exact Jaccard similarity of five-word shingles.

Texts are linked where the sets of their shingles (A-Z lower-cased, as 64-bit hashes) have a
Jaccard similarity of ``LEAST``, 4/5, or more; a component is what links reach.

The SimHash fingerprints of the sets meet in the trie self-join of simhash.py first, with a budget of
``BUDGET`` bits; what it finds is verified and joins most copies.  One fingerprint of a pair with a similarity
of 0.8 often differs in more bits, so an exact join follows for the pairs that it does not reach.  That is a
prefix filter: with the shingles of every set in one global order, two linked sets share one of their first
n - ceil(4n/5) + 1, and at the first one that they share at least 4/9 of both sizes' sum are left in each.
Rare shingles come first: the order is that of counts over all documents, in ``BINS`` bins of hashes, then of
hashes.  Any order gives the same links, so what falls into one bin only decides the work.

Scale: equal sets are one node.  The members of a shared prefix shingle are a group, which a task streams in the
order of sizes.  In a group of more than ``NEAR`` members each first meets the group's first one and its nearest; only
groups that the links found so far do not join as a whole are then searched in full, those of more than ``CELL`` members
as pairs of parts, so no task holds more.  Two sets are compared only if they are not
joined yet and their parity sketches allow a link: where two sets differ in d shingles, their sketches differ
in at most d bits, so the sketches rule out no link.

The full search returns no pair for every two members: a group's answer is stars that span the pairs that sketches allow.
What such stars join, over all groups, is a cluster; every pair that is left to verify lies in one.  A
cluster's sets meet in one task (a large cluster's in parts) and are compared there, nearest first, until they are
joined or all their pairs are ruled out; only the links that join them are returned.

Cases: texts without words are one node; under five words are one shingle; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm import simhash
from heddle.llm.batches import text_parts
from heddle.llm.graph import components
from heddle.session import cut, freed

WIDTH, NEAR, BINS, BUCKETS, SEED = 5, 8, 1 << 21, 1 << 20, 42
BUDGET, SKETCH, CELL = 3, 1024, 4096  # differing bits of fingerprints; bits of a parity sketch; members that a task holds at once
HEAVY = 128  # shingles that, where whole sets are held, count as a member more
TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's distinct five-word shingles, ascending."""
    words = (text or "").encode().lower().split()
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - WIDTH + 1
    x = h[:n] * TIMES[0]
    for k in range(1, WIDTH):
        x += h[k : k + n] * TIMES[k]
    x = (x ^ (x >> np.uint64(32))) * TIMES[3]
    return np.unique(x ^ (x >> np.uint64(29)))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sets of at least 4/5, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set: the bits that more than half of its hashes set."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(found), 1 << 14):
        part = found[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def sketch(found: np.ndarray) -> np.ndarray:
    """For each of SKETCH bins of hashes, whether it holds an odd number of the set's: bits of SKETCH / 64 longs."""
    return np.packbits(np.bincount((found >> np.uint64(13)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).view(np.int64)


def bins(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(43)).astype(np.int64) % BINS


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many documents have the shingles of each bin; a task sends one table of BINS counts, in parts."""
    part = 1 << 13  # counts of a row

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.uint32)
        for _, texts in text_parts(batches):
            total += np.bincount(bins(np.concatenate([shingles(t) for t in texts])), minlength=BINS).astype(np.uint32)
        tables = total.reshape(-1, part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tables))), pa.array([t.tobytes() for t in tables], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        least = lambda x: np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([least(x) for x in sums.values()], pa.binary())], names=["part", "counts"])

    kind = "part long, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).toArrow()
    out = np.zeros((BINS // part, part), dtype=np.uint32)
    for k, counts in zip(rows["part"].to_pylist(), rows["counts"].to_pylist()):
        out[k] = np.frombuffer(counts, np.uint32)
    return out.reshape(-1)


FOUND = "d long, th long, s long, n long, fp long, sk array<long>, prefix array<long>"


def prefixes(docs: DataFrame) -> DataFrame:
    """(d, th, text) to (d, th, s, n, fp, sk, prefix): the set's hash, size, fingerprint, sketch and first shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch, texts in text_parts(batches):
            names, sizes, fps, sketches, firsts = [], [], [], [], []
            for text in texts:
                found = shingles(text)
                names.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                fps.append(fingerprint(found))
                sketches.append(sketch(found))
                found = found[np.argsort(counts[bins(found)], kind="stable")]
                firsts.append(found[: len(found) + 4 * len(found) // -5 + 1 if len(found) else 0])
            bounds = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(firsts).view(np.int64)))
            s = pa.array(np.array(names, dtype=np.uint64).view(np.int64))
            columns = [batch.column("d"), batch.column("th"), s, pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "th", "s", "n", "fp", "sk", "prefix"])

    return docs.select("d", "th", "text").mapInArrow(run, FOUND)


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are within BUDGET, as far as they span what the trie join finds."""
    each = sets.groupBy("fp").agg(F.min("s").alias("node"))
    equal = sets.join(each.withColumnRenamed("fp", "e_fp"), F.col("fp") == F.col("e_fp")).filter("s <> node").select(F.col("s").alias("a"), F.col("node").alias("b"))
    return simhash.links(each.select(F.lit(0).alias("tab"), "fp", "node"), BUDGET).union(equal)


def dealt(found: DataFrame) -> DataFrame:
    """(sh, s, n, p): every prefix shingle of a set with its place; equal sets once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, s in enumerate(batch.column("s").to_pylist()):
                if s not in seen:
                    seen.add(s)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            lists = batch.column("prefix")
            lens = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            p = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            s, n = (np.repeat(batch.column(c).to_numpy(), lens) for c in ("s", "n"))
            yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(s), pa.array(n, pa.int32()), pa.array(p, pa.int32())], names=["sh", "s", "n", "p"])

    return found.select("s", "n", "prefix").mapInArrow(run, "sh long, s long, n int, p int")


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole groups of rows, which are bounded, the first of ``names`` being the group: columns and each row's group start."""
    held = np.zeros((len(names), 0), dtype=np.int64)
    for batch in chain(batches, [None]):
        if batch is None:
            ready = held
        else:
            both = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])], axis=1)
            last = both[0] == both[0, -1] if both.shape[1] else np.zeros(0, dtype=bool)
            ready, held = both[:, ~last], both[:, last]
        if ready.shape[1]:
            order = np.lexsort((ready[1], ready[2], ready[3], ready[0]))
            ready = ready[:, order]
            once = np.concatenate([[True], (ready[:2, 1:] != ready[:2, :-1]).any(axis=0)])
            ready = ready[:, once]
            new = np.concatenate([[True], ready[0, 1:] != ready[0, :-1]])
            yield ready, np.nonzero(new)[0][np.cumsum(new) - 1]


def hopeful(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs can be linked if the shingle of their group is the first that they share."""
    n, p = rows[2], rows[3]
    return 9 * np.minimum(n[i] - p[i], n[j] - p[j]) >= 4 * (n[i] + n[j])


def pairs_of(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    good = hopeful(rows, i, j)
    a, b = rows[1][i[good]], rows[1][j[good]]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), dtype=np.int64)


class GroupReader:
    """Reads sorted rows (sh, s, n, p) and holds, of the group that is open, the first row and the last NEAR only."""

    def __init__(self):
        self.held = np.zeros((4, 0), dtype=np.int64)
        self.first = np.zeros((4, 1), dtype=np.int64)
        self.count = 0  # rows of the open group so far

    def read(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows with one of the NEAR - 1 before or with the group's first, and members of groups of more than NEAR."""
        old = self.held.shape[1]
        rows = np.concatenate([self.held, rows], axis=1)
        new = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])  # an equal set that several tasks sent
        new[:old] = True
        rows = rows[:, new]
        if rows.shape[1] == old:
            return np.zeros((2, 0), dtype=np.int64), np.zeros((4, 0), dtype=np.int64)
        here = np.arange(rows.shape[1])
        begins = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
        start = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        place = here - start
        if old:
            place[start == 0] += self.count - old
            start[start == 0] = rows.shape[1]  # the open group's first row is put at the end
        every = np.concatenate([rows, self.first], axis=1)
        late = here[(place >= NEAR) & (here >= old)]
        i, j = [start[late]], [late]
        for k in range(1, NEAR):
            at = here[:-k][rows[0, k:] == rows[0, :-k]]
            at = at[at + k >= old]
            i.append(at)
            j.append(at + k)
        found = pairs_of(every, np.concatenate(i), np.concatenate(j))
        eighth = here[(place == NEAR) & (here >= old)]  # with it, all before it are members
        members = np.concatenate([late, (eighth[:, None] - np.arange(1, NEAR + 1)).ravel()])
        last = rows[0] == rows[0, -1]
        self.first = every[:, [start[-1]]]
        self.count = int(place[-1]) + 1
        self.held = rows[:, last][:, -NEAR:]
        return found, rows[:, members]


def first_pairs(shares: DataFrame) -> DataFrame:
    """Pairs (a, b) of group members with sh null, and the members of groups of more than NEAR with sh: a set, n and p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, names = GroupReader(), ["sh", "a", "b", "n", "p"]
        for batch in batches:
            if not batch.num_rows:
                continue
            found, held = groups.read(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("sh", "s", "n", "p")]))
            none = pa.nulls(found.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(found[0]), pa.array(found[1]), none, none], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.nulls(held.shape[1], pa.int64()), pa.array(held[2]), pa.array(held[3])], names=names)

    return shares.repartition("sh").sortWithinPartitions("sh", "n", "p", "s").mapInArrow(run, "sh long, a long, b long, n long, p long")


def parted(members: DataFrame, weight: Column | None = None) -> DataFrame:
    """Members (sh, s, root, ..) of groups with several roots; a group of more than ``CELL`` (members, or their weights) as one group for every pair of its parts."""
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = members.groupBy("sh").agg(F.min("root").alias("least"), F.max("root").alias("most"), size.alias("size")).filter("least <> most")
    sizes = sizes.select(F.col("sh").alias("z_sh"), F.when(F.col("size") > CELL, F.ceil(F.col("size") / (CELL // 2))).otherwise(1).cast("int").alias("parts"))
    split = members.join(sizes, F.col("sh") == F.col("z_sh")).withColumn("mine", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.xxhash64("sh", F.least("mine", "other"), F.greatest("mine", "other"))
    return split.withColumn("sh", F.when(F.col("parts") > 1, own).otherwise(F.col("sh"))).select(*members.columns)


def other_pairs(members: DataFrame) -> DataFrame:
    """(sh, s, n, p, root, sk) to pairs (a, b) that span, in every group, the pairs of members with different roots that sketches allow: stars on the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in grouped(batches, ["sh", "s", "n", "p", "root", *(f"k{k}" for k in range(SKETCH // 64))]):
            edges = np.concatenate([np.nonzero(start == np.arange(len(start)))[0], [len(start)]])
            sk = np.ascontiguousarray(rows[5:].T).view(np.uint64)
            for lo, hi in zip(edges, edges[1:]):
                roots, at, sizes = np.unique(rows[4, lo:hi], return_inverse=True, return_counts=True)
                if len(roots) < 2:
                    continue
                tree = np.arange(hi - lo)
                for i in np.flatnonzero(at != np.argmax(sizes)):
                    j = lo + np.flatnonzero((at != at[i]) & (tree != tree[i]))
                    j = j[hopeful(rows, np.full(len(j), lo + i), j)]
                    j = j[9 * np.bitwise_count(sk[j] ^ sk[lo + i]).sum(axis=1, dtype=np.int64) <= rows[2][j] + rows[2][lo + i]]
                    tree[np.isin(tree, tree[j - lo])] = tree[i]
                s, (_, tree) = rows[1, lo:hi], np.unique(tree, return_inverse=True)
                least = np.full(tree.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, tree, s)
                tied = least[tree] < s
                yield pa.RecordBatch.from_arrays([pa.array(s[tied]), pa.array(least[tree][tied])], names=["a", "b"])

    return members.repartition("sh").sortWithinPartitions("sh").mapInArrow(run, "a long, b long").distinct()


def possible(pairs: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs (a, b) that ``roots`` do not join and that sizes and sketches allow to be linked."""
    facts = sets.select("s", "n", "sk", F.col("s").alias("root"))
    if roots is not None:
        facts = sets.join(roots, F.col("s") == F.col("node"), "left").select("s", "n", "sk", F.coalesce("root", "s").alias("root"))
    side = lambda x: facts.select(*[F.col(c).alias(f"{c}_{x}") for c in ("s", "n", "sk", "root")])
    both = pairs.join(side("a"), F.col("a") == F.col("s_a")).join(side("b"), F.col("b") == F.col("s_b"))
    both = both.filter("root_a <> root_b AND 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy().reshape(-1, SKETCH // 64).view(np.uint64) for c in ("sk_a", "sk_b"))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good = pa.array(9 * differ <= batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "sk_a", "sk_b").mapInArrow(run, "a long, b long")


def first_texts(wanted: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(m), sets without repeats, to (s, text): the text of each one's first document."""
    met = cut(wanted.join(sets, F.col("m") == F.col("s")).select("s", F.col("first.d").alias("f_d"), F.col("first.th").alias("f_th")))
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS))
    some = F.broadcast(met.select(bucket("f_th").alias("bucket")).distinct())  # at most BUCKETS rows: most texts need no shuffle where few are met
    texts = docs.join(some, bucket("th") == F.col("bucket"), "left_semi").join(met, (F.col("d") == F.col("f_d")) & (F.col("th") == F.col("f_th")))
    return cut(texts.groupBy("d", "th", "s").agg(F.first("text").alias("text")).select("s", "text"))  # dealt as the join is: no shuffle of its own


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of sets that are linked and not joined by ``roots``, on the texts of the sets' first documents."""
    pairs = cut(possible(pairs, sets, roots))
    texts = first_texts(pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct(), docs, sets)
    both = pairs.join(texts.select(F.col("s").alias("s_a"), F.col("text").alias("text")), F.col("a") == F.col("s_a"))
    both = both.join(texts.select(F.col("s").alias("s_b"), F.col("text").alias("other")), F.col("b") == F.col("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_parts(batches):
            held: dict[str, np.ndarray] = {}

            def of(text: str) -> np.ndarray:
                if text not in held:
                    held[text] = shingles(text)
                return held[text]

            good = pa.array([linked(of(x), of(y)) for x, y in zip(texts, batch.column("other").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return cut(both.select("a", "b", "text", "other").mapInArrow(run, "a long, b long"))


def spanning(roots: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Places (i, j) of linked sets, as many as it takes to join what links and equal roots join."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    sk = np.stack([sketch(x) for x in sets]).view(np.uint64)
    _, root, sizes = np.unique(roots, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(root != np.argmax(sizes)).tolist():
        others = np.flatnonzero(root != root[i])
        differ = np.bitwise_count(sk[others] ^ sk[i]).sum(axis=1, dtype=np.int64)
        near = np.argsort(differ, kind="stable")
        near = near[9 * differ[near] <= n[others[near]] + n[i]]
        for j in others[near].tolist():
            if root[j] != root[i] and linked(sets[i], sets[j]):
                root[root == root[j]] = root[i]
                yield i, j


def cluster_links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) of sets that ``roots`` do not join, as many as it takes to join all linked sets of each cluster of ``pairs``."""
    moved = components(pairs)
    freed(docs.sparkSession)
    clusters = cut(moved.union(moved.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("m"), F.col("root").alias("sh")))
    facts = sets.join(roots, F.col("s") == F.col("node"), "left").select("s", "n", F.coalesce("root", "s").alias("root"))
    members = parted(clusters.join(facts, F.col("m") == F.col("s")).select("sh", "s", "root", "n"), 1 + F.floor(F.col("n") / HEAVY))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array([shingles(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["t_s", "found"])

    def run(cell: pa.Table) -> pa.Table:
        s = cell.column("s").to_numpy()
        sets = [x.values.to_numpy().view(np.uint64) for x in cell.column("found")]
        found = np.array(list(spanning(cell.column("root").to_numpy(), sets)), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": s[found[:, 0]], "b": s[found[:, 1]]})

    found = first_texts(clusters.select("m"), docs, sets).mapInArrow(hashed, "t_s long, found array<long>")
    cells = members.join(found, F.col("s") == F.col("t_s")).select("sh", "s", "root", "found")
    return cut(cells.groupBy("sh").applyInArrow(run, "a long, b long"))


def representatives(docs: DataFrame) -> DataFrame:
    """(d, text), d not null, to (d, th, n): the least (d, hash of text) of each component, and how many rows are equal to it."""
    docs = docs.select(F.col("d").cast("long").alias("d"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    found = cut(prefixes(docs))
    sets = cut(found.groupBy("s").agg(F.min(F.struct("d", "th")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sk").alias("sk")))
    links = verified(fingerprint_pairs(sets), docs, sets)
    roots = components(links)
    freed(docs.sparkSession)
    met = cut(first_pairs(dealt(found)))
    roots = components(verified(met.filter("sh IS NULL").select("a", "b").distinct(), docs, sets, roots).union(roots))
    freed(docs.sparkSession)
    words = [F.col("sk")[k].alias(f"k{k}") for k in range(SKETCH // 64)]
    facts = sets.join(roots, F.col("s") == F.col("node"), "left").select(F.col("s").alias("f_s"), F.coalesce("root", "s").alias("root"), "sk")
    members = met.filter("sh IS NOT NULL").select("sh", F.col("a").alias("s"), "n", "p").join(facts, F.col("s") == F.col("f_s"))
    others = cut(other_pairs(parted(members.select("sh", "s", "n", "p", "root", *words))))
    if not others.isEmpty():
        roots = components(cluster_links(others, docs, sets, roots).union(roots))
    freed(docs.sparkSession)
    named = sets.join(roots, F.col("s") == F.col("node"), "left").groupBy(F.coalesce("root", "s").alias("r")).agg(F.min("first").alias("first"))
    kept = named.select(F.col("first.d").alias("k_d"), F.col("first.th").alias("k_th"))
    counts = found.groupBy("d", "th").agg(F.count("*").alias("n"))
    return counts.join(kept, (F.col("d") == F.col("k_d")) & (F.col("th") == F.col("k_th")), "left_semi")
