"""Near-duplicates against all pairs."""

import corpus_pipeline as pipeline
import numpy as np
import pytest

from heddle.llm import neardup


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Least (id, place) of each component of texts with five-word Jaccard similarity >= 0.8."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def changed(rng, words, edits):
    out = list(words)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"x{rng.integers(10**9)}"
    return " ".join(out)


def texts():
    """Pairs about the threshold, chains, one large ball, a common passage and short texts."""
    rng = np.random.default_rng(11)
    base = [rng.choice([f"w{k}" for k in range(400)], 150).tolist() for _ in range(40)]
    out = [" ".join(b) for b in base]
    out += [changed(rng, b, e) for b in base[:30] for e in (1, 2, 3, 4)]
    out += [changed(rng, base[39], int(e)) for e in rng.integers(1, 6, 120)]
    passage = " ".join(base[38][:40])
    out += [f"{passage} {' '.join(rng.choice([f'v{k}' for k in range(400)], int(n)))}" for n in rng.integers(2, 60, 60)]
    out += [out[0], out[1].upper(), "", None, "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)), out)]


@pytest.mark.parametrize("near, cell", [(2, 6), (8, 1024)])
def test_stage_keeps_one_of_each_exact_component(spark, save, documents, monkeypatch, near, cell):
    monkeypatch.setattr(neardup, "NEAR", near)
    monkeypatch.setattr(neardup, "CELL", cell)
    rows = texts()
    docs = spark.read.parquet(save(documents=documents([(i, t, "s") for i, t in rows])) + "/documents.parquet")
    kept = [r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(brute(rows))


@pytest.mark.parametrize("cell", [40, 4096])
def test_a_group_s_pairs_are_fewer_than_its_members(spark, monkeypatch, cell):
    """Sketches allow every pair of these 300 sets, and 60 roots join none of the others' sets."""
    monkeypatch.setattr(neardup, "CELL", cell)
    words = {f"k{k}": 5 for k in range(neardup.SKETCH // 64)}
    rows = [(9, s, 150, 0, s % 60, *words.values()) for s in range(300)]
    members = spark.createDataFrame(rows, "sh long, s long, n long, p long, root long, " + ", ".join(f"{k} long" for k in words))
    dealt = neardup.parted(members)
    pairs = neardup.other_pairs(dealt).collect()
    assert len(pairs) < dealt.count() and len(pairs) < (300 if cell == 4096 else 300 * 300 // 4)
    reached = {0}
    for _ in rows:
        reached |= {x for p in pairs if p["a"] in reached or p["b"] in reached for x in p}
    assert len(reached) == 300


@pytest.mark.parametrize("cell", [30, 4096])
def test_clusters_are_joined_as_by_all_pairs(spark, monkeypatch, cell):
    """Pairs that span a cluster need not be linked themselves; links of its other pairs are found, one for every join."""
    from heddle.llm.graph import components
    from heddle.session import cut

    monkeypatch.setattr(neardup, "CELL", cell)
    rng = np.random.default_rng(3)
    base = rng.choice([f"w{k}" for k in range(400)], 150).tolist()
    rows = [(k, changed(rng, base, int(e))) for k, e in enumerate(rng.integers(2, 6, 100))]
    docs = cut(spark.createDataFrame(rows, "d long, text string").selectExpr("d", "xxhash64(text) AS th", "text"))
    found = neardup.prefixes(docs)
    sets = cut(found.selectExpr("s", "struct(d, th) AS first", "n", "fp", "sk"))
    place = {r["s"]: r["first"]["d"] for r in sets.collect()}
    chain = sorted(place)
    pairs = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")
    none = spark.createDataFrame([], "node long, root long")
    links = neardup.cluster_links(pairs, docs, sets, none)
    texts = dict(rows)
    for r in links.collect():
        assert neardup.linked(neardup.shingles(texts[place[r["a"]]]), neardup.shingles(texts[place[r["b"]]]))
    moved = {r["node"] for r in components(links).collect()}
    assert len(rows) - len(moved) == len(brute(rows)) > 1
    if cell == 4096:
        assert links.count() == len(moved)


def test_groups_are_read_alike_in_any_batches(monkeypatch):
    monkeypatch.setattr(neardup, "NEAR", 3)
    monkeypatch.setattr(neardup, "hopeful", lambda rows, i, j: np.ones(len(i), dtype=bool))
    rng = np.random.default_rng(8)
    rows = np.array(sorted((int(sh), int(n), 0, k) for k, (sh, n) in enumerate(zip(rng.zipf(1.6, 300) % 40, rng.integers(1, 5, 300)))))
    rows = rows[:, [0, 3, 1, 2]].T.astype(np.int64)
    rows = np.repeat(rows, rng.integers(1, 3, rows.shape[1]), axis=1)  # equal rows from several tasks
    once = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])]
    pairs, members = set(), []
    for sh in np.unique(once[0]):
        group = once[1, once[0] == sh].tolist()
        for j, b in enumerate(group):
            pairs |= {(min(a, b), max(a, b)) for a in group[max(0, j - 2) : j]}
            if j >= 3:
                pairs.add((min(group[0], b), max(group[0], b)))
        if len(group) > 3:
            members += [(int(sh), m) for m in group]
    for step in (1, 2, 7, 1000):
        reader, got, held = neardup.GroupReader(), set(), []
        for lo in range(0, rows.shape[1], step):
            found, kept = reader.read(rows[:, lo : lo + step])
            got |= set(zip(*found.tolist()))
            held += list(zip(kept[0].tolist(), kept[1].tolist()))
        assert got == pairs and sorted(held) == sorted(members)


def test_sketches_and_sizes_rule_out_no_link():
    sets = [neardup.shingles(t) for _, t in texts()]
    for a in sets:
        for b in sets:
            if neardup.linked(a, b):
                differ = int(np.bitwise_count((neardup.sketch(a) ^ neardup.sketch(b)).view(np.uint64)).sum())
                assert 9 * differ <= len(a) + len(b)


def test_hashed_sets_are_the_shingles():
    for _, t in texts():
        assert len(neardup.shingles(t)) == len(shingle_set(t))


def test_one_id_with_several_texts(spark, save, documents):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (7, f"{c} end"), (3, c), (7, a), (9, b)]
    docs = spark.read.parquet(save(documents=documents([(i, t, "s") for i, t in rows])) + "/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == [(3, c), (7, a), (7, b)]
