"""Operators over documents against brute force, and their odd cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_cases import ODD

from heddle.llm import mixing, packing, pii, registry, sharding, simhash, token_files, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture
def odd(save, documents, spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (5, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    return save(documents=documents(ODD), labels=labels)


@pytest.fixture
def empty(save, documents, spark):
    return save(documents=documents([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("name", ["op3_pii", "op5_stratified_shards", "op6_simhash_components", "op7_best_fit_packing", "op8_token_files", "op9_mix_sources", "op10_toxicity"])
def test_empty_table(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op3_pii", "op5_stratified_shards", "op6_simhash_components", "op8_token_files", "op9_mix_sources", "op10_toxicity"])
def test_odd_rows_are_all_kept(spark, odd, name):
    found = Counter(r["doc_id"] for r in rows_of(registry.QUERIES[name](spark, odd)))
    assert found == Counter(i for i, _, _ in ODD)


# op9


def filled(sizes, weights, cap):
    """Water-filling by repeated clamping."""
    free, targets, total = set(range(len(sizes))), {}, sum(sizes)
    while free:
        w = sum(weights[i] for i in free)
        rest = total - sum(targets.values())
        over = {i for i in free if rest * weights[i] / w >= cap * sizes[i]}
        if not over:
            targets |= {i: rest * weights[i] / w for i in free}
            break
        targets |= {i: cap * sizes[i] for i in over}
        free -= over
    return [targets[i] for i in range(len(sizes))]


@pytest.mark.parametrize("case", range(4))
def test_mix(spark, save, documents, case):
    rng = np.random.default_rng(case)
    names = ["b", "a", None, "c", "ä", "z"][: 3 + case]
    shares = rng.dirichlet(np.full(len(names), 0.4))
    rows = [(i, " ".join("w" * int(n + 1))[: 2 * int(n)], names[rng.choice(len(names), p=shares)]) for i, n in enumerate(rng.integers(0, 30, 300))]
    got = rows_of(registry.QUERIES["op9_mix_sources"](spark, save(documents=documents(rows))))
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    src = {i: s for i, _, s in rows}
    order = sorted({s for s in src.values()}, key=lambda s: (s is None, s or ""))
    sums = Counter()
    for i, s in src.items():
        sums[s] += size[i]
    want = dict(zip(order, filled([sums[s] for s in order], [1 + k % 3 for k in range(len(order))], 3)))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[src[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[src[r["doc_id"]]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[src[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order)


# op5


def test_shards(spark, save, documents):
    rows = [(i, f"text {i % 50}", ["a", "b", None, "c"][min(i % 7, 3)]) for i in range(1003)] + [(5000, None, "a")]
    got = rows_of(registry.QUERIES["op5_stratified_shards"](spark, save(documents=documents(rows))))
    text = {i: (t or "").encode() for i, t, _ in rows}
    src = {i: s for i, _, s in rows}
    by = defaultdict(list)
    mixture = Counter()
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        by[r["shard"]].append(r["slot"])
        mixture[r["shard"], src[r["doc_id"]]] += 1
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for s in set(src.values()):
        n = sum(v == s for v in src.values())
        assert all(abs(mixture[k, s] - n / 16) <= 2 for k in range(16))


# op6


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


def test_simhash(spark, save, documents):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "délta", "e", "f1"], 120)) for _ in range(12)]
    texts = base + base[:3] + [b + " tail" for b in base] + ["head " + b for b in base[:6]] + [None, "", "one", "one two", "ONE TWO"]
    ids = rng.permutation(len(texts)).tolist()
    got = {r["doc_id"]: r for r in rows_of(registry.QUERIES["op6_simhash_components"](spark, save(documents=documents([(i, t, "s") for i, t in zip(ids, texts)]))))}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in ids] == brute_components(ids, fps)


@pytest.mark.parametrize("cell", [4, 4096])
def test_simhash_links_lose_nothing_when_split(spark, cell):
    """Dense balls of fingerprints, with tries split into many subsets or not at all."""
    rng = np.random.default_rng(cell)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = {int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in centres for _ in range(60)} | {int(x) for x in rng.integers(0, 2**63, 100)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame([(0, f, f) for f in signed], "tab int, fp long, node long"), 2, cell)
    roots = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
    mine = [roots.get(f, f) for f in signed]
    want = brute_components(list(range(len(fps))), fps)
    assert len({*zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_representatives_of_near_copies(spark):
    """Components over several fingerprint tables against brute force."""
    rng = np.random.default_rng(8)
    base = [rng.choice([f"w{k}" for k in range(400)], 150).tolist() for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(3):
            copy = list(b)
            for k in rng.integers(0, 150, 2):
                copy[k] = "other"
            texts.append(" ".join(copy))
    texts += texts[:2] + ["", None]
    ids = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    tables = [simhash.fingerprint_tables(t, 3, 12) for t in texts]
    assert all(int(f[0]) == brute_fingerprint(t) for f, t in zip(tables, texts))
    near = lambda i, j: bool((np.bitwise_count(tables[i] ^ tables[j]) <= 3).any())
    parent = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if near(i, j):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    want = {min(i for i, p in zip(ids, parent) if p == root) for root in parent}
    assert {r["doc_id"] for r in simhash.representatives(docs).collect()} == want
    assert len(want) <= 30


# op7, op8


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_library(name):
    space = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x2029, 0x202F, 0x3000)]
    texts = ["", " ", "\n", "a b", "a  b", " a", "a ", "a\nb", "a\n\nb", "a\n b", "a \nb", "<|endoftext|> x", "it's we'll", "é ́x Σς", "x  y", "long " * 3000]
    texts += [f"a{c}b {c} {c}" for c in space]
    cache = tokens.PieceCache(tokens.vocabulary(name))
    for _ in range(2):
        ids, lens = cache.encode(texts, 7)
        ends = np.cumsum(lens)
        want = [e.ids + [7] for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[b - n : b].tolist() for b, n in zip(ends, lens)] == want
        cache.shrink()


def test_packing(spark, odd):
    got = rows_of(registry.QUERIES["op7_best_fit_packing"](spark, odd))
    tokenizer = tokens.cache(tokens.vocabulary("byte_bpe_50k.json")).tokenizer
    want = Counter()
    for i, t, _ in ODD:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut_points(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n])] += 1
            assert n == 1024 or k == 0
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1024
    assert len(by) <= -(-sum(r["length"] for r in got) // 1024) + 1


def test_several_packers_and_a_bound_that_binds(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 700)
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 1025, 3000).tolist()
    found = spark.createDataFrame([(int(k % 5), 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    got = packing.pack(found, 1024, 40).collect()
    assert sorted(r["length"] for r in got) == sorted(lengths) and len({r["sequence_id"] >> 32 for r in got}) == 5
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 1024
    assert len(by) <= 1.06 * sum(lengths) / 1024
    assert sorted(got) == sorted(packing.pack(found, 1024, 40).collect())


def test_the_fullest_bin_closes_at_the_real_bound():
    bins = packing.Bins(1024, packing.OPEN_BINS)
    lengths = [600 + k % 300 for k in range(packing.OPEN_BINS + 50)]  # no two fit together
    assert [bins.place(n)[0] for n in lengths] == list(range(len(lengths)))
    assert bins.open == packing.OPEN_BINS and bins.made == packing.OPEN_BINS + 50


@pytest.mark.parametrize("open_bins", [1, 3, 1000])
def test_bins_against_a_plain_search(open_bins):
    rng = np.random.default_rng(open_bins)
    bins, frees, used = packing.Bins(64, open_bins), {}, 0
    for n in rng.integers(1, 65, 2000).tolist():
        fit = [f for f in frees.values() if f >= n]
        found, offset = bins.place(n)
        if fit:
            assert frees[found] == min(fit)
        else:
            assert found not in frees
            if len(frees) == open_bins:
                full = min(frees.values())
                closed = [b for b, f in frees.items() if f == full]
                gone = next(b for b in closed if b not in {x for s in bins.by_free for x in s})
                del frees[gone]
            frees[found] = 64
            used += 1
        assert offset == 64 - frees[found]
        frees[found] -= n
        if not frees[found]:
            del frees[found]
    assert bins.made == used


def test_token_files(spark, odd, tmp_path):
    got = sorted(rows_of(registry.QUERIES["op8_token_files"](spark, odd)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in ODD), key=lambda i: (i is not None, i or 0))
    tokenizer = tokens.cache(tokens.vocabulary("word_bpe_49k.json")).tokenizer
    want = Counter((i, len(ids) + 1, zlib.crc32(np.array(ids + [1], dtype="<u4"))) for i, t, _ in ODD for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_several_shards(spark, odd, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 2)
    test_token_files(spark, odd, None)


def test_dictionary_leaves_out_long_documents(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_BYTES", 1000)
    docs = spark.createDataFrame([(1, "word " * 5000)] + [(k, f"short text {k}") for k in range(2, 60)], "doc_id long, text string")
    path = tokens.vocabulary("word_bpe_49k.json")
    assert 0 < len(token_files.sample_dictionary(docs, path, 1, "<u2")) <= 60 * 1000


def test_shard_access_by_place(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 500, n).astype("<u2") for n in rng.integers(1, 200, 300)]
    for dictionary in (token_files.train([d.tobytes() for d in docs], 4096), b""):
        folder = f"file://{tmp_path}"
        writer = token_files.ShardWriter(folder, "part-00000.tok", dictionary, 2)
        codec = token_files.zstandard.ZstdCompressor(dict_data=token_files.codec_dictionary(dictionary))
        for k, d in enumerate(docs):
            writer.add(None if k == 0 else k, codec.compress(d.tobytes()), len(d))
        writer.close()
        shard = token_files.ShardReader(folder, "part-00000.tok", dictionary)
        assert all((shard.document(k) == docs[k]).all() for k in (299, 0, 150))
        assert shard.nulls.tolist() == [1] + [0] * 299
        with pytest.raises(ValueError, match="another dictionary"):
            token_files.ShardReader(folder, "part-00000.tok", b"other")


# op3


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_plain_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    parts = ["a", "b.", "@", "1", "22", ".", "-", "+", " ", "4", "0000", "(", ")", "x@y.z", "255", "@@", "4111 1111 1111 1111", "+1", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 30)))
        assert sorted(pii.plain(text)) == sorted(brute_spans(text)), text


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write to john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("jane at example dot org thanks", "email", "jane at example dot org"),
        ("mail jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base, more = pii.find(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in more] == [(kind, source)]


def test_many_spans_and_repeated_ats_are_linear():
    base, more = pii.find("a@b.co " * 30_000 + "jane (at) example (dot) org")
    assert len(base) == 30_000 and [k for k, _, _ in more] == ["email"]
    assert pii.find("(at) a" + "-at" * 60_000) == ([], [])


def test_long_runs_are_read_once():
    text = "(dot) " + " " * 200_000 + "a" * 200_000 + "(" * 20_000 + "1" * 100_000 + "+1" + " " * 100_000 + "two three four five six"
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize("text", ["look at example.com", "one two three apples", "polka dot dress at nine", "sent at 10.30 (dot)", ""])
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == ([], [])


def test_pii_query(spark, save, documents):
    rows = [(1, "a@b.co +1 (555) 555-2485 10.0.0.1 999.1.1.1 4111111111111111", "s"), (2, None, "s"), (3, "x " * 100_000 + "z@y.xx", "s")]
    got = {r["doc_id"]: r for r in rows_of(registry.QUERIES["op3_pii"](spark, save(documents=documents(rows))))}
    for i, t, _ in rows:
        spans = sorted(brute_spans(t or ""), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and got[i]["spans"] == listed
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


# op10


def test_character_counts_and_restoring():
    texts = ["the idiot and the moron were here with a worthless loser and other clown people", None, ""] * 3
    counts = toxicity.trigram_counts(texts, toxicity.code_table())
    want = Counter()
    for t in texts:
        if t:
            padded = f"\n\n{t}\n\n"
            codes = [toxicity.CODE.get(c, 0) for c in padded]
            want.update(zip(codes, codes[1:], codes[2:]))
    assert all(counts[(a * 64 + b) * 64 + c] >= n for (a, b, c), n in want.items() if a and b and c)
    restorer = toxicity.Restorer(toxicity.CharModel(counts))
    for shown, meant in {"1d1ot": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiiiiot": "idiot", "l0$er": "loser", "cl0wn": "clown"}.items():
        assert restorer.reading(shown) == meant
        assert restorer.restore(f"the {shown}, and") == f"the {meant}, and"
    assert restorer.read("the people\twere  here.") == ("the people\twere  here.", [])
    assert toxicity.words_of("A stupid-looking m0r0n", restorer) >= {"a", "stupid", "looking", "moron"}


def test_viterbi_equals_enumeration():
    """The best of all readings of small lattices, by their probabilities added up one by one."""
    texts = ["the idiot and the moron were here with a worthless loser", "a clown is a stale silly oaf"] * 3
    model = toxicity.CharModel(toxicity.trigram_counts(texts, toxicity.code_table()))
    rng = np.random.default_rng(5)

    def score(reading):
        codes = [0, 0, *(toxicity.CODE.get(c, 0 if not c.isalpha() else toxicity.SIZE - 1) for c in reading), 0]
        return sum(model.log[(a * toxicity.SIZE + b) * toxicity.SIZE + c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    for _ in range(150):
        token = "".join(rng.choice(list("aiotsl0134@$!*.-é"), rng.integers(2, 7)))
        choices = toxicity.lattice(token)
        every = {}
        for path in itertools.product(*choices):
            reading, cost = "".join(p for p, _ in path), sum(c for _, c in path)
            every[reading] = max(every.get(reading, -1e9), score(reading) - cost)
        got = model.decode(choices)
        best = max(every.values())
        assert any(r.strip() == got and s >= best - 1e-9 for r, s in every.items()), token


def test_scores_are_the_noisy_or_of_features(spark):
    restorer = toxicity.Restorer(toxicity.CharModel(toxicity.trigram_counts(["the idiot and the moron"] * 5, toxicity.code_table())))
    weights = {"idiot ": 0.9, "moro": 0.8, "moron": 0.7, "the ": 0.5}
    docs = [(1, "the 1d1ot"), (2, "MORONS, the lot"), (3, "nothing"), (4, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string"), weights, toxicity.trigram_counts(["the idiot and the moron"] * 5, toxicity.code_table())).collect()}
    for i, t in docs:
        words = set(re.findall(r"[^\W\d_]+", restorer.restore(t or "")))
        found = [w for f, w in weights.items() if (f[:-1] in words if f.endswith(" ") else any(x.startswith(f) for x in words))]
        assert got[i] == pytest.approx(1 - (1 - toxicity.BASE) * np.prod([1 - w for w in found]))


def test_toxicity_held_out(spark, save, documents):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiourstlnm"), rng.integers(3, 8))) for _ in range(200)]
    bad = ["idiot", "moron", "clown"]
    rows, labels = [], []
    for i in range(600):
        text = rng.choice(words, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            text[7], text[20] = rng.choice(bad), rng.choice(bad)
            if i % 8 == 0:
                text[7], text[20] = text[7].replace("o", "0"), text[20].replace("o", "0")
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(toxic)))
    folder = save(documents=documents([*rows, (700, None, "s")]), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in rows_of(registry.QUERIES["op10_toxicity"](spark, folder))}
    for i, _, y in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == y == (got[i]["score"] >= 0.7)
    assert got[700]["score"] == pytest.approx(toxicity.BASE)


def test_parts_cover_a_column_in_bounded_pieces():
    import pyarrow as pa

    from heddle.llm.batches import parts

    column = pa.array(["x" * 10, None, "", "y" * 5000, "z", "z"])
    assert list(parts(column, 20, 2)) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(parts(column.slice(0, 0))) == []


def test_smallest_by_hash_is_bounded_and_whole(spark):
    from heddle.llm.batches import smallest_by_hash

    df = spark.range(5000)
    got = [r["id"] for r in smallest_by_hash(df, ["id"], 100, 5000).collect()]
    want = [r["id"] for r in df.selectExpr("id", "xxhash64(id) AS h").orderBy("h").limit(100).collect()]
    assert got == want and smallest_by_hash(df, ["id"], 9000, 5000).count() == 5000
