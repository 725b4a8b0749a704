"""Searches and page texts against brute force, and their odd cases."""

from collections import Counter

import numpy as np
import pytest

from heddle.llm import ann, exact_topk, pages, registry

VECTORS = "vec_id long, embedding array<float>, label int, id string, vec int, qb int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1, 2) for i, v in rows], VECTORS)


def usable(rows, zero):
    out = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, v) for i, v in out if zero or v.any()]


def brute(rows, every, k, score):
    out = {}
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            found = sorted(((-score(v, w), i) for m, (i, w) in enumerate(rows) if i != q))
            out.setdefault(q, []).append([(r + 1, i, -s) for r, (s, i) in enumerate(found[:k])])
    return out


def cases():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6)) for i in range(130)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(None, [1.0] * 6), (240, None), (260, [0.0] * 6), (280, [1, None, 1, 1, 1, 1]), (300, [float("nan")] * 6), (320, [float("inf")] * 6), (340, [])]
    return rows


def test_exact_topk(spark, save):
    rows = cases()
    got = registry.QUERIES["op2_exact_topk"](spark, save(embeddings=vectors(spark, rows))).collect()
    floor = lambda v: [int(np.floor(256 * x)) for x in v]
    want = brute([(i, floor(v)) for i, v in usable(rows, zero=True)], 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [sorted(v)] for q, v in by.items()} == want


def test_exact_topk_beyond_64_bits(spark, save):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 0.0]), (3, [0.5, 0.5])]
    got = registry.QUERIES["op2_exact_topk"](spark, save(embeddings=vectors(spark, rows))).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])][::2] == [(1, 2**63 - 1), (2, -(2**63))]


def test_small_blocks_give_the_same(spark, monkeypatch, save):
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 2)
    test_exact_topk(spark, save)


@pytest.mark.parametrize("name", ["op1_nearest_neighbours", "op2_exact_topk"])
def test_empty_and_single(spark, save, name):
    assert registry.QUERIES[name](spark, save(embeddings=vectors(spark, []))).collect() == []
    assert registry.QUERIES[name](spark, save(embeddings=vectors(spark, [(100, [1.0, 2.0])]))).collect() == []


def frame(spark, rows):
    """The rows that op1 takes, as (id, vec)."""
    good = [(i, v) for i, v in usable(rows, zero=False)]
    return vectors(spark, good).select("vec_id", "embedding").withColumnsRenamed({"vec_id": "id", "embedding": "vec"}), good


def listed(got):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in by.items()}


@pytest.mark.parametrize("cell", [1 << 21, 64])
def test_all_leaves_give_the_brute_force_result(spark, monkeypatch, cell):
    """Ties, repeated rows and vectors of many rows: with every leaf visited the cells, their parts and the merge lose and add nothing."""
    monkeypatch.setattr(ann, "CELL", cell * 1024)
    monkeypatch.setattr(ann, "LEAF", 8)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "HELD", 100)
    rows = cases() + [(i, [float(x) for x in np.random.default_rng(i).normal(size=6)]) for i in range(400, 2000)]
    rows += [(7, rows[7][1])] * 3 + [(400, rows[0][1])]
    df, good = frame(spark, rows)
    once = {}
    for i, v in good:
        once.setdefault((i, v.tobytes()), []).append((i, v))
    want = brute(good, 20, 20, lambda a, b: float((a * b).sum()))
    got = listed(ann.nearest(df.filter("id % 20 = 0"), df, 20, recall=1).collect())
    assert set(got) == set(want)
    for q, found in got.items():
        if q == 400:  # two vectors of one id: a candidate has its best score
            both = {}
            for r in range(2):
                mine = [v for i, v in good if i == 400][r]
                for n, (i, w) in enumerate(good):
                    if i != 400:
                        both[n] = max(both.get(n, -9e9), float((mine * w).sum()))
            best = sorted((-s, good[n][0]) for n, s in both.items())[:20]
            assert [x[1] for x in found] == [i for _, i in best]
            continue
        assert [x[:2] for x in found] == [x[:2] for x in want[q][0]]
        assert np.allclose([x[2] for x in found], [x[2] for x in want[q][0]], atol=1e-12)


def test_query_scores_are_exact_and_recall_is_high(spark, save):
    rows = cases() + [(i, np.random.default_rng(i).normal(size=6)) for i in range(400, 2400)]
    got = listed(registry.QUERIES["op1_nearest_neighbours"](spark, save(embeddings=vectors(spark, rows))).collect())
    good = usable(rows, zero=False)
    by = {i: v for i, v in good}
    want = brute(good, 20, 20, lambda a, b: float((a * b).sum()))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, 21)) and q not in {x[1] for x in found}
        assert np.allclose([x[2] for x in found], [(by[q] * by[x[1]]).sum() for x in found], atol=1e-12)
        assert [(-x[2], x[1]) for x in found] == sorted((-x[2], x[1]) for x in found)
        hits += len({x[1] for x in found} & {x[1] for x in want[q][0]})
    assert hits >= 0.9 * 20 * len(want)


def share_and_recall(spark, x, every):
    """Of a forest fitted as the operator does: mean share of rows in visited leaves, and recall of the operator."""
    rows = vectors(spark, list(enumerate(x))).select("vec_id", "embedding").withColumnsRenamed({"vec_id": "id", "embedding": "vec"})
    got = ann.nearest(rows.filter(f"id % {every} = 0"), rows, 20).toPandas()
    x = x.astype(np.float32).astype(float)
    sample = ann.lift(x, np.linalg.norm(x, axis=1).max())
    forest = ann.Forest(sample, int(np.log2(min(len(x) / ann.LEAF, len(x) / 8))))
    forest.calibrate(sample, 20, ann.RECALL)
    leaves, hits, share, n = forest.leaves(sample), 0, 0.0, 0
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-s)[:20].tolist()))
        seen = forest.visit(ann.lift_query(x[q : q + 1])[0])
        share += np.logical_or.reduce([seen[t][leaves[t]] for t in range(forest.trees)]).mean()
        n += 1
    return share / n, hits / (20 * n)


def test_forest_recall_and_share(spark):
    """Vectors of many lengths without structure, and in clusters, where a small share of the rows is enough."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32)) * rng.uniform(0.5, 1.5, (6000, 1))
    share, recall = share_and_recall(spark, x, 100)
    assert recall >= 0.9 and share < 0.65
    centres = rng.normal(size=(150, 32))
    share, recall = share_and_recall(spark, centres[rng.integers(0, 150, 6000)] + 0.3 * rng.normal(size=(6000, 32)), 100)
    assert recall >= 0.9 and share < 0.3


# pages

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
<div class="content with-sidebar"><h1>Ti&eacute;tle</h1><p>One <a href=x>link</a> text.<p>Two<br>more&nbsp;stuff.<ul><li>a<li>b</ul><div class="ad-box">BUY</div></div>
<div id="comments"><article class="comment">nice</article></div><aside>side</aside><form><input>name</form><script>if (a<b) {"</p>"}</script><footer>f</footer>"""


def test_blocks_by_structure():
    assert pages.main_texts([pages.blocks(PAGE)])[0][0] == "Tiétle\n\nOne link text.\n\nTwo more stuff.\n\na\n\nb"
    kept = lambda h: pages.main_texts([pages.blocks(h)])[0][0]
    assert kept("<article><header><h1>A</h1></header><p>b &lt;c&gt;</p><footer>x</footer></article><p>out</p>") == "A\n\nb <c>"
    assert kept('<p class="x>a b<p>c') == "a b\n\nc" and kept("x<!-- y") == "x" and kept("a<b>c</b>d") == "acd" and kept("a < b <p") == "a < b"
    assert kept('<div class="wrap sidebar"><article>in</article></div>') == "in"
    assert kept("") == "" and kept("<script>x") == "" and kept("<p>a</p><!-- b --><style>c</style>d") == "a\n\nd"
    assert kept('<main><p>m</p><div role="complementary">n</div><div hidden>h</div></main><p>o</p>') == "m"


def test_repeats_across_pages_of_a_host():
    top, end = "<div>Welcome to the best site of all the many sites</div>", "<div>Copyright all rights are with the owner of this site in every country</div>"
    made = [pages.blocks(f"<body>{top}<div>own text {i} of this page, {i * 7} words or more, not found elsewhere</div>{end}") for i in range(5)]
    assert [t for t, _ in pages.main_texts(made)] == [f"own text {i} of this page, {i * 7} words or more, not found elsewhere" for i in range(5)]
    article = [pages.blocks(f"<body>{top}<article><p>The same long article text stands on each of these pages as it is</p></article>{end}") for _ in range(5)]
    assert {t for t, _ in pages.main_texts(article)} == {"The same long article text stands on each of these pages as it is"}


def texts_of(made):
    return [t for t, _ in pages.main_texts([pages.blocks(h) for h in made])]


def test_the_array_decides_on_pages_without_names_or_articles(monkeypatch):
    """Template text that no element or name gives away: in blocks of its own, and before text in one block."""
    line = "All the news that a reader of this fine place may ever want to read"
    own = [f"{chr(65 + i)}{i} tells of {i * 7} things that are {i * 13} times as good as others in year {1900 + i}" for i in range(8)]
    made = [f"<body><div>{line}</div><div>{line} {t}</div><p>{t} and more of {i}</p></body>" for i, t in enumerate(own)]
    want = [f"{t}\n\n{t} and more of {i}" for i, t in enumerate(own)]
    assert texts_of(made) == want
    monkeypatch.setattr(pages, "boilerplate", lambda streams, share: [np.zeros(sum(map(len, s)), dtype=bool) for s in streams])
    assert texts_of(made) != want


def test_the_array_decides_inside_articles():
    promo = "Read this and many other stories in our app which you can get for nothing"
    passage = "a passage of some length that a third of the articles quote word for word in their text"
    own = [f"Story {i} has {i * 7} heroes in {i * 11} towns and ends in year {1900 + i}" + (f" with {passage}" if i % 3 == 0 else "") for i in range(9)]
    made = [f"<body><article><p>{t}</p><p>{promo}</p></article></body>" for t in own]
    assert texts_of(made) == own
    assert texts_of(made[:2]) == [f"{t}\n\n{promo}" for t in own[:2]]  # two pages prove nothing
    assert texts_of([made[0]] * 9) == [f"{own[0]}\n\n{promo}"] * 9  # nor do copies of one


def test_shares_are_of_whole_hosts_however_they_are_cut(spark, monkeypatch):
    """Lines on about a tenth, a half and all of a host's pages: with chunks of 8, of 16 and of all pages one result, that of the host in memory."""
    rng = np.random.default_rng(5)
    lines = [" ".join(f"line{k}w{j}" for j in range(9 + k % 4)) for k in range(24)]
    rates = np.concatenate([np.linspace(0.04, 0.16, 12), np.linspace(0.4, 0.6, 10), [1.0, 0.02]])
    rows = []
    for i in range(160):
        tag = "article" if i % 3 else "div"
        said = [line if rng.random() < 0.5 else f"{line} and page {i} itself" for line, rate in zip(lines, rates) if rng.random() < rate]
        html = f"<body><div>{lines[0]}</div><{tag}>" + "".join(f"<p>{t}</p>" for t in [f"own words of {i}, {i * 7} in all", *said]) + f"</{tag}></body>"
        rows += [(i, f"http://{'big' if i < 140 else 'small'}.example/{i}", html)] * (5 if i % 20 == 0 else 1)
    rows += [(900, None, None), (901, "http://big.example/x", ""), (902, None, "<p>text of no host at all</p>")]
    hosts: dict = {}
    for i, url, html in rows:
        hosts.setdefault((url or "").partition("//")[2].partition("/")[0], []).append((i, html))
    want = sorted((i, *found) for host in hosts.values() for (i, _), found in zip(host, pages.main_texts([pages.blocks(h or "") for _, h in host])))
    assert sum(n > 0 for _, _, n in want) > 100
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (8, 16, 4096):
        monkeypatch.setattr(pages, "CHUNK", chunk)
        got = pages.extract(df).select("page_id", "text", "n_boilerplate").collect()
        assert sorted(map(tuple, got)) == want


def test_findings_are_the_runs_on_enough_streams():
    rng = np.random.default_rng(3)
    streams = [[[f"w{t}" for t in rng.integers(0, 2, rng.integers(0, 30))] for _ in range(3)] for _ in range(6)]
    count = Counter(g for s in streams for g in {tuple(seg[i : i + pages.LONG]) for seg in s for i in range(len(seg) - pages.LONG + 1)})
    for least in (1, 2, 3):
        assert sorted(pages.repeats(streams, least).values()) == sorted(n for n in count.values() if n >= least)
    grams = np.array(list(pages.repeats(streams, 2)), dtype=np.int64)
    for s in streams:
        flags = [[any(count[tuple(seg[i : i + pages.LONG])] >= 2 for i in range(max(0, j - pages.LONG + 1), j + 1) if i + pages.LONG <= len(seg)) for j in range(len(seg))] for seg in s]
        assert pages.covered(s, grams).tolist() == [f for seg in flags for f in seg]


def test_parsing_is_linear():
    assert pages.blocks("<![CDATA[a" * 30_000 + "<p>b") != [] and pages.blocks("<div>" * 20_000 + "</p>" * 20_000 + "x") == [(pages.OUTSIDE, "x")]
    assert pages.main_texts([pages.blocks("<p><![CDATA[a b]]> c</p>")])[0][0] == "a b c"


def test_prefix_classes_are_equal_for_equal_prefixes():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 3, 200)
    ranks = pages.prefix_classes(tokens, 4)
    prefix = [tuple(tokens[i : i + 4]) for i in range(200)]
    assert all((ranks[i] == ranks[j]) == (prefix[i] == prefix[j]) for i in range(200) for j in range(i))
    assert [prefix[i] for i in np.argsort(ranks, kind="stable")] == sorted(prefix)


def test_pages_query(spark, save):
    schema = "page_id long, url string, html string, host string, chunk int, places string"
    rows = [(1, "http://A.example/x", "<article><p>t &amp; u</p></article>", "h", 1, "p"), (2, None, None, None, None, None), (None, "http://a.example/", "", "h", 1, "p"), (1, "http://A.example/x", "<article><p>t &amp; u</p></article>", "h", 1, "p"), (3, "//b/", "<article>" + "<p>wide   word</p>" * 30_000, None, None, None)]
    got = registry.QUERIES["op4_page_text"](spark, save(pages=spark.createDataFrame(rows, schema))).collect()
    texts = sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in got)
    assert texts == [(0, "", 0), (1, "t & u", 5), (1, "t & u", 5), (2, "", 0), (3, "wide word", 30_000 * 9 + 29_999 * 2)]
    assert registry.QUERIES["op4_page_text"](spark, save(pages=spark.createDataFrame([], schema))).collect() == []
