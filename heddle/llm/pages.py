"""Main text of web pages: structure first, then repeats across a host's pages by suffix array.

A page becomes blocks of text in page order, each with the place it has in the page's
structure: inside an article, inside another main container, outside of both, or in chrome (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments).  Chrome goes.

The suffix array decides on the other blocks, of articles and of the rest: the token streams of a
host's pages are concatenated, suffixes are sorted by prefix doubling up to ``LONG`` tokens, and a
class of equal prefixes that occurs on enough pages, and on ``LEAST``, is boilerplate.  Enough is
``SHARE`` of the pages outside of articles and ``ARTICLE_SHARE`` inside: copies of an article, and passages
that many pages share, are article text too, and only what most articles of a host have in common is not.
Articles, and pages, that are equal count once for the same reason.  Runs of ``LONG`` tokens or
more that boilerplate covers go, unique runs stay; a block covered to ``COVERED`` goes as a whole.  A page with an article
element keeps its article's blocks, one with a main element that element's, others all blocks outside of chrome.

Scale: the shares are of whole hosts, in bounded memory.  The different token streams of a host are dealt by hash to
chunks of about ``CHUNK``, each with a suffix array of its own; a class on a share of a host's streams is on that share of
one chunk's at least, so the chunks' findings hold all of the host's.  A host of one chunk is then done; for others a
second pass counts the findings exactly in all their pages.  The last pass removes them.  Only the first shuffles text, and copies of a
stream leave a task once; the others read the pages anew, the second only those of hosts with something to count.
A finding is the 64-bit hash of its tokens; a chunk has at most its streams' mean number of tokens, divided by the share, of them.
Parsing is linear in the page.

Cases: a null html is an empty page, a null url a host of its own; a page without text gives an
empty string; repeated rows are separate pages; truncated and unclosed markup is read as far as
it goes; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_module
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import shared_dir

LONG, SHARE, ARTICLE_SHARE, LEAST, COVERED, CHUNK = 8, 0.1, 0.5, 3, 0.9, 512

COMMENT, CDATA = r"<!--(?:.*?-->|.*\Z)", r"|<!\[CDATA\[(?P<cdata>.*?)\]\]>"
ELEMENT = r"|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|(?P<loose>[^>]*)(?:>|\Z))"
TAG, TAG_AFTER_CDATA = re.compile(COMMENT + CDATA + ELEMENT, re.S), re.compile(COMMENT + ELEMENT, re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[a-z0-9]+")
GRAM = np.uint64(0x9E3779B97F4A7C15)  # an odd factor
ASIDE_NOTE = re.compile(r"\b(?:has|with|no|without)[-_]\w+")  # "with-sidebar" is not a sidebar

# Elements and names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img picture source".split())
RAW = frozenset("script style textarea title xmp".split())
UNSEEN = frozenset("head script style noscript template iframe object embed svg math canvas audio video textarea title xmp datalist".split())
STRONG = frozenset("nav footer aside form menu dialog button select fieldset".split())
STRONG_NAMES = frozenset("comment comments commentlist replies responses discussion disqus ad ads adsbygoogle adslot advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe signup".split())
WEAK_NAMES = frozenset("sidebar header footer masthead banner notice notices alert popup modal overlay promo promotion related recommended recommendations share sharing social widget pagination pager toolbar teaser teasers copyright login search skip paywall disclaimer toc".split())
MAIN_NAMES = frozenset("article articlebody post entry story content main".split())
STRONG_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())

OUTSIDE, MAIN, ARTICLE, CHROME = 0, 1, 2, 3


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(text)}


def names(value: str) -> set[str]:
    return set(TOKEN.findall(ASIDE_NOTE.sub(" ", value.lower())))


def standing(name: str, attrs: str, above: tuple[int, int]) -> tuple[int, int]:
    """(place, chrome) of an element's content: place OUTSIDE, MAIN or ARTICLE, chrome 0, 1 (weak) or 2 (strong)."""
    place, chrome = above
    a = attributes(attrs) if attrs and not attrs.isspace() else {}
    called = names(f"{a.get('class', '')} {a.get('id', '')}") if a else set()
    role = a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    if chrome == 2 or name in STRONG or hidden or role in STRONG_ROLES or (called & STRONG_NAMES and name not in ("body", "html", "main")):
        return place, 2
    if name == "article" or "articlebody" in a.get("itemprop", "").lower():
        return ARTICLE, 1 if called & WEAK_NAMES else 0
    if name == "main" or role == "main":
        return max(place, MAIN), 0
    if name in ("body", "html"):
        return place, chrome
    if name == "header" and place == OUTSIDE or called & WEAK_NAMES:
        return place, max(chrome, 1)
    if called & MAIN_NAMES and name in ("div", "section", "td"):
        return max(place, MAIN), chrome
    return place, chrome


def blocks(page: str) -> list[tuple[int, str]]:
    """(place, text) of a page's blocks in order; CHROME is one of the places."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, tuple[int, int]]] = []
    opened: Counter[str] = Counter()
    now, unseen, at = (OUTSIDE, 0), None, 0
    last_cdata = page.rfind("]]>")

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((CHROME if now[1] else now[0], text))
            held.clear()

    def pop(to: int) -> None:
        nonlocal now
        opened.subtract([name for name, _ in stack[to:]])
        del stack[to:]
        now = stack[-1][1] if stack else (OUTSIDE, 0)

    size = len(page)
    while at < size:
        m = (TAG if at < last_cdata else TAG_AFTER_CDATA).search(page, at)  # no end is looked for in vain
        if unseen is None and (end := m.start() if m else size) > at:
            text = page[at:end]
            held.append(html_module.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if "cdata" in (found := m.groupdict()) and found["cdata"] is not None and unseen is None:
            held.append(found["cdata"])
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if unseen is not None:
            if m["close"] and name == unseen or unseen == "head" and name == "body":
                unseen = None
            if unseen is not None or m["close"]:
                continue
        if m["close"]:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    flush() if stack[k][1] != now or name not in INLINE else None
                    pop(k)
                    break
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["loose"] or ""
        if name in UNSEEN:
            if not attrs.rstrip().endswith("/") or name in RAW:
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = close.end() if close else size
                else:
                    unseen = name
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            if attrs and (inner := standing(name, attrs, now)) != now:
                flush()
                stack.append((name, inner))
                opened[name] += 1
                now = inner
            continue
        flush()
        if stack and stack[-1][0] == "p" or stack and stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            pop(len(stack) - 1)
        now = standing(name, attrs, now)
        stack.append((name, now))
        opened[name] += 1
    flush()
    return out


def prefix_classes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` tokens (a power of two), equal for equal prefixes."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < length:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of LONG words along the last axis, from the words' hashes."""
    n = hashes.shape[-1] - LONG + 1
    mixed = np.zeros((*hashes.shape[:-1], max(n, 0)), dtype=np.uint64)
    for i in range(LONG if n > 0 else 0):
        mixed = mixed * GRAM + hashes[..., i : i + n]
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def enough(share: float, pages: int) -> int:
    return max(LEAST, int(np.ceil(share * pages)))


def repeats(streams: list[list[list[str]]], least: int) -> dict[int, int]:
    """Hashes of the runs of LONG tokens that occur in at least ``least`` streams, with the number of these.

    A stream is the segments of a page, a segment a run of tokens of one kind of block; no repeat goes across segments.
    """
    words: dict[str, int] = {}
    ids, owner = [], []
    for page, segments in enumerate(streams):
        for segment in segments:
            ids += [words.setdefault(w, len(words)) for w in segment]
            ids.append(-1)
            owner += [page] * (len(segment) + 1)
    if not ids:
        return {}
    tokens, of = np.array(ids, dtype=np.int64), np.array(owner, dtype=np.int64)
    breaks = tokens < 0
    tokens[breaks] = len(words) + np.arange(breaks.sum())  # every break is a token of its own
    ranks = prefix_classes(tokens, LONG)
    order = np.lexsort((of, ranks))  # the suffix array, up to LONG tokens, pages in order within a class
    r, p = ranks[order], of[order]
    new_class = np.concatenate([[True], r[1:] != r[:-1]])
    new_pair = new_class | np.concatenate([[True], p[1:] != p[:-1]])
    on_pages = np.bincount(np.cumsum(new_class) - 1, weights=new_pair).astype(np.int64)
    often, firsts = on_pages >= least, order[new_class]
    whole = np.convolve(breaks, np.ones(LONG, dtype=np.int64))[LONG - 1 :][: len(tokens)] == 0
    whole &= np.arange(len(tokens)) <= len(tokens) - LONG
    often &= whole[firsts]
    if not often.any():
        return {}
    vocabulary = list(words)
    windows = tokens[firsts[often][:, None] + np.arange(LONG)]
    used, at = np.unique(windows, return_inverse=True)
    hashes = np.array([xxhash.xxh64_intdigest(vocabulary[t]) for t in used.tolist()], dtype=np.uint64)[at.reshape(windows.shape)]
    return dict(zip(gram_hashes(hashes)[:, 0].tolist(), on_pages[often].tolist()))


def gram_places(segments: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
    """(first token in the stream, hashes of the windows) of every segment."""
    begin = 0
    for segment in segments:
        if len(segment) >= LONG:
            yield begin, gram_hashes(np.array([xxhash.xxh64_intdigest(w) for w in segment], dtype=np.uint64))
        begin += len(segment)


def covered(segments: list[list[str]], grams: np.ndarray) -> np.ndarray:
    """Flags over the tokens of a stream: whether one of the runs ``grams`` covers them."""
    size = sum(map(len, segments))
    edges = np.zeros(size + 1, dtype=np.int64)
    for begin, found in gram_places(segments) if len(grams) else ():
        starts = begin + np.flatnonzero(np.isin(found, grams))
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + LONG, -1)
    return np.cumsum(edges)[:size] > 0


def boilerplate(streams: list[list[list[str]]], share: float) -> list[np.ndarray]:
    """For each stream of a host, flags over its tokens: whether boilerplate covers them."""
    different = [s for s in {stream_text(s): s for s in streams}.values() if s]
    grams = np.array(list(repeats(different, enough(share, len(different)))), dtype=np.int64)
    return [covered(s, grams) for s in streams]


def unique_runs(text: str, words: list[str], gone: np.ndarray) -> str:
    """The block without its covered runs of LONG tokens or more; shorter ones begin or end in another block."""
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    long = [(a, b) for a, b in edges.tolist() if b - a >= LONG]
    if not long:
        return text
    starts, ends = [0, *(b for _, b in long)], [*(a for a, _ in long), len(words)]
    return " ".join(w for a, b in zip(starts, ends) for w in words[a:b])


def stream(page: list[tuple[int, str]], inside: bool) -> list[list[str]]:
    """Tokens of a page's blocks inside of articles, or outside of them and of chrome, by segments."""
    segments: list[list[str]] = [[]]
    for place, text in page:
        if place == CHROME or (place == ARTICLE) != inside:
            segments.append([])
        else:
            segments[-1] += text.split()
    return [s for s in segments if s]


def stream_text(segments: list[list[str]]) -> str:
    """A segment a line; tokens have no white space."""
    return "\n".join(" ".join(s) for s in segments)


def kept_text(page: list[tuple[int, str]], flags: list[np.ndarray] | None) -> tuple[str, int]:
    """(main text, tokens outside of chrome that boilerplate covers); flags are of the stream inside and of that outside of articles, None if its host has no boilerplate."""
    places = {place for place, _ in page}
    wanted = ARTICLE if ARTICLE in places else MAIN if MAIN in places else OUTSIDE
    if flags is None:
        return "\n\n".join(text for place, text in page if place == wanted), 0
    kept, at = [], [0, 0]
    for place, text in page:
        if place == CHROME:
            continue
        k, words = int(place != ARTICLE), text.split()
        gone = flags[k][at[k] : at[k] + len(words)]
        at[k] += len(words)
        if place == wanted and (not gone.any() or gone.mean() < COVERED):
            kept.append(unique_runs(text, words, gone))
    return "\n\n".join(kept), int(sum(f.sum() for f in flags))


KINDS = ((True, ARTICLE_SHARE), (False, SHARE))  # streams inside of articles and outside, with what is enough there


def main_texts(pages: list[list[tuple[int, str]]]) -> list[tuple[str, int]]:
    """kept_text of all pages of one host, in memory; extract gives the same."""
    flags = [boilerplate([stream(page, inside) for page in pages], share) for inside, share in KINDS]
    return [kept_text(page, list(f)) for page, *f in zip(pages, *flags)]


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, str]]]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield part, [blocks(h.as_py() or "") for h in part.column("html")]


def new_streams(part: pa.RecordBatch, found: list[list[tuple[int, str]]], seen: set) -> Iterator[tuple[int, str, int, int, list[list[str]]]]:
    """(row, host, kind, hash, segments) of the streams that the task has not met before on their host."""
    for row, (host, page) in enumerate(zip(part.column("host").to_pylist(), found)):
        for kind, (inside, _) in enumerate(KINDS):
            if segments := stream(page, inside):
                key = xxhash.xxh64_intdigest(stream_text(segments)) - (1 << 63)
                if (host, kind, key) not in seen:
                    seen.add((host, kind, key))
                    yield row, host, kind, key, segments


def host_grams(part: pa.RecordBatch) -> list[list[np.ndarray]]:
    """For every row the findings of its host, by kind."""
    at: dict[str, list[np.ndarray]] = {}
    for row, host in enumerate(part.column("host").to_pylist()):
        if host not in at:
            at[host] = [np.array(part.column(f"grams_{kind}")[row].as_py() or [], dtype=np.int64) for kind in range(len(KINDS))]
    return [at[host] for host in part.column("host").to_pylist()]


def by_host(grams: DataFrame) -> DataFrame:
    """(host, kind, gram) to a row a host with the findings of each kind."""
    return grams.groupBy("host").agg(*[F.collect_set(F.when(F.col("kind") == kind, F.col("gram"))).alias(f"grams_{kind}") for kind in range(len(KINDS))])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page_id, url, text, n_chars, n_boilerplate."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/hosts-{uuid.uuid4().hex}"

    def table(df: DataFrame, name: str) -> DataFrame:
        """The rows as a written table, whose size is known, so Spark broadcasts it only below its threshold."""
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for part, found in parsed(batches):
            rows = [(h, kind, key, stream_text(s)) for _, h, kind, key, s in new_streams(part, found, seen)]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int8(), pa.int64(), pa.string()))], names=["host", "kind", "key", "stream"])

    def find(chunk: pa.Table) -> pa.Table:
        host, kind, alone = chunk["host"][0].as_py(), chunk["kind"][0].as_py(), chunk["chunks"][0].as_py() == 1
        texts = set(chunk["stream"].to_pylist())
        share = KINDS[kind][1]
        least = enough(share, len(texts)) if alone else int(np.ceil(share * len(texts)))
        found = repeats([[line.split(" ") for line in t.split("\n")] for t in texts], least)
        n = len(found) + 1
        return pa.table(
            [pa.array([host] * n, pa.string()), pa.array([kind] * n, pa.int8()), pa.array([alone] * n), pa.array([None, *found], pa.int64()), pa.array([len(texts), *found.values()], pa.int64())],
            names=["host", "kind", "alone", "gram", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for part, found in parsed(batches):
            grams, rows = host_grams(part), []
            for row, h, kind, key, segments in new_streams(part, found, seen):
                mine = [g for _, g in gram_places(segments)]
                here = np.intersect1d(np.concatenate(mine), grams[row][kind]).tolist() if mine else []
                if here:
                    rows.append((h, kind, key, here))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int8(), pa.int64(), pa.list_(pa.int64())))], names=["host", "kind", "key", "grams"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in parsed(batches):
            kept = [
                kept_text(page, [covered(stream(page, inside), g) for (inside, _), g in zip(KINDS, grams)] if any(map(len, grams)) else None)
                for page, grams in zip(found, host_grams(part))
            ]
            texts = [t for t, _ in kept]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in kept], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_boilerplate"],
            )

    sizes = pages.groupBy("host").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    hosts = table(sizes.select(F.col("host").alias("h_host"), "chunks"), "sizes")
    streams = pages.select("host", "html").mapInArrow(deal, "host string, kind tinyint, key long, stream string")
    dealt = streams.join(hosts, F.col("host") == F.col("h_host"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # One column, so that a shuffle by host alone never passes for this one.
    dealt = dealt.withColumn("chunk", F.concat_ws("#", "kind", F.pmod("key", "chunks").cast("string"), "host"))
    found = dealt.select("host", "kind", "stream", "chunks", "chunk").groupBy("chunk").applyInArrow(find, "host string, kind tinyint, alone boolean, gram long, n long")
    found = table(found, "found")

    grams = found.filter("gram IS NOT NULL")
    open_ones = table(by_host(grams.filter("NOT alone").select("host", "kind", "gram").distinct()), "open")
    counted = pages.select("host", "html").join(open_ones, "host").mapInArrow(count, "host string, kind tinyint, key long, grams array<long>")
    counted = counted.dropDuplicates(["host", "kind", "key"]).select("host", "kind", F.explode("grams").alias("gram")).groupBy("host", "kind", "gram").count()
    totals = found.filter("gram IS NULL").groupBy("host", "kind").agg(F.sum("n").alias("streams"))
    share = F.when(F.col("kind") == 0, F.lit(KINDS[0][1])).otherwise(F.lit(KINDS[1][1]))
    decided = counted.join(totals, ["host", "kind"]).filter(F.col("count") >= F.greatest(F.lit(LEAST), F.ceil(share * F.col("streams"))))
    final = table(by_host(grams.filter("alone").select("host", "kind", "gram").union(decided.select("host", "kind", "gram"))), "boilerplate")

    return pages.join(final, "host", "left").mapInArrow(finish, "page_id long, url string, text string, n_chars long, n_boilerplate long")


# The tables' pages have one structure, which SQL can follow: an article of h1 and p elements.  A reference may lack its semicolon.
OP4_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_replace(regexp_replace(split_part(split_part(coalesce(html, ''), '<article>', 2), '</article>', 1), '<br>', ' ', 'g'), '</?b>', '', 'g') AS body FROM pages),
parts AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS found
  FROM articles)
SELECT page_id, url, text, length(text) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(found, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM parts)
"""


def op4_page_text(spark, sf_dir):
    from heddle.sources.tables import load

    return extract(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
