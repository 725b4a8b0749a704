"""Links of stored pages: extraction, URL rules, mirror paths and the crawl loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import cut

COMPACT = 16
HREF = r"<a\s[^>]*?href=\"([^\"]*)\""


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a link, in page order: pos and link."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("pos", "link"))


def absolute(link: Column, page: Column, base: Column) -> Column:
    """https stays, http becomes https, // and / get scheme or site, anything else is relative to the page."""
    return (
        F.when(link.startswith("https"), link)
        .when(link.startswith("http"), F.concat(F.lit("https"), F.substring(link, 5, 1 << 30)))
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(F.rtrim(page, F.lit("/")), F.lit("/"), F.ltrim(link, F.lit("/"))))
    )


def extension(url: Column) -> Column:
    """From the last dot after the last slash; empty if there is none."""
    return F.regexp_extract(url, r"(\.[^./]*)$", 1)


def followed(url: Column) -> Column:
    """Whether a link is a page: no extension, or one with .html in it."""
    return (extension(url) == "") | extension(url).contains(".html")


def mirror_path(url: Column, base: Column, folder: str) -> Column:
    """Local file of a page of the site: fragment set aside, trailing slashes cut, index.html added."""
    local = F.concat(F.lit(folder), F.substr(url, F.length(base) + 1))
    path, fragment = F.split_part(local, F.lit("#"), F.lit(1)), F.regexp_extract(local, r"(#.*)$", 1)
    return F.concat(F.lit("file:///"), F.rtrim(path, F.lit("/")), F.lit("/index.html"), fragment)


def site(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/]+)", 1)


def same_site(url: Column, page: Column) -> Column:
    """Whether a URL is on the page's host, whatever the scheme; false for a URL without host."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#]+)", 1))
    return (host(url) != "") & (host(url) == host(page))


def rewritten(link: Column, page: Column, folder: str) -> Column:
    """What a mirrored page has in place of a link.

    https links stay as they are; links that are no pages, and links to other sites, become absolute; links to
    the page's own site become local files.  A local link with several fragments has no file: null.
    """
    target = absolute(link, page, site(page))
    fragments = F.length(target) - F.length(F.replace(target, F.lit("#"), F.lit("")))
    return (
        F.when(link.startswith("https"), link)
        .when(~followed(target) | ~same_site(target, page), target)
        .when(fragments <= 1, mirror_path(target, site(target), folder))
    )


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reachable from the roots over (src, dst), with the round each was first seen in.

    The frontier loop: join, distinct, anti-join against what was seen.  Each round's new nodes are a checkpoint, and
    what was seen is their union, rewritten as one only every ``COMPACT`` rounds, so a round writes what is new.
    """
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        reached = edges.join(frontier, edges.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
        if depth % COMPACT == 0:
            seen = cut(seen)
    return seen
