"""Pages by HTTP: a table of URLs to a table of pages, a data source of a few URLs, and the check of an entry page.

A page that can't be had is a row with its status, or without one, and the error; it fails no task.
A task that runs again asks again.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "url string, status int, html string, error string"
TIMEOUT = 10.0


def read_page(url: str | None, timeout: float = TIMEOUT) -> tuple[str | None, int | None, str | None, str | None]:
    """(url, status, html, error); html only with status 200, bytes that are no text of the page's charset replaced."""
    if url is None or not url.lower().startswith(("http://", "https://")):
        return url, None, None, "not an http URL"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            if answer.status != 200:
                return url, answer.status, None, answer.reason
            body, charset = answer.read(), answer.headers.get_content_charset() or "utf-8"
    except urllib.error.HTTPError as e:
        return url, e.code, None, str(e.reason)
    except (OSError, ValueError) as e:  # ValueError: a URL that cannot be parsed
        return url, None, None, str(e) or type(e).__name__
    except Exception as e:  # a broken answer: http.client's errors have no common base but this
        return url, None, None, f"{type(e).__name__}: {e}"
    try:
        return url, 200, body.decode(charset, "replace"), None
    except LookupError:
        return url, 200, body.decode("utf-8", "replace"), None


def fetch(urls: DataFrame, column: str = "url", timeout: float = TIMEOUT) -> DataFrame:
    """The pages of a table's URLs, a row each; the table's partitions are what is fetched side by side."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(read_page(url, timeout), types)], names=["url", "status", "html", "error"])

    return urls.select(urls[column].cast("string")).mapInArrow(read, PAGE)


def check_entry(url: str, timeout: float = TIMEOUT) -> str:
    """The URL itself if its page answers with status 200; else a ValueError."""
    _, status, _, error = read_page(url, timeout)
    if status != 200:
        raise ValueError(f"{url}: {error if status is None else status}")
    return url


class Slice(InputPartition):
    def __init__(self, urls: Sequence[str]):
        super().__init__(tuple(urls))
        self.urls = tuple(urls)


class PageReader(DataSourceReader):
    def __init__(self, urls: Sequence[str], tasks: int, timeout: float):
        self.urls, self.tasks, self.timeout = list(urls), max(1, tasks), timeout

    def partitions(self) -> list[Slice]:
        return [Slice(part) for k in range(self.tasks) if (part := self.urls[k :: self.tasks])] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return (read_page(url, self.timeout) for url in partition.urls)


class PageSource(DataSource):
    """``spark.read.format("pages").option("urls", "one a line").load()`` once registered; options tasks and timeout."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(self.options.get("urls", "").split(), int(self.options.get("tasks", "8")), float(self.options.get("timeout", TIMEOUT)))
