"""A local mirror of stored pages: one file a page, below a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write (path, html) rows as files; (path, bytes) of what was written.

    ``folder`` is a URI that driver and executors share.  Paths are relative to it; folders are made
    as needed.  A file is written under a temporary name and renamed, so a task that runs again
    leaves the same files.  A null html is an empty file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths, sizes = batch.column("path").to_pylist(), []
            for path, html in zip(paths, batch.column("html").to_pylist()):
                target = f"{root}/{path.lstrip('/')}"
                if any(part == ".." for part in target.split("/")):
                    raise ValueError(f"{path} leaves the mirror")
                parent, _, name = target.rpartition("/")
                store.create_dir(parent, recursive=True)
                temporary = f"{parent}/.{name}-{uuid.uuid4().hex}"
                data = (html or "").encode()
                with store.open_output_stream(temporary) as out:
                    out.write(data)
                store.move(temporary, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return pages.select("path", "html").filter("path IS NOT NULL").mapInArrow(write, "path string, bytes long")
