"""Token ids as files: a zstandard dictionary shared by all documents, one frame a document.

A folder holds ``dictionary`` and shards ``part-NNNNN.tok`` in ascending id order.
A shard is: magic, sha256 of the dictionary (32 bytes), bytes per id (1), frames,
index, length of the index (8), magic.  The index is a zstandard frame over four
arrays: document ids, a null flag each, ends of frames, and ids in each document; so a
reader gets at a short document with the index and one frame, and refuses a shard made
with another dictionary.

The dictionary is trained on the serialized ids of at most ``SAMPLE`` documents, those with the
smallest hash of id and text, leaving out those of more than ``SAMPLE_BYTES``, which need no dictionary; so the
driver gets a bounded sample.  Too few to train on serve as a raw dictionary instead.

Scale: documents are tokenized and compressed before the shuffle, so only frames
move; they are dealt by ranges of doc_id and each task streams one shard, written under a
temporary name and then renamed, so a task that is run again writes the same file.  The
driver holds one row a shard.  Files go to the folder that driver and executors share.

Cases: a null text is an empty one: its only id is the end id; a null doc_id comes
before all others; repeated doc_ids are all kept, side by side; an empty table gives a
folder without shards.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import tokens
from heddle.llm.batches import smallest_by_hash
from heddle.session import cut, shared_uri

MAGIC = b"HTOKENS1"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL, SHARD_DOCS = 1000, 65536, 65536, 3, 16384
HEAD = len(MAGIC) + 32 + 1


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; raw content where there is too little to train on; empty for none."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def codec_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    """Writes one shard; documents come in order as (doc_id, frame, number of ids)."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.path, self.temp = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temp)
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))
        self.at, self.ids, self.nulls, self.ends, self.counts = HEAD, [], [], [], []

    def add(self, doc_id: int | None, frame: bytes, count: int) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.at)
        self.counts.append(count)

    def close(self) -> None:
        index = b"".join(np.array(x, dtype=t).tobytes() for x, t in ((self.ids, "<i8"), (self.nulls, "u1"), (self.ends, "<u8"), (self.counts, "<u8")))
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(index)
        self.out.write(packed + struct.pack("<Q", len(packed)) + MAGIC)
        self.out.close()
        self.store.move(self.temp, self.path)


class ShardReader:
    """Reads one shard; document(k) gets one document by its place, with one read."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.file = self.store.open_input_file(f"{root}/{name}")
        head = self.file.read_at(HEAD, 0)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        if head[len(MAGIC) : -1] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        (length,) = struct.unpack("<Q", tail[:8])
        index = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, size - 8 - len(MAGIC) - length))
        n = len(index) // 25
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n)
        self.ends = np.frombuffer(index, "<u8", n, 9 * n)
        self.counts = np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
        self.kind = f"<u{head[-1]}"
        self.codec = zstandard.ZstdDecompressor(dict_data=codec_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.ends)

    def span(self, k: int) -> tuple[int, int]:
        return (int(self.ends[k - 1]) if k else HEAD), int(self.ends[k])

    def document(self, k: int) -> np.ndarray:
        lo, hi = self.span(k)
        return self.decode(self.file.read_at(hi - lo, lo))

    def decode(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.codec.decompress(frame), self.kind).astype("<u4")

    def documents(self, step: int = 512) -> Iterator[np.ndarray]:
        """All documents in order, read ``step`` frames at a time."""
        for lo in range(0, len(self), step):
            hi = min(lo + step, len(self))
            base = self.span(lo)[0]
            block = self.file.read_at(int(self.ends[hi - 1]) - base, base)
            for k in range(lo, hi):
                a, b = self.span(k)
                yield self.decode(block[a - base : b - base])


def sample_dictionary(docs: DataFrame, path: str, end: int, kind: str) -> bytes:
    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, ids, lens in tokens.cache(path).encode_column(batch.column("text"), end):
                ends = np.cumsum(lens)
                yield pa.RecordBatch.from_arrays([pa.array([ids[b - n : b].astype(kind).tobytes() for b, n in zip(ends, lens)], pa.binary())], names=["ids"])

    chosen = smallest_by_hash(docs, ["doc_id", "text"], SAMPLE, docs.count())
    found = chosen.mapInArrow(serialized, "ids binary").filter(F.octet_length("ids") <= SAMPLE_BYTES)
    return train([r.ids for r in found.collect()])


def write(docs: DataFrame, folder: str, path: str, end: int) -> list[tuple[str, int, int]]:
    """Write (doc_id, text) rows; (name, documents, ids) of each shard, in order."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = id_type(tokens.cache(path).tokenizer.get_vocab_size())
    dictionary = sample_dictionary(docs, path, end, kind)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.cache(path)
        data = codec_dictionary(dictionary)
        codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
        for batch in batches:
            for lo, hi, ids, lens in cache.encode_column(batch.column("text"), end):
                ends = np.cumsum(lens)
                narrow = ids.astype(kind)
                frames = [codec.compress(narrow[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(frames, pa.binary()), pa.array(lens)], names=["doc_id", "frame", "n"])

    def store_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), None
        name = f"part-{part:05d}.tok"
        for batch in batches:
            if batch.num_rows and shard is None:
                shard = ShardWriter(folder, name, dictionary, int(kind[-1]))
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "frame", "n"))):
                shard.add(*row)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(shard.counts)]), pa.array([sum(shard.counts)])], names=["part", "name", "docs", "ids"])

    frames = cut(docs.mapInArrow(compress, "doc_id long, frame binary, n long"))
    shards = max(1, -(-frames.count() // SHARD_DOCS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("n", "frame").asc()]  # the hash spreads an id that very many rows have
    dealt = frames.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    written = dealt.mapInArrow(store_shard, "part long, name string, docs long, ids long").collect()
    return [(r["name"], r["docs"], r["ids"]) for r in sorted(written, key=lambda r: r["part"])]


def read(spark, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32."""
    rows, start = [], 0
    for name, _, ids in shards:
        rows.append((name, start))
        start += ids
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/dictionary") as f:
        dictionary = f.read()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                shard = ShardReader(folder, name, dictionary)
                starts = base + np.cumsum(shard.counts) - shard.counts
                crcs, at = [], 0
                for ids in shard.documents():
                    if len(ids) != shard.counts[at]:
                        raise ValueError(f"{name}: document {at} has {len(ids)} ids, its index says {shard.counts[at]}")
                    crcs.append(zlib.crc32(ids))
                    at += 1
                doc_ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls.astype(bool))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(shard.counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "name string, base long").repartition(len(rows))
    return listed.mapInArrow(load, schema)


END = 1


def op8_token_files(spark, sf_dir):
    from heddle.sources.tables import load

    folder = shared_uri(spark, f"token-files-{uuid.uuid4().hex}")
    shards = write(load(spark, sf_dir, "documents"), folder, tokens.vocabulary("word_bpe_49k.json"), END)
    return read(spark, folder, shards)
