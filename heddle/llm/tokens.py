"""Token ids of whole texts by public tokenizers, with a cache of pieces.

Both tokenizers used here split a text at white space before anything else, so
what a piece between white space becomes does not depend on its neighbours.  A
text is cut at single spaces and newlines, each distinct piece goes through the
tokenizers library once while it stays in the cache, and ids are gathered from
the cache with numpy.  Where a new piece is letters, or letters and then marks, only its
letters go through the library's model, and only if they are new too.  A text with any other
white space, doubled, leading or trailing white space goes through the library as it is.

The vocabulary file's path is a parameter everywhere; nothing is copied or trained.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from heddle.llm.batches import parts

CACHED_PIECES = 500_000  # once a worker's cache holds more, it keeps the pieces met more than once of late
CHUNK_CHARS, CHUNK_TEXTS = 1 << 20, 1000  # texts worked on at a time
ODD_SPACE = re.compile(r"[^\S \n]")
MARKS = ".,;:!?%&*$#()[]|"  # after letters, marks are a token of their own kind


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its own character if that is visible, else as one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTES = byte_letters()


class Slots(dict):
    """Piece -> place in the store; unknown pieces get the next place and are noted."""

    def __init__(self, owner: PieceCache, prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.owner.size
        self.owner.size += 1
        self.owner.new.append(piece)
        self.owner.prefixes.append(self.prefix)
        return n


class PieceCache:
    """One tokenizer and the ids of the pieces seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.bare):
            t.encode_special_tokens = True
            t.model._resize_cache(0)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.newline = self._ids("\n")
        self.keeps_space = len(self.newline) > 0
        self.mark = self.bare.encode(BYTES[10], add_special_tokens=False).ids[0]  # a newline never stands in a piece
        self.reset()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def reset(self) -> None:
        self.size, self.new, self.prefixes = 0, [], []
        self.head, self.tail = Slots(self, ""), Slots(self, " ")
        self.hits = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts, self.lens = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=np.int32)
        self.used = self.filled = 0
        if self.keeps_space:
            self.head["\n"] = 0
            self._place([0], self.newline, np.array([len(self.newline)]))
            self.size = self.filled = 1

    def shrink(self) -> None:
        """Keep what was met more than once since it came or since the last time, half the limit at most."""
        floor = max(1, int(np.partition(self.hits, -CACHED_PIECES // 2)[-CACHED_PIECES // 2])) if len(self.hits) > CACHED_PIECES // 2 else 1
        keep = self.hits > floor
        if self.keeps_space:
            keep[0] = True
        at, place = np.nonzero(keep)[0], np.cumsum(keep) - 1
        lens = self.lens[at]
        ids = self.flat[ranges(self.starts[at], lens)]
        slots, hits = (self.head, self.tail), self.hits[at] // 2
        self.reset()
        self.used = self.filled = 0
        self._place(np.arange(len(at)), ids, lens)
        self.size = self.filled = len(at)
        self.hits = hits
        for new, old in zip((self.head, self.tail), slots):
            new.update((k, int(place[v])) for k, v in old.items() if keep[v])

    def _place(self, at: list[int] | np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Store ids for the places ``at``, counted from the first unfilled one."""
        at = self.filled + np.asarray(at, dtype=np.int64)
        end, more = int(at.max(initial=-1)) + 1, len(ids)
        while end > len(self.lens):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        while self.used + more > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + more] = ids
        self.starts[at] = self.used + np.cumsum(lens) - lens
        self.lens[at] = lens
        self.used += more

    def _learn(self) -> None:
        """Ids of the new pieces."""
        if not self.new:
            return
        new, prefixes, self.new, self.prefixes = self.new, self.prefixes, [], []
        plain, plain_at, rest, rest_at = [], [], [], []
        for k, (prefix, piece) in enumerate(zip(prefixes, new)):
            core = piece.rstrip(MARKS)
            if core.isalpha() and (self.keeps_space or core.isascii() or max(core) < "\u0180" and "\u0130" not in core):
                plain.append(prefix + piece if len(core) == len(piece) else f"{prefix}{core}\0{piece[len(core) :]}")
                plain_at.append(k)
            else:
                rest.append(prefix + piece)
                rest_at.append(k)
        self._place(plain_at, *self._words(plain))
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        self._place(rest_at, np.array(list(chain.from_iterable(whole)), dtype=np.uint32), np.array([len(x) for x in whole], dtype=np.int32))
        self.filled += len(new)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words, \\0 between letters and marks, in one call of the model alone.

        Words are written as the vocabulary writes bytes, with a newline, which no word holds, between them.
        """
        if not words:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)
        joined = "\n".join(words)
        read = (joined if self.keeps_space else joined.lower()).encode().decode("latin-1").translate(BYTES)
        read = read.replace(BYTES[10], f" {BYTES[10]} ").replace(BYTES[0], " ")
        ids = np.array(self.bare.encode_batch_fast([read], add_special_tokens=False)[0].ids, dtype=np.uint32)
        between = ids == self.mark
        cuts = np.nonzero(between)[0]
        assert len(cuts) == len(words) - 1
        return ids[~between], (np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1).astype(np.int32)

    def _pieces(self, text: str, out: array) -> bool:
        """Add the places of a text's pieces; False where the text must go through whole."""
        if not self.keeps_space:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return False
            out.extend(map(self.head.__getitem__, text.split()))
            return True
        if not text:
            return True
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or ODD_SPACE.search(text):
            return False
        head, tail = self.head.__getitem__, self.tail.__getitem__
        first = True
        for line in text.split("\n"):
            if not first:
                out.append(0)
            first = False
            words = line.split(" ")
            out.append(head(words[0]))
            out.extend(map(tail, words[1:]))
        return True

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another as uint32, number of ids of each text), ``end`` added to each text."""
        if self.size > CACHED_PIECES:
            self.shrink()
        last = 0 if end is None else 1
        places, counts, whole = array("i"), [], []
        for i, t in enumerate(texts):
            before = len(places)
            if not self._pieces(t, places):
                whole.append(i)
            counts.append(len(places) - before)
        self._learn()
        at = np.frombuffer(places, dtype=np.int32) if places else np.zeros(0, dtype=np.int32)
        hits = np.bincount(at, minlength=self.size).astype(np.int32)
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        lens = self.lens[at]
        sums = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        text_ends = np.cumsum(counts, dtype=np.int64)
        n_ids = sums[text_ends] - sums[text_ends - counts]
        gathered = self.flat[ranges(self.starts[at], lens)]
        if not whole and not last:
            return gathered, n_ids
        odd = {i: np.array(e.ids, dtype=np.uint32) for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False))} if whole else {}
        total = n_ids.copy()
        for i, ids in odd.items():
            total[i] = len(ids)
        total += last
        begins = np.cumsum(total) - total
        if not odd:  # only an end after each text
            return np.insert(gathered, np.cumsum(n_ids), end).astype(np.uint32), total
        out = np.empty(int(total.sum()), dtype=np.uint32)
        if len(gathered):
            shift = begins - (np.cumsum(n_ids) - n_ids)
            out[np.arange(len(gathered)) + np.repeat(shift, n_ids)] = gathered
        for i, ids in odd.items():
            out[begins[i] : begins[i] + len(ids)] = ids
        if last:
            out[begins + total - 1] = end
        return out, total

    def encode_column(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """encode() over a column in bounded chunks: (first row, row after the last, ids, counts); null counts as empty."""
        for lo, hi in parts(texts, CHUNK_CHARS, CHUNK_TEXTS):
            yield lo, hi, *self.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()], end)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for each start, lens[i] of them, one after another."""
    total = int(lens.sum(dtype=np.int64))
    out = np.ones(total, dtype=np.int32 if total < 1 << 31 else np.int64)
    some = lens > 0
    s, n = starts[some], lens[some]
    if total:
        heads = np.cumsum(n) - n
        out[heads[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
        out[0] = s[0]
    return np.cumsum(out, out=out)


_CACHES: dict[str, PieceCache] = {}


def cache(path: str) -> PieceCache:
    """This worker's cache for a vocabulary file."""
    if path not in _CACHES:
        _CACHES[path] = PieceCache(path)
    return _CACHES[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
