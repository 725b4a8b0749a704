"""Toxicity scores on restored text: a noisy channel before the classifier.

Disguises are taken back first.  A suspicious token (letters mixed with digits or
symbols, single letters set apart, a letter three or more times in a row) is a
lattice: every character may stand for itself, for the letters it imitates, or for
nothing, repeated letters may stand for fewer, and separators may vanish.
Viterbi decoding under a character trigram model picks the likeliest reading, over all
states.  A token without such choices has one path, itself, and is not decoded.

The character model is counted over all documents; its table is bounded by the
alphabet, in which all letters outside of Latin-1 are one.  The classifier scores restored text:
features are words and word beginnings, and the weight of a feature is how often documents
that hold it are toxic.  A run of three or more letters in a disguised place counts as it stands, too, so
a reading that joins two words of a compound hides neither.
Its training rows are a bounded sample, at most ``TRAIN_ROWS`` labelled documents with the smallest hash
of their id; near copies among them (equal least shingle hash) count once.  Features
whose precision is under ``PURE`` or has a lower bound under ``SURE`` are left out, so common words,
beginnings that clean words share and names from one story do not matter.  A score is the noisy or of the features found.

Scale: counting, training counts and scoring are map-only passes with small
combined tables between; features are chosen in Spark, and only those that pass are
collected: they are bounded by the training rows, as each is in ``LEAST_DOCS`` toxic ones at least.  Long texts are worked on whole.

Cases: a null or empty text gets the base score; a null doc_id is not held out; missing, null or contradictory labels
take no part in training (a document with two different labels is left out); without
labelled rows every score is the base score; repeated rows are scored alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.batches import smallest_by_hash, text_parts
from heddle.session import cut

TRAIN_ROWS, HELD = 20_000, 500_000
PURE, SURE, LEAST_DOCS, Z, BASE = 0.95, 0.75, 8, 1.64, 0.02
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

# What characters of a disguise may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "{": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "*": "aeiou",
}
SEPARATORS = " ._-*~'`^"
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
SIZE = 64  # codes of the alphabet: 0 is a boundary, 1.. the letters, the last any other letter
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}

SPACES = re.compile(r"(\s+)")
LONG_RUN = re.compile(r"[^\W\d_]{3,}")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?=[\s.,;:!?]|$)")
RUNS = re.compile(r"([^\W\d_])\1\1")
WORD = re.compile(r"[^\W\d_]+")
RUN_WORD = re.compile(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
NOISE = re.compile(r"([^\w\s])\1\1+[.,]?$")
PUNCTUATION = ".,;:?\"'()[]{}<>"
TOUCHED = re.compile(r"[0-9@$!|+(<{€£¡*._\-~'`^" + INVISIBLE + "]")


def code_table() -> np.ndarray:
    table = np.zeros(1 << 16, dtype=np.int64)
    for cp in range(0x80, 1 << 16):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = SIZE - 1
    for c, i in CODE.items():
        table[ord(c)] = i
        table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = i
    return table


def trigram_counts(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Counts of character trigrams, each text between boundaries."""
    total = np.zeros(SIZE**3, dtype=np.int64)
    group: list[str] = []
    held = 0
    for t in [*texts, None]:
        if t:
            group.append(t)
            held += len(t)
        if group and (t is None or held > 1 << 19):
            cps = np.frombuffer("\n\n".join(["", *group, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes = table[np.minimum(cps, 0xFFFF)]
            total += np.bincount(codes[:-2] * SIZE * SIZE + codes[1:-1] * SIZE + codes[2:], minlength=SIZE**3)
            group, held = [], 0
    return total


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts over every text; a task sends one bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = code_table(), np.zeros(SIZE**3, dtype=np.int64)
        for _, texts in text_parts(batches):
            total += trigram_counts(texts, table)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, dtype=np.int64)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return counts


class CharModel:
    """Interpolated trigram log-probabilities over the alphabet."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + SIZE)
        p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
        self.log: list[float] = np.log(p3).ravel().tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest string through a lattice of (string of 0 or more characters, cost) choices.

        What all states begin with is put aside every 64 steps, so a step's work does not grow with the length.
        """
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        log, settled = self.log, []
        for step, choices in enumerate([*lattice, [(" ", 0.0)]], 1):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in states.items():
                for piece, cost in choices:
                    s, x, y = score - cost, a, b
                    for c in piece:
                        z = CODE.get(c, 0 if not c.isalpha() else SIZE - 1)
                        s += log[(x * SIZE + y) * SIZE + z]
                        x, y = y, z
                    held = new.get((x, y))
                    if held is None or s > held[0]:
                        new[x, y] = (s, text + piece)
            states = new  # pairs of letters that the last choices end in: bounded by the choices, whatever the length
            if step % 64 == 0:
                same = os.path.commonprefix([text for _, text in states.values()])
                settled.append(same)
                states = {at: (score, text[len(same) :]) for at, (score, text) in states.items()}
        return ("".join(settled) + max(states.values())[1]).strip()


# Costs: dropping a symbol or a digit, letting either part two words, a space between letters set apart.
DROP, DROP_DIGIT, KEEP, SPLIT = 2.0, 6.0, 6.0, 5.0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Choices for each character of a lower-case token."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, n = token[i], 1
        while i + n < len(token) and token[i + n] == c:
            n += 1
        if c in INVISIBLE:
            out.append([("", 0.0)])
        elif c.isalpha():
            out.append([(c, 0.0), (c * 2, 1.0)] if n > 2 else [(c * n, 0.0)])
        elif c in SEPARATORS or c in LEET:
            choices = [("", 0.0 if c in SEPARATORS else DROP_DIGIT if c.isdigit() else DROP), (" ", SPLIT if c in SEPARATORS else KEEP)]
            choices += [(x * k, 0.5 * (n > 1)) for x in LEET.get(c, "") for k in {1, min(n, 2)}]
            out.append(choices)
        else:
            out.append([(" ", 0.0)])
        i += n
    return out


class Restorer:
    """Finds disguised tokens of a text and decodes them; readings are cached up to a bound."""

    def __init__(self, model: CharModel, cached: int = 100_000):
        self.model, self.cached, self.seen = model, cached, {}

    def reading(self, token: str) -> str:
        if (found := self.seen.get(token)) is None:
            found = self.model.decode(lattice(token))
            if len(self.seen) >= self.cached:
                self.seen.clear()
            if len(token) <= 64:
                self.seen[token] = found
        return found

    @staticmethod
    def core(token: str) -> str | None:
        """The part of a token to decode, if letters meet digits, symbols or separators there."""
        core = NOISE.sub("", token).strip(PUNCTUATION).rstrip("!" + PUNCTUATION)
        if len(core) < 3 or core.isalpha() or not TOUCHED.search(core) or not any(c.isalpha() for c in core):
            return None
        return core

    def read(self, text: str) -> tuple[str, list[str]]:
        """The lower-case text with disguised places replaced by their readings, and these places as they were."""
        low, places = text.lower(), []

        def read_spaced(m: re.Match) -> str:
            places.append(m.group())
            return self.reading(m.group())

        low = SPACED.sub(read_spaced, low)
        touched, runs = TOUCHED.search(low), RUNS.search(low)
        if not touched and not runs:
            return low, places
        new = {}
        for token in set(low.split()):
            core = self.core(token) if touched and not token.isalpha() else None
            if core:
                new[token] = token.replace(core, self.reading(core))
                places.append(core)
            elif runs and RUNS.search(token):
                new[token] = RUN_WORD.sub(lambda m: self.reading(m.group()), token)
                places.append(token)
        return "".join([new.get(t, t) for t in SPACES.split(low)]) if new else low, places

    def restore(self, text: str) -> str:
        return self.read(text)[0]


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    restored, places = restorer.read(text or "")
    found = set(WORD.findall(restored))
    for place in places:
        found.update(LONG_RUN.findall(place))
    return found


def features_of(words: set[str]) -> set[str]:
    """Words (between boundaries) and word beginnings."""
    out = {f"{w} " for w in words if len(w) > 2}
    for n in PREFIXES:
        out.update({w[:n] for w in words if len(w) >= n})
    return out


def story(text: str | None) -> int:
    """Least hash of a text's five-word shingles: equal for most near copies."""
    words = (text or "").split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most TRAIN_ROWS labelled documents outside the held-out third, the smallest by hash."""
    labelled = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    labelled = labelled.filter("crc32(cast(doc_id AS string)) % 3 <> 1").select("doc_id", "toxic")
    return smallest_by_hash(labelled, ["doc_id"], TRAIN_ROWS, labelled.count())


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray) -> dict[str, float]:
    """Feature -> precision, from the bounded sample of labelled training rows."""
    chosen = training_rows(labels).select(F.col("doc_id").alias("l_id"), "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # at most TRAIN_ROWS rows

    def stories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_parts(batches):
            keys = np.array([story(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys)], names=["doc_id", "story"])

    firsts = rows.select("doc_id", "text").mapInArrow(stories, "doc_id long, story long").groupBy("story").agg(F.min("doc_id").alias("f_id"))
    rows = cut(rows.join(firsts.select("f_id"), F.col("doc_id") == F.col("f_id"), "left_semi").select("doc_id", "text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Toxic and all documents a feature, in tables of about HELD features."""
        restorer = Restorer(CharModel(counts))
        toxic, every = Counter(), Counter()

        def table() -> pa.RecordBatch:
            names = list(every)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([every[f] for f in names], pa.int64())], names=["feature", "t", "n"])

        for batch, texts in text_parts(batches):
            for text, label in zip(texts, batch.column("toxic").to_pylist()):
                here = features_of(words_of(text, restorer))
                every.update(here)
                if label:
                    toxic.update(here)
                if len(every) > HELD:
                    yield table()
                    toxic, every = Counter(), Counter()
        yield table()

    found = rows.select("text", "toxic").mapInArrow(count, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    return {r["feature"]: (r["t"] + 0.5) / (r["n"] + 1) for r in accepted(found).collect()}


def accepted(found: DataFrame) -> DataFrame:
    """The features (feature, t toxic of n documents) that are precise enough."""
    p, n = F.col("t") / F.col("n"), F.col("n")
    low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)  # lower end of the Wilson interval
    return found.filter(F.col("t") >= LEAST_DOCS).filter((F.col("t") >= PURE * n) & (low >= SURE))


class Scorer:
    def __init__(self, weights: dict[str, float], restorer: Restorer):
        self.restorer = restorer
        self.whole = {f[:-1]: w for f, w in weights.items() if f.endswith(" ")}
        self.begins = {n: {f: w for f, w in weights.items() if len(f) == n and not f.endswith(" ")} for n in PREFIXES}

    def score(self, text: str | None) -> float:
        words = words_of(text, self.restorer)
        found = [self.whole[w] for w in words & self.whole.keys()]
        for n, known in self.begins.items():
            if known:
                found += [known[f] for f in {w[:n] for w in words} & known.keys()]
        clean = 1.0 - BASE
        for p in sorted(found):
            clean *= 1.0 - p
        return 1.0 - clean


def scores(docs: DataFrame, weights: dict[str, float], counts: np.ndarray, carry: str | None = None) -> DataFrame:
    """doc_id and score of each document; with ``carry`` all its columns and the score under that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, Restorer(CharModel(counts)))
        for batch, texts in text_parts(batches):
            found = pa.array([scorer.score(t) for t in texts], pa.float64())
            if carry:
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, carry])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "score"])

    if carry:
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(carry, T.DoubleType())]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    counts = count_characters(docs)
    return train(docs, labels, counts), counts


def op10_toxicity(spark, sf_dir):
    from heddle.sources.tables import load

    docs = load(spark, sf_dir, "documents")
    weights, counts = fit(docs, load(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scores(docs, weights, counts).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
