"""Personal data in whole texts, plain and disguised, with offsets into the source.

Plain identifiers are found in the text as it is.  Disguised ones are looked for in
a normalised text that a chain of transducers makes, each keeping for every character
it writes the span of source characters it stands for:

1. homoglyphs: look-alike letters and digits become ASCII, invisible characters vanish;
2. dots and ats: "[dot]", "(at)", " dot ", and " at " before a domain with a disguised dot;
3. spelled digits: runs of at least four digit words become digits, "plus" before one becomes +.

Identifiers found there are mapped back to source spans; one that touches a plain span
of its kind is left out, so plain spans stay as they are.

Scale: map-only, one pass, nothing gathered.  A text without any trace of a
disguise is not normalised; every pattern is linear in the text's length.

Cases: a null text is an empty one, without spans; repeated rows are treated alike; an
empty table gives an empty result.  Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.batches import text_parts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS_DOTS = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: one candidate an @, its local part as far back as it goes."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            pos = m.end()
            at = text.find("@", pos)
        else:
            pos = at + 1  # no match can span an @ that is not its own
            at = text.find("@", pos)
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of undisguised identifiers."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    dotted = (m.span() for m in DIGITS_DOTS.finditer(text) if m.group().count(".") > 2)
    out += [("ip", *m.span()) for a, b in dotted for m in IP.finditer(text, a, b) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


# Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ь": "b", "в": "b", "г": "r", "к": "k", "м": "m", "н": "h", "т": "t", "п": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"


def homoglyphs() -> dict[str, str]:
    """One character to one ASCII character or none: compatibility forms and digits of any script by rule."""
    out = {c: "" for c in INVISIBLE}
    for cp in range(0x100, 0x20000):
        c = chr(cp)
        folded = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            out[c] = str(digit)
        elif len(folded) == 1 and "!" <= folded <= "~":
            out[c] = folded
    return out | LOOKALIKES


HOMOGLYPHS = homoglyphs()


def has_glyphs(text: str) -> bool:
    """Whether a character of the text is in HOMOGLYPHS; Latin-1 has only one, the soft hyphen."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return "\u00ad" in text
    except UnicodeEncodeError:
        return not HOMOGLYPHS.keys().isdisjoint(text)


# Spelled digits and the words and brackets of disguises.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
GAP = r"(?:(?<=\S)\s+)?"  # white space from its beginning only, so that a long run is read once
OPEN, CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
DOT = re.compile(rf"{GAP}{OPEN}(?:dot|punkt|point|punto|\.){CLOSE}\s*|(?<=[A-Za-z0-9])\s+(?:dot|DOT|Dot)\s+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[_-](?:dot|DOT)[_-](?=[A-Za-z0-9])", re.I)
LABEL = "[A-Za-z0-9-]{1,63}"  # a label of a host name has 63 characters at most, so looking ahead is bounded
AT = re.compile(rf"{GAP}{OPEN}(?:at|arroba|@){CLOSE}\s*|(?<=[A-Za-z0-9])\s+@\s*(?=[A-Za-z0-9-]+[.\ue001])|(?<=[A-Za-z0-9])@\s+(?=[A-Za-z0-9-]+[.\ue001])|(?<=[A-Za-z0-9])(?:\s+at\s+|[_-]at[_-])(?={LABEL}(?:\.{LABEL}){{0,8}}\ue001[A-Za-z0-9-])", re.I)
WORD = "(?:" + "|".join(SPELLED) + ")"
SPELLED_RUN = re.compile(rf"(?<![A-Za-z])(?:plus[\s-]+(?={WORD}))?{WORD}(?:[\s,.-]{{1,2}}{WORD}){{3,}}(?![A-Za-z])|(?<![A-Za-z])plus[\s-]+(?=[0-9])|(?<![A-Za-z]){WORD}(?:[\s-]{WORD})*(?=\ue001)|(?<=\ue001){WORD}(?:[\s-]{WORD})*(?![A-Za-z])", re.I)
TOKEN = re.compile(rf"plus[\s-]+|{WORD}|[\s,.-]+", re.I)
BRACKETED = re.compile(rf"{OPEN}(?:at|arroba|@|dot|punkt|point|punto|\.){CLOSE}", re.I)
LONE_DOT = re.compile(r"(?:(?<![^\W_])dot|[_-]dot)(?![^\W_])")
TELLING = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "zero", "one one", "one-one", "oh oh", "one oh", "oh one", "plus ")
SPELLED_TRACE = re.compile(rf"(?:{WORD}[\s,.-]{{1,2}}){{3}}{WORD}|plus[\s-]+[0-9]")
MARK = "\ue001"  # stands for a dot that was disguised


class Aligned:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, spans: Iterator[tuple[int, int, str]]) -> Aligned:
        """Replace spans (ascending) by strings, every character of which stands for its whole span."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in spans:
            text += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        if not at:
            return self
        return Aligned("".join([*text, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def fold_glyphs(x: Aligned) -> Aligned:
    return x.rewrite((i, i + 1, HOMOGLYPHS[c]) for i, c in enumerate(x.text) if c in HOMOGLYPHS)


def fold_disguises(x: Aligned) -> Aligned:
    x = x.rewrite((*m.span(), MARK) for m in DOT.finditer(x.text))
    return x.rewrite((*m.span(), "@") for m in AT.finditer(x.text))


def spelled_pieces(text: str) -> Iterator[tuple[int, int, str]]:
    for run in SPELLED_RUN.finditer(text):
        for m in TOKEN.finditer(text, *run.span()):
            word = m.group().lower()
            yield *m.span(), "+" if word.startswith("plus") else SPELLED.get(word, "")


def fold_digits(x: Aligned) -> Aligned:
    return x.rewrite(spelled_pieces(x.text))


def traces(text: str) -> bool:
    """Whether a text holds anything that a transducer would rewrite into part of an identifier."""
    if has_glyphs(text):
        return True
    if " @" in text or "@ " in text or "@\n" in text or "\n@" in text or any(c in text for c in "[({<") and BRACKETED.search(text):
        return True
    low = text.lower()
    if "dot" in low and LONE_DOT.search(low):
        return True
    return any(x in low for x in TELLING) and bool(SPELLED_TRACE.search(low))


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of identifiers that show only after normalising."""
    if not traces(text):
        return []
    x = Aligned(text)
    folded = fold_digits(fold_disguises(fold_glyphs(x)))
    if folded.text == text:
        return []
    out = []
    taken = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    for kind, a, b in plain(folded.text.replace(MARK, ".")):
        a, b = folded.source(a, b)
        at = bisect_right(taken[kind], a, key=lambda span: span[1])  # the first plain span that ends after a
        if at == len(taken[kind]) or taken[kind][at][0] >= b:
            out.append((kind, a, b))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, added spans) of a text."""
    text = text or ""
    base = plain(text)
    return base, disguised(text, base)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of spans that overlap, all are covered and the first names them."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to counts and digests of plain spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_parts(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in texts:
                base, more = find(text)
                for k, kind in enumerate(KINDS):
                    out[k].append(sum(s[0] == kind for s in base))
                out[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[5].append(listed(base + more))
                out[6].append(len(more))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every identifier in ``text`` replaced by its kind, n_chars kept true; other columns as they are."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in text_parts(batches):
            texts = []
            for text in found:
                spans = [s for part in find(text) for s in part]
                texts.append(redact(text, spans) if spans else text)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([o if o is None or t is None else len(t) for o, t in zip(old, texts)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def op3_pii(spark, sf_dir):
    from heddle.sources.tables import load

    return detect(load(spark, sf_dir, "documents"))
