"""Personal data, plain and disguised, with spans in the source text.

Plain e-mail addresses, IP addresses, card and phone numbers are found in the text as it stands. All texts
are then run through transducers, each a rewriting of one kind of disguise that keeps, for every
character it writes, the source characters that it stands for: look-alike letters (in words that mix scripts), full-width forms and
other scripts' digits become ASCII, runs of spelled digits become digits, and "(at)", "[dot]", " at " and the
like become "@" and ".". Identifiers found in the rewritten text are mapped back to source spans; one
that overlaps a plain span, or that no rewriting took part in, is dropped. Plain spans stay as they are.

Null or empty text: no spans. Offsets are code points, ends exclusive. Repeated rows give equal results;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind as an index of KINDS, end

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is never left half-way by a match before, so a match can only begin where a run does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain; linear, since only places with an @ are looked at."""
    at = text.find("@")
    if at < 0:
        return
    back, n, free = text[::-1], len(text), 0
    while at >= 0:
        local = LOCAL.match(back, n - at, n - free)
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - len(local[0]), domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def plain_spans(text: str) -> list[Span]:
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


#: Letters that look like ASCII ones, as "what it becomes": what is written for it. Fixed values.
LOOK_ALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "к", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    ".": "․。｡", "@": "＠﹫", "-": "‐‑‒–−", "+": "＋",
}
SINGLE = str.maketrans({x: to for to, many in LOOK_ALIKES.items() for x in many})
#: All that ``single`` rewrites: the table, full-width forms and other scripts' digits.
FOREIGN = re.compile(rf"[{''.join(map(re.escape, map(chr, SINGLE)))}！-～]|(?![0-9])\d")
ASCII_LETTER, WORD_SIGN, WORD = re.compile(r"[A-Za-z]"), re.compile(r"\w"), re.compile(r"\w+")
#: Spelled digits of English, German, French and Spanish. Fixed values.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SPELT = "|".join(sorted(SPELLED, key=len, reverse=True))
#: One of these is in every spelled digit: the words that hold no other.
SPELT_PARTS = [w for w in map(str.casefold, SPELLED) if not any(x != w and x in w for x in map(str.casefold, SPELLED))]
#: A run of at least this many digits, one of them spelled, is taken as a spelled number.
SPELT_RUN = re.compile(rf"(?<!\w)(?:(?:{SPELT}|[0-9])(?:[ ,-]{{1,2}}|(?=\W)|\Z)){{3,}}", re.IGNORECASE)
SPELT_WORD = re.compile(rf"(?<!\w)(?:{SPELT})(?!\w)", re.IGNORECASE)
PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9])", re.IGNORECASE)
# White space in front is only tried from its beginning, so that long runs of it take linear time.
BRACKETED_AT = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*", re.IGNORECASE)
BRACKETED_DOT = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*", re.IGNORECASE)
#: Bare words stand for signs only where the whole reads as an address, on one line: name at host dot end.
GAP = r"[^\S\r\n]+"
BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>{GAP}at{GAP}|@)[A-Za-z0-9-]+(?:(?:{GAP}dot{GAP}|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
BARE_AT, BARE_DOT = re.compile(rf"{GAP}at{GAP}", re.IGNORECASE), re.compile(rf"{GAP}dot{GAP}", re.IGNORECASE)
BARE_LOCAL_DOT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{GAP}dot{GAP}[A-Za-z0-9_%+-]+)+(?=@)", re.IGNORECASE)
IP_DOT = re.compile(rf"(?<=[0-9]){GAP}dot{GAP}(?=[0-9])", re.IGNORECASE)


class Rewriting:
    """A text under rewriting, with the source span of each of its characters: none at all until something is rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.starts = self.ends = np.zeros(0, np.int32)
        self.changed: list[tuple[int, int]] = []  # source spans

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put texts in place of spans (of the text as it is now), given in order and not overlapping."""
        if not edits:
            return
        if not self.changed:
            self.starts = np.arange(len(self.text), dtype=np.int32)
            self.ends = self.starts + np.int32(1)
        text, at = [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            at = b
        a, b, n = (np.array(x, np.int64) for x in ([e[0] for e in edits], [e[1] for e in edits], [len(e[2]) for e in edits]))
        self.changed += zip(self.starts[a].tolist(), self.ends[b - 1].tolist(), strict=True)
        # Kept parts and new ones by turns: where each begins in the text as it is now, and how long it will be.
        begin, size = np.zeros(2 * len(a) + 1, np.int64), np.zeros(2 * len(a) + 1, np.int64)
        begin[2::2], begin[1::2], size[1::2] = b, a, n
        size[0::2] = np.append(a, len(self.text)) - begin[0::2]
        new = np.repeat(np.arange(len(size)) % 2 == 1, size)
        step = np.arange(len(new), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
        step[new] = 0
        source = np.repeat(begin, size).astype(np.int32) + step
        self.starts = self.starts[source]
        source[new] = np.repeat(b - 1, n)
        self.ends = self.ends[source]
        self.text = "".join([*text, self.text[at:]])


def single(c: str) -> str:
    """The ASCII character that one other character stands for, else itself."""
    if c < "\x80":
        return c
    to = c.translate(SINGLE)
    if to == c and c.isdecimal():
        return str(unicodedata.decimal(c))
    if to == c and "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return to


def spelt(text: str) -> Iterator[tuple[int, int, str]]:
    for run in SPELT_RUN.finditer(text):
        if SPELT_WORD.search(run[0]):
            digits = "".join(SPELLED.get(w.lower(), w) for w in re.findall(rf"{SPELT}|[0-9]", run[0], re.IGNORECASE))
            end = run.start() + len(run[0].rstrip(" ,-"))
            yield run.start(), end, digits


def looking_alike(text: str) -> Iterator[tuple[int, int, str]]:
    """Signs that stand for ASCII ones. A letter does only in a word that has ASCII letters as well; others are of the word's own script."""
    word_end, mixed = 0, False
    for m in FOREIGN.finditer(text):
        at = m.start()
        if m[0].isalpha() and not "！" <= m[0] <= "～":
            if at >= word_end:  # each word is looked at once
                first = at
                while first and WORD_SIGN.match(text, first - 1):
                    first -= 1
                word_end = WORD.match(text, first).end()
                mixed = ASCII_LETTER.search(text, first, word_end) is not None
            if not mixed:
                continue
        yield at, at + 1, single(m[0])


def whole_address(text: str, start: int, end: int) -> bool:
    """Does an address that rewriting has brought out neither begin nor end within a word of another script?"""
    return not (start and WORD_SIGN.match(text, start - 1) or end < len(text) and WORD_SIGN.match(text, end))


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    way = Rewriting(text)
    way.replace(list(looking_alike(text)) if not text.isascii() else [])
    # What the rewritings below look for; a text without it is left alone by them.
    folded = way.text.casefold()
    if any(w in folded for w in SPELT_PARTS):
        way.replace(list(spelt(way.text)))
    if "plus" in folded:
        way.replace([(m.start(), m.end(), "+") for m in PLUS.finditer(way.text)])
    if any(x in folded for x in "[({<"):
        way.replace([(m.start(), m.end(), "@") for m in BRACKETED_AT.finditer(way.text)])
        way.replace([(m.start(), m.end(), ".") for m in BRACKETED_DOT.finditer(way.text)])
    if "dot" in folded:
        way.replace([(m.start(), m.end(), ".") for m in IP_DOT.finditer(way.text)])
        inner = []
        for m in BARE.finditer(way.text):
            if "dot" in m[0].lower():
                parts = [(x.start(), x.end(), "@") for x in BARE_AT.finditer(way.text, *m.span("at"))] + [(x.start(), x.end(), ".") for x in BARE_DOT.finditer(way.text, m.end("at"), m.end())]
                inner += parts
        way.replace(inner)
        way.replace([(x.start(), x.end(), ".") for m in BARE_LOCAL_DOT.finditer(way.text) for x in BARE_DOT.finditer(way.text, m.start(), m.end())])
    if not way.changed:
        return []
    changed, taken = Overlaps(way.changed), Overlaps([(a, b) for a, _, b in plain])
    found = ((a, kind, b) for a, kind, b in plain_spans(way.text) if kind or whole_address(way.text, a, b))
    sources = ((int(way.starts[a]), kind, int(way.ends[b - 1])) for a, kind, b in found)
    return [x for x in sources if changed.any(x[0], x[2]) and not taken.any(x[0], x[2])]


class Overlaps:
    """Tells if any of some spans overlaps a given one."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.furthest = list(itertools.accumulate((b for _, b in spans), max))

    def any(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.furthest[k - 1] > start


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(SPAN)), ("added", pa.list_(SPAN))])
    for batch in tx.chunks(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            plain = plain_spans(text or "")
            rows.append((plain, disguised_spans(text or "", plain)))
        lists = [[[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in r[i]] for r in rows] for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.list_(SPAN)) for x in lists)], schema=schema)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
SPANS = "array<struct<start: long, kind: string, end: long>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the plain spans (base) and those found only behind a disguise (added), each by start."""
    return docs.select("doc_id", "text").mapInArrow(detect, f"doc_id long, base {SPANS}, added {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    rank = lambda x: F.array_position(F.lit(list(KINDS)), x["kind"])
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of plain spans, as the digest is; ``spans`` has all, ``n_added`` those behind a disguise."""
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *(of_kind(base, k) for k in KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
