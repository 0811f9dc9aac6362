"""The receipt parser as a table function, for SQL: ``SELECT r.id, p.* FROM receipts r, LATERAL parse_receipt(r.raw_text) p``.

It gives the items of one text, as ``operators.receipts.items`` gives those of a table; that one needs no Python and is the way for
whole tables in DataFrame code.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tallyspark.operators import receipts as rules

SPACE = r" \t-\r"
ITEM = "line_index int, title string, quantity decimal(19,3), unit string, unit_price decimal(19,2), line_total decimal(19,2), raw_fragment string"


def python(pattern: str) -> re.Pattern:
    """A pattern of the column rules, whose white space is ASCII alone."""
    return re.compile(re.sub(r"(\[[^\]]*)\\s", rf"\1{SPACE}", pattern).replace(r"\s", f"[{SPACE}]"))


DECIMAL, DATE, TIME, BARCODE, WITH_UNIT, MULTIPLIER = map(python, (rules.DECIMAL, rules.DATE, rules.TIME, rules.BARCODE, rules.WITH_UNIT, rules.MULTIPLIER))
ENDS = [python(p) for p in rules.TITLE_ENDS]


SPACES, EDGES = re.compile(f"[{SPACE}]+"), "".join(map(chr, range(33)))


def normalised(line: str) -> str:
    return SPACES.sub(" ", line.replace(" ", " ")).strip(EDGES)


def clean_title(text: str) -> str:
    text = normalised(text)
    for pattern in ENDS:
        text = pattern.sub("", text)
    return text


def joined(titles: list[str]) -> str:
    out = ""
    for t in map(clean_title, titles):
        out = t if not out else clean_title(f"{out} {t}")
    return out


def decimal(text: str | None, scale: str) -> Decimal | None:
    """Rounded as a column of this scale, null if it has too many digits."""
    if not text:
        return None
    with localcontext() as c:
        c.prec = 60
        value = Decimal(text.replace(",", ".").replace(" ", "").replace(" ", "")).quantize(Decimal(scale), ROUND_HALF_UP)
    return value if len(value.as_tuple().digits) <= 19 else None


#: Words that ASCII lines may hold, and all words.
SERVICE, ADDRESS, TOTAL = (([w for w in words if w.isascii()], words) for words in (rules.SERVICE_WORDS, rules.ADDRESS_WORDS, rules.TOTAL_WORDS))
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def holds(low: str, words: tuple) -> bool:
    for w in words[0] if low.isascii() else words[1]:
        if w in low:
            return True
    return False


def counted(line: str) -> tuple[int, int]:
    """How many decimal digits and letters a line has."""
    if line.isascii():
        kinds = line.encode()
        return len(kinds) - len(kinds.translate(None, b"0123456789")), len(kinds) - len(kinds.translate(None, LETTERS))
    kinds = [unicodedata.category(ch) for ch in line]
    return kinds.count("Nd"), sum(k[0] == "L" for k in kinds)


def kind_of(line: str, low: str) -> str:
    digits, letters = counted(line)
    service = holds(low, SERVICE) or digits and holds(low, ADDRESS)
    if len(line) < 2 or service or BARCODE.search(line) or DATE.search(line) or TIME.search(line):
        return "other"
    if DECIMAL.search(line):
        return "inline" if letters else "amount"
    return "title" if letters >= 3 and digits <= max(6, 2 * letters) else "other"


def item(line: str, kind: str, pending: list[str]) -> tuple | None:
    """Title, quantity, unit, unit price, line total and fragment; None without a title."""
    above = joined(pending)
    own = clean_title(line[: DECIMAL.search(line).start()])
    title = clean_title(above) if kind == "amount" else clean_title(f"{above} {own}") if above else own
    if not title:
        return None
    values = [decimal(v, "0.01") for v in DECIMAL.findall(line)]
    source = line if kind == "inline" else above
    in_title, in_source, times = WITH_UNIT.search(title), WITH_UNIT.search(source), MULTIPLIER.search(source)
    named = in_title or in_source
    quantity = decimal(named[1] if named else times[1] if times else None, "0.001")
    each = decimal(times[2], "0.01") if times and not in_title else values[-2] if len(values) > 1 else None
    if each is None and quantity:
        with localcontext() as c:
            c.prec = 38
            each = (values[-1] / quantity).quantize(Decimal("0.01"), ROUND_HALF_UP)
    return title, quantity, named[2].lower() if named else None, each, values[-1], " | ".join([*pending, line])


@udtf(returnType=ITEM)
class ParseReceipt:
    def eval(self, text: str) -> Iterator[tuple]:
        pending: list[str] = []
        index = 0
        for line in filter(None, map(normalised, re.split(r"\r\n|\r|\n", text or ""))):
            low = line.lower()
            if holds(low, TOTAL):
                return
            kind = kind_of(line, low)
            if kind == "title":
                pending.append(line)
                continue
            if kind == "inline" or kind == "amount" and joined(pending):
                index += 1
                found = item(line, kind, pending)
                if found:
                    yield (index, *found)
            pending = []


def register(spark: SparkSession, name: str = "parse_receipt") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, ParseReceipt)
