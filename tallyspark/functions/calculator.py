"""Arithmetic of amount fields, by the rules of the language that evaluates them in a browser.

Numbers are 64-bit floating point; operators are + - * / ** and parentheses. A power binds tightest and to the right, and may not
follow a sign without parentheses; "++" and "--" are no pair of signs but other operators, which no number can have; a number of
several digits may not begin with 0; /* */ encloses what is skipped. The value is rounded to two decimals by its exact
binary value (1.005 is a little less than it looks, and gives 1.00). Anything else, and a value that is not finite, gives null.
"""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ALLOWED = re.compile(r"[-0-9+*/().]+")
SKIPPED = re.compile(r"/\*.*?\*/")
#: A number, or the longest operator; what is left in between is an error.
TOKEN = re.compile(r"(?:0|[1-9][0-9]*)(?:\.[0-9]*)?|\.[0-9]+|\+\+|--|\*\*|//|[-+*/()]")
WEIGHT = {"+": 1, "-": 1, "*": 2, "/": 2, "**": 3, "sign +": 4, "sign -": 4}


def tokens(text: str) -> list[str] | None:
    found, at = [], 0
    while at < len(text):
        if gap := SKIPPED.match(text, at):
            at = gap.end()
            continue
        m = TOKEN.match(text, at)
        if not m or m[0] in ("++", "--", "//"):
            return None
        found.append(m[0])
        at = m.end()
    return found


def divided(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


def raised(a: float, b: float) -> float:
    if abs(a) == 1 and math.isinf(b):
        return math.nan
    try:
        return math.pow(a, b)
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan


def evaluate(text: str | None) -> float | None:
    """The value, or None for an empty, malformed or non-finite expression."""
    text = re.sub(r"\s+", "", text or "")
    found = tokens(text) if ALLOWED.fullmatch(text) else None
    values: list[float] = []
    waiting: list[str] = []

    def apply() -> None:
        op, b = waiting.pop(), values.pop()
        if op.startswith("sign"):
            values.append(-b if op == "sign -" else b)
        else:
            a = values.pop()
            values.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else divided(a, b) if op == "/" else raised(a, b))

    operand = True  # one is expected
    for t in found or []:
        if operand and t == "(":
            waiting.append(t)
        elif operand and t in "+-":
            waiting.append(f"sign {t}")
        elif operand and (t[0].isdigit() or t[0] == "."):
            values.append(float(t))
            operand = False
        elif operand or t == "(" or t not in WEIGHT and t != ")":
            return None
        elif t == ")":
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                return None
            waiting.pop()
        else:
            if t == "**" and waiting and waiting[-1].startswith("sign"):
                return None
            while waiting and waiting[-1] != "(" and (WEIGHT[waiting[-1]] > WEIGHT[t] or WEIGHT[waiting[-1]] == WEIGHT[t] and t != "**"):
                apply()
            waiting.append(t)
            operand = True
    if operand or "(" in waiting:
        return None
    while waiting:
        apply()
    value = values[0]
    if not math.isfinite(value):
        return None
    return value if abs(value) >= 1e21 else float(Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_UP)) + 0.0


@F.pandas_udf(DoubleType())
def calculate(expressions: pd.Series) -> pd.Series:
    """Values of a batch; each distinct expression is read once."""
    known = {text: evaluate(text) for text in expressions.unique()}
    return expressions.map(known).astype("float64").where(lambda x: x.notna(), None)
