"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,2)"


def trimmed(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020, not only spaces."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def has_text(c: Column) -> Column:
    """Has it a character that is no white space? False for null."""
    return F.coalesce(c.rlike(r"[^\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]"), F.lit(False))


def optional_text(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def category_key(c: Column) -> Column:
    return F.upper(trimmed(c))


def email_key(c: Column) -> Column:
    return F.lower(trimmed(c))


def money(c: Column) -> Column:
    return c.cast(MONEY)


def money_text(c: Column) -> Column:
    """Two decimals, no grouping."""
    return c.cast(MONEY).cast("string")


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("_"), F.lit("-"))


def safe_file_name(c: Column) -> Column:
    """The last part of a path, with anything but letters, digits, dot, underscore and hyphen replaced."""
    base = F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    return F.regexp_replace(base, "[^A-Za-z0-9._-]", "_")


#: Categories that have a label of their own. Fixed values.
LABELS = {"FOOD": "Food", "UTILITIES": "Utilities", "TRANSPORT": "Transport", "HEALTH": "Health", "ENTERTAINMENT": "Entertainment", "SHOPPING": "Shopping", "HOUSING": "Housing", "EDUCATION": "Education", "FAMILY": "Family", "TRAVEL": "Travel", "SUBSCRIPTIONS": "Subscriptions", "BILLS": "Bills", "OTHER": "Other"}


def mapped(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), c)


def object_key(prefix: str, user_id: Column, *rest: Column) -> Column:
    """A key that no other object has: prefix/user/..., where a part ``F.uuid()`` makes it one of its own."""
    return F.concat_ws("/", F.lit(prefix), user_id.cast("string"), *rest)


def report_key(user_id: Column, kind: Column, year: Column, month: Column, form: Column) -> Column:
    name = F.concat_ws("-", F.format_string("%d-%02d", year, month), F.lower(form), F.uuid())
    return object_key("reports", user_id, slug(kind), F.concat(name, F.lit("."), F.lower(form)))


def receipt_key(user_id: Column, file_name: Column) -> Column:
    return object_key("receipts", user_id, F.concat_ws("-", F.uuid(), safe_file_name(file_name)))


def category_label(c: Column) -> Column:
    """The label of a known category, else the words of its key in title case."""
    return F.coalesce(mapped(category_key(c), LABELS), title_case(c))


def title_case(c: Column) -> Column:
    words = F.filter(F.split(F.lower(trimmed(c)), r"[_\s-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def percent(share: Column) -> Column:
    """One fraction digit below ten percent, else none."""
    return F.when(share < 0.1, F.round(share * 100, 1)).otherwise(F.round(share * 100, 0))


def csv_cell(c: Column) -> Column:
    """Quoted only if it has a comma, a quote or a newline; null is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))
