"""Purchases: normalisation, derived amounts, validation, listing and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import MONEY, category_key, has_text, money, optional_text, trimmed

CURRENCIES = ("USD", "EUR", "UAH", "RUB")


def item_total(items: DataFrame) -> DataFrame:
    """Adds ``total``: the line total if given, else quantity times price, else null."""
    derived = F.col("quantity") * F.col("unit_price")
    return items.withColumn("total", F.coalesce(money(F.col("line_total")), derived.cast(MONEY)))


def with_amounts(purchases: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``items_sum`` and ``derived_amount``: the sum of the items' totals if positive, else the given amount."""
    sums = item_total(items).groupBy("purchase_id").agg(F.sum("total").cast(MONEY).alias("items_sum"))
    joined = purchases.join(sums, F.col("id") == F.col("purchase_id"), "left").drop("purchase_id")
    return joined.withColumn("derived_amount", F.when(F.col("items_sum") > 0, F.col("items_sum")).otherwise(money(F.col("amount"))))


def normalised(requests: DataFrame) -> DataFrame:
    """Purchase requests with trimmed texts, upper-case category and blank options as null."""
    return requests.withColumns(
        {"title": trimmed(F.col("title")), "category": category_key(F.col("category")), "store_name": optional_text(F.col("store_name")), "comment": optional_text(F.col("comment")), "amount": money(F.col("amount"))}
    )


def exploded_items(requests: DataFrame) -> DataFrame:
    """Items of requests (``items array<struct>``) with their position from 0 as ``line_index``."""
    return requests.select(F.col("id").alias("purchase_id"), F.posexplode("items").alias("line_index", "item")).select("purchase_id", "line_index", "item.*")


def errors(requests: DataFrame) -> DataFrame:
    """Adds ``errors``, the messages of all broken rules joined by "; "; null if there is none."""

    def blank(c: str) -> Column:
        return ~has_text(F.col(c))

    rules = [
        (blank("title"), "title: must not be blank"),
        (blank("category"), "category: must not be blank"),
        (F.col("amount").isNull(), "amount: must not be null"),
        (F.col("amount") <= 0, "amount: must be greater than 0"),
        (~F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False)), "currency: must not be null"),
        (F.col("purchase_date").isNull(), "purchaseDate: must not be null"),
    ]
    found = F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules)), lambda x: x.isNotNull())
    return requests.withColumn("errors", F.nullif(F.array_join(found, "; "), F.lit("")))


def preview(purchases: DataFrame, n: int = 3) -> DataFrame:
    """Purchases with the first ``n`` of their ``items`` and how many more there are."""
    return purchases.withColumns({"shown": F.slice("items", 1, n), "more": F.greatest(F.size("items") - n, F.lit(0))})


def created(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New purchases with amounts derived from their items, those items, and refused requests with their ``errors``.

    ``requests``: id, user_id, title, category, amount, currency, purchase_date, store_name, comment and items (title, quantity, unit, unit_price, line_total).
    """
    checked = errors(normalised(requests))
    bad = F.filter(F.transform("items", lambda x, i: item_errors(x, i)), lambda e: e != "")
    broken = F.when(F.size(bad) > 0, F.array_join(bad, "; "))
    checked = checked.withColumn("errors", F.nullif(F.concat_ws("; ", "errors", broken), F.lit("")))
    good = checked.filter("errors is null")
    items = exploded_items(good).withColumns({"title": trimmed(F.col("title")), "unit": optional_text(F.col("unit")), "unit_price": money(F.col("unit_price")), "line_total": money(F.col("line_total"))})
    bought = with_amounts(good.drop("items", "errors"), items).withColumn("amount", F.col("derived_amount")).drop("items_sum", "derived_amount").withColumn("created_at", now)
    return bought, items, checked.filter("errors is not null")


def item_errors(item: Column, place: Column) -> Column:
    """Messages of an item's broken rules, joined by "; ", else an empty text."""
    name = lambda field: F.concat(F.lit("items["), place.cast("string"), F.lit(f"].{field}: "))
    blank = F.when(~has_text(item["title"]), F.concat(name("title"), F.lit("must not be blank")))
    numbers = [F.when(item[c] <= 0, F.concat(name(shown), F.lit("must be greater than 0"))) for c, shown in (("quantity", "quantity"), ("unit_price", "unitPrice"), ("line_total", "lineTotal"))]
    return F.concat_ws("; ", blank, *numbers)


def drafted(items: DataFrame) -> DataFrame:
    """Items as typed (all texts) as items of a request: numbers only if positive, totals derived, rows without anything left out."""
    number = lambda c: F.when(F.expr(f"try_cast({c} as decimal(19,3))") > 0, F.expr(f"try_cast({c} as decimal(19,3))"))
    typed = items.withColumns({"title": trimmed(F.col("title")), "unit": optional_text(F.col("unit")), **{c: number(c) for c in ("quantity", "unit_price", "line_total")}})
    typed = item_total(typed.withColumn("unit_price", money(F.col("unit_price")))).withColumn("line_total", F.col("total")).drop("total")
    return typed.filter("title <> '' or unit is not null or quantity is not null or unit_price is not null or line_total is not null")


def drafts_total(items: DataFrame) -> DataFrame:
    """(purchase_id, total) of drafted items; an item without a total counts nothing."""
    return items.groupBy("purchase_id").agg(F.sum(F.coalesce("line_total", F.lit(0).cast(MONEY))).cast(MONEY).alias("total"))


def listing(purchases: DataFrame, user_id: int, year: int | None = None, month: int | None = None, category: str | None = None) -> DataFrame:
    """One user's purchases, newest first. Year and month are independent: a month alone is that month of every year."""
    rows = purchases.filter(F.col("user_id") == user_id)
    if year and month:  # a range, so that file statistics apply
        rows = rows.filter((F.col("purchase_date") >= F.make_date(F.lit(year), F.lit(month), F.lit(1))) & (F.col("purchase_date") < F.add_months(F.make_date(F.lit(year), F.lit(month), F.lit(1)), 1)))
    elif year:
        rows = rows.filter(F.year("purchase_date") == year)
    elif month:
        rows = rows.filter(F.month("purchase_date") == month)
    if category and category.strip():
        rows = rows.filter(F.col("category") == category_key(F.lit(category)))
    return rows.orderBy(F.desc("purchase_date"), F.desc("created_at"), F.desc("id"))


def with_items(purchases: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``items``, ordered by line; empty if a purchase has none."""
    nested = items.groupBy("purchase_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "title", "quantity", "unit", "unit_price", "line_total"))).alias("items"))
    joined = purchases.join(nested, F.col("id") == F.col("purchase_id"), "left").drop("purchase_id")
    return joined.withColumn("items", F.coalesce("items", F.expr("cast(array() as array<struct<line_index: int, title: string, quantity: decimal(19,3), unit: string, unit_price: decimal(19,2), line_total: decimal(19,2)>>)")))


def delete(purchases: DataFrame, items: DataFrame, receipts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the purchases of ``gone`` (id, user_id: only the owner's count) and their items; receipts lose their link."""
    mine = purchases.join(gone.select("id", "user_id").distinct(), ["id", "user_id"], "left_semi").select(F.col("id").alias("purchase_id"))
    left = purchases.join(mine, F.col("id") == F.col("purchase_id"), "left_anti")
    linked = receipts.join(mine.select("purchase_id", F.lit(True).alias("gone_")), "purchase_id", "left")
    unlinked = linked.withColumn("purchase_id", F.when(F.col("gone_").isNull(), F.col("purchase_id"))).drop("gone_").select(receipts.columns)
    return left, items.join(mine, "purchase_id", "left_anti"), unlinked
