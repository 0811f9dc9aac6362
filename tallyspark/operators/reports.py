"""Monthly, category and store reports for any number of jobs at once.

A job's purchases are found by an equi-join on user and month, so one shuffle serves all jobs. Groups keep the order in
which they are first seen by date and id, as a rank column. Currencies are never summed together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scalars import MONEY, csv_cell, money_text

UNKNOWN_STORE = "Unknown Store"
TITLES = {"MONTHLY_SPENDING": "Monthly Spending Report", "CATEGORY_SUMMARY": "Category Summary Report", "STORE_SUMMARY": "Store Summary Report"}
#: Section title, header and message when empty. Fixed values of the reports' format.
PURCHASES = ("Purchases", ["purchaseDate", "title", "category", "storeName", "currency", "amount", "comment"], "No purchases found for the selected period")
TOTALS = ("Totals by Currency", ["currency", "totalAmount"], "No currency totals available")
CATEGORY_TOTALS = ("Category Summary", ["category", "currency", "totalAmount"], "No category totals available")
CATEGORIES = ("Category Summary", ["category", "currency", "purchaseCount", "totalAmount"], "No category totals available")
STORES = ("Store Summary", ["storeName", "currency", "purchaseCount", "totalAmount"], "No store totals available")
SUMMARY = ("Summary", ["metric", "value"], "")


def store_key(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*$"), UNKNOWN_STORE).otherwise(c)


def of_jobs(jobs: DataFrame, purchases: DataFrame) -> DataFrame:
    """(job_id, purchase columns) of each job's user and month."""
    months = purchases.withColumns({"year": F.year("purchase_date"), "month": F.month("purchase_date")})
    return jobs.select(F.col("id").alias("job_id"), "user_id", "year", "month", "report_type").join(months, ["user_id", "year", "month"])


def grouped(rows: DataFrame, per: list[str], by: list[str]) -> DataFrame:
    """Count and total of each group, and its rank among the groups of ``per`` by first appearance."""
    first = F.min(F.struct("purchase_date", "id")).alias("first")
    sums = rows.groupBy(*per, *by).agg(F.count("*").alias("purchase_count"), F.sum("amount").cast(MONEY).alias("total_amount"), first)
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy("first"))).drop("first")


def monthly(purchases: DataFrame) -> DataFrame:
    return purchases.withColumn("period", F.date_format("purchase_date", "yyyy-MM"))


def category_summary(purchases: DataFrame) -> DataFrame:
    return grouped(monthly(purchases), ["user_id", "period"], ["category", "currency"])


def store_summary(purchases: DataFrame) -> DataFrame:
    return grouped(monthly(purchases).withColumn("store", store_key(F.col("store_name"))), ["user_id", "period"], ["store", "currency"])


def currency_totals(purchases: DataFrame) -> DataFrame:
    return grouped(monthly(purchases), ["user_id", "period"], ["currency"])


def currencies(rows: DataFrame, per: list[str]) -> DataFrame:
    """The currencies of each group of ``per``, in order of first appearance, joined by ", "."""
    each = grouped(rows, per, ["currency"])
    listed = F.array_sort(F.collect_list(F.struct("rank", "currency")))
    return each.groupBy(*per).agg(F.array_join(F.transform(listed, lambda x: x["currency"]), ", ").alias("currencies"), F.sum("purchase_count").alias("purchase_count"))


def report_rows(purchases: DataFrame) -> DataFrame:
    """Rows of the monthly report with their place."""
    place = Window.partitionBy("user_id", "period").orderBy("purchase_date", "id")
    shown = monthly(purchases).withColumn("rank", F.row_number().over(place))
    return shown.select("user_id", "period", "rank", *(cell.alias(name) for cell, name in zip(purchase_cells(), PURCHASES[1], strict=True)))


def purchase_cells() -> list[Column]:
    return [F.col("purchase_date").cast("string"), F.col("title"), F.col("category"), F.coalesce("store_name", F.lit("")), F.col("currency"), money_text(F.col("amount")), F.coalesce("comment", F.lit(""))]


def document(jobs: DataFrame, purchases: DataFrame) -> DataFrame:
    """(job_id, section, row, kind, cells): all rows of all jobs' reports.

    Section 0 has the title (row 0) and metadata. Rows of a section from 1: its title, then the header and rows, or a message
    if it has none, and a blank row at the end. ``kind`` is title, meta, section, header, row, message or blank.
    """
    rows = of_jobs(jobs, purchases)
    owner = jobs.select(F.col("id").alias("job_id"), "email", "report_type", "year", "month")
    found = currencies(rows, ["job_id"])
    head = owner.join(found, "job_id", "left").select(
        "job_id",
        F.posexplode(
            F.array(
                F.struct(F.lit("title").alias("kind"), F.array(F.element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), F.col("report_type"))).alias("cells")),
                *(
                    F.struct(F.lit("meta").alias("kind"), F.array(F.lit(label), value).alias("cells"))
                    for label, value in (("Period", F.format_string("%04d-%02d", "year", "month")), ("Owner", F.col("email")), ("Report Type", F.col("report_type")), ("Currencies", F.coalesce("currencies", F.lit("No purchases"))))
                ),
                F.struct(F.lit("blank").alias("kind"), F.array(F.lit("")).alias("cells")),
            )
        ).alias("row", "x"),
    )
    parts = [head.select("job_id", F.lit(0).alias("section"), "row", "x.kind", "x.cells")]
    of_type = lambda t: (jobs.filter(F.col("report_type") == t).select(F.col("id").alias("job_id")), rows.filter(F.col("report_type") == t))
    count, total = F.col("purchase_count").cast("string"), money_text(F.col("total_amount"))

    def section(number: int, kind: tuple, ids: DataFrame, body: DataFrame) -> DataFrame:
        """``body``: (job_id, rank, cells)."""
        title, header, message = kind
        some = body.select("job_id").distinct().withColumn("some", F.lit(True))
        frame = ids.join(some, "job_id", "left").select(
            "job_id",
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("row"), F.lit("section").alias("kind"), F.array(F.lit(title)).alias("cells")),
                    F.when(F.col("some").isNull(), F.struct(F.lit(2).alias("row"), F.lit("message").alias("kind"), F.array(F.lit(message)).alias("cells"))).otherwise(
                        F.struct(F.lit(2).alias("row"), F.lit("header").alias("kind"), F.array(*map(F.lit, header)).alias("cells"))
                    ),
                    F.struct(F.lit((1 << 31) - 1).alias("row"), F.lit("blank").alias("kind"), F.array(F.lit("")).alias("cells")),
                )
            ).alias("x"),
        )
        framed = frame.select("job_id", F.lit(number).alias("section"), "x.row", "x.kind", "x.cells")
        return framed.unionByName(body.select("job_id", F.lit(number).alias("section"), (F.col("rank") + 2).alias("row"), F.lit("row").alias("kind"), "cells"))

    def groups(of: DataFrame, by: list[str], *cells: Column) -> DataFrame:
        return grouped(of, ["job_id"], by).select("job_id", "rank", F.array(*cells).alias("cells"))

    ids, own = of_type("MONTHLY_SPENDING")
    place = Window.partitionBy("job_id").orderBy("purchase_date", "id")
    parts.append(section(1, PURCHASES, ids, own.withColumn("rank", F.row_number().over(place)).select("job_id", "rank", F.array(*purchase_cells()).alias("cells"))))
    parts.append(section(2, TOTALS, ids, groups(own, ["currency"], F.col("currency"), total)))
    parts.append(section(3, CATEGORY_TOTALS, ids, groups(own, ["category", "currency"], F.col("category"), F.col("currency"), total)))
    for kind, which, key in (("CATEGORY_SUMMARY", CATEGORIES, "category"), ("STORE_SUMMARY", STORES, "store")):
        ids, own = of_type(kind)
        own = own.withColumn("store", store_key(F.col("store_name")))
        parts.append(section(1, which, ids, groups(own, [key, "currency"], F.col(key), F.col("currency"), count, total)))
        parts.append(section(2, TOTALS, ids, groups(own, ["currency"], F.col("currency"), total)))
        counted = ids.join(own.groupBy("job_id").agg(F.count("*").alias("n")), "job_id", "left").select("job_id", F.lit(1).alias("rank"), F.array(F.lit("Purchase Count"), F.coalesce("n", F.lit(0)).cast("string")).alias("cells"))
        parts.append(section(3, SUMMARY, ids, counted))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def csv_lines(rows: DataFrame) -> DataFrame:
    """(job_id, line_no, line): the document as CSV; the title and section titles are not quoted."""
    quoted = F.array_join(F.transform("cells", csv_cell), ",")
    line = F.when(F.col("kind").isin("title", "section", "message", "blank"), F.col("cells")[0]).otherwise(quoted)
    place = Window.partitionBy("job_id").orderBy("section", "row")
    return rows.select("job_id", F.row_number().over(place).alias("line_no"), line.alias("line"))
