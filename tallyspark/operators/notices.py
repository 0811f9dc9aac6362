"""What users are told: report download contracts, notification texts, receipt summaries, connection status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import category_key
from tallyspark.operators.accounts import connected

#: Minutes that a download link is valid.
LINK_MINUTES = 15


def download_contract(jobs: DataFrame, now: Column) -> DataFrame:
    """Adds ready, error and expires_at. A report is ready if it is done and has a file."""
    has_file = F.coalesce(F.trim("s3_key") != "", F.lit(False))
    ready = (F.col("status") == "DONE") & has_file
    error = F.when(F.col("status") == "FAILED", F.coalesce("error_message", F.lit("Report generation failed")))
    return jobs.withColumns({"ready": ready, "error": error, "expires_at": F.when(ready, now + F.expr(f"interval {LINK_MINUTES} minutes"))})


def period(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year, month)


def type_name(kind: Column) -> Column:
    """A report type as words, the first capitalised."""
    words = F.replace(F.lower(kind), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 30))


def notification(jobs: DataFrame) -> DataFrame:
    """Adds subject and body of the message that a finished job sends. ``jobs``: id, report_type, report_format, year, month, status."""
    name, when, number = type_name(F.col("report_type")), period(F.col("year"), F.col("month")), F.col("id").cast("string")
    plain = F.replace(F.lower("report_type"), F.lit("_"), F.lit(" "))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    done, form = F.col("status") == "DONE", F.col("report_format")
    # The texts below.
    subject = text(name, " ", form, " report for ", when, F.when(done, " is ready").otherwise(" failed"))
    ready = text(
        "Your ", plain, " report in ", form, " format for ", when, " is ready.\nReport job id: ", number, "\nThe report file is attached or delivered directly in your selected channel.\n",
        "You can also download it via GET /api/reports/", number, "/download after authenticating.",
    )
    failed = text(plain, " report generation in ", form, " format for ", when, " failed.\nReport job id: ", number, "\nCheck GET /api/reports/", number, " for the current status and error details.")
    return jobs.withColumns({"subject": subject, "body": F.when(done, ready).otherwise(failed)})


def receipt_summaries(receipts: DataFrame, lines: DataFrame, purchases: DataFrame) -> DataFrame:
    """Adds line_count, and the category: the linked purchase's, else the receipt's own, upper-case."""
    counts = lines.groupBy("receipt_id").agg(F.count("*").alias("line_count"))
    linked = purchases.select(F.col("id").alias("purchase_id"), F.col("category").alias("linked_category"))
    joined = receipts.join(counts, "receipt_id", "left").join(linked, "purchase_id", "left")
    own = F.nullif(category_key(F.col("category")), F.lit(""))
    return joined.withColumns({"line_count": F.coalesce("line_count", F.lit(0)), "category": F.coalesce("linked_category", own)}).drop("linked_category")


def connection_status(users: DataFrame, pending: DataFrame, bot: str) -> DataFrame:
    """connected and since when, and the link, token and expiry of a pending token where the user is not connected yet."""
    waiting = pending.select(F.col("user_id").alias("id"), F.col("token").alias("token_"), F.col("expires_at").alias("expires_"))
    joined = users.join(waiting, "id", "left").withColumn("connected", connected())
    open_ = lambda c: F.when(~F.col("connected"), c)
    link = F.concat(F.lit(f"https://t.me/{bot}?start="), "token_")
    return joined.select("id", "connected", "connected_at", open_(link).alias("link"), open_(F.col("token_")).alias("token"), open_(F.col("expires_")).alias("expires_at"))
