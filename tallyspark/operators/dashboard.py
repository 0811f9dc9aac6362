"""Dashboard roll-ups, the activity feed, administration and delivery rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scalars import MONEY, category_key, has_text, mapped
from tallyspark.operators.accounts import connected, role

MOST_SEGMENTS, LEAST_SHARE, OTHER = 5, 0.06, "OTHER"
CHANNELS = ("EMAIL", "TELEGRAM")
# What the feed calls statuses and report types.
ACTIVITY_LABELS = {
    "OCR_NEW": "OCR is still running", "OCR_PROCESSING": "OCR is still running", "OCR_DONE": "OCR completed", "OCR_FAILED": "OCR finished with an error", "REPORT_NEW": "Report is still processing", "REPORT_DONE": "Report is ready",
    "REPORT_FAILED": "Report finished with an error", "MONTHLY_SPENDING": "Monthly spending", "CATEGORY_SUMMARY": "Category summary", "STORE_SUMMARY": "Store summary",
}


def currency_summary(purchases: DataFrame) -> DataFrame:
    """Total of each currency of each user; rank 1 is the default currency."""
    sums = purchases.groupBy("user_id", "currency").agg(F.sum("amount").cast(MONEY).alias("total"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("total"), "currency")))


def selected(purchases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each user's purchases in the currency that ``wanted`` (user_id, currency) names, or in the default one if they have none in it."""
    ranked = currency_summary(purchases).join(wanted.select("user_id", F.col("currency").alias("asked")), "user_id", "left")
    best = F.row_number().over(Window.partitionBy("user_id").orderBy((F.col("currency") == F.coalesce("asked", F.lit(""))).desc(), "rank"))
    chosen = ranked.withColumn("k", best).filter("k = 1").select("user_id", "currency")
    return purchases.join(chosen, ["user_id", "currency"], "left_semi")


def segment_counts(purchases: DataFrame) -> DataFrame:
    """(user_id, currency, n_segments): segments left after the roll-up."""
    return spending_segments(purchases).groupBy("user_id", "currency").agg(F.count("*").alias("n_segments"))


def upserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """A list (id, place, ...) with new rows first and, of rows with one id, the new one alone; ``place`` counts from 0."""
    both = new.withColumn("old", F.lit(0)).unionByName(rows.join(new.select("id"), "id", "left_anti").withColumn("old", F.lit(1)))
    # A list is one screen's rows, so one task may number it.
    return both.withColumn("place", F.row_number().over(Window.orderBy("old", "place")) - 1).drop("old")


def spending_segments(purchases: DataFrame) -> DataFrame:
    """Category shares per user and currency, with small and late ones rolled up into one segment that comes last.

    Ties are broken by which category is seen first in the listing's order, newest first.
    """
    latest = F.max(F.struct("purchase_date", "created_at", "id")).alias("seen")
    sums = purchases.withColumn("key", category_key(F.col("category"))).groupBy("user_id", "currency", "key").agg(F.sum("amount").cast(MONEY).alias("value"), latest)
    each = Window.partitionBy("user_id", "currency")
    shares = sums.withColumn("total", F.sum("value").over(each).cast(MONEY)).filter("total > 0").withColumn("share", F.col("value").cast("double") / F.col("total").cast("double"))
    ranked = shares.withColumn("place", F.row_number().over(each.orderBy(F.desc("value"), F.desc("seen"))))
    rolled = (F.col("place") >= MOST_SEGMENTS) | (F.col("share") < LEAST_SHARE)
    segments = ranked.withColumn("is_rollup", rolled).groupBy("user_id", "currency", "is_rollup", F.when(rolled, OTHER).otherwise(F.col("key")).alias("segment")).agg(
        F.sum("value").cast(MONEY).alias("value"), F.min("place").alias("place"), F.first("total").alias("total")
    )
    kept = segments.filter(~F.col("is_rollup") | (F.col("value") > 0))
    order = Window.partitionBy("user_id", "currency").orderBy("is_rollup", "place")
    return kept.withColumns({"rank": F.row_number().over(order), "share": F.col("value").cast("double") / F.col("total").cast("double")}).select("user_id", "currency", "rank", "segment", "is_rollup", "value", "share")


def top_category(purchases: DataFrame) -> DataFrame:
    return spending_segments(purchases).filter("rank = 1").drop("rank")


def job_metrics(statuses: DataFrame) -> DataFrame:
    """How many jobs are under way, done and failed."""
    return statuses.agg(F.count_if(F.col("status").isin("NEW", "PROCESSING")).alias("active"), F.count_if(F.col("status") == "DONE").alias("ready"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def recent_activity(first: DataFrame, second: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` latest of both feeds (kind, id, at, title); on equal times the first feed's come first."""
    both = first.withColumn("feed", F.lit(0)).unionByName(second.withColumn("feed", F.lit(1)))
    return both.orderBy(F.desc("at"), "feed", F.desc("id")).limit(n).drop("feed")


def activity(receipts: DataFrame, jobs: DataFrame, labels: dict[str, str] = ACTIVITY_LABELS, n: int = 5) -> DataFrame:
    """The ``n`` latest receipts and reports (kind, id, at, title), by when they were read or uploaded, or last changed."""
    label = lambda c, prefix: mapped(F.concat(F.lit(prefix), c), labels)
    scanned = receipts.select(F.lit("receipt").alias("kind"), "id", F.coalesce("ocr_processed_at", "uploaded_at").alias("at"), F.concat(label(F.col("ocr_status"), "OCR_"), F.lit(": "), "original_file_name").alias("title"))
    status = F.when(F.col("status").isin("DONE", "FAILED"), F.col("status")).otherwise("NEW")
    title = F.concat(label(status, "REPORT_"), F.lit(": "), label(F.col("report_type"), ""), F.lit(" "), "report_format")
    return recent_activity(scanned, jobs.select(F.lit("report").alias("kind"), "id", F.col("updated_at").alias("at"), title.alias("title")), n)


def table_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recent_users(users: DataFrame, admins: list[str], n: int = 10) -> DataFrame:
    newest = users.orderBy(F.desc("created_on"), F.desc("id")).limit(n)
    return newest.select("id", "email", F.when(F.col("google_subject").isNull(), "PASSWORD").otherwise("GOOGLE").alias("auth_provider"), role(F.col("email"), admins).alias("role"))


def delivery_plan(users: DataFrame) -> DataFrame:
    """The order of channels for each user, preferred first (EMAIL if none is), those of them that are configured, and the first of these."""
    chat = connected()
    preferred = F.array(F.coalesce("preferred_channel", F.lit(CHANNELS[0])))
    order = F.concat(preferred, F.array_except(F.array(*map(F.lit, CHANNELS)), preferred))
    usable = F.filter(order, lambda c: ((c == "EMAIL") & has_text(F.col("email"))) | ((c == "TELEGRAM") & chat))
    return users.select("id", chat.alias("connected"), F.array_join(order, ",").alias("channel_order"), F.array_join(usable, ",").alias("usable"), F.try_element_at(usable, F.lit(1)).alias("channel"))
