"""How receipts and report jobs come to be and change: status writes, parsed results, queue messages, delivery.

Statuses are NEW, PROCESSING, DONE and FAILED. A change overwrites what the status before it had left: PROCESSING and FAILED clear
results, DONE sets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import optional_text
from tallyspark.operators import receipts as parser

UNDER_WAY = ("NEW", "PROCESSING")
EMPTY_TEXT = "OCR returned empty text"
NO_TITLE = "Receipt item"


# --- reading


def find(rows: DataFrame, key: int, user_id: int) -> DataFrame:
    """The row with this id if it is the user's; no row if there is none or it is another's."""
    return rows.filter((F.col("id") == key) & (F.col("user_id") == user_id))


def newest(rows: DataFrame, user_id: int, at: str) -> DataFrame:
    """One user's receipts (``at="uploaded_at"``) or jobs (``at="created_at"``), newest first."""
    return rows.filter(F.col("user_id") == user_id).orderBy(F.desc(at), F.desc("id"))


def graph(receipts: DataFrame, users: DataFrame, purchases: DataFrame, lines: DataFrame) -> DataFrame:
    """Receipts with their owner's email, their purchase's title if there is one, and ``lines`` in order of index and id."""
    nested = lines.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "id", "title", "quantity", "unit", "unit_price", "line_total"))).alias("lines"))
    owners = users.select(F.col("id").alias("user_id"), F.col("email").alias("owner_email"))
    bought = purchases.select(F.col("id").alias("purchase_id"), F.col("title").alias("purchase_title"))
    joined = receipts.join(owners, "user_id").join(bought, "purchase_id", "left").join(nested, F.col("id") == F.col("receipt_id"), "left").drop("receipt_id")
    return joined.withColumn("lines", F.coalesce("lines", F.array().cast(nested.schema["lines"].dataType)))


def any_under_way(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row per user: must a client ask again?"""
    return rows.groupBy("user_id").agg(F.bool_or(F.col(status).isin(*UNDER_WAY)).alias("under_way"))


# --- receipts


def write_back(receipts: DataFrame, lines: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Receipts and lines after their texts have come. ``results``: receipt_id, raw_text, error.

    A blank text is an error; an error makes the receipt FAILED without parsed fields. A text makes it DONE, even if nothing could be
    read in it. Lines of all receipts with a result are replaced. Results of receipts that are gone are left out.
    """
    known = results.join(receipts.select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi")
    blank = F.coalesce(parser.normalised(F.coalesce("raw_text", F.lit(""))) == "", F.lit(True))
    judged = known.withColumn("error", F.coalesce("error", F.when(blank, F.lit(EMPTY_TEXT))))
    texts = judged.filter("error is null").select("receipt_id", "raw_text")
    new = parser.with_headers(judged.select("receipt_id", F.when(F.col("error").isNull(), F.col("raw_text")).alias("text"), "error"), "text")
    joined = receipts.join(new.withColumn("has", F.lit(True)), F.col("id") == F.col("receipt_id"), "left")
    with_ = lambda old, value: F.when(F.col("has"), value).otherwise(F.col(old)).alias(old)
    changed = {
        "ocr_status": F.when(F.col("error").isNull(), "DONE").otherwise("FAILED"), "raw_ocr_text": F.col("text"), "parsed_store_name": F.col("store_name"), "parsed_total_amount": F.col("total_amount"),
        "parsed_purchase_date": F.col("purchase_date"), "ocr_error_message": F.col("error"), "ocr_processed_at": now,
    }
    rows = joined.select(*(with_(c, changed[c]) if c in changed else F.col(c) for c in receipts.columns))
    kept = lines.join(known.select("receipt_id"), "receipt_id", "left_anti")
    columns = ["receipt_id", "line_index", "title", "quantity", "unit", "unit_price", "line_total", "raw_fragment"]
    return rows, kept.select(columns).unionByName(parser.items(texts).select(columns))


def start_reading(receipts: DataFrame, lines: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts ``ids`` (receipt_id) under way: PROCESSING, without parsed fields and lines."""
    asked = receipts.join(ids.select(F.col("receipt_id").alias("id"), F.lit(True).alias("has")).distinct(), "id", "left")
    cleared = ("raw_ocr_text", "parsed_store_name", "parsed_total_amount", "parsed_purchase_date", "ocr_error_message", "ocr_processed_at")
    value = lambda c: F.when(F.col("has").isNull(), F.col(c))
    rows = asked.select(*(value(c).alias(c) if c in cleared else F.coalesce(value(c), F.lit("PROCESSING")).alias(c) if c == "ocr_status" else F.col(c) for c in receipts.columns))
    return rows, lines.join(ids, "receipt_id", "left_anti")


def bought_items(lines: DataFrame) -> DataFrame:
    """Items of the purchase that a receipt becomes: titles from the line, what was read, or a fixed name; indexes as they are."""
    title = F.coalesce(optional_text(F.col("title")), optional_text(F.col("raw_fragment")), F.lit(NO_TITLE))
    return lines.select(F.col("receipt_id"), "line_index", title.alias("title"), "quantity", "unit", "unit_price", "line_total")


# --- jobs


def transitions(jobs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs after their last event, and events of jobs that are gone. ``events``: job_id, event_id, updated_at, status, s3_key, error.

    PROCESSING clears file and error, DONE sets the file, FAILED the error.
    """
    last = events.groupBy("job_id").agg(F.max_by(F.struct("status", "s3_key", "error", "updated_at"), F.struct("updated_at", "event_id")).alias("last"))
    joined = jobs.join(last, F.col("id") == F.col("job_id"), "left")
    to = F.col("last.status")
    changed = {
        "status": F.coalesce(to, F.col("status")),
        "s3_key": F.when(to.isNull(), F.col("s3_key")).when(to == "DONE", F.col("last.s3_key")),
        "error_message": F.when(to.isNull(), F.col("error_message")).when(to == "FAILED", F.col("last.error")),
        "updated_at": F.coalesce("last.updated_at", "updated_at"),
    }
    rows = joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns))
    return rows, events.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def job_defaults(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs as they are stored: created when they are new, updated now, NEW and CSV unless they say otherwise."""
    given = {"created_at": now, "status": F.lit("NEW"), "report_format": F.lit("CSV")}
    return jobs.withColumns({c: F.coalesce(F.col(c), default) for c, default in given.items()} | {"updated_at": now})


def receipt_defaults(receipts: DataFrame, now: Column) -> DataFrame:
    """Receipts as they are stored: uploaded now and NEW unless they say otherwise."""
    return receipts.withColumns({"uploaded_at": F.coalesce("uploaded_at", now), "ocr_status": F.coalesce("ocr_status", F.lit("NEW"))})


def messages(jobs: DataFrame) -> DataFrame:
    """(job_id, value): the queue message of each new job as JSON, to be written along with the job itself."""
    fields = {"reportJobId": "id", "userId": "user_id", "year": "year", "month": "month", "reportType": "report_type", "reportFormat": "report_format"}
    return jobs.filter("status = 'NEW'").select(F.col("id").alias("job_id"), F.to_json(F.struct(*(F.col(c).alias(k) for k, c in fields.items()))).alias("value"))


def publish(outbox: DataFrame, queue_dir: str) -> None:
    """Append messages to a queue's folder, from which ``streaming.consumer`` takes them."""
    outbox.select("value").write.mode("append").text(queue_dir)


def delivered(plan: DataFrame, tries: DataFrame) -> DataFrame:
    """(job_id, channel, n_tries, error): the first configured channel, in order, whose try succeeded.

    ``plan``: job_id, channels (array, in order, configured ones alone); ``tries``: job_id, channel, ok, error. A job without channels, or whose
    tries all failed, has a null channel and the last error; its status is not touched.
    """
    each = plan.select("job_id", F.posexplode_outer("channels").alias("place", "channel"))
    tried = each.join(tries, ["job_id", "channel"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    best = tried.groupBy("job_id").agg(F.min(F.when(F.col("ok"), F.struct("place", "channel"))).alias("best"), F.max_by("error", "place").alias("error"), F.count("channel").alias("n"))
    nobody = F.when(F.col("n") == 0, F.lit("No notification channel is configured"))
    return best.select("job_id", F.col("best.channel").alias("channel"), F.coalesce(F.col("best.place") + 1, F.col("n")).cast("long").alias("n_tries"), F.when(F.col("best").isNull(), F.coalesce("error", nobody)).alias("error"))


def polling_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """(last_update_id, next_offset) after a batch, the one row to be kept; without updates it stays."""
    latest = state.select("last_update_id").unionByName(updates.select(F.col("update_id").alias("last_update_id"))).agg(F.max("last_update_id").alias("last_update_id"))
    return latest.select("last_update_id", (F.col("last_update_id") + 1).alias("next_offset"))
