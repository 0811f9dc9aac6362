"""Messages that leave the engine: queue messages after their rows are committed, and notifications with fallback.

A queue message is a row of the table ``outbox`` that comes in the same commit as the row it is about, so none exists for a batch that
failed. ``publish_pending`` moves what is new to the queue. A receipt whose message can't be published becomes FAILED, a job stays NEW.

Notifications are kept in ``deliveries``, a row for each job, status and channel that was tried. A channel is tried once: what is logged
is not tried again, so a rerun adds no row, and a job is done with the first channel that took its message. Statuses of jobs
are never touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import dashboard, lifecycle, notices
from tallyspark.sources.tables import Tables
from tallyspark.streaming.consumer import FINISHED, reason, staged, statuses

OUTBOX = "kind string, id long, value string"
DELIVERIES = "job_id long, status string, channel string, place int, ok boolean, error string"
NO_QUEUE = "Failed to enqueue receipt OCR job"


def _held(tables: Tables, name: str, schema: str) -> DataFrame:
    return tables.read(name) if name in tables.version()["tables"] else tables.spark.createDataFrame([], schema)


def create_jobs(tables: Tables, jobs: DataFrame) -> None:
    """Append new report jobs and their messages, both or neither."""
    made = staged(tables, jobs.withColumn("status", F.lit("NEW")))
    told = lifecycle.messages(made).select(F.lit("report_jobs").alias("kind"), F.col("job_id").alias("id"), "value")
    tables.commit(appended={"report_jobs": made, "outbox": told})


def create_receipts(tables: Tables, receipts: DataFrame) -> None:
    """Append uploaded receipts (id, user_id, ...) and their messages, both or neither."""
    made = staged(tables, receipts)
    value = F.to_json(F.struct(F.col("id").alias("receiptId"), F.col("user_id").alias("userId")))
    tables.commit(appended={"receipts": made, "outbox": made.select(F.lit("receipts").alias("kind"), "id", value.alias("value"))})


def publish_pending(tables: Tables, kind: str, queue_dir: str, publish: Callable[[DataFrame, str], None] = lifecycle.publish) -> bool:
    """Write messages of one kind that are not published yet to their queue; false if that failed.

    A driver that is lost before the note is committed publishes once more; consumers leave finished rows alone.
    """
    gone = _held(tables, "published", "kind string, id long, error string").select("kind", "id")
    pending = staged(tables, _held(tables, "outbox", OUTBOX).filter(F.col("kind") == kind).join(gone, ["kind", "id"], "left_anti"))
    if pending.isEmpty():
        return True
    note = lambda error: pending.select("kind", "id", F.lit(error).cast("string").alias("error"))
    try:
        publish(pending, queue_dir)
    except Exception as error:
        failed = {"published": note(reason(error))}
        if kind == "receipts":
            nothing, event = F.lit(None).cast("string"), F.lit(0).cast("long")
            failed["receipts_status"] = pending.select("id", event.alias("event_id"), F.current_timestamp().alias("updated_at"), F.lit("FAILED").alias("status"), nothing.alias("s3_key"), F.lit(NO_QUEUE).alias("error"))
        tables.commit(appended=failed)
        return False
    tables.commit(appended={"published": note(None)})
    return True


def notifications(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """(job_id, status, user_id, channel, place, recipient, subject, body, attachment) of finished jobs, a row for each channel that is configured.

    ``jobs``: id, user_id, report_type, report_format, year, month, status, s3_key. A job of nobody's channel has one row without a channel.
    """
    plan = dashboard.delivery_plan(users).select(F.col("id").alias("user_id"), F.split("usable", ",").alias("channels"))
    people = users.select(F.col("id").alias("user_id"), "email", "chat_id")
    told = notices.notification(jobs.filter(F.col("status").isin(*FINISHED))).join(people, "user_id").join(plan, "user_id")
    each = told.select("*", F.posexplode_outer(F.filter("channels", lambda c: c != "")).alias("place", "channel"))
    ready = (F.col("status") == "DONE") & F.coalesce(F.trim("s3_key") != "", F.lit(False))
    is_chat: Column = F.col("channel") == "TELEGRAM"
    return each.select(
        F.col("id").alias("job_id"), "status", "user_id", "channel", F.coalesce("place", F.lit(0)).alias("place"), F.when(is_chat, F.trim("chat_id")).otherwise(F.col("email")).alias("recipient"), "subject",
        F.when(is_chat, F.concat_ws("\n\n", "subject", "body")).otherwise(F.col("body")).alias("body"), F.when(ready, F.col("s3_key")).alias("attachment"),
    )


def sent(messages: DataFrame, senders: dict[str, Callable[[dict], None]]) -> DataFrame:
    """(job_id, status, channel, place, ok, error): ``senders`` are called on executors, once a message; what they raise is the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                error = None
                try:
                    senders[m["channel"]](m)
                except KeyError:
                    error = f"no sender for {m['channel']}"
                except Exception as e:
                    error = str(e) or type(e).__name__
                rows.append({k: m[k] for k in ("job_id", "status", "channel", "place")} | {"ok": error is None, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("job_id", pa.int64()), ("status", pa.string()), ("channel", pa.string()), ("place", pa.int32()), ("ok", pa.bool_()), ("error", pa.string())]))

    return messages.mapInArrow(run, DELIVERIES)


def deliver(tables: Tables, senders: dict[str, Callable[[dict], None]]) -> None:
    """Tell users of their finished jobs: of each job's channels, in order, the first that works. Tables: report_jobs, its status log, users."""
    last = statuses(tables, "report_jobs_status").select("id", F.col("status").alias("now"), "s3_key")
    ended = tables.read("report_jobs").drop("status", "s3_key").join(last, "id").withColumnRenamed("now", "status")
    due = staged(tables, notifications(ended, tables.read("users")))
    for place in range(len(dashboard.CHANNELS)):
        log = _held(tables, "deliveries", DELIVERIES)
        took = log.filter("ok").select("job_id", "status")
        tried = log.select("job_id", "status", "place")
        now = due.filter(F.col("place") == place).join(took, ["job_id", "status"], "left_anti").join(tried, ["job_id", "status", "place"], "left_anti")
        nobody = F.concat(F.lit("No notification channel is configured for user id "), F.col("user_id").cast("string"))
        none = now.filter("channel is null").select("job_id", "status", "channel", "place", F.lit(False).alias("ok"), nobody.alias("error"))
        new = staged(tables, sent(now.filter("channel is not null"), senders).unionByName(none))
        if not new.isEmpty():
            tables.commit(appended={"deliveries": new})
