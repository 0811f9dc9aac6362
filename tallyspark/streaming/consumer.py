"""Queue consumers with a durable status machine.

A consumer reads a queue's folder as a stream. Of each batch it takes the messages of known rows that are not finished yet, writes
PROCESSING for them, lets ``process`` make results, and writes DONE with a key or FAILED with a text for each. Statuses are
appended to a log of ``Tables``, two commits a batch, numbered by the batch: a batch that runs again, or a message that comes
again, changes nothing. What fails in a batch is narrowed down by halves until it is one message, which becomes FAILED; the
others and the stream go on. Lines that are no message, and messages of rows that are gone, are kept in ``rejected``.

Files of results are written before their status; if the status can't be written they go again (``objects.put``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions.scalars import report_key
from tallyspark.operators import lifecycle, receipts, reports
from tallyspark.sources import objects, render
from tallyspark.sources.tables import Tables
from tallyspark.streaming.jobs import REPORT_MESSAGE

STATUS = "id long, event_id long, updated_at timestamp, status string, s3_key string, error string"
REJECTED = "queue string, batch long, value string, reason string"
RECEIPT_MESSAGE = "receiptId bigint, userId bigint"
FINISHED = ("DONE", "FAILED")


@dataclass
class Queue:
    """What a consumer needs to know.

    ``process`` turns messages into (id, error, result columns), a row each, error null if it went well, key and content where it makes a
    file; ``finished`` gives more rows to append along with the statuses.
    """

    name: str
    schema: str
    key: str
    table: str
    process: Callable[[Tables, DataFrame], DataFrame]
    finished: Callable[[Tables, DataFrame], dict[str, DataFrame]] = lambda tables, results: {}
    objects_dir: str | None = None

    @property
    def log(self) -> str:
        return f"{self.table}_status"


def reason(error: Exception) -> str:
    """What an exception says, for one from a Python worker what was raised there."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    raised = [m[1] for x in lines if (m := re.fullmatch(r"[\w.]*(?:Error|Exception): (.*)", x))]
    return (raised[-1] if raised else lines[0] if lines else type(error).__name__)[:1000]


def staged(tables: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` written down, so that they are made once; ``Tables.sweep`` removes them."""
    import uuid

    path = f"{tables.root}/data/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return tables.spark.read.parquet(path)


def isolated(tables: Tables, process: Callable[[Tables, DataFrame], DataFrame], messages: DataFrame, depth: int = 0) -> list[DataFrame]:
    """Results of messages (with an id each); a message for which ``process`` raises gets a row with the error alone."""
    try:
        return [staged(tables, process(tables, messages))]
    except Exception as error:
        if messages.select("id").distinct().limit(2).count() < 2:
            return [staged(tables, messages.select("id", F.lit(reason(error)).alias("error")).distinct())]
    half = F.pmod(F.xxhash64(F.lit(depth), "id"), F.lit(2))
    parts = [staged(tables, messages.filter(half == k)) for k in (0, 1)]
    return [x for part in parts if not part.isEmpty() for x in isolated(tables, process, part, depth + 1)]


def statuses(tables: Tables, log: str) -> DataFrame:
    """(id, event_id, updated_at, status, s3_key, error) of the last change of each row."""
    if log not in tables.version()["tables"]:
        return tables.spark.createDataFrame([], STATUS)
    rows = tables.read(log)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "id")), F.struct("updated_at", "event_id")).alias("last"))
    return last.select("id", "last.*")


def handle(tables: Tables, queue: Queue, lines: DataFrame, number: int) -> None:
    """One batch of a queue: ``lines`` (value)."""
    read = lines.select("value", F.from_json("value", queue.schema).alias("m")).withColumn("id", F.col(f"m.{queue.key}"))
    rows, last = tables.read(queue.table).select("id"), statuses(tables, queue.log).select("id", "status")
    known = read.join(rows.withColumn("there", F.lit(True)), "id", "left").join(last, "id", "left")
    why = F.when(F.col("id").isNull(), "no message").when(F.col("there").isNull(), "no such row")
    judged = staged(tables, known.withColumn("reason", why))
    rejected = judged.filter("reason is not null").select(F.lit(queue.name).alias("queue"), F.lit(number).cast("long").alias("batch"), "value", "reason")
    open_ = judged.filter("reason is null").filter(~F.coalesce(F.col("status").isin(*FINISHED), F.lit(False)))
    messages = staged(tables, open_.select("id", "m.*").dropDuplicates(["id"]))
    status = lambda k, to, s3_key, error: (F.lit(2 * number + k).cast("long").alias("event_id"), F.current_timestamp().alias("updated_at"), to.alias("status"), s3_key.cast("string").alias("s3_key"), error.alias("error"))
    nothing = F.lit(None).cast("string")
    tables.commit(appended={queue.log: messages.select("id", *status(0, F.lit("PROCESSING"), nothing, nothing)), "rejected": rejected}, writer=f"{queue.name}: started", number=number)
    if messages.isEmpty():
        return
    done = None
    for part in isolated(tables, queue.process, messages):
        done = part if done is None else done.unionByName(part, allowMissingColumns=True)
    lost = messages.join(done.select("id"), "id", "left_anti").select("id", F.lit("no result").alias("error"))
    done = staged(tables, done.unionByName(lost, allowMissingColumns=True))
    failed = F.col("error").isNotNull()
    key = F.when(~failed, F.col("key")) if "key" in done.columns else nothing
    ended = done.select("id", *status(1, F.when(failed, "FAILED").otherwise("DONE"), key, F.col("error")))

    def record(_: DataFrame | None = None) -> None:
        tables.commit(appended={queue.log: ended} | queue.finished(tables, done), writer=f"{queue.name}: ended", number=number)

    if queue.objects_dir and "content" in done.columns:
        objects.put(done.filter(~failed & F.col("content").isNotNull()).select("key", "content"), queue.objects_dir, record)
    else:
        record()


def consume(tables: Tables, queue: Queue, queue_dir: str, checkpoint_dir: str, files: int = 10) -> StreamingQuery:
    """Take what is in a queue's folder, ``files`` files of JSON lines a batch, and stop."""
    raw = tables.spark.readStream.format("text").option("maxFilesPerTrigger", files).load(queue_dir)
    one = lambda batch, number: handle(tables, queue, batch.select("value"), number)
    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


# --- the two queues


def report_queue(objects_dir: str) -> Queue:
    """Report jobs: files in the formats of ``render.RENDERERS``, from the tables users (id, email) and purchases."""

    def process(tables: Tables, messages: DataFrame) -> DataFrame:
        people = tables.read("users").select(F.col("id").alias("user_id"), "email")
        named = {"id": "id", "user_id": "userId", "year": "year", "month": "month", "report_type": "reportType", "report_format": "reportFormat"}
        asked = messages.select(*(F.col(c).alias(k) for k, c in named.items())).join(people, "user_id", "left")
        key = report_key(F.col("user_id"), F.col("report_type"), F.col("year"), F.col("month"), F.col("report_format"))
        keyed = asked.select("id", "report_format", key.alias("key"))
        made = render.files(reports.document(asked, tables.read("purchases")), keyed.select(F.col("id").alias("job_id"), "report_format"))
        return keyed.join(made, F.col("id") == F.col("job_id")).select("id", "key", "content", "error")

    return Queue("reports", REPORT_MESSAGE, "reportJobId", "report_jobs", process, objects_dir=objects_dir)


def receipt_queue(uploads_dir: str, recognise: Callable[[bytes], str]) -> Queue:
    """Receipts: stored files (receipts.s3_key) to texts; what is read in them is appended to receipt_results and receipt_lines.

    A file that is missing, can't be recognised or holds no text makes the receipt FAILED with the reason.
    """

    def process(tables: Tables, messages: DataFrame) -> DataFrame:
        asked = tables.read("receipts").join(messages.select("id"), "id", "left_semi").select("id", "s3_key")
        read = render.recognised_objects(asked, uploads_dir, recognise)
        blank = receipts.normalised(F.coalesce("raw_text", F.lit(""))) == ""
        why = F.coalesce("error", F.when(~F.col("there"), "Stored file is missing"), F.when(blank, lifecycle.EMPTY_TEXT))
        return read.select("id", "raw_text", why.alias("error"))

    def finished(tables: Tables, done: DataFrame) -> dict[str, DataFrame]:
        texts = objects.spread(done.filter("error is null").select(F.col("id").alias("receipt_id"), "raw_text"), "receipt_id")
        found = receipts.with_headers(texts).select("receipt_id", "store_name", "total_amount", "purchase_date", "raw_text")
        return {"receipt_results": found, "receipt_lines": receipts.items(texts)}

    return Queue("receipts", RECEIPT_MESSAGE, "receiptId", "receipts", process, finished)
