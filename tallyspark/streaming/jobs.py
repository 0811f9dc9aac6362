"""Queue-driven jobs: statuses, offsets and tokens as batch operators; ``consumer`` and ``feed`` have the streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tallyspark.functions.scalars import has_text, trimmed

REPORT_MESSAGE = "reportJobId bigint, userId bigint, year int, month int, reportType string, reportFormat string"
UPDATE = "update_id bigint, message struct<text: string, chat: struct<id: string>>"


def latest_status(events: DataFrame) -> DataFrame:
    """(job_id, status, updated_at) of the last change of each job; later events win ties."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at", "event_id"), F.struct("updated_at", "event_id")).alias("x"), F.count("*").cast("long").alias("n_changes")).select("job_id", "x.status", "x.updated_at", "x.event_id", "n_changes")


def next_batch(updates: DataFrame, offset: int, n: int = 20) -> DataFrame:
    """The first ``n`` updates from an offset on."""
    return updates.filter(F.col("update_id") >= offset).orderBy("update_id").limit(n)


def start_tokens(updates: DataFrame) -> DataFrame:
    """(update_id, chat_id, token, and ``at`` if there) of "/start <token>" messages of some chat; white space around text and token counts nothing."""
    kept = [c for c in ("at",) if c in updates.columns]
    told = trimmed(F.col("text"))
    token = trimmed(F.try_element_at(F.split(told, r"\s+", 2), F.lit(2)))
    return updates.filter(told.startswith("/start") & has_text(F.col("chat_id"))).select("update_id", trimmed(F.col("chat_id")).alias("chat_id"), token.alias("token"), *kept).filter(has_text(F.col("token")))


def start_outcomes(updates: DataFrame, tokens: DataFrame) -> DataFrame:
    """(update_id, user_id, token, chat_id, at, outcome): what becomes of each start, as ``feed.token_outcomes`` finds it in a stream.

    ``updates``: update_id, chat_id, text, at. ``tokens``: token, user_id, created_at, expires_at, used_at. A new token of a user voids the older ones.
    LINKED: the first start of a valid token; USED: later ones, or a token that was used before; EXPIRED: past its time; UNKNOWN: no token
    of anybody, or a void one.
    """
    tokens = tokens if "created_at" in tokens.columns else tokens.withColumn("created_at", F.lit(None).cast(tokens.schema["expires_at"].dataType))
    newer = F.lead("created_at").over(Window.partitionBy("user_id").orderBy("created_at", "token"))
    joined = start_tokens(updates).join(tokens.withColumn("void_at", newer), "token", "left")
    void = F.col("user_id").isNull() | F.coalesce((F.col("created_at") > F.col("at")) | (F.col("void_at") <= F.col("at")), F.lit(False))
    state = F.when(void, "UNKNOWN").when(F.col("used_at") <= F.col("at"), "USED").when(F.col("expires_at") < F.col("at"), "EXPIRED").otherwise("LINKED")
    judged = joined.withColumn("outcome", state)
    fits = F.when(F.col("outcome") == "LINKED", F.struct("at", "update_id"))
    first = F.min(fits).over(Window.partitionBy("token"))
    late = F.col("outcome").isin("LINKED", "EXPIRED") & (F.struct("at", "update_id") > F.col("first"))
    told = judged.withColumn("first", first).withColumn("outcome", F.when(late, "USED").otherwise(F.col("outcome")))
    return told.select("update_id", "user_id", "token", "chat_id", "at", "outcome")


def link_tokens(updates: DataFrame, tokens: DataFrame) -> DataFrame:
    """(user_id, token, chat_id, update_id, at): each valid token is taken by its first update (``start_outcomes``)."""
    return start_outcomes(updates, tokens).filter("outcome = 'LINKED'").select("user_id", "token", "chat_id", "update_id", "at")


def pending_tokens(tokens: DataFrame) -> DataFrame:
    """The newest token of each user that is unused and unexpired. ``tokens`` has ``now`` as well."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("token")))
    return tokens.filter("used_at is null and expires_at > now").withColumn("k", newest).filter("k = 1").drop("k", "now")


def parsed_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report messages of JSON lines (``value``), and the lines that are none."""
    read = raw.select("value", F.from_json("value", REPORT_MESSAGE).alias("m"))
    good = F.col("m.reportJobId").isNotNull()
    return read.filter(good).select("m.*"), read.filter(~good | good.isNull()).select("value")


def run_queue(spark: SparkSession, queue_dir: str, checkpoint_dir: str, out_dir: str, process: Callable[[DataFrame], DataFrame], files: int = 10) -> StreamingQuery:
    """Consume queue files of JSON lines once each; ``process`` turns a batch of messages into (job_id, status, ...).

    Batches are written to a folder of their own number, so a batch that is run again overwrites itself.
    """
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(queue_dir)

    def one(batch: DataFrame, number: int) -> None:
        good, bad = parsed_messages(batch)
        process(good).write.mode("overwrite").parquet(f"{out_dir}/done/batch={number}")
        bad.write.mode("overwrite").text(f"{out_dir}/rejected/batch={number}")

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
