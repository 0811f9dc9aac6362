"""Queue consumers, the outbox, deliveries, the feed and tokens."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import objects, render
from tallyspark.sources.tables import Tables
from tallyspark.streaming import consumer, feed, jobs, outbox
from tallyspark.streaming.consumer import Queue

JOB = "id long, user_id long, year int, month int, report_type string, report_format string"
USER = "id long, email string, chat_id string, connected_at timestamp, preferred_channel string"
BOUGHT = "id long, user_id long, title string, category string, amount decimal(19,2), currency string, purchase_date date, store_name string, comment string"


@pytest.fixture
def held(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def message(job_id, form="CSV"):
    return json.dumps({"reportJobId": job_id, "userId": 1, "year": 2026, "month": 3, "reportType": "STORE_SUMMARY", "reportFormat": form})


def queued(spark, tmp_path, *lines):
    """One more file in the queue's folder."""
    (tmp_path / "queue").mkdir(exist_ok=True)
    (tmp_path / "queue" / f"{len(list((tmp_path / 'queue').iterdir()))}.json").write_text("\n".join(lines) + "\n")


def consumed(held, queue, tmp_path, files=10):
    consumer.consume(held, queue, str(tmp_path / "queue"), str(tmp_path / "checkpoint"), files).awaitTermination()
    return {r.id: (r.status, r.s3_key, r.error) for r in consumer.statuses(held, queue.log).collect()}


def jobs_table(spark, held, *ids):
    held.commit(appended={"report_jobs": spark.createDataFrame([(i, 1, 2026, 3, "STORE_SUMMARY", "CSV") for i in ids], JOB)})


def test_one_bad_message_fails_alone(spark, tmp_path, held):
    """What raises for a whole batch is narrowed down to the message that is the cause; the stream goes on."""
    jobs_table(spark, held, 1, 2, 3, 4, 5, 6)
    calls = []

    def process(tables, messages):
        ids = sorted(r.id for r in messages.select("id").collect())
        calls.append(ids)
        if 3 in ids:
            raise RuntimeError("job 3 can't be made")
        boom = F.when(F.col("id") == 5, F.expr("cast(raise_error('job 5 breaks a task') as string)"))
        return messages.select("id", F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") == 6, F.lit("told so")).otherwise(boom).alias("error"))

    queue = Queue("q", jobs.REPORT_MESSAGE, "reportJobId", "report_jobs", process)
    queued(spark, tmp_path, *map(message, (1, 2, 3, 4, 5, 6)), "no json", message(99), message(2))
    got = consumed(held, queue, tmp_path)
    assert {i: got[i][:2] for i in (1, 2, 4)} == {i: ("DONE", f"k{i}") for i in (1, 2, 4)}
    assert got[3] == ("FAILED", None, "job 3 can't be made") and got[5][:2] == ("FAILED", None) and "job 5 breaks a task" in got[5][2] and got[6] == ("FAILED", None, "told so")
    assert {(r.value, r.reason) for r in held.read("rejected").collect()} == {("no json", "no message"), (message(99), "no such row")}
    log = [(r.id, r.status) for r in held.read(queue.log).orderBy("event_id").collect()]
    assert len(log) == 12 and all(log.index((i, "PROCESSING")) < log.index((i, got[i][0])) for i in got)
    # Nothing new: nothing happens. A message that comes again is of a finished row.
    n = len(calls)
    queued(spark, tmp_path, message(1), message(3))
    assert consumed(held, queue, tmp_path) == got and len(calls) == n and held.read(queue.log).count() == 12


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, held):
    """As after a driver that was lost between its two commits, or after both but before the stream's own note."""
    jobs_table(spark, held, 1, 2)
    lost = []

    def process(tables, messages):
        if not lost:
            lost.append(1)
            raise KeyboardInterrupt  # no Exception: as if the driver had gone
        return messages.select("id", F.lit("k").alias("key"), F.lit(None).cast("string").alias("error"))

    queue = Queue("q", jobs.REPORT_MESSAGE, "reportJobId", "report_jobs", process)
    lines = spark.createDataFrame([(message(1),), (message(2),)], "value string")
    with pytest.raises(KeyboardInterrupt):
        consumer.handle(held, queue, lines, 0)
    assert [r.status for r in consumer.statuses(held, queue.log).collect()] == ["PROCESSING"] * 2
    for _ in range(2):
        consumer.handle(held, queue, lines, 0)
    assert [r.status for r in consumer.statuses(held, queue.log).collect()] == ["DONE"] * 2
    assert held.read(queue.log).count() == 4


def test_reports_and_their_files(spark, tmp_path, held):
    held.commit(
        appended={
            "report_jobs": spark.createDataFrame([(i, 1, 2026, 3, "STORE_SUMMARY", "CSV") for i in (1, 2, 3)], JOB),
            "users": spark.createDataFrame([(1, "a@b.c", None, None, "EMAIL")], USER),
            "purchases": spark.createDataFrame([], BOUGHT),
        }
    )
    queue = consumer.report_queue(str(tmp_path / "files"))
    queued(spark, tmp_path, message(1), message(2, "XLSX"), message(3, "DOC"))
    got = consumed(held, queue, tmp_path)
    assert got[3] == ("FAILED", None, "no generator for format DOC") and got[1][0] == got[2][0] == "DONE"
    assert sorted(r.key for r in objects.stored(spark, str(tmp_path / "files")).collect()) == sorted([got[1][1], got[2][1]])
    assert (tmp_path / "files" / got[1][1]).read_text().startswith("Store")


def test_files_go_if_their_status_cannot_be_written(spark, tmp_path, held, monkeypatch):
    jobs_table(spark, held, 1)

    def process(tables, messages):
        return messages.select("id", F.lit("a/b.txt").alias("key"), F.lit("x").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))

    queue = Queue("q", jobs.REPORT_MESSAGE, "reportJobId", "report_jobs", process, objects_dir=str(tmp_path / "files"))
    lines = spark.createDataFrame([(message(1),)], "value string")
    real = held.commit

    def fails(*args, writer=None, **kwargs):
        if writer == "q: ended":
            raise OSError("no manifest")
        return real(*args, writer=writer, **kwargs)

    monkeypatch.setattr(held, "commit", fails)
    with pytest.raises(OSError, match="no manifest"):
        consumer.handle(held, queue, lines, 0)
    assert not (tmp_path / "files/a/b.txt").exists() and consumer.statuses(held, queue.log).first().status == "PROCESSING"
    monkeypatch.setattr(held, "commit", real)
    consumer.handle(held, queue, lines, 0)
    assert (tmp_path / "files/a/b.txt").exists() and consumer.statuses(held, queue.log).first().status == "DONE"


def test_publishing_after_the_commit(spark, tmp_path, held):
    new = spark.createDataFrame([(1, 1, 2026, 3, "STORE_SUMMARY", "CSV")], JOB)
    broken = new.withColumn("month", F.expr("cast(raise_error('refused') as int)"))
    with pytest.raises(Exception, match="refused"):
        outbox.create_jobs(held, broken)
    assert outbox.publish_pending(held, "report_jobs", str(tmp_path / "queue")) and not (tmp_path / "queue").exists()
    outbox.create_jobs(held, new)
    outbox.create_receipts(held, spark.createDataFrame([(7, 1, "a.png")], "id long, user_id long, s3_key string"))

    def down(messages, queue_dir):
        raise ConnectionError("queue is down")

    for kind in ("report_jobs", "receipts"):
        assert not outbox.publish_pending(held, kind, str(tmp_path / kind), down)
        assert outbox.publish_pending(held, kind, str(tmp_path / kind)) and not (tmp_path / kind).exists()  # tried once
    failed = consumer.statuses(held, "receipts_status").first()
    assert (failed.id, failed.status, failed.error) == (7, "FAILED", outbox.NO_QUEUE)
    assert consumer.statuses(held, "report_jobs_status").count() == 0 and held.read("report_jobs").first().status == "NEW"
    assert {r.error for r in held.read("published").collect()} == {"queue is down"}


def test_deliveries(spark, tmp_path, held):
    at = datetime(2026, 1, 1)
    people = [(1, "a@b.c", None, None, "EMAIL"), (2, "b@b.c", " chat ", at, "TELEGRAM"), (3, None, "  ", at, None), (4, "d@b.c", "c4", at, "EMAIL")]
    done = [(10 * u + k, u) for u in (1, 2, 3, 4) for k in (0, 1)]
    held.commit(
        appended={
            "users": spark.createDataFrame(people, USER),
            "report_jobs": spark.createDataFrame([(i, u, 2026, 3, "STORE_SUMMARY", "CSV") for i, u in done], JOB),
            "report_jobs_status": spark.createDataFrame([(i, 0, at, "DONE" if i % 10 else "FAILED", f"f{i}" if i % 10 else None, None) for i, _ in done], consumer.STATUS),
        }
    )

    def mail(m):
        if m["job_id"] == 40:
            raise ConnectionError("mail is down")

    def chat(m):
        if m["job_id"] == 20 or m["recipient"] != "chat" and m["user_id"] == 2:
            raise ConnectionError("chat is down")
        if (m["attachment"] is not None) != (m["status"] == "DONE"):
            raise ValueError("wrong attachment")

    before = held.read("report_jobs_status").collect()
    for _ in range(2):
        outbox.deliver(held, {"EMAIL": mail, "TELEGRAM": chat})
    log = {(r.job_id, r.channel): (r.place, r.ok, r.error) for r in held.read("deliveries").collect()}
    assert held.read("deliveries").count() == len(log) and held.read("report_jobs_status").collect() == before
    assert log == {
        (10, "EMAIL"): (0, True, None), (11, "EMAIL"): (0, True, None),
        (20, "TELEGRAM"): (0, False, "chat is down"), (20, "EMAIL"): (1, True, None), (21, "TELEGRAM"): (0, True, None),
        (30, None): (0, False, "No notification channel is configured for user id 3"), (31, None): (0, False, "No notification channel is configured for user id 3"),
        (40, "EMAIL"): (0, False, "mail is down"), (40, "TELEGRAM"): (1, True, None), (41, "EMAIL"): (0, True, None),
    }


def test_feed_in_batches_of_twenty_and_a_restart(spark, tmp_path, held):
    rows = [(3 * i + 5, f"c{i}", f"/start t{i}", datetime(2026, 1, 1, 0, i)) for i in range(50)]
    spark.createDataFrame(rows[:47], feed.UPDATES).repartition(3).write.parquet(str(tmp_path / "feed"))
    sizes = []

    def keep(batch, number):
        sizes.append(batch.count())
        held.commit(appended={"updates": batch}, writer="feed", number=number)

    def run():
        q = feed.updates(spark, str(tmp_path / "feed")).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        q.processAllAvailable()
        q.stop()

    run()
    assert [n for n in sizes if n] == [20, 20, 7]
    spark.createDataFrame(rows[47:], feed.UPDATES).write.mode("append").parquet(str(tmp_path / "feed"))
    run()
    got = held.read("updates").orderBy("update_id").collect()
    assert [r.update_id for r in got] == [r[0] for r in rows] and [r.chat_id for r in got] == [r[1] for r in rows]


def test_tokens_over_batches(spark, tmp_path):
    at = lambda m: datetime(2026, 1, 1, 0, m)
    token = lambda user, name, m: (user, "token", name, None, -1, at(m), at(m + 15))
    start = lambda user, name, chat, number, m: (user, "start", name, chat, number, at(m), None)
    batches = [
        [token(1, "a", 0), start(1, "a", "c1", 1, 1), start(1, "a", "c2", 2, 2), token(2, "x", 0)],
        [start(1, "a", "c3", 3, 3), token(1, "b", 4), start(1, "a", "c4", 4, 5), start(1, "b", "c5", 6, 6), start(1, "b", "c6", 5, 6)],
        [start(2, "x", "c7", 7, 16), start(2, "x", "c8", 8, 20), start(1, "b", "c9", 9, 40)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, feed.TOKEN_EVENTS).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(feed.TOKEN_EVENTS).parquet(str(tmp_path / "events"))
        feed.token_outcomes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.update_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "LINKED", 2: "USED", 3: "USED", 4: "UNKNOWN", 5: "LINKED", 6: "USED", 7: "EXPIRED", 8: "EXPIRED", 9: "USED"}
    # The same by the batch operator.
    rows = [r for b in batches for r in b]
    made = spark.createDataFrame([(r[2], r[0], r[5], r[6], None) for r in rows if r[1] == "token"], "token string, user_id long, created_at timestamp, expires_at timestamp, used_at timestamp")
    sent = spark.createDataFrame([(r[4], r[3], f" /start  {r[2]}\n", r[5]) for r in rows if r[1] == "start"], feed.UPDATES)
    assert {r.update_id: r.outcome for r in jobs.start_outcomes(sent, made).collect()} == got


def test_start_messages(spark):
    texts = [" /start tok", "\n/start tok\n", "/start\ttok", "/start", "/start  ", "start tok", None, "/start a b"]
    rows = [(i, "c", t) for i, t in enumerate(texts)] + [(90, None, "/start tok"), (91, " ", "/start tok")]
    got = {r.update_id: r.token for r in jobs.start_tokens(spark.createDataFrame(rows, "update_id long, chat_id string, text string")).collect()}
    assert got == {0: "tok", 1: "tok", 2: "tok", 7: "a b"}


def test_a_batch_of_many_requests_is_read_by_tasks(spark, tmp_path):
    rows = [(7 * i % 1009, f"c{i}", "hi", datetime(2026, 1, 1)) for i in range(1009)]
    spark.createDataFrame(rows, feed.UPDATES).repartition(3).write.parquet(str(tmp_path / "feed"))
    sizes, seen = [], []

    def keep(batch, number):
        sizes.append((batch.rdd.getNumPartitions(), batch.count()))
        seen.extend(r.update_id for r in batch.select("update_id").collect())

    for limit in (10, 20):  # the second query goes on from the first one's checkpoint
        q = feed.updates(spark, str(tmp_path / "feed"), limit=limit, requests=30).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint"))
        if limit == 10:
            q.trigger(availableNow=True).start().awaitTermination()
        else:
            q = q.start()
            q.processAllAvailable()
            q.stop()
    assert [n for _, n in sizes if n] == [300, 600, 109] and sizes[0][0] == 30
    assert sorted(seen) == list(range(1009))


def test_receipts_are_read_by_key(spark, tmp_path, held):
    """From a folder that is a URI; of what lies there only what is asked for, by many tasks though all comes in one file."""
    texts = {"r/a.txt": "SHOP\n-\nMILK 1.00\nTOTAL 1.00", "_r/.b.txt": "SHOP\n-\nBREAD 2.00\nTOTAL 2.00", "r/c.txt": "?", "r/d.txt": " ", "r/other.txt": "?"}
    folder = f"file://{tmp_path}/files"
    objects.write(spark.createDataFrame([(k, v.encode()) for k, v in texts.items()], "key string, content binary"), folder)
    keys = ["r/a.txt", "_r/.b.txt", "r/c.txt", "r/d.txt", "r/gone.txt", "r", "../out.txt", None]
    (tmp_path / "out.txt").write_text("SHOP")
    held.commit(appended={"receipts": spark.createDataFrame(list(enumerate(keys)), "id long, s3_key string").coalesce(1)})

    def recognise(content):
        if content == b"?":
            raise ValueError("no engine")
        return content.decode()

    queued(spark, tmp_path, *(json.dumps({"receiptId": i, "userId": 1}) for i in range(len(keys))))
    got = consumed(held, consumer.receipt_queue(folder, recognise), tmp_path)
    missing = ("FAILED", None, "Stored file is missing")
    assert got == {0: ("DONE", None, None), 1: ("DONE", None, None), 2: ("FAILED", None, "no engine"), 3: ("FAILED", None, "OCR returned empty text"), **{i: missing for i in range(4, 8)}}
    assert {(r.receipt_id, r.title) for r in held.read("receipt_lines").collect()} == {(0, "MILK"), (1, "BREAD")}
    assert {(r.receipt_id, r.raw_text, str(r.total_amount)) for r in held.read("receipt_results").collect()} == {(0, texts["r/a.txt"], "1.00"), (1, texts["_r/.b.txt"], "2.00")}
    many = spark.range(200).select("id", F.lit("r/gone.txt").alias("s3_key")).coalesce(1)
    read = render.recognised_objects(many, folder, recognise)
    assert read.filter("not there").groupBy(F.spark_partition_id()).count().count() > 4


def test_tokens_of_many_users_are_few_groups(spark, tmp_path):
    """Users share buckets, and none sees another's tokens; large ids stay whole beside a user without one."""
    at = lambda m: datetime(2026, 1, 1, m // 60, m % 60)
    big = (1 << 60) + 1
    people = [*range(40), big]
    token = lambda u, name, m: (u, "token", f"{name}{u}", None, -1, at(m), at(m + 15))
    start = lambda u, name, n, m: (u, "start", f"{name}{u}", f"c{n}", n, at(m), None)
    first = [x for k, u in enumerate(people) for x in (token(u, "a", k), start(u, "a", 10 * k, k + k % 20))]
    then = [x for k, u in enumerate(people) for x in (token(u, "b", 90 + k), start(u, "a", 10 * k + 1, 89), start(u, "b", 10 * k + 3, 95 + k), start(u, "b", 10 * k + 2, 95 + k), start(u, "b", 10 * k + 4, 200))]
    seen = []
    for rows in (first, [*then, (None, "start", "x", "c", 5000, at(100), None)]):
        spark.createDataFrame(rows, feed.TOKEN_EVENTS).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(feed.TOKEN_EVENTS).parquet(str(tmp_path / "events"))
        q = feed.token_outcomes(stream, buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
    assert seen == [4, 5]
    got = {r.update_id: (r.user_id, r.token, r.chat_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.pop(5000) == (None, "x", "c", "UNKNOWN")
    expected = {}
    for k, u in enumerate(people):
        outcomes = ["LINKED" if k % 20 <= 15 else "EXPIRED", "USED" if k % 20 <= 15 else "EXPIRED", "LINKED", "USED", "USED"]
        expected |= {10 * k + i: (u, f"{'a' if i < 2 else 'b'}{u}", f"c{10 * k + i}", x) for i, x in enumerate(outcomes)}
    assert got == expected
