"""Status writes, stored files, report files, lists and keys."""

import datetime

from pyspark.sql import functions as F

from tallyspark.functions.scalars import receipt_key, report_key
from tallyspark.operators import accounts, dashboard, lifecycle, reports
from tallyspark.sources import render, views
from tallyspark.streaming import jobs

SF = "/root/testdata/sf0.001"
LINE = "receipt_id long, line_index int, title string, quantity decimal(19,3), unit string, unit_price decimal(19,2), line_total decimal(19,2), raw_fragment string"
RECEIPT = "id long, user_id long, ocr_status string, raw_ocr_text string, parsed_store_name string, parsed_total_amount decimal(19,2), parsed_purchase_date date, ocr_error_message string, ocr_processed_at timestamp"


def test_reading_clears(spark):
    now = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(k, 1, "DONE", "t", "s", None, None, "e", now) for k in (1, 2)], RECEIPT)
    lines = spark.createDataFrame([(k, 1, "a", None, None, None, None, None) for k in (1, 1, 2)], LINE)
    ids = spark.createDataFrame([(1,), (1,), (7,)], "receipt_id long")
    got, left = lifecycle.start_reading(rows, lines, ids)
    by_id = {r.id: r for r in got.collect()}
    assert tuple(by_id[1])[2:] == ("PROCESSING", *[None] * 6) and by_id[2].ocr_status == "DONE" and by_id[2].raw_ocr_text == "t"
    assert [r.receipt_id for r in left.collect()] == [2]


def test_titles_of_bought_items(spark):
    lines = spark.createDataFrame([(1, 1, " a ", None, None, None, None, "f"), (1, 2, " ", None, None, None, None, "f"), (1, 4, None, None, None, None, None, " ")], LINE)
    assert [(r.line_index, r.title) for r in lifecycle.bought_items(lines).orderBy("line_index").collect()] == [(1, "a"), (2, "f"), (4, "Receipt item")]


def test_report_files(spark):
    document = reports.document(views.report_jobs(spark, SF), views.purchases(spark, SF)).filter("job_id in (301, 302, 303, 313)").cache()
    for job in (301, 302, 303, 313):
        lines = reports.csv_lines(document).filter(f"job_id = {job}").orderBy("line_no").collect()
        assert render.render(document, job, "CSV").decode() == "".join(f"{r.line}\n" for r in lines)
        assert render.render(document, job, "PDF").startswith(b"%PDF") and render.render(document, job, "XLSX").startswith(b"PK")
    assert {r.job_id: r.width for r in render.sheet_width(document).collect()} == {r.job_id: r.w for r in document.groupBy("job_id").agg(F.max(F.size("cells")).alias("w")).collect()}


def test_stored_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    objects = render.read_objects(spark, str(tmp_path))
    got = {r.path[-5:]: r for r in render.recognised(objects, bytes.decode).collect()}
    assert got["a.txt"].raw_text == "one\ntwo" and got["a.txt"].error is None
    assert got["b.txt"].raw_text is None and "0xff" in got["b.txt"].error
    assert {r.path[-5:]: r.raw_text for r in render.read_texts(spark, f"{tmp_path}/a.txt").collect()} == {"a.txt": "one\ntwo"}


def test_published_messages_are_read(spark, tmp_path):
    todo = views.report_jobs(spark, SF).withColumn("status", F.lit("NEW"))
    lifecycle.publish(lifecycle.messages(todo), f"{tmp_path}/queue")
    good, bad = jobs.parsed_messages(spark.read.text(f"{tmp_path}/queue"))
    assert bad.count() == 0
    assert {(r.reportJobId, r.reportFormat) for r in good.collect()} == {(r.id, r.report_format) for r in todo.collect()}


def test_lists(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 2, "c")], "id long, place int, v string")
    new = spark.createDataFrame([(2, 0, "new")], "id long, place int, v string")
    assert [(r.id, r.v) for r in dashboard.upserted(old, new).orderBy("place").collect()] == [(2, "new"), (1, "a"), (3, "c")]


def test_keys(spark):
    row = spark.range(1).select(
        report_key(F.lit(7), F.lit("STORE_SUMMARY"), F.lit(2026), F.lit(3), F.lit("PDF")).alias("report"), receipt_key(F.lit(7), F.lit("C:\\a b\\r 1.png")).alias("receipt")
    ).first()
    uuid = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    import re

    assert re.fullmatch(f"reports/7/store-summary/2026-03-pdf-{uuid}.pdf", row.report) and re.fullmatch(f"receipts/7/{uuid}-r_1.png", row.receipt)


def test_upload_and_registration_rules(spark):
    files = spark.createDataFrame([("image/png", 5, "UAH", None), ("image/gif", 0, "UAH", "EUR"), (None, None, "UAH", "UAH")], "content_type string, file_size long, currency string, purchase_currency string")
    assert [r.errors for r in accounts.upload_errors(files).collect()] == [
        None,
        "Uploaded file must not be empty; Unsupported file content type; Receipt currency must match the linked purchase currency",
        "Uploaded file must not be empty; Unsupported file content type",
    ]
    asked = spark.createDataFrame([("a@b.c", "x" * 8), ("a b@c", "x"), (None, None)], "email string, password string")
    got = [r.errors for r in accounts.registration_errors(asked).collect()]
    assert got[0] is None and got[1] == "email: must be a well-formed email address; password: size must be between 8 and 255" and got[2] == "email: must not be blank; password: must not be blank"
