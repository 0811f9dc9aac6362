"""Rules of purchases, reports, dashboard, receipts and jobs on small fixtures."""

import io
import json
import zipfile
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import dashboard, purchases, receipts, reports
from tallyspark.sources import render
from tallyspark.streaming import jobs

PURCHASE = "id long, user_id long, title string, category string, amount decimal(19,2), currency string, purchase_date date, store_name string, comment string, created_at timestamp"


def bought(spark, rows):
    full = [(i, 1, t, c, D(a), cur, d, s, x, datetime(2026, 1, 1)) for i, (t, c, a, cur, d, s, x) in enumerate(rows, 1)]
    return spark.createDataFrame(full, PURCHASE)


@pytest.fixture(scope="module")
def march(spark):
    return bought(
        spark,
        [
            ("Groceries", "FOOD", "12.50", "UAH", date(2026, 3, 10), "Fresh Market", 'Weekly, "shop"'),
            ("Snack", "FOOD", "3.00", "UAH", date(2026, 3, 11), "Fresh Market", None),
            ("Bus Card", "TRANSPORT", "15.00", "UAH", date(2026, 3, 12), "City Transit", "Top up"),
            ("Misc", "OTHER", "5.00", "USD", date(2026, 3, 13), " ", None),
            ("Old Month", "FOOD", "99.99", "UAH", date(2026, 2, 28), None, None),
        ],
    )


def lines(spark, rows, kind, month=3):
    todo = spark.createDataFrame([(9, 1, "a@b.c", 2026, month, kind)], "id long, user_id long, email string, year int, month int, report_type string")
    return [r.line for r in reports.csv_lines(reports.document(todo, rows)).orderBy("line_no").collect()]


def test_monthly_report(spark, march):
    got = lines(spark, march, "MONTHLY_SPENDING")
    assert got[:6] == ["Monthly Spending Report", "Period,2026-03", "Owner,a@b.c", "Report Type,MONTHLY_SPENDING", 'Currencies,"UAH, USD"', ""]
    assert '2026-03-10,Groceries,FOOD,Fresh Market,UAH,12.50,"Weekly, ""shop"""' in got
    assert "UAH,30.50" in got and "USD,5.00" in got and not any("99.99" in x for x in got)


def test_category_and_store_reports(spark, march):
    assert {"FOOD,UAH,2,15.50", "TRANSPORT,UAH,1,15.00", "Purchase Count,4"} <= set(lines(spark, march, "CATEGORY_SUMMARY"))
    assert {"Fresh Market,UAH,2,15.50", "City Transit,UAH,1,15.00", "Unknown Store,USD,1,5.00"} <= set(lines(spark, march, "STORE_SUMMARY"))


def test_empty_month(spark, march):
    got = lines(spark, march, "MONTHLY_SPENDING", 4)
    assert "Currencies,No purchases" in got
    assert {"No purchases found for the selected period", "No currency totals available", "No category totals available"} <= set(got)
    assert "Purchase Count,0" in lines(spark, march, "STORE_SUMMARY", 4)


def test_files(spark, march, tmp_path):
    todo = spark.createDataFrame([(9, 1, "a@b.c", 2026, 3, "CATEGORY_SUMMARY")], "id long, user_id long, email string, year int, month int, report_type string")
    document = reports.document(todo, march)
    rows = render.rows_of(document, 9)
    assert rows[0] == ("title", ["Category Summary Report"])
    pages = -(-10 * len(rows) // ((render.PAGE_HEIGHT - 2 * render.MARGIN) // render.LINE_HEIGHT))
    assert render.pdf(rows * 10).startswith(b"%PDF") and f"/Count {pages} ".encode() in render.pdf(rows * 10)
    sheet = zipfile.ZipFile(io.BytesIO(render.workbook(rows))).read("xl/worksheets/sheet1.xml").decode()
    assert "15.50" in sheet and "Purchase Count" in sheet
    render.write_csv(reports.csv_lines(document), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).count() == len(lines(spark, march, "CATEGORY_SUMMARY"))


def test_amount_from_items(spark):
    p = bought(spark, [("Shop", "FOOD", "1.00", "EUR", date(2026, 3, 1), None, None), ("None", "FOOD", "7.00", "EUR", date(2026, 3, 1), None, None)])
    items = spark.createDataFrame([(1, 0, "Milk", D(2), "pcs", D("1.50"), None), (1, 1, "Bread", None, None, None, D("2.20")), (2, 0, "x", None, None, None, None)], "purchase_id long, line_index int, title string, quantity decimal(19,3), unit string, unit_price decimal(19,2), line_total decimal(19,2)")
    got = {r.id: r.derived_amount for r in purchases.with_amounts(p, items).collect()}
    assert got == {1: D("5.20"), 2: D("7.00")}
    assert purchases.with_items(p, items).filter("id = 1").first().items[1].title == "Bread"


def test_requests(spark):
    rows = [(1, "\t Milk ", " food", D("1.005"), "UAH", date(2026, 1, 1), " ", "x"), (2, " ", None, D(0), "XXX", None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, category string, amount decimal(19,3), currency string, purchase_date date, store_name string, comment string")
    one = purchases.normalised(df).filter("id = 1").first()
    assert (one.title, one.category, one.amount, one.store_name) == ("Milk", "FOOD", D("1.01"), None)
    got = {r.id: r.errors for r in purchases.errors(df).collect()}
    assert got[1] is None and got[2].count(";") == 4


def test_listing(spark):
    rows = [("a", "FOOD", "1", "UAH", date(2026, 3, 5), None, None), ("b", "FOOD", "1", "UAH", date(2026, 2, 5), None, None), ("c", "TRANSPORT", "1", "UAH", date(2025, 3, 5), None, None)]
    p = bought(spark, rows)
    assert [r.title for r in purchases.listing(p, 1, 2026, 3, "food").collect()] == ["a"]
    assert [r.title for r in purchases.listing(p, 1, month=3).collect()] == ["a", "c"]
    assert purchases.listing(p, 2).count() == 0


def test_segments(spark):
    rows = [(c, c, str(a), "UAH", date(2026, 3, 1), None, None) for c, a in (("FOOD", 540), ("UTILITIES", 330), ("SUBSCRIPTIONS", 45), ("TRANSPORT", 25), ("EDUCATION", 20), ("BILLS", 10))]
    got = [(r.segment, r.value) for r in dashboard.spending_segments(bought(spark, rows)).orderBy("rank").collect()]
    assert got == [("FOOD", D("540.00")), ("UTILITIES", D("330.00")), ("OTHER", D("100.00"))]


NOISY = "СІЛЬПО\nм. Київ вул. Хрещатик 1\nКаса 03\nДата 14.03.2026 18:42\nМОЛОКО ЯГОТИНСЬКЕ 2 x 42.50 85.00\nХЛІБ БОРОДИНСЬКИЙ 39.90\nБАНАНИ 1.245кг x 67.80 84.41\nПакет\n3.00\nШТРИХ КОД 4820000000000\n1234567890123\nСУМА 212.31\nДякуємо за покупку"


def test_receipts(spark):
    texts = [
        (1, NOISY),
        (2, "SHOP\nTEST PRODUCT\n35.50\nTOTAL 35.50\n\n"),
        (3, "CORNER SHOP\r\nTHANK YOU FOR VISITING"),
        (4, "X\n31.02.2026\n32.01.2026 МОЛОКО 2 150.00"),
        (5, ""),
        (6, None),
    ]
    df = spark.createDataFrame(texts, "receipt_id long, raw_text string")
    head = {r.receipt_id: r for r in receipts.headers(df).collect()}
    assert (head[1].store_name, head[1].total_amount, head[1].purchase_date) == ("СІЛЬПО", D("212.31"), date(2026, 3, 14))
    assert (head[3].store_name, head[3].total_amount, head[3].purchase_date) == ("CORNER SHOP", None, None)
    assert (head[4].purchase_date, head[4].total_amount) == (date(2026, 2, 28), D("2150.00"))
    assert head[5].store_name is None and head[6].total_amount is None
    items = {(r.receipt_id, r.line_index): r for r in receipts.items(df).collect()}
    assert len([k for k in items if k[0] == 1]) == 4
    first, third, fourth = items[1, 1], items[1, 3], items[1, 4]
    assert (first.title, first.quantity, first.unit_price, first.line_total) == ("МОЛОКО ЯГОТИНСЬКЕ", D("2.000"), D("42.50"), D("85.00"))
    assert (third.quantity, third.unit, third.line_total) == (D("1.245"), "кг", D("84.41"))
    assert (fourth.title, fourth.line_total, fourth.raw_fragment) == ("Пакет", D("3.00"), "Пакет | 3.00")
    assert items[2, 1].line_total == D("35.50") and items[2, 1].raw_fragment == "SHOP | TEST PRODUCT | 35.50"


def test_tokens(spark):
    updates = spark.createDataFrame([(1, "c1", "/start t2", 5), (2, "c2", "/start t2", 6), (3, "c3", "hello", 7), (4, "c4", "/start t1", 99)], "update_id long, chat_id string, text string, at long")
    tokens = spark.createDataFrame([("t1", 1, 50, None), ("t2", 2, 50, None)], "token string, user_id long, expires_at long, used_at long")
    assert [(r.user_id, r.chat_id) for r in jobs.link_tokens(updates, tokens).collect()] == [(2, "c1")]


def test_queue(spark, tmp_path):
    (tmp_path / "queue").mkdir()
    good = json.dumps({"reportJobId": 1, "userId": 2, "year": 2026, "month": 3, "reportType": "X", "reportFormat": "CSV"})
    (tmp_path / "queue/a.json").write_text(good + "\nnot json\n")
    run = lambda: jobs.run_queue(spark, str(tmp_path / "queue"), str(tmp_path / "checkpoint"), str(tmp_path / "out"), lambda m: m.select(F.col("reportJobId").alias("job_id"), F.lit("DONE").alias("status"))).awaitTermination()
    run()
    run()  # what was consumed is not consumed again
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out/done")).collect()] == [(1, "DONE")]
    assert [r.value for r in spark.read.text(str(tmp_path / "out/rejected")).collect()] == ["not json"]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.category_label(F.lit(" home_and-garden ")).alias("label"),
        scalars.safe_file_name(F.lit("C:\\x\\my file.png")).alias("file"),
        scalars.percent(F.lit(0.0567)).alias("small"),
        scalars.percent(F.lit(0.567)).alias("large"),
        scalars.csv_cell(F.lit(None).cast("string")).alias("cell"),
    ).first()
    assert (row.label, row.file, row.small, row.large, row.cell) == ("Home And Garden", "my_file.png", 5.7, 57.0, "")


def test_receipts_are_read_in_their_rows(spark):
    """No sort or shuffle per receipt, and the same items whether titles pile up or lines hold control characters."""
    texts = ["\n".join(["LONG title"] * 300 + ["9.00", "TEA x", "TOTAL 1.00", "LATE 2.00"]), "abc \x01 def\r1.00\r\n2.00\nMILK 3.00", "1.00", "", None]
    items = receipts.items(spark.createDataFrame(list(enumerate(texts)), "receipt_id long, raw_text string"))
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan
    got = {(r.receipt_id, r.line_index): (r.title, r.raw_fragment) for r in items.collect()}
    assert got == {(0, 1): (" ".join(["LONG title"] * 300), " | ".join(["LONG title"] * 300 + ["9.00"])), (1, 1): ("abc \x01 def", "abc \x01 def | 1.00"), (1, 2): ("MILK", "MILK 3.00")}
