"""Rules of requests, accounts, channels, report files, the calculator and the table function of the parser."""

import io
import random
import re
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import receipt_table
from tallyspark.functions.calculator import calculate, evaluate
from tallyspark.operators import accounts, dashboard, lifecycle, notices, receipts
from tallyspark.operators import purchases as buying
from tallyspark.sources import render


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("2**3", 8), ("2--3", None), ("010+1", None), ("08", None), ("0", 0), ("0.5", 0.5), ("1.005", 1.0), ("0.125", 0.13), ("-0.125", -0.13), ("-2**2", None), ("(-2)**2", 4), ("-(2)**2", None), ("2**-1", 0.5),
        ("2**3**2", 512), ("2**-2**2", None), ("1/0", None), ("0/0", None), ("1/(1/0)", 0), ("0**-1", None), ("1+/*2*/3", 4), ("1/*2*/3", None), ("1/*two*/+3", None), ("1//2", None), ("1/*", None), ("1.5.5", None),
        ("1.*2", 2), (".5+.5", 1), (".", None), ("()", None), ("(1)(2)", None), ("", None), (None, None), (" 1 2 ", 12), ("+-3", -3), ("1+-1", 0), ("1-+-1", 2), ("1+++1", None), ("2*(3+4)", 14), ("1/3", 0.33), ("5-3-1", 1),
        ("8/4/2", 1), ("1e5", None), ("10**20*10", 1e21), ("10**400", None), ("(" * 5000 + "1" + ")" * 5000, 1), ("1+", None), (")(", None), ("1)", None), ("2***3", None), ("-0", 0),
    ],
)
def test_calculator(text, value):
    assert evaluate(text) == value


def test_calculator_in_frames(spark):
    df = spark.createDataFrame([("1+1",), (None,), ("x",), ("1+1",)], "t string")
    assert [r.v for r in df.select(calculate("t").alias("v")).collect()] == [2.0, None, None, 2.0]


def test_messages_of_missing_values(spark):
    asked = spark.createDataFrame([(None, None, None, "DOC"), (1999, 13, "STORE_SUMMARY", "PDF")], "year int, month int, report_type string, report_format string")
    assert [r.errors for r in accounts.report_errors(asked).collect()] == [
        "year: must not be null; month: must not be null; reportType: must not be null; reportFormat: must not be null",
        "year: must be greater than or equal to 2000; month: must be less than or equal to 12",
    ]
    people = spark.createDataFrame([("", " " * 8), ("  ", "long enough"), (" a@b.c", "long enough"), (None, None), ("a@b.c", "")], "email string, password string")
    assert [r.errors for r in accounts.registration_errors(people).collect()] == [
        "email: must not be blank; password: must not be blank",
        "email: must not be blank; email: must be a well-formed email address",
        "email: must be a well-formed email address",
        "email: must not be blank; password: must not be blank",
        "password: must not be blank; password: size must be between 8 and 255",
    ]
    bought = spark.createDataFrame([("t", "c", None, "UAH", None), (" ", "c", "0.00", None, None)], "title string, category string, amount string, currency string, purchase_date date").withColumn("amount", F.col("amount").cast("decimal(19,2)"))
    assert [r.errors for r in buying.errors(bought).collect()] == [
        "amount: must not be null; purchaseDate: must not be null",
        "title: must not be blank; amount: must be greater than 0; currency: must not be null; purchaseDate: must not be null",
    ]


def test_logins(spark):
    at = lambda d: datetime(2026, 1, d)
    users = spark.createDataFrame([(1, "a@b.c", None, None), (2, "b@b.c", "s2", "USER"), (3, "c@b.c", None, None)], "id long, email string, google_subject string, role string")
    logins = spark.createDataFrame(
        [(" A@B.C ", "zz", at(1)), ("a@b.c", "aa", at(2)), ("other@b.c", "s2", at(1)), ("new@b.c", "n1", at(3)), ("NEW@b.c", "n0", at(4)), ("b@b.c", "s9", at(1))], "email string, subject string, at timestamp"
    )
    linked, new = accounts.linked_accounts(users, logins, [" a@B.c"], F.lit(at(9)))
    assert {r.id: (r.google_subject, r.role) for r in linked.collect()} == {1: ("zz", "ADMIN"), 2: ("s2", "USER"), 3: (None, None)}
    assert [(r.email, r.google_subject, r.role, r.preferred_channel) for r in new.collect()] == [("new@b.c", "n1", "USER", "EMAIL")]
    assert accounts.by_subject(users, "s2").first().id == 2 and accounts.by_subject(users, "S2").count() == 0


def test_channels(spark):
    at = datetime(2026, 1, 1)
    users = spark.createDataFrame([(1, "a", "  ", at, "TELEGRAM"), (2, " ", "c", at, None), (3, None, "c", None, "EMAIL")], "id long, email string, chat_id string, connected_at timestamp, preferred_channel string")
    plan = {r.id: (r.connected, r.channel_order, r.usable, r.channel) for r in dashboard.delivery_plan(users).collect()}
    assert plan == {1: (False, "TELEGRAM,EMAIL", "EMAIL", "EMAIL"), 2: (True, "EMAIL,TELEGRAM", "TELEGRAM", "TELEGRAM"), 3: (False, "EMAIL,TELEGRAM", "", None)}
    pending = spark.createDataFrame([(1, "t1", at), (2, "t2", at)], "user_id long, token string, expires_at timestamp")
    got = {r.id: (r.connected, r.link) for r in notices.connection_status(users, pending, "bot").collect()}
    assert got == {1: (False, "https://t.me/bot?start=t1"), 2: (True, None), 3: (False, None)}


def test_activity(spark):
    at = lambda d: datetime(2026, 1, d)
    scans = spark.createDataFrame([(1, "NEW", "a.png", at(5), None), (2, "DONE", "b.png", at(1), at(7)), (3, "FAILED", "c.png", at(2), at(3))], "id long, ocr_status string, original_file_name string, uploaded_at timestamp, ocr_processed_at timestamp")
    made = spark.createDataFrame([(1, "DONE", "STORE_SUMMARY", "PDF", at(7)), (2, "PROCESSING", "CATEGORY_SUMMARY", "CSV", at(4)), (3, "FAILED", "MONTHLY_SPENDING", "XLSX", at(2))], "id long, status string, report_type string, report_format string, updated_at timestamp")
    assert [(r.kind, r.id, r.title) for r in dashboard.activity(scans, made).collect()] == [
        ("receipt", 2, "OCR completed: b.png"), ("report", 1, "Report is ready: Store summary PDF"), ("receipt", 1, "OCR is still running: a.png"),
        ("report", 2, "Report is still processing: Category summary CSV"), ("receipt", 3, "OCR finished with an error: c.png"),
    ]


def test_defaults(spark):
    now, old = datetime(2026, 1, 2), datetime(2025, 1, 1)
    made = spark.createDataFrame([(1, old, "DONE", "PDF"), (2, None, None, None)], "id long, created_at timestamp, status string, report_format string")
    assert [tuple(r) for r in lifecycle.job_defaults(made, F.lit(now)).orderBy("id").collect()] == [(1, old, "DONE", "PDF", now), (2, now, "NEW", "CSV", now)]
    scans = spark.createDataFrame([(1, old, None), (2, None, "DONE")], "id long, uploaded_at timestamp, ocr_status string")
    assert [tuple(r) for r in lifecycle.receipt_defaults(scans, F.lit(now)).orderBy("id").collect()] == [(1, old, "NEW"), (2, now, "DONE")]


DOCUMENT = "job_id long, section int, row int, kind string, cells array<string>"


def test_files_made_on_executors(spark, tmp_path):
    rows = [(1, 0, 0, "title", ["Report"]), (1, 0, 1, "meta", ["Owner", "a|b <c>"]), (1, 0, 2, "blank", [""]), (1, 1, 1, "section", ["Rows"]), (1, 1, 2, "header", ["A", "B", "C"])]
    rows += [(1, 1, k + 3, "row", [str(k), "x" * 40, "ю"]) for k in range(120)] + [(2, 0, 0, "title", ["Other"])]
    wanted = [(1, "PDF"), (1, "XLSX"), (1, "CSV"), (2, "CSV"), (2, "DOC"), (3, "CSV")]
    made = render.files(spark.createDataFrame(rows, DOCUMENT), spark.createDataFrame(wanted, "job_id long, report_format string"))
    got = {(r.job_id, r.report_format): (bytes(r.content) if r.content is not None else None, r.error) for r in made.collect()}
    assert set(got) == set(wanted) - {(3, "CSV")} and got[2, "DOC"] == (None, "no generator for format DOC") and got[2, "CSV"][0] == b"Other\n"
    pdf = got[1, "PDF"][0]
    # 50 lines a page from the top margin to the bottom one; titles bold and larger.
    assert pdf.count(b"/Type /Page ") == -(-125 // 50) and b"/F2 16 Tf (Report)" in pdf and b"/F2 12 Tf (Rows)" in pdf and b"/F1 10 Tf (A | B | C)" in pdf and b"Owner: a|b <c>" in pdf
    book = zipfile.ZipFile(io.BytesIO(got[1, "XLSX"][0]))
    sheet, styles = book.read("xl/worksheets/sheet1.xml").decode(), book.read("xl/styles.xml").decode()
    assert [float(w) for w in re.findall(r'<col [^>]*width="([0-9.]+)"', sheet)] == [pytest.approx(x, abs=0.01) for x in (2 + 6 * 14 / 11, 42, 3)]
    assert re.findall(r'<b/><sz val="(\d+)"', styles) == ["14", "11", "10"] and 's="3"><is><t xml:space="preserve">B</t>' in sheet and "a|b &lt;c&gt;" in sheet


def test_table_function_gives_what_columns_give(spark):
    """On receipts put together at random from parts that the rules tell apart."""
    rng = random.Random(4)
    parts = ["MILK", "Хліб", "2 x 3.50", "12.00", "1 234,50", "0,5 кг", "TOTAL 5.00", "сума", "12.03.2026", "10:30", "12345678", "shop st. 5", "x", "-", "тел", "  ", "A1", "молоко 2 150.00", "2 шт", "сир 1.5 кг", "3х4.20", "!!!", "999.99", "Aa bb", "qty 3 *", "subtotal 4.00", "дом 5", "a b"]
    rows = [(i, rng.choice(["\n", "\r\n", "\r"]).join(" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 9)))) for i in range(1500)]
    texts = spark.createDataFrame([*rows, (-1, None), (-2, "")], "receipt_id long, raw_text string")
    receipt_table.register(spark)
    lateral = spark.sql("SELECT r.receipt_id, p.* FROM {texts} r, LATERAL parse_receipt(r.raw_text) p", texts=texts)
    want = Counter(map(tuple, receipts.items(texts).collect()))
    assert sum(want.values()) > 500 and Counter(map(tuple, lateral.collect())) == want


def test_table_function_reads_a_line_as_the_column_rules_do():
    """Digits and letters are counted alike in ASCII lines and others; words of any script are found in lines of their script."""
    from tallyspark.functions import receipt_table

    assert receipt_table.counted("MILK 2 x 0.50") == (4, 5) and receipt_table.counted("Ж٣²ⅷ 1") == (2, 1)
    kinds = {"MILK 1.00": "inline", "1.00": "amount", "MILK": "title", "cashier anna": "other", "штрих": "other", "вул": "title", "вул 5": "other", "ave x": "title", "ave 5": "other", "a": "other"}
    assert {line: receipt_table.kind_of(line, line.lower()) for line in kinds} == kinds
