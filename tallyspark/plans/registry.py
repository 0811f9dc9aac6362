"""Every query of the spending engine with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import receipt_table, scalars
from tallyspark.functions.calculator import calculate
from tallyspark.operators import accounts, dashboard, lifecycle, notices, receipts, reports
from tallyspark.operators import purchases as buying
from tallyspark.sources import objects, render, scratch, views
from tallyspark.sources.tables import Tables, without
from tallyspark.sources.views import VIEWS_SQL
from tallyspark.streaming import consumer, feed, jobs, outbox

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated query under its name, with the SQL that follows the views."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = VIEWS_SQL + sql
        return run

    return add


@query("SELECT id, purchase_date, category, currency, amount FROM purchases WHERE user_id = 7 AND month(purchase_date) = 3 AND category = 'BUILDING'")
def purchase_listing_filtered(spark: SparkSession, d: str) -> DataFrame:
    return buying.listing(views.purchases(spark, d), 7, month=3, category=" building ").select("id", "purchase_date", "category", "currency", "amount")


@query("SELECT id, amount FROM purchases WHERE user_id = 3 AND purchase_date >= DATE '1995-02-01' AND purchase_date < DATE '1995-03-01'")
def purchase_listing_month(spark: SparkSession, d: str) -> DataFrame:
    return buying.listing(views.purchases(spark, d), 3, 1995, 2).select("id", "amount")


@query(
    """SELECT p.id, coalesce(n, 0) AS n_items, coalesce(t, '') AS titles FROM purchases p LEFT JOIN
    (SELECT purchase_id, count(*) AS n, string_agg(title, '|' ORDER BY line_index) AS t FROM purchase_items GROUP BY purchase_id) i ON p.id = i.purchase_id"""
)
def purchases_with_items_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = buying.with_items(views.purchases(spark, d), views.purchase_items(spark, d))
    return nested.select("id", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x["title"]), "|").alias("titles"))


@query(
    """, totals AS (SELECT purchase_id, CAST(sum(coalesce(line_total, CAST(quantity * unit_price AS DECIMAL(19,2)))) AS DECIMAL(19,2)) AS items_sum FROM purchase_items GROUP BY purchase_id)
    SELECT id, items_sum, CASE WHEN items_sum > 0 THEN items_sum ELSE amount END AS derived_amount FROM purchases LEFT JOIN totals ON id = purchase_id"""
)
def purchase_amount_from_items(spark: SparkSession, d: str) -> DataFrame:
    return buying.with_amounts(views.purchases(spark, d), views.purchase_items(spark, d)).select("id", "items_sum", "derived_amount")


MONTHLY_SQL = ", m AS (SELECT *, strftime(purchase_date, '%Y-%m') AS period, CASE WHEN trim(coalesce(store_name, '')) = '' THEN 'Unknown Store' ELSE store_name END AS store FROM purchases)"


def grouped_sql(*by: str) -> str:
    keys = ", ".join(by)
    return f"""{MONTHLY_SQL}, g AS (SELECT user_id, period, {keys}, count(*) AS purchase_count, CAST(sum(amount) AS DECIMAL(19,2)) AS total_amount, min(CAST(purchase_date AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS f
    FROM m GROUP BY user_id, period, {keys})
    SELECT user_id, period, {keys}, purchase_count, total_amount, CAST(row_number() OVER (PARTITION BY user_id, period ORDER BY f) AS INTEGER) AS rank FROM g"""


@query(grouped_sql("category", "currency"))
def report_category_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_summary(views.purchases(spark, d))


@query(grouped_sql("store", "currency"))
def report_store_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.store_summary(views.purchases(spark, d))


@query(grouped_sql("currency"))
def report_totals_by_currency(spark: SparkSession, d: str) -> DataFrame:
    return reports.currency_totals(views.purchases(spark, d))


@query(
    MONTHLY_SQL
    + """ SELECT user_id, period, CAST(row_number() OVER (PARTITION BY user_id, period ORDER BY purchase_date, id) AS INTEGER) AS rank, CAST(purchase_date AS VARCHAR) AS "purchaseDate", title, category,
    coalesce(store_name, '') AS "storeName", currency, CAST(amount AS VARCHAR) AS amount, coalesce(comment, '') AS comment FROM m"""
)
def report_monthly_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.report_rows(views.purchases(spark, d))


@query(
    MONTHLY_SQL
    + """, c AS (SELECT user_id, period, currency, count(*) AS n, min(CAST(purchase_date AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS f FROM m GROUP BY user_id, period, currency)
    SELECT user_id, period, string_agg(currency, ', ' ORDER BY f) AS currencies, CAST(sum(n) AS BIGINT) AS purchase_count FROM c GROUP BY user_id, period"""
)
def report_currencies_metadata(spark: SparkSession, d: str) -> DataFrame:
    return reports.currencies(reports.monthly(views.purchases(spark, d)), ["user_id", "period"])


@query(
    """SELECT j.id AS job_id, j.report_type, email, count(p.id) AS purchase_count FROM report_jobs j JOIN users u ON j.user_id = u.id
    LEFT JOIN purchases p ON p.user_id = j.user_id AND p.purchase_date >= make_date(j.year, CAST(j.month AS INTEGER), 1) AND p.purchase_date < make_date(j.year, CAST(j.month AS INTEGER), 1) + INTERVAL 1 MONTH
    GROUP BY j.id, j.report_type, email"""
)
def report_jobs_batch(spark: SparkSession, d: str) -> DataFrame:
    todo = views.report_jobs(spark, d)
    counts = reports.of_jobs(todo, views.purchases(spark, d)).groupBy("job_id").agg(F.count("*").alias("n"))
    joined = todo.withColumnRenamed("id", "job_id").join(counts, "job_id", "left")
    return joined.select("job_id", "report_type", "email", F.coalesce("n", F.lit(0)).alias("purchase_count"))


def cell_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[,\"\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


def csv_sql() -> str:
    """The documents of the three report types as rows (job, section, row, line)."""
    q = cell_sql

    def groups(kind: str, section: int, key: str, count: bool) -> str:
        keys = f"{key}, currency" if key else "currency"
        cells = (q(key) + " || ',' || " if key else "") + "currency" + (" || ',' || n" if count else "") + " || ',' || total"
        return f"""SELECT job_id, {section} AS section, 2 + row_number() OVER (PARTITION BY job_id ORDER BY f) AS row, {cells} AS line FROM
        (SELECT job_id, {keys}, count(*) AS n, CAST(CAST(sum(amount) AS DECIMAL(19,2)) AS VARCHAR) AS total, min(CAST(purchase_date AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS f FROM r WHERE report_type = '{kind}' GROUP BY job_id, {keys})"""

    def frame(kind: str, section: int, title: str, header: str, message: str, always: bool = False) -> str:
        some = "TRUE" if always else f"j.id IN (SELECT job_id FROM r WHERE report_type = '{kind}')"
        return f"""SELECT j.id, {section}, x.k, CASE x.k WHEN 1 THEN '{title}' WHEN 2 THEN CASE WHEN {some} THEN '{header}' ELSE '{message}' END ELSE '' END
        FROM report_jobs j, (SELECT unnest([1, 2, 2147483647]) AS k) x WHERE report_type = '{kind}'"""

    parts = [
        """SELECT j.id AS job_id, 0 AS section, CAST(x.k AS BIGINT) AS row, CASE x.k WHEN 0 THEN CASE report_type WHEN 'MONTHLY_SPENDING' THEN 'Monthly Spending Report' WHEN 'CATEGORY_SUMMARY' THEN 'Category Summary Report' ELSE 'Store Summary Report' END
        WHEN 1 THEN 'Period,' || printf('%04d-%02d', year, month) WHEN 2 THEN 'Owner,' || email WHEN 3 THEN 'Report Type,' || report_type
        WHEN 4 THEN 'Currencies,' || coalesce(CASE WHEN contains(cur, ',') THEN '"' || cur || '"' ELSE cur END, 'No purchases') ELSE '' END AS line
        FROM report_jobs j JOIN users u ON j.user_id = u.id LEFT JOIN (SELECT job_id, string_agg(currency, ', ' ORDER BY f) AS cur FROM
        (SELECT job_id, currency, min(CAST(purchase_date AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS f FROM r GROUP BY job_id, currency) GROUP BY job_id) c ON c.job_id = j.id, (SELECT unnest(range(0, 6)) AS k) x"""
    ]
    cells = " || ',' || ".join(["CAST(purchase_date AS VARCHAR)", q("title"), q("category"), q("coalesce(store_name, '')"), "currency", "CAST(amount AS VARCHAR)", q("coalesce(comment, '')")])
    m = "MONTHLY_SPENDING"
    parts += [
        frame(m, 1, "Purchases", "purchaseDate,title,category,storeName,currency,amount,comment", "No purchases found for the selected period"),
        f"SELECT job_id, 1, 2 + row_number() OVER (PARTITION BY job_id ORDER BY purchase_date, id), {cells} FROM r WHERE report_type = '{m}'",
        frame(m, 2, "Totals by Currency", "currency,totalAmount", "No currency totals available"),
        groups(m, 2, "", False),
        frame(m, 3, "Category Summary", "category,currency,totalAmount", "No category totals available"),
        groups(m, 3, "category", False),
    ]
    for kind, title, header, message, key in (
        ("CATEGORY_SUMMARY", "Category Summary", "category,currency,purchaseCount,totalAmount", "No category totals available", "category"),
        ("STORE_SUMMARY", "Store Summary", "storeName,currency,purchaseCount,totalAmount", "No store totals available", "store"),
    ):
        parts += [
            frame(kind, 1, title, header, message),
            groups(kind, 1, key, True),
            frame(kind, 2, "Totals by Currency", "currency,totalAmount", "No currency totals available"),
            groups(kind, 2, "", False),
            frame(kind, 3, "Summary", "metric,value", "", True),
            f"SELECT j.id, 3, 3, 'Purchase Count,' || count(r.id) FROM report_jobs j LEFT JOIN r ON r.job_id = j.id WHERE j.report_type = '{kind}' GROUP BY j.id",
        ]
    return f""", r AS (SELECT j.id AS job_id, j.report_type, p.*, CASE WHEN trim(coalesce(store_name, '')) = '' THEN 'Unknown Store' ELSE store_name END AS store FROM report_jobs j JOIN purchases p
    ON p.user_id = j.user_id AND year(p.purchase_date) = j.year AND month(p.purchase_date) = j.month), all_rows AS ({' UNION ALL '.join(parts)})
    SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY section, row) AS INTEGER) AS line_no, line FROM all_rows"""


@query(csv_sql())
def report_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.csv_lines(reports.document(views.report_jobs(spark, d), views.purchases(spark, d)))


@query(
    """SELECT user_id, currency, total, CAST(row_number() OVER (PARTITION BY user_id ORDER BY total DESC, currency) AS INTEGER) AS rank
    FROM (SELECT user_id, currency, CAST(sum(amount) AS DECIMAL(19,2)) AS total FROM purchases GROUP BY user_id, currency)"""
)
def dashboard_currency_summary(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.currency_summary(views.purchases(spark, d))


SEGMENTS_SQL = """, s AS (
    SELECT user_id, currency, upper(trim(category)) AS key, CAST(sum(amount) AS DECIMAL(19,2)) AS value, max(CAST(created_at AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS seen FROM purchases GROUP BY ALL
), t AS (
    SELECT *, CAST(sum(value) OVER w AS DECIMAL(19,2)) AS total, row_number() OVER (PARTITION BY user_id, currency ORDER BY value DESC, seen DESC) AS place FROM s WINDOW w AS (PARTITION BY user_id, currency)
), q AS (
    SELECT *, place >= 5 OR CAST(value AS DOUBLE) / CAST(total AS DOUBLE) < 0.06 AS is_rollup FROM t WHERE total > 0
), z AS (
    SELECT user_id, currency, is_rollup, CASE WHEN is_rollup THEN 'OTHER' ELSE key END AS segment, CAST(sum(value) AS DECIMAL(19,2)) AS value, min(place) AS place, min(total) AS total FROM q GROUP BY ALL
), segments AS (
    SELECT user_id, currency, CAST(row_number() OVER (PARTITION BY user_id, currency ORDER BY is_rollup, place) AS INTEGER) AS rank, segment, is_rollup, value, CAST(value AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM z WHERE NOT is_rollup OR value > 0
)
"""


@query(SEGMENTS_SQL + "SELECT * FROM segments")
def dashboard_spending_segments(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.spending_segments(views.purchases(spark, d))


@query(SEGMENTS_SQL + "SELECT user_id, currency, segment, is_rollup, value, share FROM segments WHERE rank = 1")
def dashboard_top_category(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.top_category(views.purchases(spark, d))


LATEST_SQL = ", latest AS (SELECT job_id, status, updated_at, event_id, count(*) OVER (PARTITION BY job_id) AS n_changes FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) = 1)"


@query(LATEST_SQL + " SELECT * FROM latest")
def job_latest_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_status(views.job_events(spark, d))


@query(LATEST_SQL + " SELECT count(*) FILTER (status IN ('NEW', 'PROCESSING')) AS active, count(*) FILTER (status = 'DONE') AS ready, count(*) FILTER (status = 'FAILED') AS failed FROM latest")
def dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.job_metrics(jobs.latest_status(views.job_events(spark, d)))


ACTIVITY_STATUS = "CASE {0} % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'FAILED' ELSE 'NEW' END"


@query(
    f""", scans AS (SELECT o_orderkey AS id, {ACTIVITY_STATUS.format("o_orderkey")} AS status, o_orderdate AS uploaded, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS processed
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5),
    f AS (SELECT 'receipt' AS kind, id, coalesce(processed, uploaded) AS at_, CASE status WHEN 'DONE' THEN 'OCR completed' WHEN 'FAILED' THEN 'OCR finished with an error' ELSE 'OCR is still running' END || ': scan-' || id || '.png' AS title, 0 AS feed FROM scans
    UNION ALL SELECT 'report', id, TIMESTAMP '1998-06-20' + INTERVAL (id % 13 * 4) DAY, CASE id % 3 WHEN 0 THEN 'Report is ready' WHEN 1 THEN 'Report finished with an error' ELSE 'Report is still processing' END || ': '
        || CASE report_type WHEN 'MONTHLY_SPENDING' THEN 'Monthly spending' WHEN 'CATEGORY_SUMMARY' THEN 'Category summary' ELSE 'Store summary' END || ' ' || report_format, 1 FROM report_jobs WHERE user_id = 5)
    SELECT kind, id, at_ AS "at", title FROM f ORDER BY at_ DESC, feed, id DESC LIMIT 5"""
)
def dashboard_recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """User 5's."""
    key = F.col("id")
    status = F.element_at(F.lit(["DONE", "FAILED", "NEW"]), (key % 3 + 1).cast("int"))
    uploaded = views.purchases(spark, d).filter("user_id = 5").select("id", status.alias("ocr_status"), F.concat(F.lit("scan-"), "id", F.lit(".png")).alias("original_file_name"), F.col("created_at").alias("uploaded_at"))
    scanned = uploaded.withColumn("ocr_processed_at", F.when(key % 3 == 0, F.expr("uploaded_at + interval 1 day")))
    changed = F.expr("timestamp_ntz'1998-06-20' + make_dt_interval(cast(id % 13 * 4 as int))")
    return dashboard.activity(scanned, views.report_jobs(spark, d).filter("user_id = 5").withColumns({"status": status, "updated_at": changed}))


@query("SELECT 'users' AS table_name, count(*) AS n_rows FROM users UNION ALL SELECT 'purchases', count(*) FROM purchases UNION ALL SELECT 'purchase_items', count(*) FROM purchase_items UNION ALL SELECT 'report_jobs', count(*) FROM report_jobs")
def admin_overview(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.table_counts(users=views.users(spark, d), purchases=views.purchases(spark, d), purchase_items=views.purchase_items(spark, d), report_jobs=views.report_jobs(spark, d))


@query(
    """SELECT id, email, CASE WHEN google_subject IS NULL THEN 'PASSWORD' ELSE 'GOOGLE' END AS auth_provider, CASE WHEN email = 'nation_3@example.org' THEN 'ADMIN' ELSE 'USER' END AS role
    FROM users ORDER BY created_on DESC, id DESC LIMIT 10"""
)
def admin_recent_users(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.recent_users(views.users(spark, d), [" NATION_3@example.ORG "])


@query(
    """, o AS (SELECT id, coalesce(trim(chat_id) <> '' AND connected_at IS NOT NULL, FALSE) AS connected, id % 10 <> 7 AS mail, CASE WHEN id % 9 <> 4 THEN preferred_channel END AS p FROM users)
    SELECT id, connected, CASE p WHEN 'TELEGRAM' THEN 'TELEGRAM,EMAIL' ELSE 'EMAIL,TELEGRAM' END AS channel_order,
    CASE p WHEN 'TELEGRAM' THEN concat_ws(',', CASE WHEN connected THEN 'TELEGRAM' END, CASE WHEN mail THEN 'EMAIL' END) ELSE concat_ws(',', CASE WHEN mail THEN 'EMAIL' END, CASE WHEN connected THEN 'TELEGRAM' END) END AS usable,
    CASE WHEN p = 'TELEGRAM' AND connected THEN 'TELEGRAM' WHEN mail THEN 'EMAIL' WHEN connected THEN 'TELEGRAM' END AS channel FROM o"""
)
def delivery_plan(spark: SparkSession, d: str) -> DataFrame:
    """Some users have no email, some no preferred channel, some a blank chat."""
    people = views.users(spark, d)
    return dashboard.delivery_plan(people.withColumns({"email": F.when(F.col("id") % 10 != 7, F.col("email")), "preferred_channel": F.when(F.col("id") % 9 != 4, F.col("preferred_channel"))}))


UPDATES_SQL = """, updates AS (SELECT event_id AS update_id, CASE WHEN event_id % 17 <> 0 THEN 'chat-' || user_id END AS chat_id, ts AS at_,
    CASE event_type WHEN 'signup' THEN '/start  tok-' || user_id WHEN 'click' THEN ' ' || chr(10) || '/start tok-' || user_id || chr(10) WHEN 'error' THEN '/start new-' || user_id ELSE event_type END AS text FROM events)"""


def updates(spark: SparkSession, d: str) -> DataFrame:
    """Messages with white space around, of tokens that are void later, and without a chat."""
    token = lambda text, name: F.concat(F.lit(text), F.lit(name), "user_id")
    kind = F.col("event_type")
    text = F.when(kind == "signup", token("/start  ", "tok-")).when(kind == "click", F.concat(token(" \n/start ", "tok-"), F.lit("\n"))).when(kind == "error", token("/start ", "new-")).otherwise(kind)
    chat = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("chat-"), "user_id"))
    return views.read(spark, d, "events").select(F.col("event_id").alias("update_id"), chat.alias("chat_id"), text.alias("text"), F.col("ts").alias("at"))


TOKENS_SQL = """, tokens AS (SELECT DISTINCT 'tok-' || user_id AS token, user_id, TIMESTAMP '2024-01-05' AS created_at, TIMESTAMP '2024-01-20' AS expires_at FROM events WHERE user_id % 5 <> 0
    UNION ALL SELECT DISTINCT 'new-' || user_id, user_id, TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-15' FROM events WHERE user_id % 5 <> 0 AND user_id % 3 = 0),
    starts AS (SELECT update_id, chat_id, at_, trim(replace(replace(text, chr(10), ''), '/start', '')) AS token FROM updates WHERE chat_id IS NOT NULL AND text LIKE '%/start%'),
    judged AS (SELECT s.*, user_id, CASE WHEN user_id IS NULL OR at_ < created_at OR token LIKE 'tok-%' AND user_id % 3 = 0 AND at_ >= TIMESTAMP '2024-01-12' THEN 'UNKNOWN' WHEN expires_at < at_ THEN 'EXPIRED' ELSE 'LINKED' END AS state
        FROM starts s LEFT JOIN tokens USING (token)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY token, state ORDER BY at_, update_id) AS k, bool_or(state = 'LINKED') OVER (PARTITION BY token ORDER BY at_, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM judged),
    outcomes AS (SELECT update_id, user_id, token, chat_id, CASE WHEN state IN ('LINKED', 'EXPIRED') AND taken THEN 'USED' ELSE state END AS outcome FROM placed)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """A token for most users, and a newer one for every third, which voids the first."""
    at = lambda t: F.expr(f"timestamp_ntz'{t}'")
    people = views.read(spark, d, "events").filter("user_id % 5 <> 0").select("user_id").distinct()
    first = people.select(F.concat(F.lit("tok-"), "user_id").alias("token"), "user_id", at("2024-01-05").alias("created_at"), at("2024-01-20").alias("expires_at"))
    newer = people.filter("user_id % 3 = 0").select(F.concat(F.lit("new-"), "user_id").alias("token"), "user_id", at("2024-01-12").alias("created_at"), at("2024-01-15").alias("expires_at"))
    return first.unionByName(newer).withColumn("used_at", F.expr("cast(null as timestamp_ntz)"))


@query(UPDATES_SQL + " SELECT update_id, chat_id, text FROM updates WHERE update_id >= 137 ORDER BY update_id LIMIT 20")
def bot_offset_batch(spark: SparkSession, d: str) -> DataFrame:
    return jobs.next_batch(updates(spark, d), 137).select("update_id", "chat_id", "text")


@query(UPDATES_SQL + TOKENS_SQL + " SELECT user_id, token, chat_id, update_id FROM outcomes WHERE outcome = 'LINKED'")
def token_link(spark: SparkSession, d: str) -> DataFrame:
    return jobs.link_tokens(updates(spark, d), tokens(spark, d)).drop("at")


@query(UPDATES_SQL + TOKENS_SQL + " SELECT * FROM outcomes")
def token_start_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return jobs.start_outcomes(updates(spark, d), tokens(spark, d)).drop("at")


@query(
    UPDATES_SQL + TOKENS_SQL
    + """ SELECT id, coalesce(o.chat_id, u.chat_id) AS chat_id, coalesce(o.at_, u.connected_at) AS connected_at FROM users u
    LEFT JOIN (SELECT user_id, chat_id, at_ FROM outcomes JOIN (SELECT update_id, at_ FROM updates) USING (update_id) WHERE outcome = 'LINKED' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_ DESC, update_id DESC) = 1) o ON u.id = o.user_id"""
)
def chats_connected(spark: SparkSession, d: str) -> DataFrame:
    return accounts.connect_chats(views.users(spark, d), jobs.link_tokens(updates(spark, d), tokens(spark, d))).select("id", "chat_id", "connected_at")


@query(
    """, gone AS (SELECT id FROM purchases WHERE id % 3 = 0 AND user_id <= 5)
    SELECT (SELECT count(*) FROM purchases WHERE id NOT IN (SELECT id FROM gone)) AS n_purchases, (SELECT count(*) FROM purchase_items WHERE purchase_id NOT IN (SELECT id FROM gone)) AS n_items,
    (SELECT count(*) FROM purchases WHERE id NOT IN (SELECT id FROM gone)) AS n_linked"""
)
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    bought = views.purchases(spark, d)
    links = bought.select(F.col("id").alias("receipt_id"), F.col("id").alias("purchase_id"))
    asked = bought.filter("id % 3 = 0").select("id", F.least("user_id", F.lit(5)).alias("user_id"))  # not all are the owner's
    left, items, linked = buying.delete(bought, views.purchase_items(spark, d), links, asked)
    a, b, c = left.agg(F.count("*").alias("n_purchases")), items.agg(F.count("*").alias("n_items")), linked.agg(F.count("purchase_id").alias("n_linked"))
    return a.crossJoin(b).crossJoin(c)


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_owner_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers who never ordered urgently."""
    urgent = views.read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return without(views.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), urgent, "id")


@query(
    """SELECT id AS job_id, 'reports/' || user_id || '/' || replace(lower(report_type), '_', '-') || '/' || printf('%d-%02d', year, month) || '-csv' AS key_start,
    replace(lower(report_type), '_', '-') || '-' || printf('%d-%02d', year, month) || '.csv' AS download_name FROM report_jobs"""
)
def key_and_slug_names(spark: SparkSession, d: str) -> DataFrame:
    kind, period = scalars.slug(F.col("report_type")), F.format_string("%d-%02d", "year", "month")
    return views.report_jobs(spark, d).select(F.col("id").alias("job_id"), F.concat(F.lit("reports/"), "user_id", F.lit("/"), kind, F.lit("/"), period, F.lit("-csv")).alias("key_start"), F.concat(kind, F.lit("-"), period, F.lit(".csv")).alias("download_name"))


CENTS = "CAST(CAST({} AS DECIMAL(19,2)) * 0.01 AS DECIMAL(19,2))"
RECEIPTS_SQL = " SELECT o_orderkey AS receipt_id, 'MARKET ' || CASE o_orderkey % 4 WHEN 0 THEN 'NORTH' WHEN 1 THEN 'SOUTH' WHEN 2 THEN 'EAST' ELSE 'WEST' END AS store_name, " + CENTS.format("o_totalprice") + " AS total_amount, CAST(o_orderdate AS DATE) AS purchase_date FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"


@query(RECEIPTS_SQL)
def receipt_header_parse(spark: SparkSession, d: str) -> DataFrame:
    return receipts.headers(views.receipt_texts(spark, d))


@query(
    " SELECT l_orderkey AS receipt_id, CAST(line_index + 1 AS INTEGER) AS line_index, upper(p_name) AS title, CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(19,3)) AS quantity, CAST(NULL AS VARCHAR) AS unit, "
    + CENTS.format("p_retailprice") + " AS unit_price, " + CENTS.format("l_extendedprice") + " AS line_total FROM numbered JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"
)
def receipt_line_items(spark: SparkSession, d: str) -> DataFrame:
    return receipts.items(views.receipt_texts(spark, d)).drop("raw_fragment")


@query()
def receipt_documents_parse(spark: SparkSession, d: str) -> DataFrame:
    return receipts.headers(views.read(spark, d, "documents").select(F.col("doc_id").alias("receipt_id"), F.col("text").alias("raw_text")))


@query(
    ", h AS (" + RECEIPTS_SQL + """), t AS (SELECT l_orderkey, upper(p_name) AS title FROM numbered JOIN part ON l_partkey = p_partkey WHERE line_index = 0)
    SELECT receipt_id, p.user_id, t.title, p.category, total_amount AS amount, p.currency, h.purchase_date, h.store_name FROM h JOIN purchases p ON p.id = receipt_id JOIN t ON t.l_orderkey = receipt_id WHERE receipt_id % 4 NOT IN (0, 1)"""
)
def receipt_to_purchase(spark: SparkSession, d: str) -> DataFrame:
    texts = views.receipt_texts(spark, d)
    key = F.col("id")
    uploaded = views.purchases(spark, d).select(
        key.alias("receipt_id"),
        "user_id",
        F.when(key % 4 == 0, key).alias("purchase_id"),
        F.when(key % 4 != 1, F.lower("category")).otherwise("  ").alias("category"),
        "currency",
        F.lit("scan.png").alias("original_file_name"),
        F.col("created_at").alias("uploaded_at"),
    )
    return receipts.to_purchases(uploaded, receipts.headers(texts), receipts.items(texts))


@query(
    """, t AS (SELECT o_orderkey AS id, CAST(strftime(o_orderdate, '%d.%m') AS DECIMAL(19,2)) AS day_month, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    m AS (SELECT l_orderkey AS id, max(greatest(CAST(CAST(l_extendedprice AS DECIMAL(19,2)) * 0.01 AS DECIMAL(19,2)), CAST(CAST(p_retailprice AS DECIMAL(19,2)) * 0.01 AS DECIMAL(19,2)))) AS most FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
    SELECT id AS receipt_id, CASE WHEN id % 2 = 0 THEN greatest(most, day_month) ELSE most END AS amount, CASE WHEN id % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2024-02-29' END AS purchase_date FROM t JOIN m USING (id)"""
)
def receipts_without_totals(spark: SparkSession, d: str) -> DataFrame:
    """Without a total line the largest amount counts, to which a date's day and month belong; without a date the day of upload does."""
    key = F.col("receipt_id")
    bare = F.regexp_replace("raw_text", r"\nTOTAL [^\n]*", "")
    texts = views.receipt_texts(spark, d).withColumn("raw_text", F.when(key % 2 == 0, bare).otherwise(F.regexp_replace(bare, r"\nDATE [^\n]*", "")))
    uploaded = texts.select("receipt_id", F.lit(1).alias("user_id"), F.lit(None).cast("long").alias("purchase_id"), F.lit("food").alias("category"), F.lit("UAH").alias("currency"), F.lit("scan.png").alias("original_file_name"), F.expr("timestamp_ntz'2024-02-29 23:59:59'").alias("uploaded_at"))
    return receipts.to_purchases(uploaded, receipts.headers(texts), receipts.items(texts)).select("receipt_id", "amount", "purchase_date")


def finished_jobs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("id")
    status = F.element_at(F.lit(["DONE", "FAILED", "NEW"]), (key % 3 + 1).cast("int"))
    return views.report_jobs(spark, d).select("id", "year", "month", "report_type", "report_format", status.alias("status"), F.when(key % 2 == 0, F.concat(F.lit("reports/"), key)).alias("s3_key"), F.when(key % 6 == 1, "no data").alias("error_message"))


FINISHED_SQL = ", finished AS (SELECT id, year, month, report_type, report_format, CASE id % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'FAILED' ELSE 'NEW' END AS status, CASE WHEN id % 2 = 0 THEN 'reports/' || id END AS s3_key, CASE WHEN id % 6 = 1 THEN 'no data' END AS error_message FROM report_jobs)"


@query(
    FINISHED_SQL
    + """ SELECT id, status = 'DONE' AND s3_key IS NOT NULL AS ready, CASE WHEN status = 'FAILED' THEN coalesce(error_message, 'Report generation failed') END AS error,
    CASE WHEN status = 'DONE' AND s3_key IS NOT NULL THEN TIMESTAMP '2024-01-01 00:15:00' END AS expires_at FROM finished"""
)
def job_download_contract(spark: SparkSession, d: str) -> DataFrame:
    return notices.download_contract(finished_jobs(spark, d), F.expr("timestamp_ntz'2024-01-01'")).select("id", "ready", "error", "expires_at")


@query(
    FINISHED_SQL
    + """, n AS (SELECT id, status, report_format AS f, replace(lower(report_type), '_', ' ') AS t, printf('%04d-%02d', year, month) AS p FROM finished WHERE status <> 'NEW')
    SELECT id, upper(t[1]) || substr(t, 2) || ' ' || f || ' report for ' || p || CASE status WHEN 'DONE' THEN ' is ready' ELSE ' failed' END AS subject,
    CASE status WHEN 'DONE' THEN 'Your ' || t || ' report in ' || f || ' format for ' || p || ' is ready.' || chr(10) || 'Report job id: ' || id || chr(10)
        || 'The report file is attached or delivered directly in your selected channel.' || chr(10) || 'You can also download it via GET /api/reports/' || id || '/download after authenticating.'
    ELSE t || ' report generation in ' || f || ' format for ' || p || ' failed.' || chr(10) || 'Report job id: ' || id || chr(10) || 'Check GET /api/reports/' || id || ' for the current status and error details.' END AS body FROM n"""
)
def notification_texts(spark: SparkSession, d: str) -> DataFrame:
    return notices.notification(finished_jobs(spark, d).filter("status <> 'NEW'")).select("id", "subject", "body")


@query(
    """SELECT o_orderkey AS receipt_id, coalesce(n, 0) AS line_count, CASE WHEN o_orderkey % 2 = 0 THEN p.category WHEN o_orderkey % 3 = 0 THEN 'FOOD' END AS category
    FROM orders JOIN purchases p ON p.id = o_orderkey LEFT JOIN (SELECT purchase_id, count(*) AS n FROM purchase_items GROUP BY purchase_id) i ON i.purchase_id = o_orderkey"""
)
def receipt_summaries(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    scans = views.read(spark, d, "orders").select(key.alias("receipt_id"), F.when(key % 2 == 0, key).alias("purchase_id"), F.when(key % 3 == 0, " food ").otherwise(" ").alias("category"))
    lines = views.purchase_items(spark, d).select(F.col("purchase_id").alias("receipt_id"))
    return notices.receipt_summaries(scans, lines, views.purchases(spark, d)).select("receipt_id", "line_count", "category")


@query(
    """, u AS (SELECT id, coalesce(trim(chat_id) <> '' AND connected_at IS NOT NULL, FALSE) AS connected, connected_at FROM users)
    SELECT id, connected, connected_at, CASE WHEN NOT connected AND id % 2 = 0 THEN 'https://t.me/tally_bot?start=tok-' || id || '-2' END AS link,
    CASE WHEN NOT connected AND id % 2 = 0 THEN 'tok-' || id || '-2' END AS token, CASE WHEN NOT connected AND id % 2 = 0 THEN TIMESTAMP '2024-03-01' END AS expires_at FROM u"""
)
def connection_status(spark: SparkSession, d: str) -> DataFrame:
    users = views.users(spark, d)
    at = lambda t: F.expr(f"timestamp_ntz'{t}'")
    made = users.filter("id % 2 = 0").select(F.col("id").alias("user_id"), F.explode(F.lit([1, 2, 3])).alias("k"))
    tokens = made.select(
        "user_id",
        F.format_string("tok-%d-%d", "user_id", "k").alias("token"),
        F.when(F.col("k") == 3, at("2024-01-01")).otherwise(at("2024-03-01")).alias("expires_at"),
        F.expr("cast(null as timestamp_ntz)").alias("used_at"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(k as int))").alias("created_at"),
        at("2024-02-01").alias("now"),
    )
    return notices.connection_status(users, jobs.pending_tokens(tokens), "tally_bot")


#: Expressions of a whole number (q), and their values in SQL; null where there is none. Quarters have no rounding of their own.
EXPRESSIONS = (
    ("(q + 0) * 6 / 2 + 1.5", "q * 3 + 1.5"), ("q**2", "q * q"), ("2**3**2 + q", "512 + q"), ("q--1", None), ("0q+1", None), ("-q**2", None), ("(-q)**2", "q * q"), ("q - -1", None), ("q+-1", "q - 1"),
    ("q/0", None), ("1/(q/0)", "0"), ("q/*two*/", None), ("q/*2*/+1", "q + 1"), ("q//1", None), ("(q)(2)", None), (".25*q", "q * 0.25"), ("q.*2", "q * 2"), ("q.5.5", None), ("", None), ("()", None), ("((q)", None),
    ("q*10**20*10", "q * 1e21"), ("1.005 + 0*q", "1"), ("2*-q", "-2 * q"), ("8/4/2-q", "1 - q"), ("q e", None),
)


@query(
    f", e AS (SELECT l_orderkey AS id, line_index, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS q, l_partkey % {len(EXPRESSIONS)} AS k FROM numbered) SELECT id, line_index, CAST(CASE k "
    + " ".join(f"WHEN {k} THEN {value or 'NULL'}" for k, (_, value) in enumerate(EXPRESSIONS)) + " END AS DOUBLE) AS value FROM e"
)
def calculated_amounts(spark: SparkSession, d: str) -> DataFrame:
    lines = views.read(spark, d, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy(*lines.columns)
    shape = F.element_at(F.lit([text for text, _ in EXPRESSIONS]), (F.col("l_partkey") % len(EXPRESSIONS) + 1).cast("int"))
    typed = F.replace(shape, F.lit("q"), F.col("l_quantity").cast("int").cast("string"))
    return lines.select(F.col("l_orderkey").alias("id"), (F.row_number().over(place) - 1).cast("int").alias("line_index"), calculate(typed).alias("value"))


# --- requests, statuses and accounts


@query("SELECT id, title, amount FROM purchases WHERE id = 33 AND user_id = (SELECT user_id FROM purchases WHERE id = 33)")
def purchase_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The owner finds purchase 33, all others find nothing."""
    rows = views.purchases(spark, d)
    found = [lifecycle.find(rows, 33, user).select("id", "title", "amount") for user in range(25)]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


REQUESTS = """, requests AS (SELECT id, user_id, CASE WHEN id % 11 = 0 THEN '  ' ELSE '  ' || title || ' ' END AS title, CASE WHEN id % 13 = 0 THEN NULL ELSE lower(category) END AS category,
    CASE WHEN id % 5 = 0 THEN 0.00 WHEN id % 23 <> 0 THEN amount END AS amount, CASE WHEN id % 17 = 0 THEN 'GBP' ELSE currency END AS currency, purchase_date, id % 3 AS n FROM purchases)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of purchases with none to two items, of which some are broken."""
    key = F.col("id")
    item = lambda k: F.struct(F.when(key % 19 != k, F.lit(f" item {k} ")).alias("title"), (key % 4).cast("decimal(19,3)").alias("quantity"), F.lit("pcs").alias("unit"), F.lit(1.25).cast("decimal(19,2)").alias("unit_price"), F.lit(None).cast("decimal(19,2)").alias("line_total"))
    return views.purchases(spark, d).select(
        "id", "user_id", F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit("  "), "title", F.lit(" "))).alias("title"), F.when(key % 13 != 0, F.lower("category")).alias("category"),
        F.when(key % 5 == 0, 0).when(key % 23 != 0, F.col("amount")).cast("decimal(19,2)").alias("amount"), F.when(key % 17 == 0, "GBP").otherwise(F.col("currency")).alias("currency"), "purchase_date",
        F.lit(None).cast("string").alias("store_name"), F.lit("").alias("comment"), F.slice(F.array(item(0), item(1)), 1, (key % 3).cast("int")).alias("items"),
    )


ERRORS_SQL = """, judged AS (SELECT *, concat_ws('; ', CASE WHEN trim(title) = '' THEN 'title: must not be blank' END, CASE WHEN category IS NULL THEN 'category: must not be blank' END,
    CASE WHEN amount IS NULL THEN 'amount: must not be null' END, CASE WHEN amount <= 0 THEN 'amount: must be greater than 0' END, CASE WHEN currency = 'GBP' THEN 'currency: must not be null' END,
    CASE WHEN n > 0 AND id % 19 = 0 THEN 'items[0].title: must not be blank' END, CASE WHEN n > 0 AND id % 4 = 0 THEN 'items[0].quantity: must be greater than 0' END,
    CASE WHEN n > 1 AND id % 19 = 1 THEN 'items[1].title: must not be blank' END, CASE WHEN n > 1 AND id % 4 = 0 THEN 'items[1].quantity: must be greater than 0' END) AS errors FROM requests)"""


@query(REQUESTS + ERRORS_SQL + " SELECT id, errors FROM judged WHERE errors <> ''")
def purchase_requests_refused(spark: SparkSession, d: str) -> DataFrame:
    return buying.created(requests(spark, d), F.expr("timestamp_ntz'2024-01-01'"))[2].select("id", "errors")


@query(
    REQUESTS
    + ERRORS_SQL
    + """ SELECT id, trim(title) AS title, upper(category) AS category, CAST(CASE WHEN n > 0 THEN n * (id % 4) * 1.25 ELSE amount END AS DECIMAL(19,2)) AS amount, CAST(n AS BIGINT) AS n_items,
    CASE n WHEN 0 THEN '' WHEN 1 THEN '0:item 0' ELSE '0:item 0,1:item 1' END AS items FROM judged WHERE errors = ''"""
)
def purchases_created(spark: SparkSession, d: str) -> DataFrame:
    bought, items, _ = buying.created(requests(spark, d), F.expr("timestamp_ntz'2024-01-01'"))
    shown = items.groupBy("purchase_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.col("line_index").cast("string"), F.lit(":"), F.col("title")))), ",").alias("shown"))
    return bought.join(shown, F.col("id") == F.col("purchase_id"), "left").select("id", "title", "category", "amount", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("shown", F.lit("")).alias("items"))


def scans(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    empty = {"raw_ocr_text": "string", "parsed_store_name": "string", "parsed_total_amount": "decimal(19,2)", "parsed_purchase_date": "date"}
    return views.read(spark, d, "orders").select(
        key.alias("id"), (key % 25).cast("long").alias("user_id"), F.when(key % 4 == 0, key).alias("purchase_id"), F.col("o_orderdate").alias("uploaded_at"), F.lit("NEW").alias("ocr_status"),
        *(F.lit(None).cast(kind).alias(c) for c, kind in empty.items()), F.lit("old").alias("ocr_error_message"), F.lit(None).cast("timestamp_ntz").alias("ocr_processed_at"),
    )


def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line each that was read before."""
    nothing = {"quantity": "decimal(19,3)", "unit": "string", "unit_price": "decimal(19,2)"}
    return views.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("receipt_id"), F.lit(9).alias("line_index"), F.lit("old line").alias("title"), *(F.lit(None).cast(k).alias(c) for c, k in nothing.items()), F.lit(1).cast("decimal(19,2)").alias("line_total"), F.lit("old line 1.00").alias("raw_fragment")
    )


def scan_results(spark: SparkSession, d: str) -> DataFrame:
    """Texts of most receipts; some are blank, some failed, and as many again belong to receipts that are gone."""
    key = F.col("receipt_id")
    texts = views.receipt_texts(spark, d).filter("receipt_id % 7 <> 0")
    own = texts.select("receipt_id", F.when(key % 5 == 0, " \n ").otherwise(F.when(key % 5 != 1, F.col("raw_text"))).alias("raw_text"), F.when(key % 5 == 1, "no engine").alias("error"))
    return own.unionByName(own.withColumn("receipt_id", -key))


WRITTEN_SQL = """, r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) OR o_orderkey % 7 = 0 THEN 'NEW' WHEN o_orderkey % 5 IN (0, 1) THEN 'FAILED' ELSE 'DONE' END AS ocr_status, * FROM orders)"""


@query(
    WRITTEN_SQL
    + f""" SELECT id, ocr_status, CASE ocr_status WHEN 'DONE' THEN 'MARKET ' || CASE id % 4 WHEN 0 THEN 'NORTH' WHEN 1 THEN 'SOUTH' WHEN 2 THEN 'EAST' ELSE 'WEST' END END AS store_name,
    CASE ocr_status WHEN 'DONE' THEN {CENTS.format("o_totalprice")} END AS total_amount, CASE ocr_status WHEN 'DONE' THEN CAST(o_orderdate AS DATE) END AS purchase_date,
    CASE ocr_status WHEN 'NEW' THEN 'old' WHEN 'FAILED' THEN CASE id % 5 WHEN 0 THEN 'OCR returned empty text' ELSE 'no engine' END END AS error, ocr_status <> 'NEW' AS processed FROM r"""
)
def receipt_writeback(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = lifecycle.write_back(scans(spark, d), scan_lines(spark, d), scan_results(spark, d), F.expr("timestamp_ntz'2024-01-01'"))
    return rows.select("id", "ocr_status", F.col("parsed_store_name").alias("store_name"), F.col("parsed_total_amount").alias("total_amount"), F.col("parsed_purchase_date").alias("purchase_date"), F.col("ocr_error_message").alias("error"), F.col("ocr_processed_at").isNotNull().alias("processed"))


@query(
    WRITTEN_SQL
    + """ SELECT id AS receipt_id, ocr_status, CASE ocr_status WHEN 'NEW' THEN 1 WHEN 'DONE' THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = id) ELSE 0 END AS n_lines FROM r"""
)
def receipt_lines_replaced(spark: SparkSession, d: str) -> DataFrame:
    rows, lines = lifecycle.write_back(scans(spark, d), scan_lines(spark, d), scan_results(spark, d), F.expr("timestamp_ntz'2024-01-01'"))
    counts = lines.groupBy("receipt_id").agg(F.count("*").alias("n_lines"))
    return rows.select(F.col("id").alias("receipt_id"), "ocr_status").join(counts, "receipt_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


@query(
    """, s AS (SELECT o_orderkey AS id, o_orderkey % 25 AS user_id, o_orderdate AS uploaded_at FROM orders WHERE o_orderkey % 25 = 3)
    SELECT s.id, CAST(row_number() OVER (ORDER BY uploaded_at DESC, s.id DESC) AS INTEGER) AS place, email AS owner_email, p.title AS purchase_title, CAST(coalesce(n, 0) AS BIGINT) AS n_lines
    FROM s JOIN users u ON u.id = s.user_id LEFT JOIN purchases p ON p.id = s.id AND s.id % 4 = 0 LEFT JOIN (SELECT purchase_id, count(*) AS n FROM purchase_items GROUP BY purchase_id) i ON i.purchase_id = s.id"""
)
def receipt_listing(spark: SparkSession, d: str) -> DataFrame:
    lines = views.purchase_items(spark, d).select(F.col("purchase_id").alias("receipt_id"), "line_index", F.col("line_index").cast("long").alias("id"), "title", "quantity", "unit", "unit_price", "line_total")
    found = lifecycle.newest(lifecycle.graph(scans(spark, d), views.users(spark, d), views.purchases(spark, d), lines), 3, "uploaded_at")
    place = F.row_number().over(Window.orderBy(F.desc("uploaded_at"), F.desc("id")))
    return found.select("id", place.alias("place"), "owner_email", "purchase_title", F.size("lines").cast("long").alias("n_lines"))


JOBS_SQL = """, e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) AS k FROM job_events),
    last AS (SELECT job_id AS id, status, event_id FROM e WHERE k = 1), j AS (SELECT DISTINCT job_id AS id FROM job_events WHERE job_id % 3 <> 0)"""


def some_jobs(events: DataFrame) -> DataFrame:
    """A job of each user of the events but every third, with a file and an error from before."""
    ids = events.select(F.col("job_id").alias("id")).distinct().filter("id % 3 <> 0")
    return ids.select("id", F.lit("NEW").alias("status"), F.lit("old key").alias("s3_key"), F.lit("old error").alias("error_message"), F.expr("timestamp_ntz'2000-01-01'").alias("updated_at"))


def job_changes(spark: SparkSession, d: str) -> DataFrame:
    return views.job_events(spark, d).withColumns({"s3_key": F.concat(F.lit("k"), "event_id"), "error": F.concat(F.lit("e"), "event_id")})


@query(
    JOBS_SQL
    + """ SELECT j.id, status, CASE status WHEN 'DONE' THEN 'k' || event_id END AS s3_key, CASE status WHEN 'FAILED' THEN 'e' || event_id END AS error_message FROM j JOIN last ON j.id = last.id"""
)
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    events = job_changes(spark, d)
    return lifecycle.transitions(some_jobs(events), events)[0].select("id", "status", "s3_key", "error_message")


@query(JOBS_SQL + " SELECT event_id, job_id FROM job_events WHERE job_id NOT IN (SELECT id FROM j)")
def job_orphan_events(spark: SparkSession, d: str) -> DataFrame:
    events = job_changes(spark, d)
    return lifecycle.transitions(some_jobs(events), events)[1].select("event_id", "job_id")


@query(
    """ SELECT id AS job_id, '{"reportJobId":' || id || ',"userId":' || user_id || ',"year":' || year || ',"month":' || month || ',"reportType":"' || report_type || '","reportFormat":"' || report_format || '"}' AS value
    FROM report_jobs WHERE id % 2 = 0"""
)
def job_messages(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.messages(views.report_jobs(spark, d).withColumn("status", F.when(F.col("id") % 2 == 0, "NEW").otherwise("DONE")))


@query(
    """, t AS (SELECT j.id AS job_id, u.id AS user_id, u.preferred_channel AS p, coalesce(trim(chat_id) <> '' AND connected_at IS NOT NULL, FALSE) AS c, (j.id % 2) = 0 AS email_ok, (j.id % 3) = 0 AS chat_ok FROM report_jobs j JOIN users u ON u.id = j.user_id),
    o AS (SELECT *, CASE WHEN p = 'TELEGRAM' AND c THEN 1 WHEN c THEN 2 ELSE 0 END AS chat_place, CASE WHEN p = 'TELEGRAM' AND c THEN 2 ELSE 1 END AS email_place FROM t),
    w AS (SELECT *, CASE WHEN chat_place > 0 AND chat_ok AND (NOT email_ok OR chat_place < email_place) THEN 'TELEGRAM' WHEN email_ok THEN 'EMAIL' END AS channel FROM o)
    SELECT job_id, channel, CAST(CASE channel WHEN 'EMAIL' THEN email_place WHEN 'TELEGRAM' THEN chat_place ELSE CASE WHEN chat_place > 0 THEN 2 ELSE 1 END END AS BIGINT) AS n_tries,
    CASE WHEN channel IS NULL THEN CASE WHEN chat_place = 2 THEN 'TELEGRAM is down' ELSE 'EMAIL is down' END END AS error FROM w"""
)
def delivery_outcomes(spark: SparkSession, d: str) -> DataFrame:
    people = views.users(spark, d)
    plan = dashboard.delivery_plan(people).select(F.col("id").alias("user_id"), F.filter(F.split("channel_order", ","), lambda c: (c == "EMAIL") | F.col("connected")).alias("channels"))
    todo = views.report_jobs(spark, d).join(plan, "user_id").select(F.col("id").alias("job_id"), "channels")
    ok = F.when(F.col("channel") == "EMAIL", F.col("job_id") % 2 == 0).otherwise(F.col("job_id") % 3 == 0)
    tries = todo.select("job_id", F.explode("channels").alias("channel")).withColumn("ok", ok).withColumn("error", F.when(~ok, F.concat("channel", F.lit(" is down"))))
    return lifecycle.delivered(todo, tries)


@query("SELECT CAST(max(event_id) AS BIGINT) AS last_update_id, CAST(max(event_id) + 1 AS BIGINT) AS next_offset FROM events")
def polling_offset(spark: SparkSession, d: str) -> DataFrame:
    state = spark.range(1).select(F.lit(-1).cast("long").alias("last_update_id"))
    found = lifecycle.polling_state(state, views.read(spark, d, "events").select(F.col("event_id").cast("long").alias("update_id")))
    return found.select(F.col("last_update_id").cast("long").alias("last_update_id"), F.col("next_offset").cast("long").alias("next_offset"))


@query(JOBS_SQL + " SELECT id AS user_id, status IN ('NEW', 'PROCESSING') AS under_way FROM last")
def refresh_needed(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.any_under_way(jobs.latest_status(views.job_events(spark, d)).withColumnRenamed("job_id", "user_id"))


@query(
    r""", r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 4 = 0 THEN upper(n_name) || '@Example.org' ELSE 'new' || (c_custkey // 3) || '@example.org' END AS raw,
        CASE c_custkey % 7 WHEN 0 THEN '        ' WHEN 1 THEN 'short' ELSE 'long enough' END AS password FROM customer JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT *, lower(trim(raw)) AS key, nullif(concat_ws('; ', CASE WHEN trim(raw) = '' THEN 'email: must not be blank' END,
        CASE WHEN raw <> '' AND NOT regexp_matches(raw, '^[^\s@]+@[^\s@]+$') THEN 'email: must be a well-formed email address' END, CASE WHEN trim(password) = '' THEN 'password: must not be blank' END,
        CASE WHEN length(password) < 8 THEN 'password: size must be between 8 and 255' END), '') AS errors FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY key, errors IS NULL ORDER BY request_id) AS k, key IN (SELECT email FROM users) AS taken FROM e),
    j AS (SELECT *, coalesce(errors, CASE WHEN taken OR k > 1 THEN 'User with email already exists' END) AS error FROM k)
    SELECT request_id, CASE WHEN error IS NULL THEN key ELSE raw END AS email, CASE WHEN error IS NULL THEN CASE key WHEN 'new1@example.org' THEN 'ADMIN' ELSE 'USER' END END AS role, error FROM j"""
)
def users_registered(spark: SparkSession, d: str) -> DataFrame:
    people = views.read(spark, d, "customer").join(views.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    new = F.concat(F.lit("new"), F.floor(key / 3).cast("string"), F.lit("@example.org"))
    email = F.when(key % 11 == 0, "  ").when(key % 13 == 0, "").when(key % 4 == 0, F.concat(F.upper("n_name"), F.lit("@Example.org"))).otherwise(new)
    password = F.when(key % 7 == 0, " " * 8).when(key % 7 == 1, "short").otherwise("long enough")
    asked = people.select(key.alias("request_id"), email.alias("email"), password.alias("password"), F.lit("x").alias("password_hash"))
    made, refused = accounts.register(views.users(spark, d), asked, ["  NEW1@Example.org "], F.expr("timestamp_ntz'2024-01-01'"))
    return made.select("request_id", "email", "role", F.lit(None).cast("string").alias("error")).unionByName(refused.select("request_id", "email", F.lit(None).cast("string").alias("role"), "error"))


@query(
    """SELECT id, coalesce(google_subject, CASE WHEN id % 5 = 0 THEN 'sub-b' || id END) AS google_subject,
        CASE WHEN id % 4 <> 1 THEN 'USER' WHEN id % 5 = 0 THEN CASE WHEN id % 10 = 5 THEN 'ADMIN' ELSE 'USER' END END AS role FROM users
    UNION ALL SELECT NULL, 'sub-x' || id, 'USER' FROM users WHERE id % 5 = 1"""
)
def accounts_linked(spark: SparkSession, d: str) -> DataFrame:
    """Two logins each, of which the later has the lesser subject; every fourth user has no role yet."""
    key, at = F.col("id"), lambda t: F.expr(f"timestamp_ntz'{t}'").alias("at")
    people = views.users(spark, d).withColumn("role", F.when(key % 4 != 1, "USER"))
    own = people.filter("id % 5 = 0")
    later = own.select(F.upper("email").alias("email"), F.concat(F.lit("sub-a"), "id").alias("subject"), at("2024-02-02"))
    first = own.select("email", F.concat(F.lit("sub-b"), "id").alias("subject"), at("2024-02-01"))
    other = people.filter("id % 5 = 1").select(F.concat(F.lit("x"), "email").alias("email"), F.concat(F.lit("sub-x"), "id").alias("subject"), at("2024-02-01"))
    admins = [f" {r.email.upper()}" for r in people.filter("id % 10 = 5").select("email").collect()]  # a configured list, five names
    linked, new = accounts.linked_accounts(people, later.unionByName(first).unionByName(other), admins, F.expr("timestamp_ntz'2024-03-01'"))
    return linked.select("id", "google_subject", "role").unionByName(new.select(F.lit(None).cast("long").alias("id"), "google_subject", "role"))


@query(
    """SELECT id, CASE WHEN id % 2 = 1 AND (id % 3 = 0 OR coalesce(trim(chat_id) <> '' AND connected_at IS NOT NULL, FALSE)) THEN CASE WHEN id % 3 = 0 THEN 'EMAIL' ELSE 'TELEGRAM' END ELSE preferred_channel END AS preferred_channel,
    id % 2 = 1 AND id % 3 <> 0 AND NOT coalesce(trim(chat_id) <> '' AND connected_at IS NOT NULL, FALSE) AS refused FROM users"""
)
def channel_preferences(spark: SparkSession, d: str) -> DataFrame:
    people = views.users(spark, d)
    asked = people.filter("id % 2 = 1").select("id", F.when(F.col("id") % 3 == 0, "EMAIL").otherwise("TELEGRAM").alias("channel"))
    changed, refused = accounts.preferences(people, asked)
    return changed.join(refused.select("id", F.lit(True).alias("refused")), "id", "left").select("id", "preferred_channel", F.coalesce("refused", F.lit(False)).alias("refused"))


@query(
    """SELECT 'users' AS table_name, count(*) AS n_rows FROM users WHERE id % 6 <> 0 UNION ALL SELECT 'purchases', count(*) FROM purchases WHERE user_id % 6 <> 0
    UNION ALL SELECT 'items', count(*) FROM purchase_items i WHERE i.purchase_id NOT IN (SELECT id FROM purchases WHERE user_id % 6 = 0) UNION ALL SELECT 'jobs', count(*) FROM report_jobs WHERE user_id % 6 <> 0"""
)
def user_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    people = views.users(spark, d)
    left = accounts.remove_users(people.filter("id % 6 = 0"), people, views.purchases(spark, d), views.purchase_items(spark, d), jobs=views.report_jobs(spark, d))
    return dashboard.table_counts(**left)


@query(
    """SELECT id, concat_ws('; ', CASE WHEN y IS NULL THEN 'year: must not be null' END, CASE WHEN y < 2000 THEN 'year: must be greater than or equal to 2000' END, CASE WHEN y > 9999 THEN 'year: must be less than or equal to 9999' END,
    CASE WHEN m IS NULL THEN 'month: must not be null' END, CASE WHEN m < 1 THEN 'month: must be greater than or equal to 1' END, CASE WHEN m > 12 THEN 'month: must be less than or equal to 12' END, CASE WHEN id % 7 = 0 THEN 'reportType: must not be null' END,
    CASE WHEN id % 9 = 0 THEN 'reportFormat: must not be null' END) AS errors FROM (SELECT id, CASE WHEN id % 11 <> 0 THEN 1990 + id % 30 * 400 END AS y, CASE WHEN id % 13 <> 0 THEN id % 15 END AS m FROM report_jobs)"""
)
def report_requests_checked(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("id")
    asked = views.report_jobs(spark, d).select("id", F.when(key % 11 != 0, 1990 + key % 30 * 400).alias("year"), F.when(key % 13 != 0, key % 15).alias("month"), F.when(key % 7 != 0, F.col("report_type")).alias("report_type"), F.when(key % 9 == 0, "DOC").otherwise(F.col("report_format")).alias("report_format"))
    return accounts.report_errors(asked).select("id", F.coalesce("errors", F.lit("")).alias("errors"))


@query(
    """, s AS (SELECT user_id, currency, sum(amount) AS t FROM purchases GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (user_id % 2 = 0 AND currency = 'EUR') DESC, t DESC, currency) AS k FROM s)
    SELECT p.user_id, p.currency, count(*) AS n, CAST(sum(amount) AS DECIMAL(19,2)) AS total FROM purchases p JOIN r ON r.k = 1 AND r.user_id = p.user_id AND r.currency = p.currency GROUP BY ALL"""
)
def dashboard_selected_currency(spark: SparkSession, d: str) -> DataFrame:
    wanted = views.users(spark, d).select(F.col("id").alias("user_id"), F.when(F.col("id") % 2 == 0, "EUR").otherwise("XXX").alias("currency"))
    chosen = dashboard.selected(views.purchases(spark, d), wanted)
    return chosen.groupBy("user_id", "currency").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(19,2)").alias("total"))


@query(
    """, typed AS (SELECT purchase_id, title, CASE WHEN line_index % 4 = 0 THEN NULL WHEN line_index % 4 = 1 THEN 0 ELSE 2 END AS q, unit_price AS u, CASE WHEN line_index % 3 = 0 THEN line_total END AS l FROM purchase_items)
    SELECT purchase_id, CAST(sum(CASE WHEN l > 0 THEN l WHEN q > 0 THEN CAST(q * u AS DECIMAL(19,2)) ELSE 0 END) AS DECIMAL(19,2)) AS total FROM typed GROUP BY purchase_id"""
)
def item_drafts_total(spark: SparkSession, d: str) -> DataFrame:
    index = F.col("line_index")
    typed = views.purchase_items(spark, d).select(
        "purchase_id", "title", "unit", F.when(index % 4 == 0, "").when(index % 4 == 1, "0").otherwise("2").alias("quantity"), F.col("unit_price").cast("string").alias("unit_price"), F.when(index % 3 == 0, F.col("line_total").cast("string")).otherwise("two").alias("line_total")
    )
    return buying.drafts_total(buying.drafted(typed))


@query(
    """SELECT id, CASE category WHEN 'BUILDING' THEN 'Building' WHEN 'AUTOMOBILE' THEN 'Automobile' WHEN 'MACHINERY' THEN 'Machinery' WHEN 'HOUSEHOLD' THEN 'Household' WHEN 'FURNITURE' THEN 'Furniture' END AS label,
    CASE WHEN id % 2 = 0 THEN 'Food' ELSE 'Eating Out' END AS other FROM purchases"""
)
def category_labels(spark: SparkSession, d: str) -> DataFrame:
    return views.purchases(spark, d).select("id", scalars.category_label(F.col("category")).alias("label"), scalars.category_label(F.when(F.col("id") % 2 == 0, " food ").otherwise("eating_OUT")).alias("other"))


@query(
    """, n AS (SELECT purchase_id, count(*) AS n FROM purchase_items GROUP BY purchase_id)
    SELECT id, CAST(least(coalesce(n, 0), 3) AS BIGINT) AS n_shown, CAST(greatest(coalesce(n, 0) - 3, 0) AS BIGINT) AS more FROM purchases LEFT JOIN n ON id = purchase_id"""
)
def purchase_previews(spark: SparkSession, d: str) -> DataFrame:
    shown = buying.preview(buying.with_items(views.purchases(spark, d), views.purchase_items(spark, d)))
    return shown.select("id", F.size("shown").cast("long").alias("n_shown"), F.col("more").cast("long").alias("more"))


# --- tables that change together, stored files, queues and streams


def scratch_tables(spark: SparkSession) -> Tables:
    return Tables(spark, scratch.folder(spark, "tables"))


@query(
    """SELECT v AS version, count(DISTINCT p.id) AS n_purchases, count(i.purchase_id) AS n_items, CAST(coalesce(sum(i.line_index), 0) AS BIGINT) AS places
    FROM (SELECT unnest([1, 2]) AS v) JOIN purchases p ON v = 1 OR p.id % 3 <> 0 LEFT JOIN purchase_items i ON i.purchase_id = p.id GROUP BY v"""
)
def purchases_committed(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with their items in one commit, then without every third: what readers of either version see of both tables."""
    held = scratch_tables(spark)
    rows, items = views.purchases(spark, d), views.purchase_items(spark, d)
    held.commit(appended={"purchases": rows.select("id", "user_id"), "items": items.join(rows.select(F.col("id").alias("purchase_id")), "purchase_id", "left_semi").select("purchase_id", "line_index")}, writer="load", number=0)
    held.commit(appended={"purchases": rows.select("id", "user_id")}, writer="load", number=0)  # once more: nothing happens
    first = held.version()
    left, fewer, _ = buying.delete(held.read("purchases"), held.read("items"), held.read("purchases").select("id").withColumnRenamed("id", "purchase_id"), held.read("purchases").filter("id % 3 = 0"))
    held.commit(replaced={"purchases": left, "items": fewer}, base=first)

    def seen(number: int, version: dict) -> DataFrame:
        bought, lines = held.read("purchases", version), held.read("items", version)
        return bought.agg(F.count("*").alias("n_purchases")).crossJoin(lines.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("line_index"), F.lit(0)).alias("places"))).select(F.lit(number).alias("version"), "*")

    return seen(1, first).unionByName(seen(2, held.version()))


@query(
    """ SELECT id AS job_id, report_format, report_format <> 'DOC' AS made, CASE report_format WHEN 'CSV' THEN bytes END AS csv_bytes FROM
    (SELECT id, CASE WHEN id % 11 = 0 THEN 'DOC' ELSE report_format END AS report_format FROM report_jobs) JOIN (SELECT job_id AS id, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM ("""
    + ORACLE_SQL["report_csv_lines"]
    + ") GROUP BY job_id) USING (id)"
)
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """All jobs' files, made on executors and stored; every eleventh job asks for a format that there is not."""
    rows = views.report_jobs(spark, d)
    asked = rows.select(F.col("id").alias("job_id"), F.when(F.col("id") % 11 == 0, "DOC").otherwise(F.col("report_format")).alias("report_format"))
    made = render.files(reports.document(rows, views.purchases(spark, d)), asked)
    held, folder = scratch_tables(spark), scratch.folder(spark, "reports")
    held.commit(appended={"files": made.withColumn("key", F.concat(F.col("job_id").cast("string"), F.lit("."), F.lower("report_format")))})
    objects.write(held.read("files").filter("error is null").select("key", "content"), folder)
    stored = objects.stored(spark, folder)
    return held.read("files").join(stored, "key", "left").select("job_id", "report_format", F.col("length").isNotNull().alias("made"), F.when(F.col("report_format") == "CSV", F.col("length")).alias("csv_bytes"))


def queued_jobs(spark: SparkSession, d: str, held: Tables, folder: str) -> None:
    """All report jobs, of which every eleventh can't be made, in a table and a queue that holds lines of no use as well; and all of them consumed, some twice."""
    rows = views.report_jobs(spark, d).drop("email").withColumn("report_format", F.when(F.col("id") % 11 == 0, "DOC").otherwise(F.col("report_format")))
    held.commit(appended={"users": views.users(spark, d), "purchases": views.purchases(spark, d)})
    outbox.create_jobs(held, rows)
    outbox.publish_pending(held, "report_jobs", f"{folder}/queue")
    again = held.read("outbox").filter("id % 2 = 0").select("value")
    gone = held.read("outbox").select(F.replace("value", F.lit('"reportJobId":'), F.lit('"reportJobId":-')).alias("value")).filter("value like '%01,%'")
    lifecycle.publish(again.unionByName(gone).unionByName(again.limit(1).select(F.lit("no message").alias("value"))), f"{folder}/queue")
    for _ in range(2):  # what was consumed is not consumed again
        consumer.consume(held, consumer.report_queue(f"{folder}/files"), f"{folder}/queue", f"{folder}/checkpoint", files=100).awaitTermination()


@query(
    """ SELECT id, CASE WHEN id % 11 = 0 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN id % 11 = 0 THEN 'no generator for format DOC' END AS error, id % 11 <> 0 AS stored, CAST(2 AS BIGINT) AS n_changes FROM report_jobs"""
)
def jobs_consumed(spark: SparkSession, d: str) -> DataFrame:
    held, folder = scratch_tables(spark), scratch.folder(spark, "jobs")
    queued_jobs(spark, d, held, folder)
    files = objects.stored(spark, f"{folder}/files").select(F.col("key").alias("s3_key"), F.lit(True).alias("stored"))
    counts = held.read("report_jobs_status").groupBy("id").agg(F.count("*").alias("n_changes"))
    last = consumer.statuses(held, "report_jobs_status").join(files, "s3_key", "left").join(counts, "id")
    return last.select("id", "status", "error", F.coalesce("stored", F.lit(False)).alias("stored"), "n_changes")


def mail(message: dict) -> None:
    if message["job_id"] % 2:
        raise ConnectionError("EMAIL is down")


def chat(message: dict) -> None:
    if message["job_id"] % 3:
        raise ConnectionError("TELEGRAM is down")


@query(
    """, t AS (SELECT j.id AS job_id, u.preferred_channel AS p, coalesce(trim(chat_id) <> '' AND connected_at IS NOT NULL, FALSE) AS c, CASE WHEN j.id % 11 = 0 THEN 'FAILED' ELSE 'DONE' END AS status FROM report_jobs j JOIN users u ON u.id = j.user_id),
    o AS (SELECT job_id, status, 'EMAIL' AS channel, CASE WHEN c AND p = 'TELEGRAM' THEN 1 ELSE 0 END AS place, job_id % 2 = 0 AS ok FROM t
        UNION ALL SELECT job_id, status, 'TELEGRAM', CASE WHEN p = 'TELEGRAM' THEN 0 ELSE 1 END, job_id % 3 = 0 FROM t WHERE c)
    SELECT job_id, status, channel, CAST(place AS INTEGER) AS place, ok, CASE WHEN NOT ok THEN channel || ' is down' END AS error FROM o
    WHERE place = 0 OR NOT EXISTS (SELECT 1 FROM o e WHERE e.job_id = o.job_id AND e.place = 0 AND e.ok)"""
)
def deliveries_logged(spark: SparkSession, d: str) -> DataFrame:
    """Finished jobs are told by channels of which some fail; a second run adds nothing."""
    held, folder = scratch_tables(spark), scratch.folder(spark, "jobs")
    queued_jobs(spark, d, held, folder)
    for _ in range(2):
        outbox.deliver(held, {"EMAIL": mail, "TELEGRAM": chat})
    return held.read("deliveries")


def as_text(content: bytes) -> str:
    if content.startswith(b"?"):
        raise ValueError("no engine")
    return content.decode()


@query(
    """, c AS (SELECT c_custkey AS id, c_custkey % 5 AS k FROM customer) SELECT id, CASE WHEN k IN (0, 1, 2) THEN 'FAILED' ELSE 'DONE' END AS status,
    CASE k WHEN 0 THEN 'no engine' WHEN 1 THEN 'OCR returned empty text' WHEN 2 THEN 'Stored file is missing' END AS error, CASE WHEN k > 2 THEN 'SHOP ' || CASE k WHEN 3 THEN 'NORD' ELSE 'WEST' END END AS store_name,
    CASE WHEN k > 2 THEN CAST(id % 90 + 10.25 AS DECIMAL(19,2)) END AS total_amount, CAST(CASE WHEN k > 2 THEN 2 ELSE 0 END AS BIGINT) AS n_lines FROM c"""
)
def receipts_consumed(spark: SparkSession, d: str) -> DataFrame:
    """A stored receipt of each customer, read by the consumer of the receipt queue; some can't be."""
    held, folder = scratch_tables(spark), scratch.folder(spark, "receipts")
    key, kind = F.col("id"), F.col("id") % 5
    rows = views.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit(1).cast("long").alias("user_id"), F.concat(F.lit("r/"), "c_custkey", F.lit(".txt")).alias("s3_key"))
    amount = (key % 90 + F.lit(10.25).cast("decimal(19,2)")).cast("decimal(19,2)").cast("string")
    text = F.concat(F.lit("SHOP "), F.when(kind == 3, "NORD").otherwise("WEST"), F.lit("\n-\nMILK 1.00\nBREAD 2 x 0.50 1.00\nTOTAL "), amount)
    files = rows.filter(kind != 2).select(F.col("s3_key").alias("key"), F.when(kind == 0, "?").when(kind == 1, " \n ").otherwise(text).cast("binary").alias("content"))
    objects.write(files, f"{folder}/files")
    outbox.create_receipts(held, rows)
    outbox.publish_pending(held, "receipts", f"{folder}/queue")
    consumer.consume(held, consumer.receipt_queue(f"{folder}/files", as_text), f"{folder}/queue", f"{folder}/checkpoint").awaitTermination()
    lines = held.read("receipt_lines").groupBy("receipt_id").agg(F.count("*").alias("n_lines"))
    parsed = held.read("receipt_results").select(F.col("receipt_id").alias("id"), "store_name", "total_amount")
    last = consumer.statuses(held, "receipts_status").join(parsed, "id", "left").join(lines.withColumnRenamed("receipt_id", "id"), "id", "left")
    return last.select("id", "status", "error", "store_name", "total_amount", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query(UPDATES_SQL + " SELECT update_id, chat_id, text, at_ AS \"at\" FROM updates")
def bot_updates_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The whole feed by a stream that is stopped after its first batch and started again, each batch kept by one commit."""
    held, folder = scratch_tables(spark), scratch.folder(spark, "feed")
    updates(spark, d).select("update_id", "chat_id", "text", F.col("at").cast("timestamp").alias("at")).orderBy("update_id").write.parquet(f"{folder}/feed")
    keep = lambda batch, number: held.commit(appended={"updates": batch}, writer="feed", number=number)
    for once in (True, False):
        source = feed.updates(spark, f"{folder}/feed", limit=2000, requests=1 if once else 500)
        started = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(**({"availableNow": True} if once else {"processingTime": "0 seconds"})).start()
        if once:
            started.awaitTermination()
        else:
            started.processAllAvailable()
            started.stop()
    return held.read("updates").select("update_id", "chat_id", "text", F.col("at").cast("timestamp_ntz").alias("at"))


@query(UPDATES_SQL + TOKENS_SQL + " SELECT * FROM outcomes WHERE user_id IS NOT NULL")
def token_outcomes_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and starts as a stream in three parts by time; the stream is started anew for each and goes on from its state."""
    folder = scratch.folder(spark, "tokens")
    stamp = {c: F.col(c).cast("timestamp") for c in ("at", "expires_at")}
    made = feed.token_events(jobs.start_tokens(updates(spark, d)), tokens(spark, d)).withColumns(stamp)
    days = ("2024-01-01", "2024-01-11", "2024-01-16", "2025-01-01")
    for first, behind in zip(days, days[1:], strict=False):
        made.filter(f"at >= timestamp'{first}' and at < timestamp'{behind}'").write.mode("append").parquet(f"{folder}/events")
        events = spark.readStream.schema(feed.TOKEN_EVENTS).parquet(f"{folder}/events")
        found = feed.token_outcomes(events).writeStream.format("parquet").option("path", f"{folder}/outcomes")
        found.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/outcomes")


@query(ORACLE_SQL["receipt_line_items"].removeprefix(VIEWS_SQL))
def receipt_items_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The table function of the parser, in SQL."""
    receipt_table.register(spark)
    found = "SELECT r.receipt_id, p.* FROM {texts} r, LATERAL parse_receipt(r.raw_text) p"
    return spark.sql(found, texts=views.receipt_texts(spark, d)).drop("raw_fragment")
