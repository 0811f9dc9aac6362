"""Domain tables of the spending engine, as views over the star-schema test tables.

The SQL text of ``VIEWS_SQL`` defines the same views for a reference database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONEY, QUANTITY = "decimal(19,2)", "decimal(19,3)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def currency_of(key: Column) -> Column:
    return F.element_at(F.lit(["UAH", "EUR", "USD", "RUB"]), (key % 4 + 1).cast("int"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    linked = key % 4 == 0
    return read(spark, sf_dir, "nation").select(
        key.alias("id"),
        F.concat(F.lower("n_name"), F.lit("@example.org")).alias("email"),
        F.when(key % 3 == 0, F.concat(F.lit("g-"), key)).alias("google_subject"),
        F.when(key % 16 == 12, "  ").when(linked, F.concat(F.lit("chat-"), key)).alias("chat_id"),
        F.when(linked & (key % 8 != 0), F.expr("timestamp_ntz'2024-02-01'")).alias("connected_at"),
        F.when(key % 2 == 0, "TELEGRAM").otherwise("EMAIL").alias("preferred_channel"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key * 7 % 25).cast("int")).alias("created_on"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        key.cast("long").alias("id"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        F.concat(F.lit("Order "), key).alias("title"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        currency_of(key).alias("currency"),
        F.col("o_orderdate").cast("date").alias("purchase_date"),
        F.when(key % 10 != 0, F.col("o_orderpriority")).alias("store_name"),
        F.when(key % 7 == 0, F.concat(F.lit('said "'), F.col("o_orderstatus"), F.lit('", ok'))).alias("comment"),
        F.col("o_orderdate").alias("created_at"),
    )


def purchase_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals, and both of quantity and price, are missing on some lines so that each rule of the amount occurs."""
    lines = read(spark, sf_dir, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy(*lines.columns)
    numbered = lines.withColumn("line_index", (F.row_number().over(place) - 1).cast("int"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    index = F.col("line_index")
    return numbered.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("long").alias("purchase_id"),
        "line_index",
        F.col("p_name").alias("title"),
        F.when(index % 5 != 4, F.col("l_quantity").cast(QUANTITY)).alias("quantity"),
        F.lit("pcs").alias("unit"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"),
        F.when(index % 3 == 0, F.col("l_extendedprice").cast(MONEY)).alias("line_total"),
    )


def report_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each user for every month of 1995 and one month without purchases."""
    months = spark.range(1, 14).select(F.col("id").alias("k"))
    return users(spark, sf_dir).select(F.col("id").alias("user_id"), "email").crossJoin(F.broadcast(months)).select(
        (F.col("user_id") * 100 + F.col("k")).alias("id"),
        "user_id",
        "email",
        F.when(F.col("k") == 13, 2050).otherwise(1995).alias("year"),
        F.when(F.col("k") == 13, 1).otherwise(F.col("k")).cast("int").alias("month"),
        F.element_at(F.lit(["MONTHLY_SPENDING", "CATEGORY_SUMMARY", "STORE_SUMMARY"]), (F.col("k") % 3 + 1).cast("int")).alias("report_type"),
        F.element_at(F.lit(["CSV", "PDF", "XLSX"]), ((F.col("k") + F.col("user_id")) % 3 + 1).cast("int")).alias("report_format"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of jobs, one job a user of the event stream."""
    status = F.create_map(*[F.lit(x) for pair in (("signup", "NEW"), ("view", "PROCESSING"), ("click", "PROCESSING"), ("purchase", "DONE"), ("error", "FAILED")) for x in pair])
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("updated_at"), status[F.col("event_type")].alias("status"), "value")


def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts written from purchases and their items, amounts divided by 100 so that they fit a receipt's number format."""
    lines = read(spark, sf_dir, "lineitem")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"), "p_retailprice")
    money = lambda c: (F.col(c).cast(MONEY) / 100).cast(MONEY).cast("string")
    shown = F.concat_ws(" ", "name", F.col("l_quantity").cast("int"), F.lit("x"), money("p_retailprice"), money("l_extendedprice"))
    # Windows of one sort gather a receipt's lines in order; collect_list by groupBy would sort all rows twice more.
    place = Window.partitionBy("l_orderkey").orderBy(*lines.columns, "shown")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_line = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).repartition("l_orderkey").select(*lines.columns, shown.alias("shown"))
    items = per_line.select("l_orderkey", F.row_number().over(place).alias("i"), F.collect_list("shown").over(whole).alias("rows")).filter("i = 1")
    head = F.concat(F.lit("MARKET "), F.element_at(F.lit(["NORTH", "SOUTH", "EAST", "WEST"]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    body = F.array_join("rows", "\n")
    orders = read(spark, sf_dir, "orders")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("receipt_id"),
        F.concat_ws("\n", head, F.lit("CASHIER 03"), F.concat(F.lit("DATE "), F.date_format("o_orderdate", "dd.MM.yyyy")), body, F.concat(F.lit("TOTAL "), money("o_totalprice")), F.lit("THANK YOU")).alias("raw_text"),
    )


VIEWS_SQL = """
WITH users AS (
    SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) || '@example.org' AS email,
           CASE WHEN n_nationkey % 3 = 0 THEN 'g-' || n_nationkey END AS google_subject,
           CASE WHEN n_nationkey % 16 = 12 THEN '  ' WHEN n_nationkey % 4 = 0 THEN 'chat-' || n_nationkey END AS chat_id,
           CASE WHEN n_nationkey % 4 = 0 AND n_nationkey % 8 <> 0 THEN TIMESTAMP '2024-02-01' END AS connected_at,
           CASE WHEN n_nationkey % 2 = 0 THEN 'TELEGRAM' ELSE 'EMAIL' END AS preferred_channel,
           CAST(DATE '2024-01-01' + CAST(n_nationkey * 7 % 25 AS INTEGER) AS DATE) AS created_on
    FROM nation
), purchases AS (
    SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, 'Order ' || o_orderkey AS title, c_mktsegment AS category,
           CAST(o_totalprice AS DECIMAL(19,2)) AS amount,
           CASE o_orderkey % 4 WHEN 0 THEN 'UAH' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE 'RUB' END AS currency,
           CAST(o_orderdate AS DATE) AS purchase_date,
           CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS store_name,
           CASE WHEN o_orderkey % 7 = 0 THEN 'said "' || o_orderstatus || '", ok' END AS comment,
           o_orderdate AS created_at
    FROM orders JOIN customer ON o_custkey = c_custkey
), numbered AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS line_index
    FROM lineitem
), purchase_items AS (
    SELECT l_orderkey AS purchase_id, line_index, p_name AS title,
           CASE WHEN line_index % 5 <> 4 THEN CAST(l_quantity AS DECIMAL(19,3)) END AS quantity, 'pcs' AS unit,
           CAST(p_retailprice AS DECIMAL(19,2)) AS unit_price,
           CASE WHEN line_index % 3 = 0 THEN CAST(l_extendedprice AS DECIMAL(19,2)) END AS line_total
    FROM numbered JOIN part ON l_partkey = p_partkey
), report_jobs AS (
    SELECT id * 100 + k AS id, id AS user_id, CASE WHEN k = 13 THEN 2050 ELSE 1995 END AS year, CASE WHEN k = 13 THEN 1 ELSE k END AS month,
           CASE k % 3 WHEN 0 THEN 'MONTHLY_SPENDING' WHEN 1 THEN 'CATEGORY_SUMMARY' ELSE 'STORE_SUMMARY' END AS report_type,
           CASE (k + id) % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'PDF' ELSE 'XLSX' END AS report_format
    FROM users, (SELECT unnest(range(1, 14)) AS k)
), job_events AS (
    SELECT event_id, user_id AS job_id, ts AS updated_at,
           CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' END AS status, value
    FROM events
)
"""
