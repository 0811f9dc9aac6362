"""Benchmark decontamination with DataFrame functions only.

Test items become windows of ``WINDOW`` consecutive normalised words (a shorter item is one window of its own
length), keyed by a 64-bit hash. Each document's word windows are hashed in the scan's own task and looked
up in that set; a hit is verified on the words themselves before it counts. The set is broadcast if there
are at most ``BROADCAST_WINDOWS``, a count that is taken first; a larger set is joined by a shuffle of all
windows instead. Only hits, and one row a document, are shuffled: they are grouped by a row number that
is made in the same task, so documents with equal ids are told apart. Documents are cut into pieces of ``PIECE`` words first, so the
work grows with a text's length. ``decontaminate`` shuffles the texts alone that a bitmap of the hit ones lets through.

Null or empty text: no words, not contaminated. Null or wordless items match nothing; an item without an id
counts as a hit, but isn't listed. An item that occurs twice in the benchmark is listed once. Columns
other than doc_id, text and item_id are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, maybe_in, packed, table, unpacked

WINDOW = 10
#: Windows of all items, and item ids listed with them, up to which they are broadcast (of about 200 bytes each).
BROADCAST_WINDOWS = 500_000
#: Words whose windows are looked up together; each piece has the next WINDOW - 1 words as well.
PIECE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words; A-Z are lower-cased before anything else, so they are letters here."""
    # lower() is the fast way, and the same as A-Z to a-z where there is no other letter.
    low = F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), PARTING), lambda w: w != "")


def word_keys(of: Column) -> Column:
    return F.transform(of, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(size, key, window, item_ids): distinct windows of all items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    sized = items.select("item_id", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("size"))
    each = sized.select("item_id", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    cut = each.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("window"))
    grouped = cut.groupBy("size", "window").agg(F.collect_set("item_id").alias("item_ids"))
    return grouped.select(F.col("size").alias("of_size"), F.xxhash64(word_keys(F.col("window"))).alias("of_key"), "window", "item_ids")


def places(size: int) -> Column:
    """(size, at) of each run of ``size`` words that begins among a piece's own words, by its first word's number from 1."""
    last = F.least(F.lit(PIECE), F.size("w") - (size - 1))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(F.lit(size).alias("size"), i.alias("at")))
    return F.when(last > 0, runs).otherwise(F.array().cast("array<struct<size: int, at: int>>"))


def pieces(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(row, base, w, doc, n_words): for each document one row with its kept columns and number of words, and others with ``PIECE`` of its words and the next few.

    So what is copied for a window is a piece, however long its document.
    """
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{k}`") for k in keep)).alias("doc"), words(F.col("text")).alias("w"))
    entry = lambda base, w, doc, n: F.struct(base.cast("int").alias("base"), w.alias("w"), doc.alias("doc"), n.cast("long").alias("n_words"))
    own = entry(F.lit(0), F.array().cast("array<string>"), F.col("doc"), F.size("w"))
    none = F.lit(None).cast(split.schema["doc"].dataType)
    cuts = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PIECE)), lambda base: entry(base, F.slice("w", base + 1, PIECE + WINDOW - 1), none, F.lit(None)))
    each = F.when(F.size("w") > 0, F.concat(F.array(own), cuts)).otherwise(F.array(own))
    return split.select("row", F.explode(each).alias("e")).select("row", "e.base", "e.w", "e.doc", "e.n_words")


def scanned(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row a document, in any order: the columns of ``keep``, n_words, spans and items, in a struct doc and columns n_words, spans, items.

    ``spans`` has (first, last), the word numbers from 1 of each verified window, by place; ``items`` the
    ids of items whose windows occur, sorted as strings.
    """
    windows = item_windows(benchmark)
    # One row: the windows' lengths (at most WINDOW of them), and their number with that of the listed ids, which decides on the broadcast.
    seen = windows.agg(F.sort_array(F.collect_set("of_size")).alias("sizes"), F.coalesce(F.sum(1 + F.size("item_ids")), F.lit(0)).alias("n")).first()
    # A document's own row asks for no window: size 0, and a key of its own, so that such rows go everywhere.
    own = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("at")))
    asked = F.when(F.col("doc").isNotNull(), own).otherwise(F.concat(*(places(s) for s in seen.sizes)) if seen.sizes else own)
    placed = pieces(docs, keep).withColumn("h", word_keys(F.col("w"))).select("row", "base", "w", "h", "doc", "n_words", F.explode(asked).alias("e"))
    key = F.when(F.col("e.size") > 0, F.xxhash64(F.slice("h", F.greatest("e.at", F.lit(1)), F.col("e.size")))).otherwise(F.xxhash64("row"))
    each = placed.select("row", "base", "w", "doc", "n_words", "e.size", "e.at", key.alias("key"))
    matching = (F.col("key") == F.col("of_key")) & (F.col("size") == F.col("of_size"))
    run = F.slice("w", F.greatest("at", F.lit(1)), F.col("size"))
    if seen.n <= BROADCAST_WINDOWS:
        met = each.join(F.broadcast(windows), matching, "left")
    else:
        met = each.withColumn("w", run).join(windows, matching, "left")
        run = F.col("w")
    found = met.filter((F.col("size") == 0) | (run == F.col("window")))
    span = F.when(F.col("size") > 0, F.struct((F.col("base") + F.col("at")).alias("first"), (F.col("base") + F.col("at") + F.col("size") - 1).alias("last")))
    grouped = found.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.first("n_words", ignorenulls=True).alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("item_ids").alias("lists"))
    return grouped.select("doc", "n_words", "spans", F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``scanned`` with the columns of ``keep``, which should have other names, beside n_words, spans and items."""
    return scanned(docs, benchmark, keep).select(*(F.col("doc")[k].alias(k) for k in keep), "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by place."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["last"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["end"], s["first"] - 1))).alias("n"),
    )
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what parts them from the next word."""
    low = F.coalesce(text, F.lit(""))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(low, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all(low, F.lit(f"({word})"), 1)
    left = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (i + 1 >= s["first"]) & (i + 1 <= s["last"])))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(lead, F.array_join(left, "")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without documents that hold a window of the benchmark, or (``remove="spans"``) without the hit words."""
    found = scanned(packed(docs).select("id", "is", "doc.text"), benchmark, ("id", "is"))
    hit = cut(found.filter(F.size("spans") > 0).select("doc.id", "doc.is", "spans").dropDuplicates(["id", "is"]))
    marked = maybe_in(packed(docs), hit, "id", "is")
    clean, asked = unpacked(marked.filter("not maybe_"), docs.columns), marked.filter("maybe_")
    if remove == "documents":
        return clean.unionByName(unpacked(asked.join(hit, ["id", "is"], "left_anti"), docs.columns))
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<first: int, last: int>>)"))
    return clean.unionByName(unpacked(asked.join(hit, ["id", "is"], "left"), docs.columns, text=without_spans(F.col("doc.text"), spans)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ("doc_id",))
    return found.select(
        "doc.doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, doc_id AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), items AS (
    SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
    FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM items)
), sizes AS (
    SELECT DISTINCT size FROM windows
), runs AS (
    SELECT r, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size)
), found AS (
    SELECT r, runs.size, pos, item_id FROM runs JOIN windows ON runs.win = windows.win AND runs.size = windows.size
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY r
), listed AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
