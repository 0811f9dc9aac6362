"""Receipt texts to store, total, date and items, with column expressions alone.

Which lines make up an item's title is a question of neighbouring lines: a line with an amount takes the
unbroken run of title lines right above it. So each line gets a mark by its kind, and the text is split anew at the lines that
are no titles: each part is such a line with its run. A receipt stays in its row until its items are rows, so nothing
is shuffled or sorted and a task holds one receipt at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import MONEY, category_key, optional_text

# Fixed values of the receipt format: patterns and keywords.
DECIMAL = r"(?<![0-9])([0-9]{1,5}(?:[ \u00A0][0-9]{3})*[.,][0-9]{2})(?![0-9])"
EDGE, END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
DATE = rf"{EDGE}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[./-][0-9]{{2}}[./-][0-9]{{2,4}}){END}"
TIME = rf"{EDGE}[0-9]{{2}}:[0-9]{{2}}{END}"
BARCODE = r"^[0-9\s-]{8,}$"
UNITS = "шт|кг|kg|гр|g|г|л|ml|мл|уп|упак|pcs|pc|pack|бут|btl|pkg"
WITH_UNIT = rf"(?iu)([0-9]+(?:[.,][0-9]+)?)\s*({UNITS})(?=\s|$)"
MULTIPLIER = r"(?iu)([0-9]+(?:[.,][0-9]+)?)\s*[xх×*]\s*([0-9]+[.,][0-9]{2})"
TITLE_ENDS = (r"(?iu)\s+[0-9]+(?:[.,][0-9]+)?\s*[xх×*]$", r"(?iu)\s*[xх×*]$", r"[\s,;:/\\|.-]+$")
TOTAL_WORDS = ("total", "amount due", "sum", "subtotal", "итого", "сумма", "сума", "всього", "до сплати", "к оплате")
SERVICE_WORDS = (
    "barcode", "bar code", "штрих", "штрихкод", "штрих код", "касса", "каса", "кассир", "касир", "cashier", "terminal", "терминал", "термінал", "address", "адрес", "www", "http", "qr",
    "receipt", "чек", "фискал", "фіскал", "thank", "дякуємо", "спасибо", "card", "payment", "discount", "зниж", "скид", "vat", "tax", "пдв", "phone", "тел",
)
ADDRESS_WORDS = ("вул", "ул", "улица", "street", "st.", "avenue", "ave", "просп", "пр-т", "буд", "дом", "місто", "город")
HEAD_LINES = 8


#: White space that is not a single space already; what is trimmed at both ends.
UNEVEN, EDGES = r"\s{2,}|[\t-\r]", "".join(map(chr, range(33)))


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), UNEVEN, " "), F.lit(EDGES))


def once(c: Column, then) -> Column:
    """``then`` of a value that is made once; inside lambdas Spark makes an expression anew at each of its places."""
    return F.transform(F.array(c), then)[0]


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def lines_of(text: Column) -> Column:
    """Normalised lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), normalised), lambda x: x != "")


def amounts(c: Column) -> Column:
    """All amounts in order."""
    found = F.regexp_extract_all(c, F.lit(DECIMAL), 1)
    return F.transform(found, lambda x: F.translate(F.replace(x, F.lit(","), F.lit(".")), "\u00a0 ", "").cast(MONEY))


def is_service(c: Column) -> Column:
    return once(F.lower(c), lambda low: any_of(low, SERVICE_WORDS) | (any_of(low, ADDRESS_WORDS) & low.rlike(r"\p{Nd}")))


def is_total(c: Column) -> Column:
    return once(F.lower(c), lambda low: any_of(low, TOTAL_WORDS))


def has_letters(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def has_time(c: Column) -> Column:
    return c.rlike(DATE) | c.rlike(TIME)


def clean_title(c: Column) -> Column:
    """Without a multiplier, a multiplier sign or punctuation at the end, in this order."""
    out = normalised(c)
    for pattern in TITLE_ENDS:
        out = F.regexp_replace(out, pattern, "")
    return out


def is_title(c: Column) -> Column:
    letters, digits = F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))
    return has_letters(c) & ~c.rlike(DECIMAL) & ~has_time(c) & ~is_service(c) & ~c.rlike(BARCODE) & (letters >= 3) & (digits <= F.greatest(F.lit(6), 2 * letters))


def store_name(lines: Column) -> Column:
    fits = F.filter(F.slice(lines, 1, HEAD_LINES), lambda x: has_letters(x) & ~x.rlike(DECIMAL) & ~x.rlike(BARCODE) & ~has_time(x) & ~is_service(x))
    return F.try_element_at(F.filter(F.transform(fits, clean_title), lambda x: x != ""), F.lit(1))


def total_amount(lines: Column, text: Column) -> Column:
    """The last amount of the first total line that has one, else the largest amount of the text."""
    per_line = F.transform(F.filter(lines, lambda x: once(F.lower(x), lambda low: any_of(low, TOTAL_WORDS) & ~F.contains(low, F.lit("subtotal")))), amounts)
    named = F.try_element_at(F.filter(per_line, lambda a: F.size(a) > 0), F.lit(1))
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.array_max(amounts(text)))


def parsed_date(c: Column) -> Column:
    """ISO dates strictly; day-first dates with one kind of separator and 2 or 4 digits of year, a day beyond the month's end becoming its last."""
    part = lambda k: F.regexp_extract(c, r"^([0-9]{2})([./-])([0-9]{2})\2([0-9]{4}|[0-9]{2})$", k)
    day, month, year = part(1).try_cast("int"), part(3).try_cast("int"), part(4).try_cast("int")
    year = F.when(year < 100, 2000 + year).otherwise(year)
    fits = day.between(1, 31) & month.between(1, 12) & (year >= 1)
    first = F.make_date(F.when(fits, year), F.when(fits, month), F.lit(1))
    clamped = F.date_add(first, F.least(day, F.dayofmonth(F.last_day(first))) - 1)
    return F.when(c.rlike("^[0-9]{4}-"), F.try_to_date(c, "yyyy-MM-dd")).otherwise(clamped)


def purchase_date(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(DATE), 1), parsed_date)
    return F.try_element_at(F.filter(found, lambda d: d.isNotNull()), F.lit(1))


def with_headers(rows: DataFrame, text: str = "raw_text") -> DataFrame:
    """``rows`` with store_name, total_amount and purchase_date of their texts; all three are null where the text is."""
    split = rows.withColumn("lines", lines_of(F.col(text)))
    return split.withColumns({"store_name": store_name(F.col("lines")), "total_amount": total_amount(F.col("lines"), F.col(text)), "purchase_date": purchase_date(F.col(text))}).drop("lines")


def headers(receipts: DataFrame) -> DataFrame:
    """(receipt_id, store_name, total_amount, purchase_date) of (receipt_id, raw_text)."""
    return with_headers(receipts.select("receipt_id", "raw_text")).drop("raw_text")


def number(c: Column) -> Column:
    return F.nullif(F.replace(c, F.lit(","), F.lit(".")), F.lit("")).try_cast("decimal(19,3)")


def kind_of(line: Column) -> Column:
    """A line's kind: T(itle), I(nline: with an amount and letters), A(mount alone), O(ther)."""
    ignored = (F.length(line) < 2) | line.rlike(BARCODE) | is_service(line) | has_time(line)
    return F.when(ignored, "O").when(line.rlike(DECIMAL), F.when(has_letters(line), "I").otherwise("A")).when(is_title(line), "T").otherwise("O")


def joined(titles: Column) -> Column:
    return F.aggregate(F.transform(titles, clean_title), F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(clean_title(F.concat_ws(" ", acc, x))))


def items(receipts: DataFrame) -> DataFrame:
    """(receipt_id, line_index, title, quantity, unit, unit_price, line_total, raw_fragment) of all receipts' items."""
    # Lines hold neither \n nor \r. A title ends with \n, any other line with \r, so a part between two \r is a line and the titles above it.
    ended = lambda lines: F.array_position(F.transform(lines, is_total), True).cast("int")
    split = receipts.select("receipt_id", lines_of(F.col("raw_text")).alias("lines")).withColumn("end", ended(F.col("lines")))
    before = F.when(F.col("end") > 0, F.slice("lines", F.lit(1), F.greatest("end", F.lit(1)) - 1)).otherwise(F.col("lines"))
    mark = lambda x: once(kind_of(x), lambda k: F.when(k == "T", F.concat(x, F.lit("\n"))).otherwise(F.concat(k, x, F.lit("\r"))))
    parts = F.split(F.array_join(F.transform(before, mark), ""), "\r")
    placed = F.filter(F.transform(parts, lambda p: F.split(p, "\n")), lambda p: F.element_at(p, -1).rlike("^[IA]"))
    # Amounts without a title above are no items and have no index; inline lines have one even if their title turns out empty.
    items = F.filter(placed, lambda p: F.element_at(p, -1).startswith("I") | (joined(F.slice(p, F.lit(1), F.size(p) - 1)) != ""))
    # posexplode would have Spark look for empty arrays first, and make all of them twice for that.
    found = split.select("receipt_id", F.posexplode_outer(items).alias("pos", "p")).filter("pos is not null")
    last = F.element_at("p", -1)
    known = found.select("receipt_id", (F.col("pos") + 1).alias("line_index"), F.when(last.startswith("I"), "inline").otherwise("amount").alias("kind"), F.substr(last, F.lit(2)).alias("line"), F.slice("p", F.lit(1), F.size("p") - 1).alias("pending"))
    line = F.col("line")
    known = known.withColumns({"pending_title": joined(F.col("pending")), "values": amounts(line)})
    own = clean_title(F.substring(line, F.lit(1), F.regexp_instr(line, F.lit(DECIMAL)) - 1))
    title = F.when(F.col("kind") == "amount", clean_title(F.col("pending_title"))).when(F.col("pending_title") != "", clean_title(F.concat_ws(" ", F.col("pending_title"), own))).otherwise(own)
    source = F.when(F.col("kind") == "inline", line).otherwise(F.col("pending_title"))
    titled = known.withColumns({"title": title, "source": source}).filter("title <> ''")
    unit_in = lambda c, k: F.regexp_extract(c, WITH_UNIT, k)
    by_title, by_source = unit_in(F.col("title"), 2) != "", unit_in(F.col("source"), 2) != ""
    times = lambda k: F.regexp_extract("source", MULTIPLIER, k)
    second_last = F.when(F.size("values") >= 2, F.try_element_at("values", F.lit(-2)))
    quantity = F.when(by_title, number(unit_in(F.col("title"), 1))).when(by_source, number(unit_in(F.col("source"), 1))).otherwise(number(times(1)))
    unit = F.when(by_title, F.lower(unit_in(F.col("title"), 2))).when(by_source, F.lower(unit_in(F.col("source"), 2)))
    priced = titled.withColumns({"quantity": quantity, "unit": unit, "line_total": F.try_element_at("values", F.lit(-1)), "each": F.when(~by_title, number(times(2)).cast(MONEY))})
    divided = F.when(F.col("quantity") > 0, F.round(F.col("line_total") / F.col("quantity"), 2).cast(MONEY))
    fragment = F.array_join(F.concat("pending", F.array("line")), " | ")
    return priced.select("receipt_id", "line_index", "title", "quantity", "unit", F.coalesce("each", second_last, divided).alias("unit_price"), "line_total", fragment.alias("raw_fragment"))


def to_purchases(receipts: DataFrame, parsed: DataFrame, lines: DataFrame) -> DataFrame:
    """Purchases of receipts that have none yet, a category, and a parsed total.

    ``receipts``: receipt_id, user_id, purchase_id, category, currency, original_file_name, uploaded_at.
    """
    first = lines.groupBy("receipt_id").agg(F.min_by("title", "line_index").alias("first_title"))
    ready = receipts.filter("purchase_id is null").withColumn("category", category_key(F.col("category"))).filter("category <> ''")
    joined = ready.join(parsed.filter("total_amount is not null"), "receipt_id").join(first, "receipt_id", "left")
    title = F.coalesce(optional_text(F.col("first_title")), optional_text(F.col("store_name")), F.col("original_file_name"))
    return joined.select("receipt_id", "user_id", title.alias("title"), "category", F.col("total_amount").alias("amount"), "currency", F.coalesce("purchase_date", F.to_date("uploaded_at")).alias("purchase_date"), optional_text(F.col("store_name")).alias("store_name"))
