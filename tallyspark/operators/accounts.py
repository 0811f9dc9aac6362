"""Users: registration, linked accounts, settings and removal; and the rules that requests must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scalars import email_key, has_text, trimmed

TYPES, FORMATS = ("MONTHLY_SPENDING", "CATEGORY_SUMMARY", "STORE_SUMMARY"), ("CSV", "PDF", "XLSX")
UPLOADS = ("image/jpeg", "image/png", "application/pdf")
EMAIL = r"^[^\s@]+@[^\s@]+$"


def messages(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that are broken (a null is not), joined by "; "; null if none is."""
    found = F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules)), lambda x: x.isNotNull())
    return F.nullif(F.array_join(found, "; "), F.lit(""))


def unknown(c: str, values: tuple[str, ...]) -> Column:
    """Null, or none of the values."""
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def report_errors(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` to report requests (year, month, report_type, report_format). A missing number breaks one rule, not those on its size."""
    return requests.withColumn(
        "errors",
        messages(
            (F.col("year").isNull(), "year: must not be null"),
            (F.col("year") < 2000, "year: must be greater than or equal to 2000"),
            (F.col("year") > 9999, "year: must be less than or equal to 9999"),
            (F.col("month").isNull(), "month: must not be null"),
            (F.col("month") < 1, "month: must be greater than or equal to 1"),
            (F.col("month") > 12, "month: must be less than or equal to 12"),
            (unknown("report_type", TYPES), "reportType: must not be null"),
            (unknown("report_format", FORMATS), "reportFormat: must not be null"),
        ),
    )


def upload_errors(files: DataFrame) -> DataFrame:
    """Adds ``errors`` to files (content_type, file_size, currency, and purchase_currency of a linked purchase, else null)."""
    other = F.col("purchase_currency").isNotNull() & (F.col("purchase_currency") != F.col("currency"))
    return files.withColumn(
        "errors",
        messages((F.coalesce(F.col("file_size"), F.lit(0)) <= 0, "Uploaded file must not be empty"), (unknown("content_type", UPLOADS), "Unsupported file content type"), (other, "Receipt currency must match the linked purchase currency")),
    )


def registration_errors(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` to registrations (email, password). Both are judged as they were given; an empty email breaks one rule alone."""
    email, size = F.col("email"), F.length("password")
    return requests.withColumn(
        "errors",
        messages(
            (~has_text(email), "email: must not be blank"),
            ((email != "") & ~email.rlike(EMAIL), "email: must be a well-formed email address"),
            (F.length(email) > 255, "email: size must be between 0 and 255"),
            (~has_text(F.col("password")), "password: must not be blank"),
            ((size < 8) | (size > 255), "password: size must be between 8 and 255"),
        ),
    )


def role(email: Column, admins: list[str]) -> Column:
    """ADMIN if a normalised email is in the list, whose entries are normalised alike."""
    return F.when(email.isin([a.strip("".join(map(chr, range(33)))).lower() for a in admins]), "ADMIN").otherwise("USER")


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.col("email") == email_key(F.lit(email)))


def by_subject(users: DataFrame, subject: str) -> DataFrame:
    """The user with an outside subject, which is compared as it is."""
    return users.filter(F.col("google_subject") == subject)


def register(users: DataFrame, requests: DataFrame, admins: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """New users with their defaults, and refused requests. ``requests``: request_id, email, password, password_hash.

    Requests that break a rule are refused first; of the others with one email the first is taken, if no user has it.
    """
    checked = registration_errors(requests)
    place = F.row_number().over(Window.partitionBy("key", F.col("errors").isNull()).orderBy("request_id"))
    asked = checked.withColumn("key", email_key(F.col("email"))).withColumn("k", place)
    taken = users.select(F.col("email").alias("key"), F.lit(True).alias("taken"))
    known = F.when(F.col("taken") | (F.col("k") > 1), F.lit("User with email already exists"))
    judged = asked.join(taken, "key", "left").withColumn("error", F.coalesce("errors", known))
    new = judged.filter("error is null").select("request_id", F.col("key").alias("email"), "password_hash", F.lit(None).cast("string").alias("google_subject"), now.alias("created_at"))
    return with_defaults(new, admins), judged.filter("error is not null").select("request_id", "email", "error")


def with_defaults(users: DataFrame, admins: list[str]) -> DataFrame:
    """Users with the role and preferred channel that a new or older row may lack."""
    given = lambda c: F.col(c) if c in users.columns else F.lit(None).cast("string")
    return users.withColumns({"role": F.coalesce(given("role"), role(F.col("email"), admins)), "preferred_channel": F.coalesce(given("preferred_channel"), F.lit("EMAIL"))})


def linked_accounts(users: DataFrame, logins: DataFrame, admins: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """Users after outside logins (email, subject, at), and new users of logins without one.

    A login belongs to the user with its subject, else to the one with its email. The first login of a user without a subject gives it,
    and a user that logs in gets a role if none is set. Of the logins of one subject, and then of one new email, the first counts.
    """
    asked = logins.withColumn("email", email_key(F.col("email")))
    held = users.filter("google_subject is not null").select(F.col("google_subject").alias("subject"), F.col("email").alias("owner"))
    own = asked.join(held, "subject", "left")
    first = own.filter("owner is null").groupBy("subject").agg(F.min_by(F.struct("email", "at"), F.struct("at", "email")).alias("x")).select("subject", "x.*")
    per_email = first.groupBy("email").agg(F.min_by("subject", F.struct("at", "subject")).alias("subject"))
    seen = own.select(F.coalesce("owner", "email").alias("email")).distinct().withColumn("seen", F.lit(True))
    joined = users.join(per_email, "email", "left").join(seen, "email", "left")
    changed = {"google_subject": F.coalesce("google_subject", "subject"), "role": F.when(F.col("seen"), F.coalesce("role", role(F.col("email"), admins))).otherwise(F.col("role"))}
    linked = joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in users.columns))
    new = per_email.join(users.select("email"), "email", "left_anti").select("email", F.col("subject").alias("google_subject"), now.alias("created_at"))
    return linked, with_defaults(new, admins)


def connect_chats(users: DataFrame, links: DataFrame) -> DataFrame:
    """Users with the chat of their link (user_id, chat_id, at), the last if there are several."""
    last = links.groupBy("user_id").agg(F.max_by(F.struct("chat_id", "at"), F.struct("at", "update_id")).alias("last"))
    joined = users.join(last, F.col("id") == F.col("user_id"), "left")
    changed = {"chat_id": F.coalesce(trimmed(F.col("last.chat_id")), F.col("chat_id")), "connected_at": F.coalesce("last.at", "connected_at")}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in users.columns))


def connected() -> Column:
    """Has the user (chat_id, connected_at) a chat, and since when?"""
    return has_text(F.col("chat_id")) & F.col("connected_at").isNotNull()


def preferences(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with the channel that they ask for (id, channel), and requests for a channel that is not connected."""
    asked = users.join(requests.select("id", "channel"), "id", "left").withColumn("fits", F.col("channel").isNotNull() & ((F.col("channel") != "TELEGRAM") | connected()))
    changed = asked.withColumn("preferred_channel", F.when(F.col("fits"), F.col("channel")).otherwise(F.col("preferred_channel"))).select(users.columns)
    return changed, asked.filter("channel is not null and not fits").select("id", "channel", F.lit("Connect Telegram before choosing TELEGRAM as the preferred notification channel").alias("error"))


def remove_users(gone: DataFrame, users: DataFrame, purchases: DataFrame, items: DataFrame, **owned: DataFrame) -> dict[str, DataFrame]:
    """All tables without the users of ``gone`` (id) and what is theirs; ``owned`` tables have a user_id."""
    ids = gone.select(F.col("id").alias("user_id")).distinct()
    left = {name: df.join(ids, "user_id", "left_anti") for name, df in {"purchases": purchases, **owned}.items()}
    bought = purchases.join(ids, "user_id", "left_semi").select(F.col("id").alias("purchase_id"))
    return left | {"users": users.join(gone.select("id").distinct(), "id", "left_anti"), "items": items.join(bought, "purchase_id", "left_anti")}
