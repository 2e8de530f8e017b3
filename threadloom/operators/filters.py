"""Which messages a search may look at, and joins that only filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: types of calendar entries, senders and phrases of invitations
CALENDAR_TYPES = ("text/calendar", "application/ics")
INVITING_ADDRESS = "calendar-notification@google.com"
INVITING_DOMAINS = ("evite.com", "paperlesspost.com", "punchbowl.com", "partiful.com", "eventbrite.com", "splashthat.com", "anyvite.com", "greenvelope.com", "withjoy.com", "rsvpify.com")
INVITING = (
    "rsvp", "you're invited", "you are invited", "youre invited", "respond by", "please respond", "regrets only", "are you attending", "will you attend", "accept or decline", "accept this invitation",
    "decline this invitation", "confirm your attendance", "let us know if you can make it", "let us know if you can attend",
)


def candidates(
    messages: DataFrame, attachments: DataFrame, user: str | None = None, sender: str | None = None, to: str | None = None, subject: str | None = None, after: str | None = None, before: str | None = None,
    has_attachment: bool | None = None, labels: tuple[str, ...] = (),
) -> DataFrame:
    """The messages that meet every condition given; one that is None asks for nothing.

    Texts match anywhere in any case; ``before`` is a day that still counts; the
    predicates are plain columns, so they reach the scan.
    """
    out = messages if user is None else messages.where(F.col("user_id") == user)
    for column, wanted in (("from_addr", sender), ("to_addr", to), ("subject", subject)):
        if wanted is not None:
            out = out.where(F.lower(column).contains(wanted.lower()))
    if after is not None:
        out = out.where(F.col("date") >= after)
    if before is not None:
        out = out.where(F.col("date") <= f"{before}T23:59:59+00:00")
    for label in labels:
        out = out.where(F.array_contains("labels", label))
    if has_attachment is not None:
        # an attachment without a message filters nothing
        owners = attachments.where("message_id is not null").select(F.col("message_id").alias("id"))
        out = out.join(owners, "id", "left_semi" if has_attachment else "left_anti")
    return out


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL's ``NOT IN``: nothing if the other side holds a null; a null of one's own passes only an empty other side."""
    state = other.agg(F.count(F.lit(1)).alias("__all"), F.count(other_column).alias("__told"))
    left = df.join(other.where(F.col(other_column).isNotNull()).select(F.col(other_column).alias(column)).distinct(), column, "left_anti")
    return left.join(F.broadcast(state)).where((F.col("__all") == 0) | ((F.col("__all") == F.col("__told")) & F.col(column).isNotNull())).select(df.columns)


def through_parent(children: DataFrame, parents: DataFrame, link: str, id: str, owner: str, user: str) -> DataFrame:
    """Rows whose parent belongs to ``user``; the rows themselves carry no owner."""
    return children.join(parents.where(F.col(owner) == user).select(F.col(id).alias(link)), link, "left_semi").select(children.columns)


def missing_under(rows: DataFrame, made: DataFrame, key: str, **fixed: str) -> DataFrame:
    """Rows without a counterpart that also has the fixed values: a counterpart of another model doesn't count."""
    own = made
    for column, value in fixed.items():
        own = own.where(F.col(column) == value)
    return rows.join(own.select(key), key, "left_anti")


def contact_matches(contacts: DataFrame, messages: DataFrame, name: str = "email", sender: str = "from_addr") -> DataFrame:
    """(contact, messages, last) of contacts whose address stands in a message's sender field.

    The field's own addresses are cut out, so the join is on equal keys.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(sender), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+"), F.lit(0))))
    seen = messages.select(found.alias(name), "date").groupBy(name).agg(F.count(F.lit(1)).alias("messages"), F.max("date").alias("last"))
    return contacts.select(F.lower(name).alias(name)).distinct().join(seen, name)


def bulk(messages: DataFrame) -> DataFrame:
    """Messages labelled as bulk mail, or with a header (structs name, value; may be null) that tells how to unsubscribe."""
    from threadloom.functions.urls import looks_bulk

    listed = F.coalesce(F.exists("headers", lambda h: F.lower(h["name"]) == "list-unsubscribe"), F.lit(False))
    return messages.where(looks_bulk(F.col("labels")) | listed)


def bulk_threads(messages: DataFrame) -> DataFrame:
    """Threads all of whose messages are bulk mail."""
    from threadloom.functions.urls import looks_bulk

    return messages.groupBy("thread_id").agg(F.bool_and(looks_bulk(F.col("labels"))).alias("bulk"), F.count(F.lit(1)).alias("n")).where("bulk").select("thread_id", "n")


def invitations(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Messages that may be invitations: an attached calendar entry, a sender at or below an inviting domain, or an inviting phrase in subject or body."""
    kind, name = F.lower(F.coalesce("mime_type", F.lit(""))), F.lower(F.coalesce("filename", F.lit("")))
    entry = name.endswith(".ics")
    for start in CALENDAR_TYPES:
        entry = entry | kind.startswith(start)
    invited = attachments.where(entry).select(F.col("message_id").alias("id"), F.lit(True).alias("__entry")).distinct()
    sender = F.lower(F.coalesce("from_addr", F.lit("")))
    domain = F.regexp_extract(sender, r"[\w.+-]+@([\w.-]+)", 1)
    shaped = F.coalesce("__entry", F.lit(False)) | sender.contains(INVITING_ADDRESS)
    for d in INVITING_DOMAINS:
        shaped = shaped | (domain == d) | domain.endswith(f".{d}")
    said = F.lower(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body_text", F.lit(""))))
    for phrase in INVITING:
        shaped = shaped | said.contains(phrase)
    return messages.join(invited, "id", "left").where(shaped).select(messages.columns)
