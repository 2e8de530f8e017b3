"""Messages from a mail API's JSON: headers, date, text and HTML parts at any depth the format allows, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep parts may lie in parts; mail programs themselves stop well before.  A message that goes deeper has ``cut`` set.
DEPTH = 24
_LEAF = "partId: string, mimeType: string, filename: string, body: struct<attachmentId: string, size: bigint, data: string>"


def _part(depth: int) -> str:
    return f"struct<{_LEAF}{f', parts: array<{_part(depth - 1)}>' if depth else ', parts: array<string>'}>"


SCHEMA = f"struct<id: string, threadId: string, internalDate: string, historyId: string, labelIds: array<string>, payload: struct<headers: array<struct<name: string, value: string>>, {_LEAF}, parts: array<{_part(DEPTH)}>>>"
_FLAT = "array<struct<mime: string, name: string, attachment: string, size: bigint, data: string, deeper: boolean>>"


def _leaves(part: Column, depth: int) -> Column:
    """The parts that hold no others, in order."""
    own = F.array(F.struct(part["mimeType"].alias("mime"), part["filename"].alias("name"), part["body"]["attachmentId"].alias("attachment"), part["body"]["size"].alias("size"), part["body"]["data"].alias("data"), (F.lit(not depth) & part["parts"].isNotNull()).alias("deeper"))).cast(_FLAT)
    if not depth:
        return own
    return F.when(part["parts"].isNull(), own).otherwise(F.flatten(F.transform(part["parts"], lambda p: _leaves(p, depth - 1))))


def decoded(data: Column) -> Column:
    """URL-safe base64 as text, with or without padding; bytes that are no UTF-8 become replacement marks."""
    standard = F.regexp_replace(F.translate(data, "-_", "+/"), "=+$", "")
    padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-F.length(standard), F.lit(4))))
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def header(headers: Column, name: str) -> Column:
    """The first header so named, or an empty text."""
    return F.coalesce(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"], F.lit(""))


def mail_time(text: Column) -> Column:
    """The moment an RFC 2822 date names (UTC where it names no zone), or null."""
    short = F.regexp_replace(F.regexp_replace(F.btrim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    zoned = F.regexp_replace(F.regexp_replace(short, r"\s+(GMT|UTC|UT|Z)$", " +0000"), r"\s+", " ")
    full = F.when(zoned.rlike(r" [+-]\d{4}$"), zoned).otherwise(F.concat(zoned, F.lit(" +0000")))
    with_seconds = F.regexp_replace(full, r"^(\d{1,2} \w{3} \d{4} \d{1,2}:\d{2}) ", "$1:00 ")
    return F.try_to_timestamp(with_seconds, F.lit("d MMM yyyy H:mm:ss Z"))


def message_time(message: Column) -> Column:
    """When a message came: the API's own time if it is above 0, else the first readable Received stamp, else Date, else the epoch."""
    headers = message["payload"]["headers"]
    own = F.expr("null").cast("timestamp")
    internal = F.try_to_number(message["internalDate"], F.lit("9999999999999999")).cast("bigint")
    stamps = F.transform(F.filter(headers, lambda h: (F.lower(h["name"]) == "received") & h["value"].contains(";")), lambda h: mail_time(F.element_at(F.split(h["value"], ";"), -1)))
    return F.coalesce(own, F.when(internal > 0, F.timestamp_millis(internal)), F.get(F.filter(stamps, lambda s: s.isNotNull()), F.lit(0)), mail_time(header(headers, "Date")), F.timestamp_millis(F.lit(0)))


def parse(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Messages of JSON texts; a text that isn't a message gives nulls."""
    m = F.from_json(F.col(column), SCHEMA)
    parts = _leaves(F.col("m.payload"), DEPTH + 1)
    plain = lambda text: F.replace(text, F.lit("\x00"), F.lit(""))

    def joined(mime: str) -> Column:
        own = F.filter(F.col("parts"), lambda p: (p["mime"] == mime) & p["attachment"].isNull() & p["data"].isNotNull())
        return plain(F.array_join(F.transform(own, lambda p: decoded(p["data"])), "\n"))

    headers = F.col("m.payload.headers")
    return raw.select(F.col(column).alias("raw_json"), m.alias("m")).withColumn("parts", parts).select(
        F.col("m.id").alias("id"),
        F.coalesce("m.threadId", "m.id").alias("thread_id"),
        *(plain(header(headers, h)).alias(n) for h, n in (("From", "from_addr"), ("To", "to_addr"), ("Subject", "subject"))),
        joined("text/plain").alias("body_text"),
        joined("text/html").alias("body_html"),
        message_time(F.col("m")).alias("date"),
        F.coalesce("m.labelIds", F.array().cast("array<string>")).alias("labels"),
        F.coalesce(F.col("m.historyId").cast("bigint"), F.lit(0)).alias("history_id"),
        F.transform(F.filter("parts", lambda p: p["attachment"].isNotNull()), lambda p: F.struct(F.coalesce(p["name"], F.lit("")).alias("filename"), p["mime"].alias("mime_type"), p["attachment"].alias("attachment_id"), F.coalesce(p["size"], F.lit(0)).alias("size"))).alias("attachments"),
        F.col("raw_json"),
        F.coalesce(F.exists("parts", lambda p: p["deeper"]), F.lit(False)).alias("cut"),
    )
