"""Text out of files: by type and ending, for plain text, HTML, tables, calendars and archives of them."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TEXT, MOST_LINES, LEAST_HTML = 50_000, 500, 80
MOST_MEMBERS, MOST_ARCHIVE, MOST_MEMBER_BYTES = 20, 100_000, 10 << 20
#: Which reader a type goes to, and which an ending where the type says nothing.
TYPES = {"text/plain": "text", "text/markdown": "text", "text/html": "html", "text/csv": "table", "text/calendar": "calendar", "application/zip": "archive", "application/ics": "calendar"}
ENDINGS = {".txt": "text", ".md": "text", ".log": "text", ".html": "html", ".htm": "html", ".csv": "table", ".ics": "calendar", ".zip": "archive"}


class _Reader(html.parser.HTMLParser):
    """Title, text, and the text of main parts of a page, without scripts and styles."""

    def __init__(self):
        super().__init__()
        self.skip, self.main, self.in_title = 0, [], False
        self.title, self.text, self.inside, self.data, self.in_json = [], [], [], [], False

    def handle_starttag(self, tag, attrs):
        told = dict(attrs)
        if tag in ("script", "style", "noscript"):
            self.skip += 1
            self.in_json = tag == "script" and "json" in (told.get("type") or "")
        elif tag == "title":
            self.in_title = True
        elif tag in ("article", "main") or told.get("role") == "main":
            self.main.append(tag)
        elif self.main and tag == self.main[-1]:
            self.main.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip, self.in_json = max(0, self.skip - 1), False
        elif tag == "title":
            self.in_title = False
        elif self.main and tag == self.main[-1]:
            self.main.pop()

    def handle_data(self, data):
        if self.in_json:
            self.data.append(data)
        elif self.skip:
            return
        elif self.in_title:
            self.title.append(data)
        else:
            self.text.append(data)
            if self.main:
                self.inside.append(data)


def _page(source: str) -> _Reader:
    reader = _Reader()
    reader.feed(source)
    reader.close()
    return reader


def _line(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def html_to_text(source: str) -> str:
    """All text of a page, white space collapsed, without scripts and styles."""
    page = _page(source)
    return _line([*page.title, *page.text])


def main_text(source: str, least: int = 250) -> str:
    """Title and main part of a page; the whole body if that is short; texts inside embedded JSON if that is short too."""
    page = _page(source)
    title, body = _line(page.title), _line(page.inside)
    if len(body) < least:
        body = max(body, _line(page.text), key=len)
    if len(body) < least:
        told = [w for block in page.data for w in re.findall(r'"(?:text|body|description|content|articleBody|headline|name|title)"\s*:\s*"((?:[^"\\]|\\.){20,})"', block)]
        body = max(body, _line([w.encode().decode("unicode_escape", "ignore") for w in told]), key=len)
    return f"{title}\n\n{body}" if title and body else title or body


def calendar_text(source: str) -> str | None:
    """Events of a calendar as lines: at most ten attendees, descriptions of 500 characters."""
    lines = re.sub(r"\r?\n[ \t]", "", source).splitlines()
    out, now = [], None
    for line in lines:
        name, _, value = line.partition(":")
        name = name.partition(";")[0].upper()
        value = value.replace("\\n", "\n").replace("\\,", ",").replace("\\;", ";")
        if line.strip().upper() == "BEGIN:VEVENT":
            now = {}
        elif line.strip().upper() == "END:VEVENT" and now is not None:
            attendees = now.get("ATTENDEE", [])
            shown = [("Event", "SUMMARY"), ("Location", "LOCATION"), ("Start", "DTSTART"), ("End", "DTEND"), ("Organizer", "ORGANIZER")]
            event = [f"{label}: {now[key][0]}" for label, key in shown if now.get(key, [""])[0]]
            event += [f"Attendees: {', '.join(attendees[:10])}" if len(attendees) > 1 else f"Attendee: {attendees[0]}"] if attendees else []
            event += [f"Description: {now['DESCRIPTION'][0][:500]}"] if now.get("DESCRIPTION", [""])[0] else []
            out.append("\n".join(event))
            now = None
        elif now is not None:
            now.setdefault(name, []).append(value)
    return "\n\n".join(out) or None


def kind_of(mime: str | None, name: str) -> str | None:
    """The reader of a file: by type, or by ending where the type is general or missing."""
    low = name.lower()
    by_ending = next((k for e, k in ENDINGS.items() if low.endswith(e)), None)
    return by_ending if not mime or mime == "application/octet-stream" else TYPES.get(mime.lower().split(";")[0].strip())


def _archive(data: bytes) -> str | None:
    out, size = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in [i for i in z.infolist() if not i.is_dir()][:MOST_MEMBERS]:
            unsafe = info.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", info.filename)
            kind = kind_of(None, info.filename)
            if unsafe or info.file_size > MOST_MEMBER_BYTES or kind in (None, "archive"):
                continue
            text = text_of(kind, z.read(info))
            if text:
                out.append(f"[{info.filename}]\n{text}"[: MOST_ARCHIVE - size])
                size += len(out[-1])
            if size >= MOST_ARCHIVE:
                break
    return "\n\n".join(out) or None


def text_of(kind: str | None, data: bytes) -> str | None:
    """What a reader makes of a file, or None for nothing worth keeping and for files it can't read."""
    if kind is None:
        return None
    if kind == "archive":
        try:
            return _archive(data)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
            return None
    source = data.decode("utf-8", "replace")
    if kind == "html":
        text = html_to_text(source)
        return text[:MOST_TEXT] if len(text) >= LEAST_HTML else None
    if kind == "table":
        return "\n".join(source.strip().split("\n")[:MOST_LINES]) or None
    if kind == "calendar":
        return calendar_text(source)
    return source.strip()[:MOST_TEXT] or None


def extracted(files: DataFrame, name: str = "path", content: str = "content", mime: str | None = None) -> DataFrame:
    """(path, kind, text) of files as Spark's ``binaryFile`` reader gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [kind_of(m, n) for m, n in zip(batch["mime"], batch["path"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "kind": kinds, "text": [text_of(k, bytes(c)) for k, c in zip(kinds, batch["content"], strict=True)]})

    own = files.select(F.col(name).alias("path"), F.col(content).alias("content"), (F.col(mime) if mime else F.lit(None)).cast("string").alias("mime"))
    return own.mapInPandas(run, "path string, kind string, text string")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))


def main_texts(pages: DataFrame, id: str = "page_id", source: str = "html") -> DataFrame:
    """(id, title and main text) of pages."""
    kind = pages.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [main_text(h or "") for h in batch["source"]]})

    return pages.select(F.col(id).alias("id"), F.col(source).alias("source")).mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id)
