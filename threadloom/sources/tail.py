"""A stream source of lines that are still being written: files of a folder are followed by byte, a line begun is waited for.

The offset is how far each file has been read, always just behind a line's end; so it
lives in the stream's checkpoint, a restart goes on there, and the unfinished end of a file
is read again with what follows it.  A file that has become shorter begins anew.  New parts
of large files are read in ranges by as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE, STEP = 64 << 20, 1 << 20


class LineTail(DataSource):
    """``spark.readStream.format("line_tail").option("path", folder)``: (file, at, line), ``at`` being the byte the line begins at."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


@dataclass
class _Piece(InputPartition):
    """The lines of ``file`` that begin in [start, stop); the part read so far ends at ``start`` if it is ``first``."""

    file: str
    start: int
    stop: int
    end: int
    first: bool


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path.removeprefix(root).lstrip("/"): _last_line_end(system, f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", "."))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for file, stop in sorted(end.items()):
            at = start.get(file, 0)
            at = 0 if at > stop else at
            out += [_Piece(file, a, min(a + self.most, stop), stop, a == at) for a in range(at, stop, self.most)]
        return out

    def read(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(f"{root.rstrip('/')}/{piece.file}") as source:
            at, held = piece.start, b""
            if not piece.first:  # the line before belongs to the range it began in
                at, held = _after_line_end(source, piece.start - 1, piece.end), b""
            begins, lines = [], []
            where = at
            while at < piece.stop and where < piece.end:
                source.seek(where)
                data = source.read(min(STEP, piece.end - where))
                where += len(data)
                *whole, held = (held + data).split(b"\n")
                for line in whole:
                    if at < piece.stop:
                        begins.append(at)
                        lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([piece.file] * len(lines)), pa.array(begins, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])
                    begins, lines = [], []

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the files are the history."""


def _last_line_end(system: fs.FileSystem, path: str, size: int) -> int:
    """How many bytes there are up to and with the last line end."""
    with system.open_input_file(path) as source:
        stop = size
        while stop > 0:
            start = max(0, stop - STEP)
            source.seek(start)
            found = source.read(stop - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            stop = start
    return 0


def _after_line_end(source: pa.NativeFile, at: int, end: int) -> int:
    """Where the next line begins, looking from ``at`` on."""
    while at < end:
        source.seek(at)
        data = source.read(min(STEP, end - at))
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return end
