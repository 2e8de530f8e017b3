"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by page, digests and headers made anew from the payload,
each record a gzip member, and files rolled by compressed size.  A file is written
under a temporary name and moved to its final one; only files in the manifest,
written last, count.  A task that runs again writes the same bytes to the same
names, so lost executors and repeated attempts change nothing.

Of records with equal payloads of at least ``least_bytes`` the one with the
largest page id is a response, the others are revisits that name it.  Null html
is an empty payload, a null page id ranks below all others, rows that repeat both
page and payload keep one response, an empty table gives no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shards import with_shard

#: Bytes of payload in a shard, compressed bytes in a file, zlib's level, the date all records carry.
SHARD_BYTES = 24 << 20
FILE_BYTES = 16 << 20
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "file string, shard int, sequence int, records long, bytes long, sha256 string"


def record_id(page: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}/{nth}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: int) -> bytes:
    """One record, headers and all, as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest, nth)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head += [f"X-Page: {page}"] if page is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


class _Roller:
    """Files of a shard, each under a temporary name until it is whole."""

    def __init__(self, folder: str, limit: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.shard = limit, None, None

    def put(self, shard: int, data: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.limit):
            yield self.close()
        if shard != self.shard:
            self.shard, self.sequence = shard, 0
        if self.out is None:
            self.name = f"pages-{shard:06d}-{self.sequence:05d}.warc.gz"
            self.part = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sum = self.files.open_output_stream(self.part), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.files.move(self.part, f"{self.folder}/{self.name}")
        self.out = None
        self.sequence += 1
        return {"file": self.name, "shard": self.shard, "sequence": self.sequence - 1, "records": self.records, "bytes": self.size, "sha256": self.sum.hexdigest()}


def write(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under the shared ``folder``; the manifest as committed."""
    spark = pages.sparkSession
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    small = rows.select("page_id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    kept = small.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = small.join(kept, "digest").where("page_id IS DISTINCT FROM keep").select("page_id", "digest", "keep").distinct()
    # a page's decision sorts right before the page, so one shuffle of the payloads does
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("keep"), "url", "html").unionByName(
        revisits.select("page_id", "digest", F.lit(0).alias("kind"), "keep", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    )
    dealt, shard, n = with_shard(both, "page_id", F.octet_length("html") + 512, shard_bytes, F.conv(F.substring("digest", 1, 8), 16, 10), rows)
    dealt = dealt.repartitionById(n, shard).sortWithinPartitions(shard, "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, decision, nth = _Roller(folder, file_bytes), None, None, 0
        for batch in batches:
            made: list[dict] = []
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for page, digest, kind, keep, url, html, of in zip(*columns, batch.column(6).to_pylist(), strict=True):
                if (page, digest) != last:
                    last, decision, nth = (page, digest), None, 0
                if kind == 0:
                    decision = (keep,)
                    continue
                payload = html.encode()
                again = nth > 0 and len(payload) >= least_bytes
                revisit = decision is not None or again
                made += roller.put(of, record(page, url, payload, decision[0] if decision else page, revisit, nth))
                nth += 1
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
        if roller.out is not None:
            yield pa.RecordBatch.from_pylist([roller.close()], schema)

    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("sequence", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    dealt.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        yield head, block


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, html string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in the folder's manifest; a revisit has no html.

    A response's payload is checked against its digest and length.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    listed = manifest.select("file").repartition(max(1, manifest.count()), "file")
    columns = [c.split()[0] for c in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[tuple] = []
                weight = 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name}: a payload doesn't match its digest")
                        page, to = head.get("X-Page"), head.get("X-Refers-To-Page")
                        html = payload.decode() if head["WARC-Type"] == "response" else None
                        held.append((int(page) if page else None, head["WARC-Target-URI"], size, digest, head["WARC-Type"], int(to) if to else None, head["WARC-Record-ID"], html))
                        weight += len(payload) + 200
                        if weight > 8 << 20:
                            yield _batch(held, columns)
                            held, weight = [], 0
                if held:
                    yield _batch(held, columns)

    return listed.mapInArrow(run, _READ)


def _batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.string())) for c, x in zip(columns, zip(*rows, strict=True), strict=True)], columns)
