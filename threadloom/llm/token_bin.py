"""Token ids on disk in as few bits as the vocabulary needs.

A file holds the ids of consecutive documents as one bit stream in blocks of 4096
ids, a table with each block's byte offset, and for each document its id and where
its tokens end.  The width is fixed, so numpy unpacks a block at once and any
token is found from its number alone.

Layout, little-endian: magic ``TLTB1``, a byte with the width, int64 documents, tokens and
blocks; the blocks; int64 block offsets, document ids and ends; a byte for each document
whose id is null.  Files are written under temporary names and moved; the manifest, written last, lists them.

A shard's file is closed after so many ids, so what a task holds is bounded.

Null text is an empty one (only the end id); null ids come first; equal document ids
stand side by side, ordered by text (by digests first, where one id fills shards of its
own); an empty table gives no files.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.bpe import Memo, Vocabulary, encode_texts
from threadloom.llm.shards import with_shard
from threadloom.llm.words import buffers, chunks

MAGIC = b"TLTB1"
BLOCK = 4096
#: Bytes of text in a shard, ids after which a file is closed.
SHARD_BYTES = 24 << 20
FILE_TOKENS = 8 << 20
#: Pieces and characters a task remembers the ids of, pieces of a text the library gets at once.
_MEMO, _MEMO_CHARACTERS = 300_000, 6 << 20
_RUN = 2000
_HEAD = struct.Struct("<5sBqqq")
_MANIFEST = "file string, shard int, sequence int, documents long, tokens long, bytes long"


def width_of(vocabulary: int) -> int:
    """Bits that hold ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8)
    spread = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_file(out, ids: np.ndarray, keys: list[int | None], ends: np.ndarray, bits: int) -> int:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = _HEAD.size + np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
    out.write(_HEAD.pack(MAGIC, bits, len(keys), len(ids), len(blocks)))
    for b in blocks:
        out.write(b)
    tail = offsets.astype("<i8").tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + ends.astype("<i8").tobytes() + bytes(k is None for k in keys)
    out.write(tail)
    return int(offsets[-1]) + len(tail)


class TokenFile:
    """Random access to a file's tokens and documents."""

    def __init__(self, data: bytes):
        magic, self.bits, documents, self.tokens, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        at = len(data) - documents * 17 - (blocks + 1) * 8
        self.offsets = np.frombuffer(data, "<i8", blocks + 1, at)
        at += (blocks + 1) * 8
        keys = np.frombuffer(data, "<i8", documents, at)
        self.ends = np.frombuffer(data, "<i8", documents, at + 8 * documents)
        null = data[at + 16 * documents :]
        self.keys = [None if z else int(k) for k, z in zip(keys, null, strict=True)]

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop``, touching only their blocks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        parts = [unpack(self.data[self.offsets[b] : self.offsets[b + 1]], self.bits, min(BLOCK, self.tokens - b * BLOCK)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


@lru_cache(maxsize=1)
def _library(path: str):
    """(a memo over the tokenizers library, its added tokens, the pattern that finds them, vocabulary size)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    width = Vocabulary(path).width

    def joined(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a space and a word part again where they meet, and their lengths tell whose ids are whose."""
        runs = ["".join(found[i : i + _RUN]) for i in range(0, len(found), _RUN)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in found), np.int64, len(found)))
        return ids, np.diff(np.searchsorted(np.cumsum(width[ids]), ends), prepend=-1)

    def each(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(count.sum())), count

    def encode(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces encoded in few calls."""
        meets = np.fromiter((len(p) > 1 and p[0] == " " and not p[1].isspace() for p in found), bool, len(found))
        if meets.all():
            return joined(found)
        count = np.empty(len(found), np.int64)
        parts = [f([p for p, m in zip(found, meets.tolist(), strict=True) if m == side]) for side, f in ((True, joined), (False, each)) if (meets == side).any()]
        sides = [side for side in (True, False) if (meets == side).any()]
        for side, (_, n) in zip(sides, parts, strict=True):
            count[meets == side] = n
        out = np.empty(int(count.sum()), np.int32)
        owner = np.repeat(meets, count)
        for side, (ids, _) in zip(sides, parts, strict=True):
            out[owner == side] = ids
        return out, count

    find = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    return Memo(encode, _MEMO, _MEMO_CHARACTERS), special, find, tokenizer.get_vocab_size()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode ``docs`` and write token files under the shared ``folder`` in ascending key order; the manifest as committed."""
    spark = docs.sparkSession
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    dealt, shard, n = with_shard(rows, "key", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, shard_bytes, F.shiftrightunsigned(F.xxhash64("text"), 32))
    dealt = dealt.repartitionById(n, shard).sortWithinPartitions(shard, "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo, special, find, vocabulary = _library(tokenizer)
        bits = width_of(max(vocabulary, end_id + 1))
        files, path = fs.FileSystem.from_uri(folder)
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        counts: list[np.ndarray] = []
        of, sequence = None, 0

        def close() -> pa.RecordBatch:
            name = f"tokens-{of:06d}-{sequence:05d}.bin"
            part = f"{path}/.{name}.{uuid.uuid4().hex}"
            flat = np.concatenate(ids)
            with files.open_output_stream(part) as out:
                size = write_file(out, flat, keys, np.cumsum(np.concatenate(counts)), bits)
            files.move(part, f"{path}/{name}")
            row = [name], pa.array([of], pa.int32()), pa.array([sequence], pa.int32()), [len(keys)], [len(flat)], [size]
            ids.clear(), keys.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in row], ["file", "shard", "sequence", "documents", "tokens", "bytes"])

        for batch in batches:
            shards = batch.column(2).to_numpy(zero_copy_only=False)
            _, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets, min(4 << 20, 4 * file_tokens)):
                for s in np.unique(shards[i:j]):
                    a, b = i + int(np.searchsorted(shards[i:j], s, "left")), i + int(np.searchsorted(shards[i:j], s, "right"))
                    if keys and (s != of or sum(map(len, ids)) >= file_tokens):
                        yield close()
                        sequence += 1
                    if s != of:
                        of, sequence = int(s), 0
                    flat, count = encode_texts(memo, [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], find, special)
                    ids.append(np.insert(flat, np.cumsum(count), end_id))
                    counts.append(count + 1)
                    keys += batch.column(0).slice(a, b - a).to_pylist()
        if keys:
            yield close()

    dealt.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of each document in the manifest's files."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("tokens").over(W.orderBy("shard", "sequence").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.select("file", before.alias("start")).repartition(max(1, manifest.count()), "file")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{path}/{name}") as f:
                    own = TokenFile(f.read())
                for a in range(0, len(own.keys), 2000):
                    b = min(a + 2000, len(own.keys))
                    first = int(own.ends[a - 1]) if a else 0
                    flat = own.slice(first, int(own.ends[b - 1])).astype("<u4")
                    edge = np.concatenate([[first], own.ends[a:b]]) - first
                    crc = [zlib.crc32(flat[p:q]) for p, q in zip(edge[:-1], edge[1:], strict=True)]
                    columns = [pa.array(own.keys[a:b], pa.int64()), pa.array(start + first + edge[:-1]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return listed.mapInArrow(run, schema)


__all__ = ["TokenFile", "pack", "read", "unpack", "width_of", "write", "write_file"]
