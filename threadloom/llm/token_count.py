"""Token counts of a unigram tokenizer without its tokens.

The vocabulary is a public piece file read as a unigram model: its piece scores
are the log weights.  A text is cut at spaces, each part marked in front, as the
public library's metaspace splitting does; in a part, Aho-Corasick enumerates
the pieces that end at each byte and a Viterbi pass carries only the best score
and its piece count.  Ties go to the path whose last piece begins first.  A
character no piece covers costs the least score less ten and counts as its
UTF-8 bytes (byte fallback).

Null or empty text: 0.  Texts without spaces are one part, however long: once few
parts are left in step, each goes on alone in a plain loop.  A memo of bounded size
holds counts of short parts met before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.llm.automaton import automaton
from threadloom.llm.words import buffers, chunks

MARK = "▁"
#: Parts the memo holds, their longest length, and how many parts at most go on one by one.
_MEMO, _MEMO_LENGTH = 600_000, 64
_FEW = 24


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a sentencepiece file with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


class Counter:
    """Viterbi counts of many parts at once, a byte of each part a step."""

    def __init__(self, pieces: list[tuple[str, float]]):
        data = [p.encode() for p, _ in pieces]
        self.score = np.array([s for _, s in pieces], np.float64)
        self.width = np.array([len(b) for b in data], np.int64)
        self.unknown = float(self.score.min()) - 10.0
        self.go, self.row, self.longest, shorter = automaton([(b, k) for k, b in enumerate(data)])
        self.shorter = np.full(len(data), -1, np.int64)
        for k, s in shorter.items():
            self.shorter[k] = s
        self.reach = 1 << int(self.width.max() + 4).bit_length()

    def _alone(self, part: bytes, t: int, state: int, char: int, best: list[float], pieces: list[int]) -> int:
        """The count of ``part`` from byte ``t`` on; ``best`` and ``pieces`` hold the last ``reach`` nodes by place modulo ``reach``."""
        go, row, longest, shorter, width, value = map(memoryview, (self.go, self.row, self.longest, self.shorter, self.width, self.score))
        last, n, unknown, none = self.reach - 1, len(part), self.unknown, -np.inf
        for t in range(t, n):
            byte = part[t]
            state = go[row[state] + byte]
            char = char + 1 if byte & 0xC0 == 0x80 else 1
            top, total, alone = none, 0, False
            piece = longest[state]
            while piece >= 0:
                w = width[piece]
                came = t + 1 - w & last
                score = best[came] + value[piece]
                if score > top:
                    top, total = score, pieces[came] + 1
                alone |= w == char
                piece = shorter[piece]
            if not alone:
                came = t + 1 - char & last
                if best[came] + unknown > top:
                    top, total = best[came] + unknown, pieces[came] + char
            if t + 1 < n and part[t + 1] & 0xC0 == 0x80:
                top = none  # no piece ends inside a character
            best[t + 1 & last], pieces[t + 1 & last] = top, total
        return pieces[n & last]

    def count(self, parts: list[bytes]) -> np.ndarray:
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        if not len(parts) or not length.sum():
            return np.zeros(len(parts), np.int64)
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        start = (np.cumsum(length) - length)[order]
        at_node = start + order  # a node before each byte and one after the last
        best = np.full(len(data) + len(parts), -np.inf)
        pieces = np.zeros(len(best), np.int64)
        best[at_node] = 0.0
        state, char = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        upto = np.searchsorted(-length[order], -np.arange(int(length.max())), "left")
        out = np.empty(len(parts), np.int64)
        for t, n in enumerate(upto):
            if n <= _FEW:
                for p in range(n):
                    known = np.arange(max(0, t + 1 - self.reach), t + 1)
                    at = at_node[p] + known
                    held = [0.0] * self.reach, [0] * self.reach
                    for k, b, c in zip((known & (self.reach - 1)).tolist(), best[at].tolist(), pieces[at].tolist(), strict=True):
                        held[0][k], held[1][k] = b, c
                    out[order[p]] = self._alone(parts[order[p]], t, int(state[p]), int(char[p]), *held)
                order = order[n:]
                at_node = at_node[n:]
                break
            byte = data[start[:n] + t]
            state[:n] = self.go[self.row[state[:n]] + byte]
            char[:n] = np.where((byte & 0xC0) == 0x80, char[:n] + 1, 1)
            node = at_node[:n] + t + 1
            top, total = np.full(n, -np.inf), np.zeros(n, np.int64)
            alone = np.zeros(n, bool)
            piece = self.longest[state[:n]].astype(np.int64)
            who = np.flatnonzero(piece >= 0)
            while len(who):
                p = piece[who]
                came = node[who] - self.width[p]
                score = best[came] + self.score[p]
                better = score > top[who]
                top[who[better]], total[who[better]] = score[better], pieces[came[better]] + 1
                alone[who] |= self.width[p] == char[who]
                piece[who] = self.shorter[p]
                who = who[piece[who] >= 0]
            bare = np.flatnonzero(~alone)
            if len(bare):
                came = node[bare] - char[bare]
                score = best[came] + self.unknown
                better = score > top[bare]
                top[bare[better]], total[bare[better]] = score[better], (pieces[came] + char[bare])[better]
            if t + 1 < len(upto):
                # no piece ends inside a character
                following = np.flatnonzero(length[order[:n]] > t + 1)
                inside = following[(data[start[following] + t + 1] & 0xC0) == 0x80]
                top[inside] = -np.inf
            best[node], pieces[node] = top, total
        out[order] = pieces[at_node + length[order]]
        return out


@lru_cache(maxsize=1)
def _counter(path: str) -> tuple[Counter, dict[str, int]]:
    return Counter(unigram_pieces(path)), {}


def count_texts(counter: Counter, memo: dict[str, int], texts: list[str]) -> np.ndarray:
    parts: list[str] = []
    each = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t:
            own = t.split(" ")
            parts += own if own[0] else own[1:]
            each[k] = len(own) - (not own[0])
    if len(memo) > _MEMO:
        memo.clear()
    due = [p for p in set(parts) if p not in memo]
    now = dict(zip(due, counter.count([(MARK + p).encode() for p in due]).tolist(), strict=True))
    long = {p: n for p, n in now.items() if len(p) > _MEMO_LENGTH}
    memo.update((p, n) for p, n in now.items() if p not in long)
    upto = np.concatenate([[0], np.cumsum(np.fromiter((memo[p] if len(p) <= _MEMO_LENGTH else long[p] for p in parts), np.int64, len(parts)))])
    edge = np.concatenate([[0], np.cumsum(each)])
    return upto[edge[1:]] - upto[edge[:-1]]


def token_counts(df: DataFrame, model_path: str, text: str = "text", count: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``df`` with the number of unigram tokens of ``text``; a column already named ``count`` gives way."""
    df = df.drop(count)
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    out = T.StructType([*fields, T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, memo = _counter(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = buffers(column)
            for i, j in chunks(offsets, 4 << 20):
                n = count_texts(counter, memo, column.slice(i, j - i).to_pylist())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in fields), pa.array(n)], out.names)

    return df.mapInArrow(run, out)
