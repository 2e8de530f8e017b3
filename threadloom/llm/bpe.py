"""Byte-level BPE by backtracking, and decoding by an offset table.

The encoder finds, with an Aho-Corasick automaton, every vocabulary token that
begins at each byte of a pre-token, walks them longest first, and accepts a token
only if its boundary with the token before survives the merge order: that test,
kept in a pair-compatibility table, needs only the right edge of the left token
and the left edge of the right one.  A byte position found to lead nowhere is
never tried again, so the work is linear in the bytes.

Results per case: null text is empty, an empty text has no ids, the vocabulary's
added special tokens are matched in the text first, as the public library does.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.llm.automaton import automaton
from threadloom.llm.shared import held, small_batches
from threadloom.llm.words import buffers, chunks, mix

_NEVER = 1 << 60
#: Pieces and characters a memo holds, pairs the scalar path remembers, and how many words at most go on one by one.
_MEMO, _MEMO_CHARACTERS = 100_000, 4 << 20
_PAIRS = 1 << 18
_FEW = 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks and added tokens of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(to_byte[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.formed: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            if whole not in self.parts:
                self.parts[whole], self.formed[whole] = pair, r
        self.ids = {t: i for i, t in enumerate(self.token) if t and i not in set(self.special.values())}
        self.width = np.array([len(t) for t in self.token], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.width)])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)


# The split pattern of the public byte-level vocabularies, and its
# classes written out for texts whose characters all lie below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE_ALL = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SLOW = regex.compile(PATTERN.replace(r"(?!\S)", f"(?![^{_SPACE_ALL}])").replace(r"\s", "\0").replace("[^\0", f"[^{_SPACE_ALL}").replace("\0", f"[{_SPACE_ALL}]"))
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_HIGH = re.compile("[^\x00-ɏ]")
_UNSAFE = re.compile(r"\s (?!\S)")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of ``text``, in order."""
    return (_SLOW if _HIGH.search(text) else _FAST).findall(text)


def pieces(text: str) -> list[str]:
    """``text`` cut only where the split pattern always cuts: before a space that begins a word.

    Where spaces meet other white space the cut could fall elsewhere; such texts
    go through the pattern itself.
    """
    if _UNSAFE.search(text):
        return pretokens(text)
    out = text.split(" ")
    first = out[0]
    out = [" " + x for x in out]
    out[0] = first
    return out if first else out[1:]


class Encoder:
    """Exact merges of many pre-tokens at once.

    All words take their steps together: each numpy operation advances every word
    that isn't finished, so a step costs some nanoseconds a word.  Once few words
    are left (very long ones), each goes on alone in a plain loop.
    """

    CACHE_BITS = 20

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        ranks = sorted((a << 20 | b, r) for (a, b), r in v.rank.items())
        self.rank_key = np.array([k for k, _ in ranks], np.int64)
        self.rank_value = np.array([r for _, r in ranks], np.int64)
        edges = [self._edges(side) for side in (0, 1)]
        (self.left_at, self.left, self.left_until), (self.right_at, self.right, self.right_until) = edges
        self.tables = [memoryview(x) for x in (self.right, self.right_until, self.left, self.left_until, self.rank_key, self.rank_value)]
        self.cache_key = np.full(1 << self.CACHE_BITS, -1, np.int64)
        self.cache_value = np.zeros(1 << self.CACHE_BITS, bool)
        self.pairs: dict[int, bool] = {}
        tokens = self._reachable()
        # over reversed tokens: read from the right, its state at a byte knows the longest token that begins there
        self.go, self.row, self.longest, _ = automaton([(v.token[i][::-1], i) for i in tokens])
        shorter = np.full(len(v.token), -1, np.int32)
        known = {v.token[i]: i for i in tokens}
        for t, i in known.items():
            shorter[i] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        self.shorter = shorter
        special = sorted(v.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _edges(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces at an edge of each token from its outermost byte up, and the rank at which each is merged into the next."""
        start, piece, until = [0], [], []
        for token in range(len(self.v.token)):
            up, rank, x = [], _NEVER, token
            while True:
                up.append((x, rank))
                if x not in self.v.parts:
                    break
                rank, x = self.v.formed[x], self.v.parts[x][side]
            for x, rank in reversed(up):
                piece.append(x)
                until.append(rank)
            start.append(len(piece))
        return np.array(start), np.array(piece, np.int64), np.array(until, np.int64)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary of a and b before both are whole."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        i, j = self.right_at[a], self.left_at[b]
        while len(live):
            x_until, y_until = self.right_until[i], self.left_until[j]
            key = self.right[i] << 20 | self.left[j]
            at = np.minimum(np.searchsorted(self.rank_key, key), len(self.rank_key) - 1)
            across = np.where(self.rank_key[at] == key, self.rank_value[at], _NEVER)
            crossed = (across < x_until) & (across <= y_until)
            out[live[crossed]] = False
            go = ~crossed & ((x_until < _NEVER) | (y_until < _NEVER))
            first = x_until <= y_until
            i, j, live = (i + first)[go], (j + ~first)[go], live[go]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair-compatibility table, filled as pairs are met."""
        key = a.astype(np.int64) << 20 | b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(64 - self.CACHE_BITS)).astype(np.int64)
        out = self.cache_value[slot]
        lack = np.flatnonzero(self.cache_key[slot] != key)
        if len(lack):
            new, back = np.unique(key[lack], return_inverse=True)
            fits = self._apart(new >> 20, new & 0xFFFFF)
            out[lack] = fits[back]
            own = (mix(new.astype(np.uint64)) >> np.uint64(64 - self.CACHE_BITS)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            last = np.append(own[order][1:] != own[order][:-1], True) if len(own) else np.zeros(0, bool)
            keep = order[last]
            self.cache_key[own[keep]], self.cache_value[own[keep]] = new[keep], fits[keep]
        return out

    def _reachable(self) -> list[int]:
        """Tokens that merging their own bytes ends with."""
        v = self.v
        fine: dict[int, bool] = {}
        for t in sorted(v.parts, key=lambda t: v.formed[t]):
            a, b = v.parts[t]
            fine[t] = fine.get(a, True) and fine.get(b, True) and self._meets(a, b)
        return [i for i in v.ids.values() if fine.get(i, len(v.token[i]) == 1)]

    def _meets(self, a: int, b: int) -> bool:
        """Whether a and b are whole when they meet."""
        right, right_until, left, left_until, *_ = self.tables
        i, j = int(self.right_at[a]), int(self.left_at[b])
        while True:
            x_until, y_until = right_until[i], left_until[j]
            if x_until == y_until == _NEVER:
                return True
            across = self._rank(right[i] << 20 | left[j])
            if across < x_until and across <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _rank(self, key: int) -> int:
        *_, keys, ranks = self.tables
        at = bisect_left(keys, key)
        return ranks[at] if at < len(keys) and keys[at] == key else _NEVER

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, the number of each)."""
        v = self.v
        length = np.fromiter(map(len, words), np.int64, len(words))
        edge = np.concatenate([[0], np.cumsum(length)])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        begins = np.empty(len(data), np.int32)
        order = np.argsort(-length, kind="stable")
        upto = np.searchsorted(-length[order], -np.arange(int(length.max())), "left")
        state, end = np.zeros(len(words), np.int64), edge[1:][order]
        for t, n in enumerate(upto):
            if n <= _FEW:
                for k in range(n):
                    self._begins_alone(data, begins, int(end[k]) - 1 - t, int(end[k] - length[order[k]]), int(state[k]))
                break
            at = end[:n] - 1 - t
            state[:n] = self.go[self.row[state[:n]] + data[at]]
            begins[at] = self.longest[state[:n]]
        stack = np.zeros(len(data) + 1, np.int32)
        dead = np.zeros(len(data) + 1, bool)
        depth = np.zeros(len(words), np.int64)
        live = np.flatnonzero(length > 0)
        at, stop, base = edge[:-1][live].copy(), edge[1:][live], edge[:-1][live]
        candidate, d = begins[at].astype(np.int64), np.zeros(len(live), np.int64)
        while len(live):
            if len(live) <= _FEW:
                for k, word in enumerate(live.tolist()):
                    depth[word] = self._walk_alone(begins, stack, dead, *(int(x[k]) for x in (at, stop, base, candidate, d)))
                break
            has = candidate >= 0
            end = at + np.where(has, v.width[candidate], 0)
            fits = has & ~dead[end]
            check = np.flatnonzero(fits & (d > 0))
            if len(check):
                fits[check] = self.compatible(stack[base[check] + d[check] - 1], candidate[check])
            put = np.flatnonzero(fits)
            stack[base[put] + d[put]] = candidate[put]
            d[put] += 1
            at[put] = end[put]
            over = at == stop
            more = put[~over[put]]
            candidate[more] = begins[at[more]]
            lack = np.flatnonzero(~fits)
            if len(lack):
                candidate[lack] = np.where(has[lack], self.shorter[candidate[lack]], -1)
                back = lack[candidate[lack] < 0]
                if len(back):
                    if (d[back] == 0).any():
                        raise ValueError("the vocabulary lacks a byte")
                    dead[at[back]] = True
                    d[back] -= 1
                    last = stack[base[back] + d[back]]
                    at[back] -= v.width[last]
                    candidate[back] = self.shorter[last]
            if over.any():
                depth[live[over]] = d[over]
                keep = ~over
                live, at, stop, base, candidate, d = live[keep], at[keep], stop[keep], base[keep], candidate[keep], d[keep]
        total = int(depth.sum())
        where = np.repeat(edge[:-1] - (np.cumsum(depth) - depth), depth) + np.arange(total)
        return stack[where], depth

    def _begins_alone(self, data: np.ndarray, begins: np.ndarray, at: int, first: int, state: int) -> None:
        """``begins`` of the bytes of one word from ``at`` back to ``first``."""
        go, row, longest, data, begins = map(memoryview, (self.go, self.row, self.longest, data, begins))
        for at in range(at, first - 1, -1):
            state = go[row[state] + data[at]]
            begins[at] = longest[state]

    def _walk_alone(self, begins: np.ndarray, stack: np.ndarray, dead: np.ndarray, at: int, stop: int, base: int, candidate: int, d: int) -> int:
        """The number of tokens of one word, the tokens themselves on the stack from ``base`` on."""
        width, shorter, begins, stack, dead, pairs = *map(memoryview, (self.v.width, self.shorter, begins, stack, dead)), self.pairs
        while at < stop:
            if candidate >= 0:
                end = at + width[candidate]
                fits = not dead[end]
                if fits and d:
                    key = stack[base + d - 1] << 20 | candidate
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > _PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self._meets(key >> 20, candidate) and self._rank(key) == _NEVER
                if fits:
                    stack[base + d] = candidate
                    d, at = d + 1, end
                    candidate = begins[at] if at < stop else -1
                    continue
                candidate = shorter[candidate]
            if candidate < 0:
                if d == 0:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = True
                d -= 1
                at -= width[stack[base + d]]
                candidate = shorter[stack[base + d]]
        return d

    def encode_pieces(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [pretokens(p) for p in found]
        each = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, count = self.encode([w.encode() for p in parts for w in p])
        upto, edge = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(each)])
        return ids, upto[edge[1:]] - upto[edge[:-1]]


class Memo(dict):
    """Index of a piece's ids in a growing table; pieces not met before are encoded together, and a full memo is emptied between runs of texts."""

    def __init__(self, encode, limit: int = _MEMO, characters: int = _MEMO_CHARACTERS):
        super().__init__()
        self.encode, self.limit, self.most_characters, self.due = encode, limit, characters, []
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.end, self.size, self.characters = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0, 0

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        self.due.append(piece)
        return at

    def _append(self, ids: np.ndarray, count: np.ndarray) -> None:
        used = int(self.end[self.size])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.size + len(count) >= len(self.end):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
        self.flat[used : used + len(ids)] = ids
        self.end[self.size + 1 : self.size + 1 + len(count)] = used + np.cumsum(count)
        self.size += len(count)

    def ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, the number of each)."""
        if len(self) > self.limit or self.characters > self.most_characters:
            self.clear()
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        due, self.due = self.due, []
        if due:
            self._append(*self.encode(due))
            self.characters += sum(map(len, due))
        begin = self.end[at]
        count = self.end[at + 1] - begin
        where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return self.flat[where], count


def encode_texts(memo: Memo, texts: list[str], special: re.Pattern | None, special_ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts one after another, the number of each).

    Added tokens are cut out of a text first; one stands in the memo for itself.
    """
    found: list[str] = []
    per_text = np.empty(len(texts), np.int64)
    marks: list[tuple[int, int]] = []
    for k, t in enumerate(texts):
        before = len(found)
        if special is not None and special.search(t):
            for part in special.split(t):
                if part in special_ids:
                    marks.append((len(found), special_ids[part]))
                    found.append("")
                elif part:
                    found += pieces(part)
        elif t:
            found += pieces(t)
        per_text[k] = len(found) - before
    ids, count = memo.ids(found)
    if marks:
        at = np.array([m for m, _ in marks])
        ids = np.insert(ids, np.concatenate([[0], np.cumsum(count)])[at], [i for _, i in marks])
        count[at] = 1
    upto = np.concatenate([[0], np.cumsum(count)])
    edge = np.concatenate([[0], np.cumsum(per_text)])
    return ids, upto[edge[1:]] - upto[edge[:-1]]


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoder(path: str) -> tuple[Encoder, Memo]:
    return held(("byte-level encoder", path), lambda: _new_encoder(path))


def _new_encoder(path: str) -> tuple[Encoder, Memo]:
    vocabulary = Vocabulary(path)
    encoder = Encoder(vocabulary)
    for built_from in (vocabulary.rank, vocabulary.parts, vocabulary.formed, vocabulary.ids):
        built_from.clear()
    return encoder, Memo(encoder.encode_pieces)


def _schema(df: DataFrame, added: list[tuple[str, T.DataType]], without: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in without] + [T.StructField(n, t) for n, t in added])


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with the column ``ids`` (array of int) of its ``text``.

    A null text has an empty array.  Other columns pass through untouched, and
    without ``keep_text`` the text itself is left out.  A column already named
    ``ids`` gives way.
    """
    df = df.drop(ids)
    small_batches(df.sparkSession)
    out = _schema(df, [(ids, T.ArrayType(T.IntegerType()))], () if keep_text else (text,))
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memo = _encoder(vocabulary_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = buffers(column)
            for i, j in chunks(offsets, 1 << 19):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                flat, count = encode_texts(memo, texts, encoder.special, encoder.v.special)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat, pa.int32()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([lists if n == ids else part.column(part.schema.get_field_index(n)) for n in names], names)

    return df.mapInArrow(run, out)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with the column ``text`` that its ``ids`` stand for.

    The bytes of all tokens lie one after another in one array; an offset table
    says where each begins.  Null ids give an empty text, bytes that are no valid
    UTF-8 the replacement character.  A column already named ``text`` gives way.
    """
    df = df.drop(text)
    small_batches(df.sparkSession)
    out = _schema(df, [(text, T.StringType())], () if keep_ids else (ids,))
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocabulary_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            count = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(count)])
            for i, j in chunks(edge, 1 << 18):
                own = flat[edge[i] : edge[j]].astype(np.int64)
                width = v.width[own]
                upto = np.concatenate([[0], np.cumsum(width)])
                where = np.repeat(v.offset[own] - upto[:-1], width) + np.arange(upto[-1])
                data = v.bytes[where].tobytes()
                cut = upto[edge[i : j + 1] - edge[i]]
                try:
                    data.decode()
                    texts = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)])
                    texts.validate(full=True)
                except (UnicodeDecodeError, pa.ArrowInvalid):
                    texts = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([texts if n == text else part.column(part.schema.get_field_index(n)) for n in names], names)

    return df.mapInArrow(run, out)


__all__ = ["Encoder", "Memo", "Vocabulary", "decode", "encode", "encode_texts", "pieces", "pretokens"]
