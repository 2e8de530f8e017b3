"""Language identification by a blended-spectrum string kernel.

Two texts are as alike as the n-grams (one to three bytes of the lower-cased
text, everything but letters read as a space) that both contain, by presence:
|x & y| / sqrt(|x| |y|).  Nystroem landmarks, the same number for each language,
stand for the feature space; one-versus-rest kernel ridge regression on them is
fitted to a bounded sample of labelled rows, and rows are scored in batches by
two matrix products.  Grams no landmark has count in |x| alone.

Null text and text without any letter: ``und`` with score 0.  Without labelled
rows every prediction is ``und``.  Ties go to the language first in code-point order.
A column of the input named as one of the results gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.shared import free_name, held, small_batches
from threadloom.llm.words import buffers, chunks

#: Labelled rows that the fit may see, for each language and in all; landmarks among them, and the ridge.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 8000
LANDMARKS_PER_LANGUAGE = 48
RIDGE = 1e-2
UNDETERMINED = "und"

_CODE = np.full(256, 0x20, np.uint8)
_CODE[0x80:] = np.arange(0x80, 0x100)
_CODE[65:91] = np.arange(97, 123)
_CODE[97:123] = np.arange(97, 123)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all n-grams of the rows, the row of each): bytes side by side in 24 bits."""
    code = _CODE[data[offsets[0] : offsets[-1]]].astype(np.int32)
    at = (offsets - offsets[0]).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    ids, rows = [code], [row]
    for n in (2, 3):
        if len(code) >= n:
            same = row[: len(row) - n + 1] == row[n - 1 :]
            g = code[: len(code) - n + 1].copy()
            for k in range(1, n):
                g |= code[k : len(code) - n + 1 + k] << (8 * k)
            ids.append(g[same])
            rows.append(row[: len(row) - n + 1][same])
    return np.concatenate(ids), np.concatenate(rows)


@dataclass
class Model:
    """Languages, the gram ids landmarks have (ascending), their presence matrix and the ridge weights."""

    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, present: np.ndarray, other: np.ndarray | int = 0) -> np.ndarray:
        """Of rows with the grams ``present`` and ``other`` more that no landmark has."""
        size = np.maximum(present.sum(1) + other, 1.0)
        own = np.maximum(self.landmarks.sum(1), 1.0)
        return (present @ self.landmarks.T) / np.sqrt(size[:, None] * own[None, :]).astype(np.float32)

    def scores(self, present: np.ndarray, other: np.ndarray | int = 0) -> np.ndarray:
        return self.kernel(present, other) @ self.weights


def fit_rows(languages: list[str], rows: list[tuple[str, np.ndarray]], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Fit to (language, distinct gram ids) rows; the first of each language are its landmarks."""
    marks: list[int] = []
    for x in languages:
        marks += [k for k, (lang, _) in enumerate(rows) if lang == x][:landmarks_per_language]
    vocabulary = np.unique(np.concatenate([rows[k][1] for k in marks])) if marks else np.zeros(0, np.int32)

    def presence(which: list[int]) -> np.ndarray:
        p = np.zeros((len(which), len(vocabulary)), np.float32)
        for r, k in enumerate(which):
            at = np.searchsorted(vocabulary, rows[k][1])
            at = at[at < len(vocabulary)]
            p[r, at[vocabulary[at] == rows[k][1][: len(at)]]] = 1
        return p

    def sizes(which: range) -> np.ndarray:
        return np.array([len(rows[k][1]) for k in which])

    model = Model(languages, vocabulary, presence(marks), np.zeros((len(marks), len(languages)), np.float32))
    if marks:
        # each language weighs the same, however many rows it has
        lang = np.array([languages.index(x) for x, _ in rows])
        weight = 1.0 / np.bincount(lang, minlength=len(languages))[lang]
        weight *= len(rows) / weight.sum()
        k_nm = []
        for i in range(0, len(rows), 256):
            own = range(i, min(i + 256, len(rows)))
            present = presence(list(own))
            k_nm.append(model.kernel(present, sizes(own) - present.sum(1)))
        k_nm = np.concatenate(k_nm).astype(np.float64)
        k_mm = model.kernel(model.landmarks).astype(np.float64)
        y = np.where(lang[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
        a = k_nm.T @ (weight[:, None] * k_nm) + ridge * k_mm + 1e-6 * np.eye(len(marks))
        model.weights = np.linalg.solve(a, k_nm.T @ (weight[:, None] * y)).astype(np.float32)
    return model


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit to about ``sample_per_language`` rows of each non-null ``lang``, fewer where there are very many languages.

    Rows are drawn by a hash of ``key``; only their distinct gram ids, at most some
    thousands a row, reach the driver, never texts.
    """
    small_batches(df.sparkSession)
    labelled = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.crc32(F.concat_ws("#", F.lit("language sample"), F.col(key).cast("string"))).alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit_rows([], [])
    sample_per_language = min(sample_per_language, max(1, SAMPLE // len(counts)))
    limit = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(int(min(1.0, sample_per_language / n) * (1 << 32))))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            own = []
            for i, j in chunks(offsets):
                ids, row = grams(data, offsets[i : j + 1])
                both = np.unique(row.astype(np.int64) << 24 | ids)
                cut = np.searchsorted(both, np.arange(j - i + 1) << 24)
                own += [both[a:b] & 0xFFFFFF for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.int32()))], ["lang", "h", "grams"])

    sample = labelled.where(F.col("h") < limit[F.col("lang")]).mapInArrow(distinct, "lang string, h long, grams array<int>").collect()
    rows = sorted(((r["lang"], r["h"], r["grams"]) for r in sample), key=lambda r: (r[0], r[1], r[2]))
    return fit_rows(sorted(counts), [(x, np.array(g, np.int32)) for x, _, g in rows if g])


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """``df`` with the predicted language and its score (0 to 1)."""
    df = df.drop(lang, score)
    small_batches(df.sparkSession)
    letter = free_name(df, "__has_letter")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    out = T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    block = max(1, (8 << 20) // max(1, 4 * len(model.vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language model")
        column_of = np.full(1 << 24, -1, np.int16 if len(model.vocabulary) < 1 << 15 else np.int32)
        column_of[model.vocabulary] = np.arange(len(model.vocabulary))
        for batch in batches:
            data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
            n = batch.num_rows
            best, value = np.full(n, len(model.languages)), np.zeros(n)
            for i, j in chunks(offsets) if model.languages else ():
                for a in range(i, j, block):
                    b = min(a + block, j)
                    ids, row = grams(data, offsets[a : b + 1])
                    at = column_of[ids]
                    has = at >= 0
                    present = np.zeros((b - a, len(model.vocabulary)), np.float32)
                    present[row[has], at[has]] = 1
                    unseen = np.unique(row[~has].astype(np.int64) << 24 | ids[~has])
                    f = model.scores(present, np.bincount(unseen >> 24, minlength=b - a))
                    best[a:b] = f.argmax(1)
                    value[a:b] = np.clip((f.max(1) + 1) / 2, 0, 1)
            ok = batch.column(batch.schema.get_field_index(letter)).fill_null(False).to_numpy(zero_copy_only=False)
            best[~ok], value[~ok] = len(model.languages), 0.0
            value = np.nan_to_num(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), pa.array(names[best], pa.string()), pa.array(value)], out.names)

    return df.withColumn(letter, F.col(text).rlike(r"\p{L}")).mapInArrow(run, out)


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of a key's decimal text, modulo ``folds``; a null key counts as an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds
