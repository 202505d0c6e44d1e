"""Language identification by nearest centroids.

A text becomes hashed counts of its 1- to 4-byte grams (A-Z folded, other ASCII that is no
letter one space, grams of spaces alone left out), log-scaled, weighted by inverse document
frequency and normalised. Each language has several centroids, found by spherical k-means. A
text takes the language of the centroid with the highest cosine; its score weighs that
against other languages' best. It is rejected when its cosine is below what nearly all
sample texts of that language and about its length show, and when no letter is in it.

Document frequencies count every row that may be learned from. Centroids and rejection
limits are fitted on about ``SAMPLE`` ids of each language, a task a language; the driver sees
the model alone, half a megabyte a language. Limits come from cosines with
centroids of the half of the sample that a text is not in (equal texts share a half).

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected;
without any row to learn from, so is every text; ties go to the language that sorts first;
a language with sample texts in one half only has no limit; very long texts are counted
alone; rows with equal or null ids are judged by their own texts; further columns aren't
read, and pass through ``keep_identified``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import flat, slices
from keelson.llm.sampling import per_class

DIM = 1 << 15
GRAMS = (1, 2, 3, 4)
SAMPLE = 500
CENTROIDS = 4
#: A limit is this share of this quantile of the cosines of so many texts of like length.
SHARE, QUANTILE, LIKE = 0.75, 0.01, 100
#: Limits by the power of two of a text's bytes that are no space.
BANDS = 16
SHARPNESS = 25.0
UNKNOWN = "und"
_ROWS = 64
#: Document frequencies are added up in blocks of so many grams.
_BLOCK = 512

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_FOLD[65:91] += 32
_LETTER = re.compile(r"[^\W\d_]")


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed gram counts of each text of a flat array, by row."""
    n, rows = len(data), len(at) - 1
    if not n:
        return np.zeros((rows, DIM), np.float32)
    folded = _FOLD[data]
    blank = folded == 32
    owner = np.repeat(np.arange(rows), np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    gram, empty, places = np.zeros(n, np.uint64), np.ones(n, bool), []
    for k in range(min(max(GRAMS), n)):
        gram = gram[: n - k] * np.uint64(257) + folded[k:]
        empty = empty[: n - k] & blank[k:]
        fits = (left[: n - k] > k) & ~empty
        place = ((gram[fits] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (DIM - 1).bit_length())
        places.append(owner[: n - k][fits] * DIM + place.astype(np.int64))
    return np.bincount(np.concatenate(places), minlength=rows * DIM).astype(np.float32).reshape(rows, DIM)


def bands(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The length band of each text of a flat array."""
    solid = np.concatenate(([0], np.cumsum(_FOLD[data] != 32)))
    return np.minimum(np.log2(np.maximum(np.diff(solid[at]), 1)).astype(np.int64), BANDS - 1)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of gram counts."""
    x = np.zeros_like(tf)
    some = np.flatnonzero(tf)
    x.reshape(-1)[some] = np.log1p(tf.reshape(-1)[some]) * idf[some % DIM]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: by language and length band
    least: np.ndarray

    def best(self, tf: np.ndarray) -> np.ndarray:
        """The highest cosine of each row with each language."""
        cosine = weighted(tf, self.idf) @ self.centroids.T
        return np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(column), 2 << 20):
            for first in range(lo, hi, _ROWS):
                yield batch.slice(first, min(_ROWS, hi - first))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Rows with each gram, and all rows: blocks of sums per task, added up by block."""
    schema = "block int, n binary"

    def emit(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + _BLOCK, np.int64)
        for part in _chunks(batches, 0):
            total[:DIM] += (counts(*flat(part.column(0))) > 0).sum(axis=0)
            total[DIM] += part.num_rows
        yield emit(dict(enumerate(total.reshape(-1, _BLOCK))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(n, np.int64)
        yield emit(sums)

    found = np.zeros((DIM // _BLOCK + 1, _BLOCK), np.int64)
    for block, n in texts.mapInArrow(task, schema).repartition("block").mapInArrow(add, schema).collect():
        found[block] = np.frombuffer(n, np.int64)
    return found.reshape(-1)[:DIM], int(found[-1, 0])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart rows."""
    centre = x.mean(axis=0)
    chosen = [int(np.argmax(x @ centre))]
    while len(chosen) < min(k, len(x)):
        far = (x @ x[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(far)))
    c = x[chosen]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _limits(x: np.ndarray, half: np.ndarray, band: np.ndarray, centroids: int) -> np.ndarray:
    """The least cosine of each length band, from texts that meet the other half's centroids."""
    if not (half == 0).any() or not (half == 1).any():
        return np.full(BANDS, -1.0)
    cosine = np.zeros(len(x))
    for k in (0, 1):
        cosine[half == k] = (x[half == k] @ _cluster(x[half != k], centroids).T).max(axis=1)
    out = []
    for b in range(BANDS):
        away = np.abs(band - b)
        # all of the band, with those of the nearest bands where it has too few
        reach = next((r for r in range(BANDS) if (away <= r).sum() >= LIKE), BANDS)
        out.append(SHARE * np.quantile(cosine[away <= reach], QUANTILE))
    return np.array(out)


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """A model from ``text`` and ``lang`` of the rows of ``docs`` where ``learnable``."""
    known = docs.select("doc_id", "text", "lang").where(learnable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    frequency, n = _document_frequencies(known.select("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 1):
            keep = has_letter(part.column(1).to_pylist())
            tf, band = counts(*flat(part.column(1)))[keep], bands(*flat(part.column(1)))[keep]
            langs = part.column(0).filter(pa.array(keep))
            some = [np.flatnonzero(r) for r in tf]
            columns = [langs, pa.array(band), pa.array([i.astype(np.int32).tobytes() for i in some], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(tf, some, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "band", "gram", "tf"])

    # an id that repeats gives one text of each of its languages
    texts = per_class(known, "lang", sample).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = texts.select("lang", "text").mapInArrow(task, "lang string, band long, gram binary, tf binary")
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + np.float32(0.05)
    found = sorted(rows.groupBy("lang").applyInArrow(_language_of(idf, centroids), "lang string, centroids binary, least binary").collect())
    if not found:
        return None
    each = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIM) for r in found]
    least = np.stack([np.frombuffer(r["least"], np.float64) for r in found])
    return Model([r["lang"] for r in found], idf, np.concatenate(each), np.repeat(np.arange(len(each)), [len(c) for c in each]), least)


def _language_of(idf: np.ndarray, centroids: int) -> Callable[[pa.Table], pa.Table]:
    """Centroids and limits from the sample texts of one language, in one task."""

    def one(table: pa.Table) -> pa.Table:
        own = sorted(zip(*(table.column(c).to_pylist() for c in ("gram", "tf", "band")), strict=True))  # however tasks return them
        tf = np.zeros((len(own), DIM), np.float32)
        for to, (gram, count, _) in zip(tf, own, strict=True):
            to[np.frombuffer(gram, np.int32)] = np.frombuffer(count, np.float32)
        x = weighted(tf, idf)
        del tf
        least = _limits(x, np.array([zlib.crc32(g + c) % 2 for g, c, _ in own]), np.array([b for *_, b in own]), centroids)
        return pa.table({"lang": table.column("lang").slice(0, 1), "centroids": [_cluster(x, centroids).astype(np.float32).tobytes()], "least": [least.astype(np.float64).tobytes()]})

    return one


def _judge(part: pa.Array, model: Model | None) -> tuple[np.ndarray, ...]:
    """Language, score, cosine and rejection of each text."""
    n = len(part)
    named = has_letter(part.to_pylist())
    if model is None:
        named[:] = False
    lang, score, cosine, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n), np.ones(n, bool)
    if named.any():
        best = model.best(counts(*flat(part))[named]).astype(np.float64)
        pick = np.argmax(best, axis=1)
        top = best[np.arange(len(pick)), pick]
        lang[named] = np.array(model.languages, object)[pick]
        score[named] = 1 / np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
        cosine[named] = top
        rejected[named] = top < model.least[pick, bands(*flat(part))[named]]
    return lang, score, cosine, rejected


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, cosine, rejected`` of each row; no shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 1):
            lang, score, cosine, rejected = _judge(part.column(1), model)
            columns = [part.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def _held_out() -> Column:
    return F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cosine, rejected`` of each row of ``docs``,
    learned from the rows whose id's crc32 modulo 3 is not 1."""
    model = fit(docs.select("doc_id", "text", "lang"), ~_held_out(), **options)
    return predict(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; no shuffle."""
    model = fit(docs.select("doc_id", "text", "lang"), ~_held_out(), **options)
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, place):
            yield part.filter(pa.array(~_judge(part.column(place), model)[3]))

    return docs.mapInArrow(task, docs.schema)
