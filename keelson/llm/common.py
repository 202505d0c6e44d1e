"""Helpers shared by the operators: whole texts as flat arrays, hashes, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keelson.sources.scratch import cut, folder as scratch  # noqa: F401

#: Bytes of text that a task turns into arrays at once; one longer text is taken alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Codes that are hashed or compared at once.
_BLOCK = 1 << 16


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, so that long texts don't pile up in a task. Set for
    the session, for the DataFrames that queries return run after them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    # a step that ends in a written table no longer needs its shuffle files
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each starts (one more than texts);
    a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together take about ``limit`` bytes."""
    _, at = flat(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each span, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _walk(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The codes of many spans in blocks that stay in cache: of each code its span and its
    place in it; where the block's (parts of) spans begin in the block, and whose they are.
    Empty spans are left out."""
    parts = -(-lengths // _BLOCK)
    owner = np.repeat(np.arange(len(lengths)), parts)
    skip = ragged(np.zeros(len(lengths), np.int64), parts) * _BLOCK
    size = np.minimum(lengths[owner] - skip, _BLOCK)
    ends, lo = np.cumsum(size), 0
    while lo < len(owner):
        before = ends[lo] - size[lo]
        hi = max(int(np.searchsorted(ends, before + _BLOCK, "right")), lo + 1)
        at = ends[lo:hi] - size[lo:hi] - before
        place = np.arange(int(ends[hi - 1] - before)) + np.repeat(skip[lo:hi] - at, size[lo:hi])
        yield np.repeat(owner[lo:hi], size[lo:hi]), place, at, owner[lo:hi]
        lo = hi


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``codes[start:end]`` (codes under 2**21): the sum of a mixed
    value for each (place, code). It is no polynomial, so no pattern of texts cancels out."""
    out = np.full(len(starts), seed, np.uint64)
    salt = mix(np.array([2 * seed + 1], np.uint64))[0]
    for span, place, at, owner in _walk(ends - starts):
        value = mix((place.astype(np.uint64) << _U(21) | codes[starts[span] + place]) ^ salt)
        np.add.at(out, owner, np.add.reduceat(value, at))
    return mix(out + (ends - starts).astype(np.uint64))


def equal_spans(codes: np.ndarray, starts: np.ndarray, other_starts: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether every span has the codes of the span of that length at ``other_starts``."""
    return all((codes[starts[span] + place] == codes[other_starts[span] + place]).all() for span, place, _, _ in _walk(lengths))


def first_equal(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each span the first span with the same codes. Spans with equal hashes are compared
    code by code; should two differ, all are hashed anew with another seed."""
    lengths, seed = ends - starts, 0
    while True:
        first = first_of(span_hashes(codes, starts, ends, seed))
        again = np.flatnonzero(first != np.arange(len(first)))
        if (lengths[first] == lengths).all() and equal_spans(codes, starts[again], starts[first[again]], lengths[again]):
            return first
        seed += 1


def first_of(keys: np.ndarray) -> np.ndarray:
    """Of each key the place of the first key equal to it."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    steps = np.full((2, n), [[_BASE], [_BASE_INV]], np.uint64)
    steps[:, :1] = 1
    return np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The ASCII white space of the contracts, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none across a boundary in ``starts``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[starts[(starts >= 0) & (starts <= n)]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0
