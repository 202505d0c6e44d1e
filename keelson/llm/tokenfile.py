"""Token ids of whole corpora in files of patched frame-of-reference blocks.

Documents are dealt by range of their id and sorted inside each partition. A task encodes
its documents, appends the end id, and writes shards of about ``SHARD_IDS`` ids. A shard is
a sequence of blocks of ``BLOCK`` ids: the block's minimum is subtracted, the rest packed at
the bit width that holds the ``PERCENTILE`` lowest values, and values beyond it stand in an
exception list; an index gives the byte where each block starts, so a reader can go to any
id directly. Shards are rows of Parquet files in a shared folder (columns part, part_start,
doc_ids, lengths, payload), written and read only by Spark.

Payload, little-endian: b"PFR1", u32 ids, u32 blocks, u32 byte offset of each block; a
block is u32 minimum, u8 width, u16 exceptions, packed bits, u16 places, u32 values.

Defined cases: a null or empty text is just the end id; an added token's string becomes its
id; rows with one id follow each other, those with none come first; a text longer than a
shard makes a longer shard; further columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import ragged, scratch, slices
from keelson.llm.pretokens import PieceTable, code_points, split

BLOCK = 1024
SHARD_IDS = 1 << 20
PERCENTILE = 97
END_ID = 2
_MAGIC = b"PFR1"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each non-negative value needs."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """A shard's payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return _MAGIC + np.array([0, 0], "<u4").tobytes()
    padded = np.concatenate((ids, np.repeat(ids[-1:], blocks * BLOCK - n))).astype(np.int64).reshape(blocks, BLOCK)
    low = padded.min(axis=1)
    rest = padded - low[:, None]
    bound = np.partition(rest, (kth := PERCENTILE * (BLOCK - 1) // 100), axis=1)[:, kth]
    width = _widths(bound)
    beyond = rest >= (np.int64(1) << width)[:, None]
    out: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        bits = ((rest[rows].astype(np.uint32)[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for r, line in zip(rows.tolist(), packed, strict=True):
            places = np.flatnonzero(beyond[r])
            out[r] = b"".join((low[r].astype("<u4").tobytes(), bytes([w]), np.array(len(places), "<u2").tobytes(), line.tobytes(), places.astype("<u2").tobytes(), rest[r, places].astype("<u4").tobytes()))
    head = 12 + 4 * blocks
    starts = head + np.cumsum([0, *map(len, out[:-1])])
    return b"".join((_MAGIC, np.array([n, blocks], "<u4").tobytes(), starts.astype("<u4").tobytes(), *out))


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids ``first`` up to ``last`` of a shard; only their blocks are read."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a shard of token ids")
    n, blocks = np.frombuffer(payload, "<u4", 2, 4).tolist()
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", blocks, 12).astype(np.int64)
    lo, hi = first // BLOCK, -(-last // BLOCK)
    raw = np.frombuffer(payload, np.uint8)
    own = starts[lo:hi]
    low = raw[own[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint32)
    width, n_beyond = raw[own + 4], raw[own[:, None] + np.arange(5, 7)].copy().view("<u2").ravel().astype(np.int64)
    out = np.empty((hi - lo, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        bits = np.unpackbits(raw[(own[rows] + 7)[:, None] + np.arange(size)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        value = np.zeros((len(rows), BLOCK), np.uint32)
        for k in range(w):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        out[rows] = value
    for r in np.flatnonzero(n_beyond).tolist():
        at, c = int(own[r]) + 7 + BLOCK * int(width[r]) // 8, int(n_beyond[r])
        out[r, np.frombuffer(payload, "<u2", c, at)] = np.frombuffer(payload, "<u4", c, at + 2 * c)
    return (out + low[:, None]).ravel()[first - lo * BLOCK : last - lo * BLOCK]


class Encoder:
    """The tokenizers library over distinct pieces: each piece of a worker is encoded once."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.end_id = end_id
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: Bytes that any id of the vocabulary fits.
        self.id_bytes = 2 if max(self.library.get_vocab().values()) < 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.table = PieceTable(self._encode, 64 << 20, keep=True)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's followed by the end id; their numbers."""
        parts, owner, marks = [], [], []
        for i, text in enumerate(texts):
            if self.special and "<|" in text and (found := self.special.split(text))[1:]:
                for k, part in enumerate(found):
                    if k % 2:
                        marks.append((len(parts), self.added[part]))
                    parts.append("" if k % 2 else part)
                    owner.append(i)
            else:
                parts.append(text)
                owner.append(i)
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        whole = "".join(parts)
        points = code_points(whole)
        begin, end = split(points, at[:-1], "spaced")
        slots = self.table.look_up(whole, points, begin, end)
        counts = self.table.count[slots]
        ids = self.table.ids[ragged(self.table.begin[slots], counts)]
        of = np.repeat(np.searchsorted(at, begin, "right") - 1, counts)
        owner = np.array(owner, np.int64)
        last_part = np.searchsorted(owner, np.arange(len(texts)), "right") - 1
        add_ids = np.array([m[1] for m in marks] + [self.end_id] * len(texts), np.uint32)
        add_of = np.concatenate((np.array([m[0] for m in marks], np.int64), last_part))
        places = np.searchsorted(of, add_of, "right")
        order = np.argsort(add_of, kind="stable")
        ids = np.insert(ids, places[order], add_ids[order])
        return ids, np.bincount(owner[of], minlength=len(texts)) + np.bincount(owner[add_of], minlength=len(texts))


@functools.lru_cache(2)
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    return Encoder(path, end_id)


_FILE = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


SHARDS = "part int, part_start long, doc_ids array<long>, lengths array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in ascending id order into the files at ``path``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), encoder(tokenizer_path)
        start, held, doc_ids, lengths = 0, [], [], []

        def shard() -> pa.RecordBatch:
            columns = [[part], [start], [[i for x in doc_ids for i in x.to_pylist()]], [np.concatenate(lengths).tolist()], [pack(np.concatenate(held))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FILE, strict=True)], schema=_FILE)

        for batch in batches:
            for lo, hi in slices(batch.column(1), 3 << 20):  # more text, fewer pieces looked up twice
                ids, counts = own.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                held.append(ids)
                doc_ids.append(batch.column(0).slice(lo, hi - lo))
                lengths.append(counts)
                if (size := sum(map(len, held))) >= SHARD_IDS:
                    yield shard()
                    start, held, doc_ids, lengths = start + size, [], [], []
        if held:
            yield shard()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an id that many rows share is dealt by its texts' hashes
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("_h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ordered.select("doc_id", "text").mapInArrow(task, SHARDS).write.option("compression", "uncompressed").parquet(path)


def read(spark, path: str) -> DataFrame:
    """``part, part_start, doc_ids, lengths, payload`` of the shards at ``path``."""
    return spark.read.schema(SHARDS).parquet(path)


def documents_of(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files alone.

    A shard knows where it starts in its partition; partitions' totals (one row for each
    task that wrote) are added up in id order and joined back.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["payload"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(raw[a : a + c]) for a, c in zip(starts.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()), pa.array(row["part_start"] + starts), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"])

    docs = shards.mapInArrow(task, "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long")
    # one small row per task that wrote; parts are numbered in id order
    sizes = shards.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("part_before"))
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("part_before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    path = path or scratch(docs.sparkSession)
    write(docs, path, tokenizer_path)
    return documents_of(read(docs.sparkSession, path))
