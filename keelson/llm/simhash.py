"""Near-duplicates by SimHash fingerprints, pruned with pivot distance tables.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it.
Fingerprints link when at most ``MAX_BITS`` bits differ; classes are the components.

Only distinct fingerprints are compared. 64 bits fall into ``BLOCKS`` blocks; two linked
fingerprints agree in at least ``BLOCKS - MAX_BITS`` of them, so each is dealt once for
every such choice of blocks and compared within its bucket alone. A task keeps a table of
the Hamming distances of its fingerprints to ``len(PIVOTS)`` reference fingerprints. A
bucket is sorted by the first distance, so a fingerprint meets only those within
``MAX_BITS`` of it; pairs whose largest coordinate difference is over ``MAX_BITS`` cannot
link (triangle inequality) and are discarded, and the rest verified bit by bit. A task
hands on a spanning forest of the links of its buckets, not the pairs.

A bucket of over ``HOT`` fingerprints is dealt again by sub-blocks of its free bits, of
which one must agree too; one still larger is dealt in pairs of chunks. Both are exact.

Defined cases: a text of fewer words than a shingle is one shingle, one without words has
fingerprint zero and links like any other; nulls have no words; rows with equal texts
share a class; a null id never becomes a class id unless the class has no other.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, flat, mix
from keelson.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = 6
HOT = 4096
CHUNK = 2048
#: Reference fingerprints; any set is right, spread ones discard most.
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64))
_PART_WORDS = 1 << 18


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text's UTF-8 bytes."""
    import xxhash

    digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
    found = raw.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        return digest(b" ".join(found))
    n, total = len(found) - words + 1, np.zeros(64, np.int64)
    for lo in range(0, n, _PART_WORDS):
        part = found[lo : lo + _PART_WORDS + words - 1]
        shingles = map(b" ".join, zip(*(itertools.islice(part, k, None) for k in range(words)), strict=False))
        h = np.fromiter(map(digest, shingles), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _fingerprint_task(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            raw, at = data.tobytes(), at.tolist()
            fps = np.array([fingerprint(raw[a:b], words) for a, b in itertools.pairwise(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return task


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of each row."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_fingerprint_task(words), "doc_id long, fp long")


def _masks(blocks: int, equal: int) -> list[int]:
    """A mask for each choice of ``equal`` of ``blocks`` blocks of the 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(single, equal)]


def _submasks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` parts."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [sum(1 << k for k in free[len(free) * p // parts : len(free) * (p + 1) // parts]) for p in range(parts)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, group: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each group as all of its links do; ``group`` is
    sorted."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    fps, group, table = fps[order], group[order], table[order]
    first, pairs = table[:, 0], []
    row, d = np.arange(len(fps)), 0
    while len(row):
        d += 1
        row = row[row + d < len(fps)]
        row = row[(group[row + d] == group[row]) & (first[row + d] - first[row] <= max_bits)]
        left = row
        for k in range(1, table.shape[1]):
            left = left[np.abs(table[left + d, k] - table[left, k]) <= max_bits]
            if len(left) < 64:
                break
        left = left[np.bitwise_count(fps[left] ^ fps[left + d]) <= max_bits]
        if len(left):
            pairs.append((left, left + d))
    if not pairs:
        return fps[:0], fps[:0]
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    joined = np.flatnonzero(root != np.arange(len(root)))
    return fps[joined], fps[root[joined]]


def _forest_task(max_bits: int):
    """Rows come sorted by their bucket (all columns but the last)."""

    def solve(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        keys = [c.to_numpy() for c in table.columns[:-1]]
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        a, b = forest(table.columns[-1].to_numpy().view(np.uint64), np.cumsum(new), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(c[row].as_py() for c in batch.columns[:-1])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows > 100_000 and key(held[-1], held[-1].num_rows - 1) != key(batch, batch.num_rows - 1):
                last = [c.to_numpy() for c in batch.columns[:-1]]
                same = np.ones(batch.num_rows, bool)
                for c in last:
                    same &= c == c[-1]
                cut_at = int(np.argmax(same))  # the batch's last bucket may go on
                yield solve([*held, batch.slice(0, cut_at)])
                held, rows = [batch.slice(cut_at)], batch.num_rows - cut_at
            else:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield solve(held)

    return task


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """``a, b``: links between distinct fingerprints, joining them as all links would."""
    n_parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = _masks(blocks, blocks - max_bits)
    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("k")) for c, m in enumerate(masks)))).alias("x")).select("x.c", "x.k", "fp")

    def solve(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.select(*keys, "fp").repartition(n_parts, *keys).sortWithinPartitions(*keys).mapInArrow(_forest_task(max_bits), "a long, b long")

    crowded = cut(dealt.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    if crowded.isEmpty():
        return solve(dealt, "c", "k").distinct()
    rest = dealt.join(crowded, ["c", "k"], "left_anti")
    parts = max_bits + 1
    options = F.array(*(F.array(*(F.lit(_long(s)).cast("long") for s in _submasks(m, parts))) for m in masks))
    again = dealt.join(crowded.select("c", "k"), ["c", "k"]).select("c", "k", "fp", F.posexplode(F.element_at(options, F.col("c") + 1)).alias("p", "mask")).select("c", "k", "p", F.col("fp").bitwiseAND(F.col("mask")).alias("s"), "fp")
    keys = ["c", "k", "p", "s"]
    still = cut(again.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    grid = again.join(still.select(*keys, "chunks"), keys).withColumn("mine", mine).select(*keys, "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(*keys, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    fine = again.join(still.select(*keys), keys, "left_anti")
    return solve(rest, "c", "k").unionByName(solve(fine, *keys)).unionByName(solve(grid, *keys, "i", "j")).distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``: the class is named by the
    least id in it."""
    listed = cut(fingerprints(docs, words, id_col, text_col))
    distinct = cut(listed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), max_bits, hot=hot))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return listed.join(classes.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row of each class with the least id, with all its columns; where several rows
    have that id, one of them."""
    names = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, **options))
    kept = names.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("rows")).withColumnRenamed("doc_id", "_keelson_kept")
    rows = docs.join(kept.select("_keelson_kept").hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col("_keelson_kept")), "left_semi")
    return rows if kept.where("rows > 1").isEmpty() else rows.dropDuplicates([id_col])
