"""Tables that micro-batches keep: the newest row of each key, and rows stored once.

A table of newest rows is Parquet parts by key hash under ``data/v=<batch>`` and, per batch, a
log ``log/v=<batch>`` that names every part, the batch that wrote it and its rows. Readers open
the parts that the newest log names, so a read costs the same after ten batches as after a
million. The driver sees one row per part, of about ``PART_ROWS`` rows each.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.scratch import exists, remove
from keelson.sources.sinks import newest

KEY = ["platform", "market_id"]
#: Hash bits that tell the parts of a new table apart.
START = 3
#: A part that would hold more is split by further bits when a batch touches it.
PART_ROWS = 1_000_000
#: Logs kept, with the parts they name: the last batch may run again, and a reader may be one batch behind.
KEEP = 2

_LOG = "depth int, bucket long, at long, n long, v long"


class Part(NamedTuple):
    """The rows whose hash ends in the ``depth`` bits of ``bucket``; ``at`` is the batch that wrote them, -1 if there are none."""

    depth: int
    bucket: int
    at: int
    n: int

    @property
    def name(self) -> str:
        return f"d{self.depth}b{self.bucket}"

    def folder(self, path: str) -> str:
        return f"{path}/data/v={self.at}/_part={self.name}"


def logs(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[Part]]:
    """The parts by log version, of the few versions kept."""
    found: dict[int, list[Part]] = {}
    if exists(spark, f"{path}/log"):
        rows = spark.read.schema(_LOG).json(f"{path}/log")
        for depth, bucket, at, n, v in rows.where("v is not null" if before is None else F.col("v") < before).collect():
            found.setdefault(v, []).append(Part(depth, bucket, at, n))
    return found


def _placed(rows: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """Rows with the ``_depth, _bucket`` of the one planned part that holds their ``_hash``, and ``_to``;
    those that none holds are out."""
    index = rows.sparkSession.createDataFrame(plan, "_depth int, _bucket long, _to int")
    places = F.array(*(F.struct(F.lit(d).alias("_depth"), F.col("_hash").bitwiseAND(F.lit((1 << d) - 1)).alias("_bucket")) for d in sorted({p[0] for p in plan})))
    return rows.withColumn("_at", F.explode(places)).select(*rows.columns, "_at.*").join(F.broadcast(index), ["_depth", "_bucket"])


def _hashed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("_hash", F.xxhash64(*by))


def _load(spark: SparkSession, path: str, parts: list[Part]) -> DataFrame | None:
    folders = [p.folder(path) for p in parts if p.at >= 0]
    return spark.read.parquet(*folders) if folders else None


def newest_version(spark: SparkSession, path: str, before: int | None = None, holding: DataFrame | None = None) -> DataFrame:
    """The rows of a table kept by ``merge_into``, as the last batch (under ``before``) left them.

    ``holding`` has the columns that deal the table's parts; only parts that may hold one of its
    rows are read. A table that was never written to is an error.
    """
    found = logs(spark, path, before)
    if not found:
        raise ValueError(f"no batch was merged into {path}")
    parts = found[max(found)]
    if holding is None:
        return _load(spark, path, parts)
    touched = _placed(_hashed(holding, holding.columns), [(p.depth, p.bucket, p.depth) for p in parts]).select("_depth", "_bucket").distinct()
    wanted = {tuple(r) for r in touched.collect()}
    some = _load(spark, path, [p for p in parts if (p.depth, p.bucket) in wanted])
    return _load(spark, path, parts).limit(0) if some is None else some


def merge_into(path: str, key: list[str] = KEY, order: tuple[str, ...] = ("ts", "event_id"), by: list[str] | None = None, part_rows: int = PART_ROWS, keep: int = KEEP) -> Callable[[DataFrame, int], None]:
    """A merge ``(batch, number)`` that keeps the newest row of each key, the last by ``order``.

    Parts are dealt by the hash of ``by`` (some of the key's columns, else all). A batch reads and
    writes the parts that its keys fall in, splits those that grew over ``part_rows``, then writes
    its log, which alone makes them count, and removes what only logs older than the last
    ``keep`` name. A batch that runs again starts from the log before it and writes the same; an
    empty one writes nothing. Null keys are a key like any other; columns that a batch lacks
    in older parts read as null.
    """
    by = by or key

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = _hashed(newest(batch, key, *order), by).persist()
        try:
            before = logs(spark, path, number)
            parts = before[max(before)] if before else [Part(START, b, -1, 0) for b in range(1 << START)]
            plan = [(p.depth, p.bucket, p.depth) for p in parts]
            incoming = {(d, b): n for d, b, n in _placed(fresh, plan).groupBy("_depth", "_bucket").count().collect()}
            if not incoming:
                return
            touched = [p for p in parts if (p.depth, p.bucket) in incoming]
            plan = [(p.depth, p.bucket, p.depth + math.ceil(math.log2(max(1.0, (p.n + incoming[p.depth, p.bucket]) / part_rows)))) for p in touched]
            old = _load(spark, path, touched)
            rows = fresh if old is None else fresh.unionByName(_hashed(old, by), allowMissingColumns=True)
            part: Column = F.concat(F.lit("d"), F.col("_to"), F.lit("b"), F.col("_hash").bitwiseAND(F.expr("shiftleft(1L, _to) - 1L")))
            # one shuffle: rows dealt by part are dealt by (part, key)
            dealt = _placed(rows, plan).withColumn("_part", part).drop("_depth", "_bucket", "_to", "_hash").repartition("_part")
            newest(dealt, ["_part", *key], *order).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/data/v={number}")
            written = dict(map(tuple, spark.read.parquet(f"{path}/data/v={number}").groupBy("_part").count().collect()))
        finally:
            fresh.unpersist()
        split = [Part(to, b + (i << d), -1, 0) for d, b, to in plan for i in range(1 << (to - d))]
        split = [p._replace(at=number, n=written[p.name]) if p.name in written else p for p in split]
        after = [p for p in parts if (p.depth, p.bucket) not in incoming] + split
        spark.createDataFrame(after, "depth int, bucket long, at long, n long").coalesce(1).write.mode("overwrite").json(f"{path}/log/v={number}")
        _vacuum(spark, path, {**before, number: after}, keep)

    return merge


def _vacuum(spark: SparkSession, path: str, versions: dict[int, list[Part]], keep: int) -> None:
    """Remove the logs before the last ``keep`` and the parts that they alone name; a vacuum that
    was stopped half way is ended by the next."""
    last = sorted(versions)[-keep:]
    named = {(p.at, p.name) for v in last for p in versions[v]}
    for v in sorted(set(versions) - set(last)):
        for p in versions[v]:
            if p.at >= 0 and (p.at, p.name) not in named:
                remove(spark, p.folder(path) if any(at == p.at for at, _ in named) else f"{path}/data/v={p.at}")
        remove(spark, f"{path}/log/v={v}")


def store_new(rows: DataFrame, path: str, key: list[str], at: str) -> None:
    """Append rows whose key is not stored yet, whatever batch they came with.

    ``at`` is a timestamp of the key; rows are kept by its day. Stored keys are looked up only in
    the days that ``rows`` have, and there only in files and row groups whose times meet theirs
    (they are written in order of time), so a lookup does not grow with what is stored. Rows
    without a time are one day of their own, null keys are keys like any other.
    """
    spark = rows.sparkSession
    dated = rows.withColumn("_day", F.to_date(at)).persist()
    try:
        days, low, high, undated = dated.agg(F.collect_set(F.col("_day").cast("string")), F.min(at), F.max(at), F.count_if(F.col(at).isNull())).first()
        if exists(spark, path):
            stored = spark.read.parquet(path)
            within = F.col("_day").cast("date").isin([F.lit(d).cast("date") for d in days]) & F.col(at).between(F.lit(low), F.lit(high)) if days else F.lit(False)
            if undated:
                within = within | F.col("_day").isNull()
            seen = stored.where(within).select(*key).alias("s")
            same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
            fresh = dated.dropDuplicates(key).alias("r").join(seen, same, "left_anti")
        else:
            fresh = dated.dropDuplicates(key)
        fresh.sortWithinPartitions("_day", at).write.mode("append").partitionBy("_day").parquet(path)
    finally:
        dated.unpersist()
