"""Lloyd's clustering with vectors sharded by dimension, in exact integers.

Every vector component becomes an integer, and each Arrow batch of vectors a chunk, cut into blocks
of columns: one row per (chunk, shard). The blocks are written once, bucketed by (shard, chunk). A
round is three steps, joined in one job:

1. tasks over blocks compute squared distances of a block to their shard's slice of the centroids,
   exact in 64 bits and stored as narrow as they fit;
2. the shards' partial distances of a chunk are added up, and each vector takes the nearest centroid;
3. the labels go back to the buckets of every shard, where each adds up its own columns by cluster
   and replaces its own slice of the centroids by floors of exact means.

Centroids stay a table (shard, cluster, dim, value); the driver sees only whether any value changed.
Rounds end early once none does, for later ones would change nothing. Per vector a round
shuffles the narrow partial distances and one label per shard, never the vectors.

Defined cases: rows with a null vector, another number of components, or a null or non-finite
component are left out; rows that repeat, or have no id, are vectors of their own (a null id is
written as an empty string for the choice of starts); equal hashes go by components; a component
whose distances might not fit 64 bits is an error; fewer vectors than clusters make fewer clusters;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import cut, scratch

#: Columns of a block.
SHARD_COLUMNS = 32
#: Bytes of centroids up to which their slices are broadcast.
BROADCAST_BYTES = 32 << 20

_BLOCK = "chunk long, shard int, ids array<long>, width int, block binary"


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Integers in the fewest bytes (1, 2, 4 or 8) that hold them all."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return width, values.astype(f"<i{width}").tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").astype(np.int64)


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, v array<long>``: the vectors with ``dims`` finite components, as floors of ``scale`` times each."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    bound = math.sqrt(2.0**63 / dims) / 2 - 2  # dims * (2 * bound)**2 fits
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double") * F.lit(float(scale))) < bound, F.floor(x.cast("double") * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits")).cast("long")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v).where((F.size(v) == dims) & finite).select("id", whole.alias("v"))


def starts(whole: DataFrame, k: int, order: Column) -> DataFrame:
    """``shard, cluster, dim, value`` of the first ``k`` vectors in ``order``."""
    first = whole.select(order.alias("o"), "v").orderBy("o", "v").limit(k)  # the k rows, sorted per task first
    numbered = first.select((F.row_number().over(Window.orderBy("o", "v")) - 1).alias("cluster"), "v")
    return numbered.select("cluster", F.posexplode("v").alias("at", "value")).select(F.floor(F.col("at") / SHARD_COLUMNS).cast("int").alias("shard"), "cluster", F.col("at").alias("dim"), "value")


def column_blocks(whole: DataFrame) -> DataFrame:
    """One row per chunk of vectors and shard of columns; the ids go with shard 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            values = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            shards = range(0, values.shape[1], SHARD_COLUMNS)
            packed = [_narrow(values[:, a : a + SHARD_COLUMNS]) for a in shards]
            n = len(packed)
            columns = [[chunk] * n, [*range(n)], [batch.column(0).to_pylist()] + [None] * (n - 1), [w for w, _ in packed], [b for _, b in packed]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "shard", "ids", "width", "block"])
            chunk += 1

    return whole.select("id", "v").mapInArrow(task, _BLOCK)


def partial_distances(block: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centroid, exact: as products of doubles where
    those hold every sum, else column by column in 64-bit integers."""
    most = max(int(np.abs(block).max(initial=0)), int(np.abs(slice_).max(initial=0)))
    if 4 * block.shape[1] * most * most < 1 << 53:
        x, c = block.astype(np.float64), slice_.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.zeros((len(block), len(slice_)), np.int64)
    for at in range(block.shape[1]):
        out += (block[:, at, None] - slice_[:, at]) ** 2
    return out


def _distances(blocks: DataFrame, slices: DataFrame, *more: str) -> DataFrame:
    """``chunk, width, part`` of every block, ``part`` its distances; ``more`` columns go along."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, block, k, values in zip(*(batch.column(n).to_pylist() for n in ("width", "block", "k")), batch.column("slice"), strict=True):
                slice_ = values.values.to_numpy().reshape(k, -1)
                out.append(_narrow(partial_distances(_wide(block, width).reshape(-1, slice_.shape[1]), slice_)))
            columns = [batch.column("chunk"), batch.column("k"), pa.array([w for w, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(n) for n in more)], ["chunk", "k", "width", "part", *more])

    kinds = {"ids": "array<long>"}
    return blocks.select("chunk", "shard", "width", "block", *more).join(slices, "shard").mapInArrow(task, ", ".join(["chunk long, k int, width int, part binary", *(f"{n} {kinds[n]}" for n in more)]))


def _added(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's partial distances from all shards: the nearest centroids, and how far they are."""
    k = parts.column("k")[0].as_py()
    total = sum(_wide(b, w) for b, w in zip(parts.column("part").to_pylist(), parts.column("width").to_pylist(), strict=True)).reshape(-1, k)
    label = total.argmin(1)  # the smaller number of equally near ones
    return label, total[np.arange(len(total)), label]


def _labels(parts: pa.Table) -> pa.Table:
    width, raw = _narrow(_added(parts)[0])
    return pa.table({"chunk": parts.column("chunk")[:1], "label_width": pa.array([width], pa.int32()), "labels": pa.array([raw], pa.binary())})


def _assigned(parts: pa.Table) -> pa.Table:
    label, far = _added(parts)
    ids = next(x for x in parts.column("ids").to_pylist() if x is not None)
    return pa.table({"id": pa.array(ids, pa.int64()), "cluster": pa.array(label, pa.int32()), "distance": pa.array(far, pa.int64())})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of each cluster and column that a task's blocks hold."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for shard, width, block, label_width, labels in zip(*(batch.column(n).to_pylist() for n in ("shard", "width", "block", "label_width", "labels")), strict=True):
            label = _wide(labels, label_width)
            values = _wide(block, width).reshape(len(label), -1)
            order = np.argsort(label, kind="stable")
            names, at, counts = np.unique(label[order], return_index=True, return_counts=True)
            for c, total, n in zip(names.tolist(), np.add.reduceat(values[order], at), counts.tolist(), strict=True):
                entry = held.setdefault((shard, c), [0, 0])
                entry[0], entry[1] = entry[0] + total, entry[1] + n
    for (shard, c), (total, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([c], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["shard", "cluster", "total", "n"])


def _slices(centroids: DataFrame, k: int, dims: int) -> DataFrame:
    """``shard, k, slice``: a shard's columns of all centroids, in order of cluster and column."""
    one = F.sort_array(F.collect_list(F.struct("cluster", "dim", "value")))
    slices = centroids.groupBy("shard").agg(F.transform(one, lambda x: x["value"]).alias("slice"), F.count_distinct("cluster").cast("int").alias("k"))
    return F.broadcast(slices) if k * dims * 8 <= BROADCAST_BYTES else slices


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``id, cluster, distance`` of every vector, and the ``shard, cluster, dim, value`` of the centroids.

    Centroids start at the ``k`` vectors whose ``<seed>:<id>`` has the least SHA-256; each of ``rounds``
    assigns all vectors and moves every centroid that has any; then vectors are assigned once more.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dims, scale, id_col, vector_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"keelson_blocks_{uuid.uuid4().hex}"
    column_blocks(whole).repartition(n, "shard", "chunk").write.bucketBy(n, "shard", "chunk").sortBy("shard", "chunk").option("path", scratch(spark)).saveAsTable(name)
    blocks = spark.table(name)
    n_shards = -(-dims // SHARD_COLUMNS)
    centroids = cut(starts(whole, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)))
    for _ in range(rounds):
        parts = _distances(blocks, _slices(centroids, k, dims))
        labels = parts.groupBy("chunk").applyInArrow(_labels, "chunk long, label_width int, labels binary").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        sums = blocks.join(labels, ["shard", "chunk"]).select("shard", "width", "block", "label_width", "labels").mapInArrow(_sums, "shard int, cluster int, total array<long>, n long")
        added = sums.select("shard", "cluster", "n", F.posexplode("total").alias("at", "s")).groupBy("shard", "cluster", (F.col("shard") * SHARD_COLUMNS + F.col("at")).alias("dim")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        moved = added.select("shard", "cluster", "dim", F.expr("(s - pmod(s, n)) div n").alias("to"))
        nxt = cut(centroids.join(moved, ["shard", "cluster", "dim"], "left").select("shard", "cluster", "dim", F.coalesce("to", "value").alias("value"), (F.col("to") != F.col("value")).alias("changed")))
        centroids = nxt.drop("changed")
        if nxt.where("changed").isEmpty():
            break
    out = cut(_distances(blocks, _slices(centroids, k, dims), "ids").groupBy("chunk").applyInArrow(_assigned, "id long, cluster int, distance long"))
    spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder
    return out, centroids


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid``: ``lloyd`` with what is known of
    each cluster, one small row for each joined back."""
    assigned, centroids = lloyd(vectors, k, rounds, dims, scale, seed, id_col, vector_col)
    whole = centroids.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("centroid"))
    sizes = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # at most k rows, in one window
    rows = sizes.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())).join(whole, "cluster")
    return assigned.join(F.broadcast(rows) if k * dims * 8 <= BROADCAST_BYTES else rows, "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """DuckDB SQL for the registered query: every round a pair of tables."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"x AS MATERIALIZED (SELECT r, unnest(range({dims})) AS dim, unnest(v) AS value FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster, v FROM kept QUALIFY cluster < {k})",
        f"c0 AS MATERIALIZED (SELECT cluster, unnest(range({dims})) AS dim, unnest(v) AS value FROM first)",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT r, cluster, CAST(sum((x.value - c.value) * (x.value - c.value)) AS BIGINT) AS far FROM x JOIN c{t} c USING (dim) GROUP BY r, cluster)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, cluster, far FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, cluster) = 1)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT cluster, dim, CAST(sum(value) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{t} USING (r) GROUP BY cluster, dim)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.cluster, c.dim, coalesce((s - ((s % n) + n) % n) // n, value) AS value FROM c{t} c LEFT JOIN m{t} m ON c.cluster = m.cluster AND c.dim = m.dim)")
    parts.append(f"names AS (SELECT cluster, sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    end = f"""SELECT vec_id, cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, centroid_sha256
      FROM a{rounds} JOIN kept USING (r) JOIN names USING (cluster)"""
    return "WITH " + ",\n".join(parts) + "\n" + end
