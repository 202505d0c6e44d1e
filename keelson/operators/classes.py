"""One-to-one choice where many rows are alike: over classes of rows instead of pairs of rows.

Rows of a side that have the same edges are a class, and an edge links two classes. In the order
of a, each row takes the free b it prefers: the least ``pref`` of an edge, then the least b. The
taken rows of a class are always its first, so the state of a class is one number, and n x n
edges of alike rows are never made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.operators.graph import components
from keelson.sources.scratch import cut

#: Rows and edges that one task of a choice holds.
GROUP_ROWS = 500_000


def classed(rows: DataFrame, ord_col: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """``class, ord`` of every row, and ``class, by...`` of every class of rows alike in ``by``; a class
    is named by its least ``ord``."""
    kinds = rows.groupBy(*by).agg(F.min(ord_col).alias("class"))
    members = rows.alias("r").join(kinds.alias("k"), [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by])
    return members.select("class", F.col(f"r.{ord_col}").alias("ord")), kinds


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with their ``place`` (from 0) in ``order`` among those of one ``key``, however many
    share it: rows are dealt by ranges, numbered in each, and ranges of a key are added up."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, key, order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = sizes.select(key, "_part", (F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1
    return ranged.withColumn("_own", own).join(before, [key, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias("place"))


_OUT = "a_ord long, a_class long, b_ord long, b_class long"


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    """The choice of one group, given as rows of a (``side`` 0: ord, class), of b (1) and edges (2:
    class, to, pref)."""
    rows = rows.sort_values(["side", "pref", "ord"], kind="stable")
    a, b, e = (rows[rows["side"] == k] for k in (0, 1, 2))
    supply = {c: [g.to_numpy(), 0] for c, g in b.groupby("class")["ord"]}
    wants: dict[int, list] = {}
    for c, to, pref in zip(e["class"].tolist(), e["to"].tolist(), e["pref"].tolist(), strict=True):
        if to in supply:
            steps = wants.setdefault(c, [])
            if not steps or steps[-1][0] != pref:
                steps.append((pref, []))
            steps[-1][1].append(to)
    for steps in wants.values():
        steps.reverse()  # what is used up goes from the end
    out = []
    for i, c in zip(a["ord"].tolist(), a["class"].tolist(), strict=True):
        steps = wants.get(c)
        while steps:
            tied = steps[-1][1]
            left = [t for t in tied if supply[t][1] < len(supply[t][0])] if len(tied) > 1 or supply[tied[0]][1] >= len(supply[tied[0]][0]) else tied
            if left:
                steps[-1] = (steps[-1][0], left)
                best = min(left, key=lambda t: supply[t][0][supply[t][1]]) if len(left) > 1 else left[0]
                own = supply[best]
                out.append((i, c, int(own[0][own[1]]), best))
                own[1] += 1
                break
            steps.pop()
    return pd.DataFrame(out, columns=["a_ord", "a_class", "b_ord", "b_class"]).astype(np.int64)


def choose(a: DataFrame, b: DataFrame, edges: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``a_ord, a_class, b_ord, b_class`` of the choice among ``a(class, ord)`` and ``b(class, ord)`` by
    ``edges(a_class, b_class, pref)``.

    Two classes with no other edge are matched place by place, however large. Other classes
    fall into connected groups; groups up to ``group_rows`` rows and edges are folded in a task
    each. A larger group is folded in ranges of its a, one after the other: a range needs the edges
    of its own classes and of a class of b no more free rows than it has rows itself.
    """
    edges = cut(edges.select(F.col("a_class").cast("long"), F.col("b_class").cast("long"), F.col("pref").cast("double")))
    alone = lambda c: edges.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
    pairs = edges.join(alone("a_class"), "a_class", "left_semi").join(alone("b_class"), "b_class", "left_semi")
    a, b = (numbered(x.select(F.col("class").cast("long"), F.col("ord").cast("long")), "class", "ord") for x in (a, b))
    rows = {k: x.select(F.col("class").alias(f"{k}_class"), F.col("ord").alias(f"{k}_ord"), F.col("place").alias(f"{k}_place")) for k, x in (("a", a), ("b", b))}
    zipped = rows["a"].join(pairs, "a_class").withColumn("b_place", F.col("a_place")).join(rows["b"], ["b_class", "b_place"]).select("a_ord", "a_class", "b_ord", "b_class")
    rest = cut(edges.join(pairs, ["a_class", "b_class"], "left_anti"))
    if rest.isEmpty():
        return zipped
    node = lambda c, side: F.col(c) * 2 + side
    group = components(rest.select(node("a_class", 1).alias("a"), node("b_class", 0).alias("b")))
    of = lambda x, side: x.join(group.where(F.col("node") % 2 == side).select(F.floor(F.col("node") / 2).alias("class"), F.col("root").alias("g")), "class")
    null = lambda kind: F.lit(None).cast(kind)
    mine = of(a, 1).select("g", F.lit(0).alias("side"), "ord", "class", null("long").alias("to"), null("double").alias("pref"), "place")
    theirs = of(b, 0).select("g", F.lit(1).alias("side"), "ord", "class", null("long").alias("to"), null("double").alias("pref"), "place")
    links = of(rest.withColumnRenamed("a_class", "class"), 1).select("g", F.lit(2).alias("side"), null("long").alias("ord"), "class", F.col("b_class").alias("to"), "pref", null("long").alias("place"))
    every = cut(mine.unionByName(theirs).unionByName(links))
    sizes = cut(every.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("n_a")))
    small = every.join(sizes.where(F.col("n") <= group_rows).select("g"), "g", "left_semi")
    found = zipped.unionByName(small.groupBy("g").applyInPandas(fold, _OUT))
    large = sizes.where(F.col("n") > group_rows)
    if large.isEmpty():
        return found
    width = F.greatest(F.lit(1), F.floor(F.col("n_a") * group_rows / F.col("n"))).cast("long")
    big = cut(every.join(large.select("g", width.alias("width")), "g"))
    ranged = cut(numbered(big.where("side = 0").drop("place"), "g", "ord").withColumn("range", F.floor(F.col("place") / F.col("width"))))
    used = big.select(F.col("class").alias("b_class"), F.col("place").alias("gone")).limit(0)
    columns = ["g", "side", "ord", "class", "to", "pref"]
    for k in range(ranged.agg(F.max("range")).first()[0] + 1):
        own = ranged.where(F.col("range") == k)
        wanted = big.where("side = 2").join(own.select("class").distinct(), "class", "left_semi")
        gone = F.coalesce("gone", F.lit(0))
        free = big.where("side = 1").join(used.withColumnRenamed("b_class", "class"), "class", "left").where((F.col("place") >= gone) & (F.col("place") < gone + F.col("width")))
        part = own.select(columns).unionByName(wanted.select(columns)).unionByName(free.select(columns))
        taken = cut(part.groupBy("g").applyInPandas(fold, _OUT))
        found = found.unionByName(taken)
        used = cut(used.unionByName(taken.groupBy("b_class").agg(F.count("*").alias("gone"))).groupBy("b_class").agg(F.sum("gone").alias("gone")))
    return found
