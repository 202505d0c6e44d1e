"""Bounded, repeatable samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a label may have; a column with more is no class label.
MOST_LABELS = 1000


def _by_label(values: dict, label: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[label]


def per_class(rows: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of about ``most`` ids of each label, those with the least id hash, or of all
    where there are fewer, with a ``weight``: how many rows of the label one stands for.

    Labels are counted first, and a row is in by its own id's hash and its label's count
    alone, so nothing is ranked, joined or gathered; the driver sees one count per label.
    Rows without a label or id are out.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    sizes = dict(map(tuple, known.groupBy(label).agg(F.count("*")).limit(MOST_LABELS + 1).collect()))
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"{label} has over {MOST_LABELS} values")
    if not sizes:
        return known.withColumn("weight", F.lit(1.0))
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1) / F.lit(float(1 << 63))
    low = known.where(place * _by_label(sizes, F.col(label)) <= most)
    return low.withColumn("weight", _by_label({k: max(1.0, n / most) for k, n in sizes.items()}, F.col(label)))
