"""Spelling variants and exact clusters against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import centroids, spelling
from keelson.llm.common import tune
from tests.llm import brute


def corpus():
    rnd = random.Random(8)
    base = ["".join(rnd.choice("aeioulnrstéßÀ") for _ in range(rnd.randint(6, 12))) for _ in range(60)] + ["aaaaaaaa", "abababab", "aaaaaaab"]
    docs = []
    for d in range(120):
        words = [rnd.choice(base[:20] if rnd.random() < 0.7 else base) for _ in range(rnd.randint(0, 80))]
        for k in range(len(words)):
            if rnd.random() < 0.08:
                at, w = rnd.randrange(len(words[k])), words[k]
                words[k] = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("aeiz") + w[at:], w[:at] + rnd.choice("aeiz") + w[at + 1 :]])
        docs.append((d, rnd.choice([" ", "-", "1", "\n"]).join(words).replace("a", rnd.choice("aA"))))
    return docs + [(500, None), (501, ""), (None, " ".join(base)), (7, docs[7][1]), (7, docs[7][1]), (502, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999), (503, "z" * 4999 + " ×÷×÷×÷× ×÷×÷×÷×")]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    tune(spark)
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).withColumn("w", F.lit(1)).withColumn("n", F.lit("x")).withColumn("word", F.lit(None).cast("string"))


@pytest.mark.parametrize("slip", [31, 3])
def test_variants(docs, slip):
    found = spelling.variants(docs, slip).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute.variants(DOCS, slip)
    assert sorted(map(tuple, found)) == want
    assert len({r[5] for r in want}) < len(want)


@pytest.mark.parametrize(("symbols", "link_pairs"), [(None, 256), (1, 4), (2, 1), (90, 1)])
def test_near_words_with_crowded_links(spark, symbols, link_pairs):
    rnd = random.Random(symbols or 0)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(7, 9))) for _ in range(400)}
    vocab = spark.createDataFrame([(w, i + 2) for i, w in enumerate(sorted(words))], "word string, n long")
    found = spelling.near_words(vocab, link_pairs, symbols).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted((a, b) for a in words for b in words if a < b and brute.one_edit(a, b))


def test_chains_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("v", "w5")]
    assert {r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {"w13"}


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0


def vectors(n, dims, seed):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rnd.normal(rnd.integers(0, 3), 0.4, dims)]) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, rows[5][1]), (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1))]
    return rows + [(904, [float("nan")] + [1.0] * (dims - 1)), (905, [float("-inf")] + [1.0] * (dims - 1)), (906, [0.0] * dims), (907, [-1e5] + [0.0] * (dims - 1))]


def rows_of(df):
    found = df.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()
    return sorted(map(tuple, found), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize(("n", "dims", "k", "rounds"), [(150, 64, 8, 10), (60, 70, 5, 3), (40, 3, 4, 0), (6, 33, 30, 2)])
def test_clusters(spark, n, dims, k, rounds):
    tune(spark)
    rows = vectors(n, dims, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("id", F.lit(0)).withColumn("chunk", F.lit("x")).withColumn("label", F.lit(None).cast("int"))
    assert rows_of(centroids.clusters(df, k, rounds, dims)) == brute.lloyd(rows, k, rounds, dims)


def test_cluster_left_empty_and_large_values(spark):
    rows = [(i, [float(x)] * 2) for i, x in enumerate([0, 0, 0, 1, 1e5, 1e5, -1e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(centroids.clusters(df, 4, 10, 2)) == brute.lloyd(rows, 4, 10, 2)
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(spark.createDataFrame([(1, [1e300, 0.0])], df.schema), 1, 1, 2).collect()


def test_no_vectors(spark):
    assert centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_partial_distances_are_exact():
    rnd = np.random.default_rng(2)
    for most in (100, 1 << 28):
        block, slice_ = rnd.integers(-most, most, (20, 4)), rnd.integers(-most, most, (3, 4))
        want = [[sum(int(a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in slice_] for x in block]
        assert centroids.partial_distances(block, slice_).tolist() == want
