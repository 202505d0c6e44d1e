"""What the fourth round's finding named, in small."""

from __future__ import annotations

import random

import pytest

from keelson.llm import spelling
from tests.llm import brute


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")  # bytes: any table sent through the driver is an error
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("link_pairs", [1, 256])
def test_near_words_are_not_sent_through_the_driver(spark, no_broadcast, link_pairs):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(7, 9))) for _ in range(200)})
    found = spelling.near_words(spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long"), link_pairs, 2).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted((a, b) for a in words for b in words if a < b and brute.one_edit(a, b)) and found


def test_forms_are_not_sent_through_the_driver(spark, no_broadcast):
    docs = [(1, "abcdefgh " * 200 + "abcdefg " * 15 + "bcdefgh bcdefgh"), (2, None)]
    found = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), slip=10**9).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, found)) == brute.variants(docs, 10**9) and any(r["form"] for r in found)
