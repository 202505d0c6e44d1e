"""Packing against the properties that define it, and the library's ids."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keelson.llm import packing
from keelson.llm.common import scratch, tune

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    import tokenizers

    own = tokenizers.Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


def texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(1, 8)))
    sizes = [rnd.choice([0, 3, 40, 130, 250, 400, 900, 2500]) for _ in range(150)]
    out = [(k, " ".join(word() for _ in range(rnd.randint(0, n) if n else 0))) for k, n in enumerate(sizes)]
    return out + [(200, None), (201, ""), (7, "again"), (None, "no id"), (None, "no id"), (202, "x " * 30_000), (203, "<|endoftext|> mark")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(5)
    return df.withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("pieces", F.lit(None).cast("string"))


def check(rows, texts, longest=2048):
    """Every id of every document lies in one piece; sequences are gapless and never padded."""
    own, want, got = library(), {}, {}
    for d, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault((d, len(ids)), []).append(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(want)
    for key, pieces in got.items():
        covered = sorted((s, n) for s, n, _ in pieces)
        starts = np.repeat(np.arange(key[1]), len(want[key]))
        assert sorted(i for s, n in covered for i in range(s, s + n)) == starts.tolist()
        for s, n, crc in pieces:
            assert crc in {zlib.crc32(ids[s : s + n]) for ids in want[key]}
    for spans in sequences.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= longest and ends[-1] & (ends[-1] - 1) == 0
    return sequences


def test_packs_every_id_once(docs):
    tune(docs.sparkSession)
    check(packing.write_and_read(docs, PATH).collect(), texts())


def test_small_buffers_and_tails(docs, spark):
    path = scratch(spark)
    packing.write(docs, path, PATH, tiers=(64, 128, 512), buffer_ids=2000, tail_tasks=2)
    rows = packing.pieces_of(packing.read(spark, path)).collect()
    sequences = check(rows, texts(), 512)
    small = [k for k, spans in sequences.items() if sum(n for _, n in spans) < 64]
    assert len(small) <= 6 * 3  # the ends of three groups of tasks, at most one of each power of two


def test_tiers_cuts_and_steps(docs, spark):
    path = scratch(spark)
    packing.write(docs.repartition(1), path, PATH)
    found = packing.read(spark, path)
    cuts = found.select(F.explode("pieces").alias("p")).groupBy("p.doc_id", "p.doc_tokens").count()
    cut = cuts.where("doc_tokens <= 256 and doc_id <> 7").where("count > 1").count()
    assert cut <= 6  # short documents stay whole, but for the last
    steps = packing.step_groups(found, 8192).join(found.drop("tier"), "sequence_id").groupBy("tier", "step_group").agg(F.sum(F.length("ids") / F.col("id_bytes")).alias("n"), F.sum("cost").alias("cost"))
    for tier in {r["tier"] for r in steps.collect()}:
        sizes = [r["n"] for r in steps.where(F.col("tier") == tier).orderBy("step_group").collect()]
        assert all(n == 8192 for n in sizes[:-1]) and 0 < sizes[-1] <= 8192


def test_cost_is_spread():
    costs = np.random.default_rng(1).pareto(1.5, 512)
    order = packing.spread(costs)
    assert sorted(order.tolist()) == list(range(512))
    sums = np.sort(costs)[:-8].sum() / 32
    ranks = np.argsort(np.argsort(costs))[order].reshape(32, 16).mean(1)
    assert ranks.min() > 200 and ranks.max() < 312 and sums > 0


def test_pack_fills_windows():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        lengths = rnd.integers(1, rnd.integers(2, 5000), rnd.integers(1, 200))
        starts = np.cumsum(lengths) - lengths
        windows, left = packing.pack(starts, lengths)
        assert all(sum(n for *_, n in w) == tier for tier, w in windows)
        assert sum(n for *_, n in left) < 2048
        spans = sorted((s, n) for _, w in windows for _, s, n in w) + sorted((s, n) for _, s, n in left)
        assert sorted(i for s, n in spans for i in range(s, s + n)) == list(range(int(lengths.sum())))
        assert all(starts[i] <= s and s + n <= starts[i] + lengths[i] for _, w in windows for i, s, n in w)


def test_empty_table(spark):
    assert packing.write_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.write(spark.createDataFrame([], "doc_id long, text string"), scratch(spark), PATH, tiers=(300, 2048))
