"""What the third round's findings named, in small."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import scoring as S
from keelson.functions import text as T
from keelson.operators import matching
from keelson.plans import all_queries
from keelson.plans.fixtures import view
from keelson.sources import parsing, sinks
from tests.compare import SF
from tests.test_rules import one


def test_long_runs_of_names_need_no_stack(spark):
    texts = ["Alpha Beta " * 100_000 + "Gamma9", "The " * 50_000 + "Foo", "xFoo Bar9 The Qux. Foo\nBar  Baz9 Will Foo A Ba"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.entities(F.col("t"))).collect()]
    assert got == [[("Alpha Beta " * 100_000).strip()], ["Foo"], ["Qux", "Foo\nBar", "Foo", "Ba"]]


def test_score_on_the_limit_is_not_over_it(spark):
    # 3 * 0.35 + 4.2 * 0.25 + 9 * 0.20 + 6 * 0.10 + 5 * 0.10 with exact steps falls just short of 5, as in SQL
    score = S.composite(F.lit(0.05), F.lit(0.42), F.lit(None).cast("double"), F.lit(20000.0), F.lit(5))
    assert one(spark, score) < 5


def test_market_context_takes_every_event(spark):
    rows = all_queries()["j19_market_context"](spark, SF).select("points", F.size(F.split("headlines", ";")).alias("n")).agg(F.sum("n"), F.count_if(F.col("points") < 10)).first()
    snapshots = view(spark, SF, "snapshots")
    few = snapshots.where("platform = 'venue_a'").groupBy("market_id").count().where("count < 10").count()
    assert (rows[0], rows[1]) == (snapshots.count(), few)


def _long_texts():
    rnd = random.Random(3)
    return ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(60_000)) for _ in range(2)]


def test_dice_of_long_texts_of_many_letters(spark):
    # numbering each kind of pair among all of a text's took the square of its length
    a, b = _long_texts()
    b = b[:20_000] + a[:40_000] + "😀 😀😀"
    count = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1))
    x, y = count(a), count(b.replace(" ", ""))
    want = 2 * sum(min(n, y[k]) for k, n in x.items()) / (sum(x.values()) + sum(y.values()))
    start = time.monotonic()
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.dice(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(want) and time.monotonic() - start < 20
    assert spark.sql("select null as a, 'x' as b").select(T.dice(F.col("a").cast("string"), F.col("b"))).first()[0] is None


@pytest.mark.parametrize("least", [0.15, 0.5, 0.8])
def test_word_join_is_whole(spark, least):
    rnd = random.Random(4)
    base = [[f"w{int(rnd.paretovariate(0.6)) % 90}" for _ in range(rnd.choice([1, 3, 8, 40]))] for _ in range(25)]
    sets = [[w for w in rnd.choice(base) if rnd.random() < 0.8] + [f"x{rnd.randrange(20)}"] * rnd.randrange(2) for _ in range(160)]
    a, b = (spark.createDataFrame(list(enumerate(x)), "ord long, words array<string>") for x in (sets[:80], sets[80:]))
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {(i, j) for i, x in enumerate(sets[:80]) for j, y in enumerate(sets[80:]) if jaccard(set(x), set(y)) >= least}
    assert {(r["a_ord"], r["b_ord"]) for r in matching.word_join(a, b, least).collect()} == want and want


def test_titles_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_LETTERS", 600)
    monkeypatch.setattr(matching, "CHUNK_LETTERS", 120)
    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice("abcd😀") for _ in range(rnd.choice([1, 2, 5, 20, 60])))
    q, m = (spark.createDataFrame(sorted({t: i for i, t in enumerate(text() for _ in range(n))}.items()), "text string, ord long") for n in (60, 90))
    full = q.withColumnsRenamed({"text": "a", "ord": "q"}).crossJoin(m.withColumnsRenamed({"text": "b", "ord": "m"})).where("a <> b").withColumn("dice", T.dice(F.col("a"), F.col("b"))).where("dice >= 0.5")
    want = sorted((r["q"], r["m"], r["dice"]) for r in full.collect())
    assert sorted((r["q_ord"], r["m_ord"], r["dice"]) for r in matching.title_dice(q, m, 0.5).collect()) == want and len(want) > 100


def _verdicts(spark, replies):
    rows = spark.createDataFrame(list(enumerate(replies)), "i long, raw string")
    return rows.select("i", parsing.parse_verdict(F.col("raw"), F.array(F.lit("x"), F.lit("y"))).alias("v"))


def test_verdicts_are_parsed_once(spark):
    good, odd = '{"match_index":1,"same_event":true,"same_criteria":false,"reason":"r"}', '{"match_index":"no","same_event":true}'
    found = _verdicts(spark, [good, odd, "no json", None, "", '{"match_index":'])
    assert [r["v"] and tuple(r["v"]) for r in found.orderBy("i").collect()] == [("y", True, False, True, "r"), (None, False, False, True, ""), None, None, None, None]
    plan = found.select("i", "v.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_ranked_pairs_are_joined_once(spark):
    plan = all_queries()["t7_rank_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_exports_are_compressed(spark, tmp_path):
    sinks.export_csv(spark.range(9), f"{tmp_path}/x")
    assert [p for p in (tmp_path / "x").iterdir() if p.name.endswith(".csv.gz")] and spark.read.option("header", True).csv(f"{tmp_path}/x").count() == 9


def test_unlike_sets_are_not_compared(spark, monkeypatch):
    # one rare word in common: sizes and places leave room, the sketches don't
    own = lambda k: [(i, [f"{k}{j}" for j in range(39)] + [f"x{i}"]) for i in range(9)]
    a, b = (spark.createDataFrame(own(k), "ord long, words array<string>") for k in "ab")
    monkeypatch.setattr(T, "jaccard", lambda x, y: F.raise_error(F.lit("compared")).cast("double"))
    assert matching.word_join(a, b, 0.5).collect() == []


def test_titles_whose_days_are_too_far_apart_are_not_pairs(spark):
    rnd = random.Random(6)
    side = lambda n: [(i, "".join(rnd.choice("abc") for _ in range(12)), lo := rnd.randrange(20), lo + rnd.choice([0, 0, 5])) for i in range(n)]
    q, m = (spark.createDataFrame(side(n), "ord long, text string, lo long, hi long") for n in (30, 40))
    full = q.withColumnsRenamed({c: f"q_{c}" for c in q.columns}).crossJoin(m.withColumnsRenamed({c: f"m_{c}" for c in m.columns})).where("q_text <> m_text").withColumn("dice", T.dice(F.col("q_text"), F.col("m_text")))
    gap = F.greatest(F.lit(0), F.col("q_lo") - F.col("m_hi"), F.col("m_lo") - F.col("q_hi"))
    want = {(r["q_ord"], r["m_ord"]) for r in full.where((F.col("dice") >= 0.5 + 0.03 * gap - 1e-9) & (gap < 14)).collect()}
    assert {(r["q_ord"], r["m_ord"]) for r in matching.title_dice(q, m, 0.5, 0.03, 14).collect()} == want and len(want) > 50


def test_replies_of_both_kinds_are_judged_in_one_pass(spark):
    plan = all_queries()["src9_import_verdicts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("from_json") == 2


def test_group_patterns_are_applied_once(spark):
    plan = all_queries()["a23_group_feed"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "regexp_extract" not in plan


def test_semantic_matches_list_few_partners(spark, monkeypatch):
    rng = np.random.default_rng(9)
    near = rng.normal(size=8) + rng.normal(size=(60, 8)) * 0.05
    v = np.concatenate((near, np.tile(near[:1], (24, 1)), rng.normal(size=(36, 8)), np.zeros((2, 8))))
    v = v[rng.permutation(len(v))]
    cosine = np.round(matching._unit(v) @ matching._unit(v).T, 6)
    edges = [(a, -cosine[a, b], b, cosine[a, b]) for a in range(0, len(v), 2) for b in range(1, len(v), 2) if cosine[a, b] >= 0.3]
    for name, n in {"LIST": 2, "MOST_LISTED": 8, "LISTED": 40}.items():
        monkeypatch.setattr(matching, name, n)
    seen, whole = [], matching.greedy
    monkeypatch.setattr(matching, "greedy", lambda e, n: seen.append(e.count()) or whole(e, n))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = sorted((r["a_ord"], r["b_id"]) for r in matching.semantic_matches(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.3).collect())
    assert got == sorted((a, b) for a, b, _ in matching.replay(edges))
    assert len(seen) > 2 and max(seen) <= 2 * len(v) + 40 < len(edges) / 4


def test_alert_windows_share_state(spark, tmp_path):
    from keelson.streaming import jobs

    rows = "SELECT 't' AS type, 'p' AS platform, concat('m', CAST(id % 40 AS STRING)) AS market_id, timestamp_seconds(1700000000 + id * 600) AS ts, CAST(id % 7 AS DOUBLE) AS score, id AS event_id FROM range({}, {})"
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo, hi in ((0, 400), (400, 700)):
            spark.sql(rows.format(lo, hi)).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(spark.sql(rows.format(0, 1)).schema).parquet(f"{tmp_path}/in")
            last = jobs.dedup_alerts(stream, buckets=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            last.awaitTermination()
    finally:
        spark.conf.unset(name)
    got = sorted((r["market_id"], r["first_seen"].timestamp() - 1_700_000_000, r["n"], r["best_score"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # a market has a row every 400 minutes, so each is a window; those over at the watermark are closed
    limit = 699 * 600 - 1800 - 4 * 3600  # from the first row
    assert got == sorted((f"m{i % 40}", float(i * 600), 1, float(i % 7)) for i in range(700) if i * 600 < limit)
    assert {p["batchId"]: p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in last.recentProgress}[2] <= 2


def test_event_rows_are_grouped_after_they_are_dealt(spark):
    plan = all_queries()["src2_normalize_venue_b"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]


def test_live_overlay_sorts_no_small_parts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        found = all_queries()["j17_live_overlay"](spark, SF)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set(name, before)
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
