"""Rules at their stated values."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keelson.functions import prices as P
from keelson.functions import scoring as S
from keelson.functions import text as T
from keelson.operators import detect, history, matching, study


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [("night", "nacht", 0.25), ("aaaa", "aa", 0.5), ("same", "same", 1.0), ("a", "b", 0.0), ("", "", 1.0)])
def test_dice(spark, a, b, want):
    assert one(spark, T.dice(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert one(spark, T.dice(F.lit(b), F.lit(a))) == pytest.approx(want)


def test_titles_and_sources(spark):
    assert one(spark, T.normalize_title(F.lit("Will  Naftali Bennett be PM?!"))) == "will naftali bennett be pm"
    assert one(spark, T.data_source(F.lit("Resolves based on the Bureau of Labor Statistics report."), T.SOURCE_PHRASES_B)) == "the Bureau of Labor Statistics report"
    assert one(spark, T.host_of(F.lit("https://www.bls.gov/x"))) == "bls.gov"
    assert one(spark, T.slugify(F.lit("?!"))) == "untitled"
    assert [str(d) for d in one(spark, T.dates_in_text(F.lit("By March 3, 2026 or 2026-04-05, not 2026-99-99.")))] == ["2026-03-03", "2026-04-05"]


def test_scores(spark):
    for net, want in ((0.0, 1.0), (0.05, 3.0), (0.07, 5.0), (0.10, 7.0), (0.15, 9.0), (0.25, 10.0)):
        assert one(spark, S.edge_score(F.lit(net))) == pytest.approx(want)
    for usd, want in ((400, 0), (500, 3), (1000, 5), (5000, 7), (10000, 9), (50000, 10)):
        assert one(spark, S.liquidity_score(F.lit(usd))) == want
    for days, want in ((None, 5), (-1.0, 10), (0.5, 10), (2.0, 8), (5.0, 6), (20.0, 4), (31.0, 2)):
        assert one(spark, S.time_score(F.lit(days).cast("double"))) == want


@pytest.mark.parametrize(("edge", "conf", "want"), [(0.10, 0.8, (20.0, 4.0, "none")), (0.25, 0.9, (50.0, 10.0, "max")), (0.0, 0.9, (0.0, 0.0, "kelly")), (0.2, 0.05, (0.0, 0.0, "kelly"))])
def test_kelly(spark, edge, conf, want):
    assert tuple(one(spark, S.kelly(F.lit(edge), F.lit(conf), 500.0))) == pytest.approx(want)


def test_gap_exactly_at_fees_is_no_edge(spark):
    assert one(spark, P.funnel_stage(F.lit(True), F.lit(True), F.lit(0.09))) == "validated_same_contract"
    assert one(spark, P.gap(F.lit(0.3), F.lit(0.6), F.lit(False))) == pytest.approx(0.1)


def books(spark, asks, bids, liquidity):
    rows = [("venue_a", "m", datetime(2024, 1, 1), i, a, b, float(q)) for i, (a, b, q) in enumerate(zip(asks, bids, liquidity, strict=True))]
    return detect.outcome_books(spark.createDataFrame(rows, "platform string, market_id string, ts timestamp, outcome int, ask double, bid double, liquidity double"))


def test_multi_outcome_fixtures(spark):
    fees = detect.multi_outcome(books(spark, [0.30, 0.25, 0.40], [0.28, 0.23, 0.38], [1000, 800, 1200])).first()
    assert fees["reason"] == "fees_exceed_edge" and fees["gross"] == pytest.approx(5)
    good = detect.multi_outcome(books(spark, [0.25, 0.25, 0.35], [0.2, 0.2, 0.3], [600, 600, 600])).first()
    assert good["reason"] is None and good["net"] == pytest.approx(9) and good["capital"] == pytest.approx(85)
    four = detect.multi_outcome(books(spark, [0.2] * 4, [0.1] * 4, [600] * 4)).first()
    assert (four["gross"], four["net"]) == pytest.approx((20, 12))
    assert detect.multi_outcome(books(spark, [0.4, 0.4], [0.3, 0.3], [600, 600])).count() == 0
    assert detect.multi_outcome(books(spark, [0.25, None, 0.35], [0.2, 0.2, 0.3], [600] * 3)).count() == 0
    assert detect.multi_outcome(books(spark, [0.25, 0.25, 0.35], [0.2, 0.2, 0.3], [600, 400, 600])).first()["reason"] == "low_liquidity"


def test_price_sums(spark):
    assert detect.price_sums(books(spark, [0.5, 0.51], [0.4, 0.4], [600, 600])).count() == 0
    over = detect.price_sums(books(spark, [0.55, 0.52], [0.4, 0.4], [600, 600])).first()
    assert over["kind"] == "binary_overpriced" and over["edge"] == pytest.approx(7)
    assert detect.price_sums(books(spark, [0.55, 0.52], [0.4, 0.4], [600, 400])).count() == 0


def test_alert_windows(spark):
    t = datetime(2024, 1, 1)
    rows = [("correlated", "venue_a", "m", t + timedelta(minutes=m), float(s), i) for i, (m, s) in enumerate([(0, 5), (180, 9), (239, 6), (300, 4), (539, 8), (540, 7)])]
    df = spark.createDataFrame(rows, "type string, platform string, market_id string, ts timestamp, score double, event_id long")
    got = [(r["n"], r["best_score"]) for r in history.dedup_alerts(df).orderBy("first_seen").collect()]
    assert got == [(3, 9.0), (2, 8.0), (1, 7.0)]


def test_chunks_fill_in_order(spark):
    df = spark.createDataFrame([(f"k{i:03d}", 40) for i in range(50)], "key string, tokens long")
    rows = history.assign_chunks(df, 100, 50_000).collect()
    sizes = {}
    for r in rows:
        sizes[r["chunk"]] = sizes.get(r["chunk"], 0) + r["tokens"]
    assert len(rows) == 50 and sizes == {k: 80 for k in range(25)}


def test_greedy_is_the_sequential_choice(spark):
    import random

    rnd = random.Random(3)
    edges = sorted({(rnd.randrange(30), float(rnd.randrange(5)), 100 + rnd.randrange(30)) for _ in range(80)})
    df = spark.createDataFrame([(a, p, b, 1.0) for a, p, b in edges], "a_ord long, pref double, b_id long, score double")
    got = sorted((r["a_ord"], r["b_id"]) for r in matching.greedy(df).collect())
    want = sorted((a, b) for a, b, _ in matching.replay([(a, p, b, 1.0) for a, p, b in edges]))
    assert got == want and len({b for _, b in got}) == len(got)


def test_greedy_deals_one_component_to_many_tasks(spark):
    import random

    rnd = random.Random(5)
    same = [(a, float(b), 100 + b) for a in range(40) for b in range(30)]
    sparse = [(a, float(rnd.randrange(4)), 200 + rnd.randrange(60)) for a in range(30, 120) for _ in range(5)]
    edges = [(a, p, b, 1.0) for a, p, b in sorted({*same, *sparse})]
    df = spark.createDataFrame(edges, "a_ord long, pref double, b_id long, score double")
    first_free = matching._first_free
    tasks = spark.sparkContext.accumulator(0)

    def counted(batches):
        tasks.add(1)
        yield from first_free(batches)

    matching._first_free = counted
    try:
        got = sorted(map(tuple, matching.greedy(df, task_edges=300).collect()))
    finally:
        matching._first_free = first_free
    assert got == sorted(matching.replay(edges)) and tasks.value > 5
    assert matching.greedy(df.limit(0)).count() == 0


def test_vector_blocks_agree(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")
    a, b = df.where("id < 30"), df.where("id >= 30")
    one_block = sorted(map(tuple, matching.similar_vectors(a, b, 0.3).collect()))
    many = sorted(map(tuple, matching.similar_vectors(a, b, 0.3, block_rows=7).collect()))
    assert one_block == many and one_block


def test_semantic_matches_need_more_than_the_nearest(spark):
    import numpy as np

    from keelson.plans import matching_q

    rng = np.random.default_rng(7)
    v = np.concatenate((rng.normal(size=8) + rng.normal(size=(130, 8)) * 0.05, rng.normal(size=(30, 8))))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    want, used = [], set()
    for a in range(0, len(v), 2):
        free = sorted((-cosine[a, b], b) for b in range(1, len(v), 2) if cosine[a, b] >= 0.3 and b not in used)
        if free:
            used.add(free[0][1])
            want.append((a, free[0][1]))
    got = sorted((r["a_ord"], r["b_id"]) for r in matching_q.j2(df).collect())
    assert got == want and len(want) >= 65


def test_order_statistic(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "gap double")
    assert study.order_statistic(df, "gap", 90).first()[0] == 10.0
    assert study.order_statistic(df, "gap", 50).first()[0] == 6.0


def test_empty_inputs(spark):
    pairs = spark.createDataFrame([], "a_id string, b_id string, gap double, same_criteria boolean, priceable boolean, thin double, triage_label string, category string")
    r = study.gap_distribution(pairs).first()
    assert (r["n"], r["median"], r["p90"]) == (0, 0.0, 0.0)
    assert [x["n"] for x in study.gap_histogram(pairs).collect()] == [0] * 6


def edges_of(a, b, fits):
    """All edges of members ``(ord, key)``, as ``replay`` takes them."""
    return [(i, p, j, 1.0) for i, x in a for j, y in b if (p := fits(x, y)) is not None]


@pytest.mark.parametrize("group_rows", [1_000_000, 40])
def test_choice_over_classes_is_the_sequential_choice(spark, group_rows):
    import random

    from keelson.operators import classes

    for seed in (5,):
        rnd = random.Random(seed)
        a, b = ([(i, rnd.choice("pqrstu" if rnd.random() < 0.5 else "pq")) for i in rnd.sample(range(500), 60)] for _ in "ab")
        prefs = {(x, y): float(rnd.randrange(3)) for x in "pqrstu" for y in "pqrstu" if rnd.random() < 0.4 or x == y == "u"}
        prefs = {k: v for k, v in prefs.items() if k == ("u", "u") or "u" not in k}
        want = sorted((i, j) for i, j, _ in matching.replay(edges_of(a, b, lambda x, y: prefs.get((x, y)))))
        (ra, ka), (rb, kb) = (classes.classed(spark.createDataFrame(x, "ord long, key string"), "ord", "key") for x in (a, b))
        links = spark.createDataFrame([(x, y, p) for (x, y), p in prefs.items()], "x string, y string, pref double")
        edges = links.join(ka.select(F.col("key").alias("x"), F.col("class").alias("a_class")), "x").join(kb.select(F.col("key").alias("y"), F.col("class").alias("b_class")), "y")
        got = sorted((r["a_ord"], r["b_ord"]) for r in classes.choose(ra, rb, edges, group_rows).collect())
        assert got == want and got


def listings(spark, titles, days, offset=0):
    rows = [(offset + i, t, 2, d) for i, (t, d) in enumerate(zip(titles, days, strict=True))]
    return spark.createDataFrame(rows, "ord long, question string, n_outcomes int, close_day int")


def test_lexical_choice_of_a_hundred_thousand_equal_titles(spark):
    n = 100_000
    a = spark.range(n).select(F.col("id").alias("ord"), F.lit("The same title").alias("question"), F.lit(2).alias("n_outcomes"), F.when(F.col("id") % 4 > 0, (F.col("id") % 3).cast("int")).alias("close_day"))
    b = spark.range(n).select((F.col("id") + n).alias("ord"), F.lit("The SAME title!").alias("question"), F.lit(2).alias("n_outcomes"), F.lit(1).alias("close_day"))
    got = matching.lexical_matches(a, b)
    # any a fits any b: the k-th takes the k-th
    assert got.agg(F.count("*"), F.count_if(F.col("b_ord") - F.col("a_ord") == n), F.min("confidence")).first() == (n, n, 1.0)


def test_lexical_choice_with_near_days(spark):
    import random

    rnd = random.Random(4)
    titles = ["one two three four", "one two three five", "Another thing here", "?!"]
    a, b = (listings(spark, [rnd.choice(titles) for _ in range(40)], [rnd.choice([None, 0, 5, 9, 16]) for _ in range(40)], k) for k in (0, 100))
    edges = [(r["a_ord"], float(r["b_ord"]), r["b_ord"], r["confidence"]) for r in matching.lexical_edges(a, b).collect()]
    got = sorted(map(tuple, matching.lexical_matches(a, b).collect()))
    assert got == sorted(matching.replay(edges)) and len(got) > 20


def test_greedy_in_few_rounds(spark, monkeypatch):
    import random

    rnd = random.Random(9)
    hot = [(a, float(rnd.randrange(100)), b, 1.0) for a in range(400) for b in range(1000, 1015)]
    own = [(a, 200.0 + k, 2000 + 40 * (a // 20) + rnd.randrange(30), 1.0) for a in range(400) for k in range(6)]
    edges = sorted({(a, b): (a, p, b, s) for a, p, b, s in hot + own}.values())
    rounds = []
    real = matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: (rounds.append(df.columns), real(df))[1])
    df = spark.createDataFrame(edges, "a_ord long, pref double, b_id long, score double")
    assert sorted(map(tuple, matching.greedy(df, task_edges=400).collect())) == sorted(matching.replay(edges))
    assert sum("sure" in c and "holder" not in c for c in rounds) < 10


def test_forecasts_meet_by_signatures(spark):
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 9)))
    base = [" ".join(word() for _ in range(rnd.choice([1, 4, 12, 30]))) for _ in range(40)] + ["x", "y", ""]
    near = lambda t: t if rnd.random() < 0.4 or not t else t[: (k := rnd.randrange(len(t)))] + rnd.choice("abc ") + t[k + rnd.randrange(2) :]
    q = [(i, near(rnd.choice(base)), "binary", rnd.randrange(12), 0.5, 1) for i in range(120)]
    m = [(i, near(rnd.choice(base)), rnd.choice([None, *range(12)]), 0.5) for i in range(200)]
    qs, ms = spark.createDataFrame(q, "id long, title string, type string, resolve_day int, q2 double, age_days int"), spark.createDataFrame(m, "ord long, question string, close_day int, yes double")
    pairs = qs.crossJoin(ms).where("abs(close_day - resolve_day) < 14")
    days = F.abs(F.col("close_day") - F.col("resolve_day"))
    full = pairs.withColumn("overall", 0.5 * T.dice(F.lower("title"), F.lower("question")) + 0.3 * 0.5 + 0.2 * T.timing_similarity(days)).where("overall >= 0.8")
    want = sorted((r["id"], r["ord"]) for r in full.select("id", "ord").collect())
    edges = matching.forecast_edges(qs, ms).collect()
    assert sorted((r["q_id"], r["m_ord"]) for r in edges) == want and len(want) > 100
    got = sorted((r["q_id"], r["m_ord"]) for r in matching.forecast_matches(qs, ms).collect())
    assert got == sorted((a, b) for a, b, _ in matching.replay([(r["q_id"], -round(r["overall"], 6), r["m_ord"], 1.0) for r in edges]))


def test_hot_week_makes_few_candidates(spark):
    import random

    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda: " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(10))
    rows = [(s, i, text()) for s in (0, 1) for i in range(1500)]
    sets = spark.createDataFrame(rows, "side int, ord long, t string").select("side", "ord", T.pair_key(F.col("t"))["pairs"].alias("words"))
    keys = matching._signed(sets, 0.9)
    x, y = (keys.where(F.col("side") == n).withColumnRenamed("ord", f"o{n}").drop("side") for n in (0, 1))
    n = x.join(y, ["sizes", "part", "key"]).select("o0", "o1").distinct().count()
    assert n < 1500 * 1500 / 50, n


def test_vector_cells_are_skipped(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    v = np.concatenate([c + rng.normal(size=(40, 32)) * 0.08 for c in centres] + [np.zeros((1, 32))])
    rng.shuffle(v)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    pairs = []
    blocks = matching._blocks
    monkeypatch.setattr(matching, "_blocks", lambda *x: (pairs.append((r := blocks(*x))[2].count()), r)[1])
    whole = sorted(map(tuple, matching.similar_vectors(a, b, 0.68, 0.5, None).collect()))
    dealt = sorted(map(tuple, matching.similar_vectors(a, b, 0.68, 0.5, None, block_rows=8).collect()))
    assert whole == dealt and len(whole) > 1000
    assert pairs[0] == 1 and 0 < pairs[1] < 60 * 60 / 4  # of the pairs of some 60 cells most are left out


@pytest.mark.parametrize("n_parts", [1, 7])
def test_alert_windows_of_one_key_over_many_tasks(spark, n_parts):
    import random

    rnd = random.Random(n_parts)
    t, rows = datetime(2024, 1, 1), []
    for key, n, step in (("hot", 600, 3000), ("dense", 200, 1), ("sparse", 30, 90_000), ("once", 1, 1)):
        at = 0
        for i in range(n):
            at += rnd.randrange(step + 1)
            rows.append(("x", "venue_a", key, t + timedelta(seconds=at), float(rnd.randrange(100)), i))
    want = {}
    for _, _, key, ts, score, _ in rows:
        windows = want.setdefault(key, [])
        if windows and ts - windows[-1][0] < timedelta(hours=4):
            windows[-1][1:] = [ts, max(windows[-1][2], score), windows[-1][3] + 1]
        else:
            windows.append([ts, ts, score, 1])
    df = spark.createDataFrame(rows, "type string, platform string, market_id string, ts timestamp, score double, event_id long").repartition(3)
    got = history.dedup_alerts(df, n_parts=n_parts).select("market_id", "first_seen", "last_seen", "best_score", "n").collect()
    assert sorted(map(tuple, got)) == sorted((k, *w) for k, ws in want.items() for w in ws)


def test_sensitivity_by_plain_python(spark):
    import random

    rnd = random.Random(1)
    vol = lambda: rnd.choice([0.0, None, 500.0, 1000.0, 9999.0, 10_000.0, 250_000.0])
    rows = [(rnd.random() < 0.8, rnd.random() < 0.8, rnd.choice([rnd.random(), 0.05, 0.0, 1.0]), vol(), vol(), rnd.choice(["semantic_survivor", "x", None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "same_criteria boolean, priceable boolean, gap double, a_volume double, b_volume double, triage_label string")
    a, b = (spark.createDataFrame([(vol(),) for _ in range(50)], "volume double") for _ in "ab")
    counts = [[r["volume"] or 0 for r in x.collect()] for x in (a, b)]
    got = {r["floor_"]: r for r in study.sensitivity(df, a, b).collect()}
    assert sorted(got) == study.FLOORS
    for f, r in got.items():
        over = [x for x in rows if x[3] and x[4] and min(x[3], x[4]) >= f]
        gaps = sorted(x[2] for x in over if x[0] and x[1])
        n = len(gaps)
        median = (gaps[(n - 1) // 2] + gaps[n // 2]) / 2 if n else 0
        p90 = gaps[min(n - 1, int(n * 0.9))] if n else 0
        assert (r["overlaps"], r["priceable"], r["median_pp"], r["p90_pp"]) == (len(over), n, pytest.approx(median * 100, abs=1e-6), pytest.approx(p90 * 100, abs=1e-6))
        assert [r["venue_a"], r["venue_b"]] == [sum(v > 0 and v >= f for v in c) for c in counts]
        assert r["confirmed"] == sum(x[5] == "semantic_survivor" and x[2] > 0.09 and x[0] and x[1] for x in over)
