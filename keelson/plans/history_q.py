"""Queries over snapshots, opportunities and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import calibration, detect, history
from keelson.plans.fixtures import forecast_pairs
from keelson.plans.functions_q import EDGE_SQL, PROFIT_SQL, SCORE_SQL
from keelson.plans.registry import query

AS_OF = "2024-01-20 12:00:00"
_LATEST = "arg_max({0}, (ts, event_id))"


def _now():
    return F.lit(AS_OF).cast("timestamp")


def _us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("pf18_fresh", "snapshots", sql=f"SELECT event_id, yes FROM {{snapshots}} WHERE ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR")
def pf18(x: DataFrame) -> DataFrame:
    return history.fresh(x, _now(), 360).select("event_id", "yes")


@query("w1_latest_per_market", "snapshots", sql=f"SELECT platform, market_id, {_LATEST.format('yes')} AS yes, CAST(epoch_us(max(ts)) AS BIGINT) AS at FROM {{snapshots}} GROUP BY platform, market_id")
def w1(x: DataFrame) -> DataFrame:
    return history.latest(x).select("platform", "market_id", "yes", _us("ts").alias("at"))


@query("w2_first_seen", "events", sql="SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS rn FROM {events}) WHERE rn = 1")
def w2(x: DataFrame) -> DataFrame:
    src = F.expr("CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END")
    return history.first_seen(x.withColumn("source_ord", src), "user_id", "source_ord", "event_id").select("user_id", "event_type", "event_id")


@query("w4_movement_24h", "snapshots", sql=f"""SELECT platform, market_id, arg_max(yes, (ts, event_id)) AS now, coalesce(arg_max(yes, (ts, event_id)) FILTER (ts <= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR), arg_min(yes, (ts, event_id))) AS was,
    CAST(floor((arg_max(yes, (ts, event_id)) - coalesce(arg_max(yes, (ts, event_id)) FILTER (ts <= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR), arg_min(yes, (ts, event_id)))) * 100 + 0.5) AS BIGINT) AS move_pp FROM {{snapshots}} WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY platform, market_id HAVING count(*) >= 2""")
def w4(x: DataFrame) -> DataFrame:
    return history.movement(x, _now())


@query("w5_recent_history", "snapshots", sql="SELECT platform, market_id, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY platform, market_id ORDER BY ts DESC, event_id DESC) AS nth FROM {snapshots}) WHERE nth <= 10")
def w5(x: DataFrame) -> DataFrame:
    return history.recent(x).select("platform", "market_id", "event_id", "nth")


@query("w6_assign_chunks", "listings", sql="""WITH RECURSIVE r AS (SELECT id AS key, CAST(ceil(length(rules) / 4.0) + 160 AS BIGINT) AS tokens, row_number() OVER (ORDER BY id) AS rn FROM {listings}),
    f AS (SELECT key, tokens, rn, CAST(0 AS BIGINT) AS chunk, tokens AS used, 1 AS n FROM r WHERE rn = 1 UNION ALL SELECT r.key, r.tokens, r.rn, CASE WHEN f.used + r.tokens > 20000 OR f.n >= 100 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + r.tokens > 20000 OR f.n >= 100 THEN r.tokens ELSE f.used + r.tokens END, CASE WHEN f.used + r.tokens > 20000 OR f.n >= 100 THEN 1 ELSE f.n + 1 END FROM f JOIN r ON r.rn = f.rn + 1)
    SELECT key, tokens, chunk FROM f""")
def w6(x: DataFrame) -> DataFrame:
    tokens = (F.ceil(F.length("rules") / 4) + 160).cast("long")
    return history.assign_chunks(x.select(F.col("id").alias("key"), tokens.alias("tokens")), 20_000, 100)


@query("w7_dedup_alerts", "opportunities", sql="""WITH RECURSIVE o AS (SELECT type, platform, market_id, ts, score, row_number() OVER (PARTITION BY type, platform, market_id ORDER BY ts, event_id) AS rn FROM {opportunities}),
    w AS (SELECT type, platform, market_id, rn, ts, ts AS anchor FROM o WHERE rn = 1 UNION ALL SELECT o.type, o.platform, o.market_id, o.rn, o.ts, CASE WHEN o.ts - w.anchor >= INTERVAL 4 HOUR THEN o.ts ELSE w.anchor END FROM w JOIN o ON o.type = w.type AND o.platform = w.platform AND o.market_id = w.market_id AND o.rn = w.rn + 1)
    SELECT w.type, w.platform, w.market_id, CAST(epoch_us(anchor) AS BIGINT) AS first_seen, CAST(epoch_us(max(w.ts)) AS BIGINT) AS last_seen, max(score) AS best_score, count(*) AS n FROM w JOIN o USING (type, platform, market_id, rn) GROUP BY w.type, w.platform, w.market_id, anchor""")
def w7(x: DataFrame) -> DataFrame:
    return history.dedup_alerts(x).select("type", "platform", "market_id", _us("first_seen").alias("first_seen"), _us("last_seen").alias("last_seen"), "best_score", "n")


_SEEN = f"""WITH RECURSIVE o AS (SELECT type, platform, market_id, ts, score, row_number() OVER (PARTITION BY type, platform, market_id ORDER BY ts, event_id) AS rn FROM {{opportunities}} WHERE ts <= TIMESTAMP '{AS_OF}'),
    w AS (SELECT type, platform, market_id, rn, ts AS first, score AS best FROM o WHERE rn = 1 UNION ALL SELECT o.type, o.platform, o.market_id, o.rn, CASE WHEN o.ts - w.first >= INTERVAL 4 HOUR THEN o.ts ELSE w.first END, CASE WHEN o.ts - w.first >= INTERVAL 4 HOUR THEN o.score ELSE greatest(w.best, o.score) END FROM w JOIN o ON o.type = w.type AND o.platform = w.platform AND o.market_id = w.market_id AND o.rn = w.rn + 1),
    seen AS (SELECT arg_max(first, rn) AS first, arg_max(best, rn) AS best FROM w GROUP BY type, platform, market_id)
    SELECT count(*) FILTER (TIMESTAMP '{AS_OF}' - first <= INTERVAL 4 HOUR) AS total, CAST(epoch_us(min(first) FILTER (TIMESTAMP '{AS_OF}' - first <= INTERVAL 4 HOUR)) AS BIGINT) AS oldest, max(best) FILTER (TIMESTAMP '{AS_OF}' - first <= INTERVAL 4 HOUR) AS best_score, count(*) FILTER (TIMESTAMP '{AS_OF}' - first > INTERVAL 4 HOUR) AS pruned FROM seen"""


@query("w7_alert_stats", "opportunities", sql=_SEEN)
def w7_stats(x: DataFrame) -> DataFrame:
    seen = history.dedup_alerts(x.where(F.col("ts") <= _now()))
    return history.alert_stats(seen, _now()).withColumn("oldest", _us("oldest"))


_ASOF = f"(SELECT platform, market_id, {_LATEST.format('yes')} AS yes, {_LATEST.format('liquidity_total')} AS liq FROM {{snapshots}} WHERE ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2000 MINUTE GROUP BY platform, market_id)"


@query("j6_asof_pairs", "matches", "snapshots", sql=f"SELECT m.a_id, m.b_id, a.yes AS a_yes, b.yes AS b_yes FROM {{matches}} m JOIN {_ASOF} a ON a.platform = 'venue_a' AND a.market_id = m.a_id JOIN {_ASOF} b ON b.platform = 'venue_b' AND b.market_id = m.b_id")
def j6(m: DataFrame, s: DataFrame) -> DataFrame:
    return history.asof_pairs(m, s, _now(), 2000).select("a_id", "b_id", "a_yes", "b_yes")


@query("j7_cross_venue", "matches", "snapshots", sql=f"""SELECT a_id, round(gross, 6) AS gross_edge, round(net, 6) AS net_edge, round(least(1.0, greatest(0.5, 0.7 + (net - 0.10) * 2.5 + least(0.05, liq / 10000 * 0.05))), 6) AS confidence FROM (SELECT m.a_id, abs(a.yes - b.yes) AS gross, greatest(0.0, abs(a.yes - b.yes) - CAST(0.09 AS DOUBLE)) AS net, least(a.liq, b.liq) AS liq FROM {{matches}} m JOIN {_ASOF} a ON a.platform = 'venue_a' AND a.market_id = m.a_id
    JOIN {_ASOF} b ON b.platform = 'venue_b' AND b.market_id = m.b_id WHERE m.confidence >= 0.5 AND m.n % 5 <> 0) WHERE liq >= 500 AND net >= CAST(0.10 AS DOUBLE)""")
def j7(m: DataFrame, s: DataFrame) -> DataFrame:
    risk = F.when(F.col("n") % 5 == 0, "HIGH").otherwise("LOW")
    found = detect.cross_venue(history.asof_pairs(m, s, _now(), 2000).withColumn("risk", risk))
    return found.select("a_id", F.round("gross_edge", 6).alias("gross_edge"), F.round("net_edge", 6).alias("net_edge"), F.round("opportunity_confidence", 6).alias("confidence"))


CANDLES = "(SELECT platform, market_id, date_trunc('day', ts) AS day, arg_max(yes, (ts, event_id)) AS close, avg(yes) AS mean, count(*) AS n FROM {snapshots} GROUP BY 1, 2, 3)"


@query("src8_price_history", "snapshots", sql=f"SELECT platform, market_id, CAST(epoch_us(day) AS BIGINT) AS day, close AS price FROM {CANDLES} WHERE day >= TIMESTAMP '2024-01-05' AND close > 0 AND close < 1")
def src8(x: DataFrame) -> DataFrame:
    return history.price_history(history.daily_candles(x), "2024-01-05").select("platform", "market_id", _us("day").alias("day"), "price")


@query("j21_pair_history", "matches", "snapshots", sql=f"SELECT m.a_id, CAST(epoch_us(day) AS BIGINT) AS day, a_close, round(CASE WHEN m.n % 4 <> 0 THEN b_close ELSE 1 - b_close END, 6) AS b_close FROM {{matches}} m JOIN (SELECT coalesce(a.market_id, b.market_id) AS m, coalesce(a.day, b.day) AS day, a.close AS a_close, b.close AS b_close FROM (SELECT * FROM {CANDLES} WHERE platform = 'venue_a') a FULL JOIN (SELECT * FROM {CANDLES} WHERE platform = 'venue_b') b ON a.market_id = b.market_id AND a.day = b.day) h ON h.m = m.a_id")
def j21(m: DataFrame, s: DataFrame) -> DataFrame:
    found = history.pair_history(m, history.daily_candles(s), F.col("n") % 4 != 0)
    return found.select("a_id", _us("day").alias("day"), "a_close", F.round("b_close", 6).alias("b_close"))


@query("t1_recent_snapshots", "snapshots", sql="SELECT event_id, yes FROM {snapshots} WHERE platform = 'venue_a' ORDER BY ts DESC, event_id DESC LIMIT 50")
def t1(x: DataFrame) -> DataFrame:
    return x.where("platform = 'venue_a'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "yes")


@query("t2_market_history", "snapshots", sql="SELECT event_id, market_id, yes FROM {snapshots} WHERE market_id = 'm7' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'")
def t2(x: DataFrame) -> DataFrame:
    return x.where("market_id = 'm7'").where(F.col("ts").between(F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))).orderBy("ts", "event_id").select("event_id", "market_id", "yes")


@query("t3_recent_matches", "matches", sql="SELECT a_id, confidence FROM {matches} WHERE confidence >= 0.5 ORDER BY ts DESC, a_id LIMIT 100")
def t3(m: DataFrame) -> DataFrame:
    return m.where("confidence >= 0.5").orderBy(F.desc("ts"), "a_id").limit(100).select("a_id", "confidence")


@query("t4_recent_opportunities", "opportunities", sql=f"SELECT id, type, score FROM {{opportunities}} WHERE score >= 5 AND ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR")
def t4(x: DataFrame) -> DataFrame:
    return history.fresh(x.where("score >= 5"), _now(), 72 * 60).orderBy(F.desc("ts"), F.desc("score"), "id").select("id", "type", "score")


@query("t5_safe_comparisons", "comparisons", sql="SELECT a_id, b_id, overall FROM {comparisons} WHERE safe")
def t5(x: DataFrame) -> DataFrame:
    return x.where("safe").orderBy(F.desc("overall"), "a_id").select("a_id", "b_id", "overall")


@query("t10_scored_order", "opportunities", sql=f"SELECT id, round(CAST({SCORE_SQL} AS DOUBLE), 6) AS total, round(CAST({EDGE_SQL} AS DOUBLE), 6) AS edge, round(CAST({PROFIT_SQL} AS DOUBLE), 6) AS profit FROM {{opportunities}} WHERE {SCORE_SQL} >= 5")
def t10(x: DataFrame) -> DataFrame:
    part = lambda c: F.round(f"breakdown.{c}", 6).alias(c)
    return detect.scored(x).select("id", F.round("total", 6).alias("total"), part("edge"), part("profit"))


@query("t11_list_forecasts", "forecasts", sql="SELECT id, probability FROM {forecasts} WHERE resolved ORDER BY ts DESC, id DESC LIMIT 100")
def t11(x: DataFrame) -> DataFrame:
    return x.where("resolved").orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id", "probability")


@query("a13_opportunity_stats", "opportunities", sql="SELECT type, count(*) AS n, round(coalesce(avg(score), 0), 6) AS avg_score FROM {opportunities} GROUP BY ROLLUP (type)")
def a13(x: DataFrame) -> DataFrame:
    return detect.stats(x)


@query("a14_divergence_rate", "comparisons", sql="SELECT count(*) AS resolved, count(*) FILTER (outcome = 'diverged') AS diverged, round(coalesce(count(*) FILTER (outcome = 'diverged') / nullif(count(*), 0), 0), 6) AS rate FROM {comparisons} WHERE outcome IS NOT NULL")
def a14(x: DataFrame) -> DataFrame:
    return calibration.divergence_rate(x)


_P = "least(1.0, greatest(0.0, probability))"


@query("a15_brier", "forecasts", sql=f"SELECT category, count(*) AS n, round(avg(pow({_P} - outcome, 2)), 6) AS brier, CASE WHEN avg(pow({_P} - outcome, 2)) <= 0.1 THEN 'Excellent' WHEN avg(pow({_P} - outcome, 2)) <= 0.2 THEN 'Good' WHEN avg(pow({_P} - outcome, 2)) <= 0.25 THEN 'Average' ELSE 'Poor' END AS band FROM {{forecasts}} WHERE resolved GROUP BY category")
def a15(x: DataFrame) -> DataFrame:
    return calibration.brier_by(x, "category")


@query("a16_calibration_curve", "forecasts", sql=f"""WITH c AS (SELECT *, (bucket + 0.5) / 10 AS midpoint FROM (SELECT least(9, CAST(floor({_P} * 10) AS BIGINT)) AS bucket, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS hits FROM {{forecasts}} WHERE resolved GROUP BY 1)), e AS (SELECT sum((midpoint - hits / n) * n) / sum(n) AS err FROM c)
    SELECT bucket, n, hits, round(hits / n, 6) AS observed, midpoint, round(err, 6) AS signed_error, CASE WHEN abs(floor(err * 100 + 0.5)) <= 5 THEN 'calibrated' WHEN err > 0 THEN 'overconfident' ELSE 'underconfident' END AS verdict FROM c, e""")
def a16(x: DataFrame) -> DataFrame:
    return calibration.curve(x)


@query("a17_calibration_by_category", "forecasts", sql=f"SELECT category, count(*) AS total, count(*) FILTER (resolved) AS resolved, round(avg(CASE WHEN resolved THEN pow({_P} - outcome, 2) END), 6) AS brier FROM {{forecasts}} GROUP BY ROLLUP (category)")
def a17(x: DataFrame) -> DataFrame:
    return calibration.by_category(x)


_BOOKS = "(SELECT platform, market_id, count(*) AS n, sum(ask) AS a, sum(bid) AS b, min(liquidity) AS liq FROM {outcomes} GROUP BY platform, market_id)"
_MULTI = f"(SELECT *, gross - n * 2.0 AS net FROM (SELECT *, CASE WHEN (1 - a) * 100 > (b - 1) * 100 AND (1 - a) * 100 > 0 THEN 'buy' WHEN (b - 1) * 100 > 0 THEN 'sell' END AS kind, CASE WHEN (1 - a) * 100 > (b - 1) * 100 AND (1 - a) * 100 > 0 THEN (1 - a) * 100 ELSE (b - 1) * 100 END AS gross FROM {_BOOKS} WHERE n >= 3) WHERE kind IS NOT NULL)"
_REASON = "CASE WHEN net <= 0 THEN 'fees_exceed_edge' WHEN liq < 500 THEN 'low_liquidity' WHEN net < 0.5 THEN 'low_edge' END"


@query("a19_multi_outcome", "outcomes", sql=f"""SELECT platform, market_id, kind, round(gross, 6) AS gross, round(net, 6) AS net, round(CASE WHEN kind = 'buy' THEN a * 100 ELSE 100 END, 6) AS capital, round(CASE WHEN kind = 'buy' THEN 100 - a * 100 ELSE b * 100 - 100 END * net / gross, 6) AS profit,
    round(CAST(least(1.0, CASE WHEN net >= 3 THEN 0.9 + least((net - 3) / 10, 0.1) WHEN net >= 1 THEN 0.7 + (net - 1) / 2 * 0.2 ELSE 0.5 + (net - 0.5) / 0.5 * 0.2 END + CASE WHEN liq >= 2000 THEN 0.05 ELSE 0 END) AS DOUBLE), 6) AS confidence FROM {_MULTI} WHERE {_REASON} IS NULL""")
def a19(x: DataFrame) -> DataFrame:
    found = detect.multi_outcome(detect.outcome_books(x)).where("reason is null")
    return found.select("platform", "market_id", "kind", *(F.round(c, 6).alias(c) for c in ("gross", "net", "capital", "profit", "confidence")))


@query("a20_near_misses", "outcomes", sql=f"SELECT platform, market_id, kind, round(net, 6) AS net, {_REASON} AS reason FROM {_MULTI} WHERE {_REASON} IS NOT NULL")
def a20(x: DataFrame) -> DataFrame:
    return detect.multi_outcome(detect.outcome_books(x)).where("reason is not null").select("platform", "market_id", "kind", F.round("net", 6).alias("net"), "reason")


_SUMS = f"(SELECT *, abs(a - 1) * 100 AS edge FROM {_BOOKS} WHERE n >= 2 AND liq >= 500 AND a > 0 AND abs(a - 1) * 100 >= 2)"
_SUM_CONF = "CASE WHEN edge > 5 THEN 0.9 + (least(edge, 10) - 5) / 5 * 0.1 ELSE 0.7 + (edge - 2) / 3 * 0.2 END"


@query("a21_price_sums", "outcomes", sql=f"SELECT platform, market_id, concat(CASE WHEN n = 2 THEN 'binary_' ELSE 'multi_' END, CASE WHEN a > 1 THEN 'overpriced' ELSE 'underpriced' END) AS kind, round(edge, 6) AS edge, round({_SUM_CONF}, 6) AS confidence, round(abs(a - 1), 6) AS expected_value FROM {_SUMS}")
def a21(x: DataFrame) -> DataFrame:
    return detect.price_sums(detect.outcome_books(x)).select("platform", "market_id", "kind", *(F.round(c, 6).alias(c) for c in ("edge", "confidence", "expected_value")))


_CROSS = f"""(SELECT *, least(1.0, greatest(0.5, 0.7 + (net - 0.10) * 2.5 + least(0.05, liq / 10000 * 0.05))) AS sure FROM (SELECT m.a_id, m.confidence, abs(a.yes - b.yes) AS gross, greatest(0.0, abs(a.yes - b.yes) - CAST(0.09 AS DOUBLE)) AS net, least(a.liq, b.liq) AS liq FROM {{matches}} m JOIN {_ASOF} a ON a.platform = 'venue_a' AND a.market_id = m.a_id
    JOIN {_ASOF} b ON b.platform = 'venue_b' AND b.market_id = m.b_id WHERE m.confidence >= 0.5 AND m.n % 5 <> 0) WHERE liq >= 500 AND net >= CAST(0.10 AS DOUBLE))"""
# forecasts of all markets by the shared number of their question, whatever many there are
_FORECAST = """(SELECT l.platform, l.id AS market_id, 0.9 AS confidence, q.age_days, floor(abs(q.q2 - l.yes) * 100 + 0.5) AS percent FROM {listings} l JOIN (SELECT *, row_number() OVER (ORDER BY id) - 1 AS nth, count(*) OVER () AS n FROM {questions}) q ON l.ord % q.n = q.nth WHERE floor(abs(q.q2 - l.yes) * 100 + 0.5) >= 5)"""
UNIFIED = f"""(SELECT 'multi_outcome' AS type, platform, market_id, gross / 100 AS gross_edge, net / 100 AS net_edge, CAST(least(1.0, CASE WHEN net >= 3 THEN 0.9 + least((net - 3) / 10, 0.1) WHEN net >= 1 THEN 0.7 + (net - 1) / 2 * 0.2 ELSE 0.5 + (net - 0.5) / 0.5 * 0.2 END + CASE WHEN liq >= 2000 THEN 0.05 ELSE 0 END) AS DOUBLE) AS detector_confidence, CAST(NULL AS DOUBLE) AS match_confidence, liq AS min_liquidity, n AS depth FROM {_MULTI} WHERE {_REASON} IS NULL
    UNION ALL SELECT 'correlated', platform, market_id, edge / 100, greatest(0.0, edge / 100 - CASE WHEN platform = 'venue_a' THEN 0.02 ELSE 0.07 END * n), {_SUM_CONF}, NULL, liq, n FROM {_SUMS}
    UNION ALL SELECT 'cross_platform', 'cross', a_id, gross, net, sure, confidence, liq, 2 FROM {_CROSS}
    UNION ALL SELECT 'divergence', platform, market_id, percent / 100, percent / 100, CASE WHEN age_days <= 7 THEN 0.9 ELSE 0.6 END, confidence, 0.0, 1 FROM {_FORECAST})"""


def _found(outcomes: DataFrame, m: DataFrame, s: DataFrame, x: DataFrame, q: DataFrame) -> DataFrame:
    books = detect.outcome_books(outcomes)
    risk = F.when(F.col("n") % 5 == 0, "HIGH").otherwise("LOW")
    cross = detect.cross_venue(history.asof_pairs(m, s, _now(), 2000).withColumn("risk", risk))
    return detect.unify(detect.multi_outcome(books), detect.price_sums(books), cross, detect.divergence(forecast_pairs(x, q)))


_INPUTS = ("outcomes", "matches", "snapshots", "listings", "questions")


@query("u2_unified", *_INPUTS, sql=f"SELECT substring(md5(concat_ws(':', type, platform, market_id)), 1, 16) AS id, type, platform, market_id, round(gross_edge, 6) AS gross_edge, round(net_edge, 6) AS net_edge, round(detector_confidence, 6) AS detector_confidence, round(match_confidence, 6) AS match_confidence, round(min_liquidity, 4) AS min_liquidity, depth FROM {UNIFIED}")
def u2(*tables: DataFrame) -> DataFrame:
    r = lambda c, n=6: F.round(c, n).alias(c)
    return _found(*tables).select("id", "type", "platform", "market_id", r("gross_edge"), r("net_edge"), r("detector_confidence"), r("match_confidence"), r("min_liquidity", 4), "depth")


@query("a22_detector_counts", *_INPUTS, sql=f"SELECT type, platform, count(*) AS n FROM {UNIFIED} GROUP BY CUBE (type, platform)")
def a22(*tables: DataFrame) -> DataFrame:
    return detect.counts(_found(*tables))


@query("a22_run_counters", *_INPUTS, sql=f"SELECT count(*) FILTER (type = 'multi_outcome' AND platform = 'venue_a') AS multi_outcome_a, count(*) FILTER (type = 'multi_outcome' AND platform = 'venue_b') AS multi_outcome_b, count(*) FILTER (type = 'correlated') AS correlated, count(*) FILTER (type = 'cross_platform') AS cross_platform, count(*) FILTER (type = 'divergence') AS divergence, count(*) AS total FROM {UNIFIED}")
def a22_counters(*tables: DataFrame) -> DataFrame:
    return detect.run_counters(_found(*tables))


