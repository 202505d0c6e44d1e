"""Queries over study pairs: gaps, funnel, audits, corrections, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import prices as P
from keelson.operators import study
from keelson.plans.registry import query
from keelson.sources.scratch import cut

_GAP = "abs(a_price - CASE WHEN yes_aligned THEN b_price ELSE 1 - b_price END)"


def _priceable(c: str) -> str:
    return f"{c} > 0.005 AND {c} < 0.995"


@query("pf1_yes_price", "outcomes", sql="""SELECT market_id, round(coalesce(max(CASE WHEN outcome = 1 THEN ask END), arg_min(ask, outcome), 0.5), 6) AS loose, round(max(CASE WHEN outcome = 2 THEN ask END), 6) AS strict FROM {outcomes} GROUP BY market_id""")
def pf1(x: DataFrame) -> DataFrame:
    name = F.expr("CASE outcome WHEN 1 THEN 'Yes' WHEN 2 THEN 'YES' ELSE CAST(outcome AS STRING) END")
    maps = x.groupBy("market_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("outcome", name.alias("k"), "ask"))), lambda e: F.struct(e["k"], e["ask"]))).alias("p"))
    strict = F.map_filter("p", lambda k, v: k != "Yes")
    return maps.select("market_id", F.round(P.yes_loose(F.col("p")), 6).alias("loose"), F.round(P.yes_strict(strict), 6).alias("strict"))


@query("pf2_priceable", "pairs", sql=f"SELECT a_id, a_volume > 0 AND b_volume > 0 AS tradeable, {_priceable('a_price')} AND {_priceable('b_price')} AS priceable FROM {{pairs}}")
def pf2(x: DataFrame) -> DataFrame:
    return x.select("a_id", ((F.col("a_volume") > 0) & (F.col("b_volume") > 0)).alias("tradeable"), (P.priceable(F.col("a_price")) & P.priceable(F.col("b_price"))).alias("priceable"))


@query("pf3_oriented_gap", "pairs", sql=f"SELECT a_id, b_id, round({_GAP}, 6) AS gap, round(greatest(0.0, {_GAP} - 0.09), 6) AS net, greatest(a_volume, b_volume) AS volume FROM {{pairs}}")
def pf3(x: DataFrame) -> DataFrame:
    g = study.with_gap(x)
    return g.select("a_id", "b_id", F.round("gap", 6).alias("gap"), F.round("net", 6).alias("net"), "volume")


@query("pf4_threshold_flags", "pairs", sql=f"SELECT a_id, {_GAP} >= 0.03 AS surfaced_3pp, {_GAP} > 0.09 AS beats_fees_9pp, {_GAP} >= 0.19 AS meets_detector_19pp FROM {{pairs}}")
def pf4(x: DataFrame) -> DataFrame:
    return study.with_flags(study.with_gap(x)).select("a_id", "surfaced_3pp", "beats_fees_9pp", "meets_detector_19pp")


@query("pf5_funnel_stage", "pairs", sql=f"SELECT a_id, CASE WHEN NOT same_criteria THEN 'topical_overlap' WHEN NOT ({_priceable('a_price')} AND {_priceable('b_price')}) THEN 'dropped_degenerate' WHEN {_GAP} <= 0.09 THEN 'validated_same_contract' ELSE 'apparent_fee_clearing_gap' END AS stage FROM {{pairs}}")
def pf5(x: DataFrame) -> DataFrame:
    return study.staged(study.with_gap(x)).select("a_id", F.col("funnel_stage").alias("stage"))


@query("pf6_triage_relabel", "pairs", sql=f"""SELECT a_id, CASE WHEN stage <> 'apparent_fee_clearing_gap' OR new_label IS NULL AND stage <> 'apparent_fee_clearing_gap' THEN stage WHEN new_label = 'confirmed' THEN 'semantic_survivor' WHEN new_label = 'scope_mismatch' THEN 'scope_mismatch' ELSE 'needs_manual_review' END AS label
    FROM (SELECT a_id, new_label, CASE WHEN NOT same_criteria THEN 'topical_overlap' WHEN NOT ({_priceable('a_price')} AND {_priceable('b_price')}) THEN 'dropped_degenerate' WHEN {_GAP} <= 0.09 THEN 'validated_same_contract' ELSE 'apparent_fee_clearing_gap' END AS stage FROM {{pairs}})""")
def pf6(x: DataFrame) -> DataFrame:
    labels = x.select("a_id", "b_id", F.col("new_label").alias("label"), F.lit("").alias("new_reason"))
    return study.apply_triage(study.staged(study.with_gap(x.drop("new_label"))).withColumn("reason", F.lit("r")), labels).select("a_id", F.col("triage_label").alias("label"))


@query("pf7_liquidity_tier", "pairs", sql="SELECT a_id, least(a_volume, b_volume) AS thin, CASE WHEN least(a_volume, b_volume) > 10000 THEN '>10k' WHEN least(a_volume, b_volume) > 5000 THEN '>5k' WHEN least(a_volume, b_volume) > 1000 THEN '>1k' WHEN least(a_volume, b_volume) > 500 THEN '>500' ELSE '<=500' END AS tier FROM {pairs}")
def pf7(x: DataFrame) -> DataFrame:
    thin = F.least("a_volume", "b_volume")
    return x.select("a_id", thin.alias("thin"), P.tier(thin).alias("tier"))


@query("pf8_strict_audit", "study", "checklists", sql="""SELECT s.a_id, s.thin, coalesce(s.l_orderkey % 10 <> 9 AND s.l_orderkey % 13 <> 0 AND s.l_orderkey % 7 <> 0 AND s.l_suppkey % 9 <> 0, false) AS spec_match FROM {study} s WHERE triage_label = 'semantic_survivor' AND thin > 500""")
def pf8(s: DataFrame, c: DataFrame) -> DataFrame:
    return study.strict_audit(s, c).select("a_id", "thin", "spec_match")


_SUSPICIOUS = r"""CASE WHEN regexp_matches(a, '(top goalscorer|top scorer|golden boot)') AND regexp_matches(b, 'goal leader') THEN 'top scorer or goal leader' WHEN regexp_matches(a, '(score a goal|goal contribution|to score)') AND regexp_matches(b, 'goal leader') THEN 'goal or goal leader'
    WHEN regexp_matches(a, '(a player representing|any player)') AND regexp_matches(b, '—\s*[a-zà-ÿ'']+\s+[a-zà-ÿ'']+') THEN 'any player or a named one'
    WHEN regexp_matches(a, '(o/u|over/under|\btotal\b)') AND regexp_matches(b, '(o/u|over/under|\btotal\b)') AND regexp_matches(a, '(first half|second half|1st half|2nd half)') <> regexp_matches(b, '(first half|second half|1st half|2nd half)') THEN 'full or half total'
    WHEN regexp_matches(a, '(win the (world cup|championship|tournament|title|final)|tournament winner|outright)') AND regexp_matches(b, '(win on \d|advance|\bvs\.?\b|group stage|to reach|semifinal|quarterfinal)') THEN 'tournament or one match'
    WHEN (regexp_matches(a, '\bin [a-z.'' -]*?county\b') AND NOT regexp_matches(b, '\bcount(y|ies)\b')) OR (regexp_matches(b, '\bin [a-z.'' -]*?county\b') AND NOT regexp_matches(a, '\bcount(y|ies)\b')) THEN 'county or state' END"""


@query("pf9_suspicious_titles", "pairs", sql=f"SELECT a_id, {_SUSPICIOUS} AS reason FROM (SELECT a_id, lower(a_title) AS a, lower(b_title) AS b FROM {{pairs}})")
def pf9(x: DataFrame) -> DataFrame:
    return x.select("a_id", P.suspicious(F.col("a_title"), F.col("b_title")).alias("reason"))


_STATUS = "CASE triage_label WHEN 'dropped_degenerate' THEN 'stale' WHEN 'scope_mismatch' THEN 'spec_mismatch' WHEN 'spec_mismatch' THEN 'spec_mismatch' WHEN 'semantic_survivor' THEN 'survivor' WHEN 'validated_same_contract' THEN 'same_contract' ELSE 'topical' END"


@query("pf10_pair_status", "study", sql=f"SELECT a_id, {_STATUS} AS status FROM {{study}}")
def pf10(s: DataFrame) -> DataFrame:
    return s.select("a_id", P.status(F.col("triage_label")).alias("status"))


@query("pf11_cause_of_death", "study", sql=f"""SELECT a_id, CASE WHEN why IS NOT NULL OR status = 'spec_mismatch' THEN 'different contract: ' || coalesce(why, 'resolve differently') WHEN status = 'stale' THEN concat('near-settled: ', CAST(CAST(floor(a_price * 100 + 0.5) AS BIGINT) AS STRING), '% and ', CAST(CAST(floor(b_price * 100 + 0.5) AS BIGINT) AS STRING), '%')
    WHEN status = 'topical' THEN 'same event, another contract' WHEN gap <= 0.09 THEN printf('fees: %.1f pp gap', gap * 100) WHEN thin < 10000 THEN 'depth: $' || CAST(CAST(floor(thin) AS BIGINT) AS STRING) WHEN l_orderkey % 2 = 1 THEN 'not strictly verified' ELSE 'passes' END AS cause
    FROM (SELECT *, {_STATUS} AS status, {_SUSPICIOUS} AS why FROM (SELECT *, lower(a_title) AS a, lower(b_title) AS b FROM {{study}}))""")
def pf11(s: DataFrame) -> DataFrame:
    cause = P.cause_of_death(F.col("a_title"), F.col("b_title"), P.status(F.col("triage_label")), F.col("gap"), F.col("thin"), F.col("l_orderkey") % 2 == 0, F.col("a_price"), F.col("b_price"), F.lit(""))
    return s.select("a_id", cause.alias("cause"))


@query("pf12_verifier_state", "study", "strict", sql="SELECT s.a_id, CASE WHEN c.spec_match AND c.tier = '>10k' THEN 'deep_survivor' WHEN c.spec_match THEN 'strict_match' WHEN c.spec_match IS NOT NULL THEN 'spec_mismatch' WHEN triage_label = 'semantic_survivor' THEN 'semantic_survivor' WHEN triage_label IN ('scope_mismatch', 'entity_mismatch_rejected') THEN 'spec_mismatch' ELSE 'candidate' END AS state FROM {study} s LEFT JOIN {strict} c ON s.a_id = c.a_id AND s.b_id = c.b_id")
def pf12(s: DataFrame, c: DataFrame) -> DataFrame:
    return study.verifier_states(s, c).select("a_id", "state")


_STATE = "CASE WHEN c.spec_match AND c.tier = '>10k' THEN 0 WHEN c.spec_match THEN 1 WHEN c.spec_match IS NOT NULL THEN 2 WHEN triage_label = 'semantic_survivor' THEN 3 WHEN triage_label IN ('scope_mismatch', 'entity_mismatch_rejected') THEN 2 ELSE 4 END"


@query("pf12_live_states", "study", "strict", "orders", sql=f"""WITH s AS (SELECT concat('p', CAST(l_partkey AS STRING)) AS a, concat('s', CAST(l_suppkey AS STRING)) AS b, {_STATE} AS r FROM {{study}} s LEFT JOIN {{strict}} c ON s.a_id = c.a_id AND s.b_id = c.b_id),
    m AS (SELECT a AS market_id, b AS other_id, r FROM s UNION ALL SELECT b, a, r FROM s), best AS (SELECT market_id, min(r) AS r, arg_min(other_id, (r, other_id)) AS other_id FROM m GROUP BY market_id)
    SELECT o.o_orderkey, o.market_id, CASE r WHEN 0 THEN 'deep_survivor' WHEN 1 THEN 'strict_match' WHEN 2 THEN 'spec_mismatch' WHEN 3 THEN 'semantic_survivor' WHEN 4 THEN 'candidate' ELSE 'live_only' END AS state, other_id FROM (SELECT o_orderkey, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 's' END, CAST(o_custkey AS STRING)) AS market_id FROM {{orders}}) o LEFT JOIN best ON best.market_id = o.market_id""")
def pf12_live(s: DataFrame, c: DataFrame, o: DataFrame) -> DataFrame:
    states = study.verifier_states(s, c).select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b_id"), "state")
    live = o.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "p").otherwise("s"), F.col("o_custkey").cast("string")).alias("market_id"))
    return study.live_states(live, states)


@query("pf13_filter_pairs", "study", sql=f"SELECT a_id, status, thin FROM (SELECT *, {_STATUS} AS status FROM {{study}}) WHERE (contains(lower(a_title), 'county') OR contains(lower(b_title), 'county')) AND status NOT IN ('stale', 'topical') AND thin >= 2000")
def pf13(s: DataFrame) -> DataFrame:
    return study.filter_pairs(s.withColumn("status", P.status(F.col("triage_label"))), search="County", stale=False, topical=False, min_liquidity=2000).select("a_id", "status", "thin")


@query("pf19_chart_pairs", "study", sql="SELECT a_id, triage_label, round(gap * 100, 6) AS gap_pp, gap > 0.09 AS beats_fees FROM {study} WHERE triage_label IN ('validated_same_contract', 'semantic_survivor', 'apparent_fee_clearing_gap')")
def pf19(s: DataFrame) -> DataFrame:
    return study.chart_pairs(s).select("a_id", "triage_label", F.round("gap_pp", 6).alias("gap_pp"), "beats_fees")


def _p90(c: str, by: str = "") -> str:
    """The order statistic at floor(0.9 n), not interpolated, by a list."""
    return f"coalesce(list_sort(list({c}))[least(count({c}), CAST(floor(90 / 100.0 * count({c})) AS BIGINT) + 1)], 0)"


@query("a1_gap_distribution", "study", sql=f"SELECT count(*) AS n, round(coalesce(median(gap), 0), 6) AS median, round(coalesce(avg(gap), 0), 6) AS mean, round({_p90('gap')}, 6) AS p90, round(coalesce(max(gap), 0), 6) AS max FROM {{study}} WHERE same_criteria AND priceable")
def a1(s: DataFrame) -> DataFrame:
    return study.gap_distribution(s)


@query("a2_actionable", "study", sql="SELECT count(*) FILTER (gap >= 0.03) AS over_3pp, count(*) FILTER (gap > 0.09) AS beats_fees, count(*) FILTER (gap >= 0.19) AS detector, count(*) FILTER (gap > 0.09 AND triage_label = 'semantic_survivor') AS confirmed FROM {study} WHERE same_criteria AND priceable")
def a2(s: DataFrame) -> DataFrame:
    return study.actionable(s)


@query("a3_gap_histogram", "study", sql="SELECT b.ord, b.label, count(s.a_id) AS n FROM (VALUES (0, '0-1pp'), (1, '1-2pp'), (2, '2-3pp'), (3, '3-5pp'), (4, '5-9pp'), (5, '9pp+')) b(ord, label) LEFT JOIN (SELECT a_id, CASE WHEN gap * 100 < 1 THEN 0 WHEN gap * 100 < 2 THEN 1 WHEN gap * 100 < 3 THEN 2 WHEN gap * 100 < 5 THEN 3 WHEN gap * 100 < 9 THEN 4 ELSE 5 END AS k FROM {study} WHERE same_criteria AND priceable) s ON s.k = b.ord GROUP BY ALL")
def a3(s: DataFrame) -> DataFrame:
    return study.gap_histogram(s)


# as the reference states it: both volumes over 0 and at the floor
_AT = "a_volume >= floor_ AND b_volume >= floor_ AND a_volume > 0 AND b_volume > 0"
_SCP = f"{_AT} AND same_criteria AND priceable"
_MARKETS = "(SELECT count(*) FROM {{listings}} WHERE platform = '{0}' AND volume > 0 AND volume >= floor_)"


@query("a4_sensitivity", "study", "listings", sql=f"""SELECT floor_, {_MARKETS.format('venue_a')} AS venue_a, {_MARKETS.format('venue_b')} AS venue_b, count(*) FILTER ({_AT}) AS overlaps, count(*) FILTER ({_SCP}) AS priceable, round(coalesce(median(gap) FILTER ({_SCP}), 0) * 100, 6) AS median_pp,
    round(coalesce(list_sort(list(gap) FILTER ({_SCP}))[least(count(*) FILTER ({_SCP}), CAST(floor(0.9 * count(*) FILTER ({_SCP})) AS BIGINT) + 1)], 0) * 100, 6) AS p90_pp, count(*) FILTER ({_SCP} AND gap > 0.09) AS beats_fees, count(*) FILTER ({_SCP} AND gap > 0.09 AND triage_label = 'semantic_survivor') AS confirmed
    FROM {{study}} CROSS JOIN (VALUES (0), (1000), (10000), (100000)) f(floor_) GROUP BY floor_""")
def a4(s: DataFrame, x: DataFrame) -> DataFrame:
    return study.sensitivity(s, x.where("platform = 'venue_a'"), x.where("platform = 'venue_b'"))


@query("a5_category_slices", "study", sql="SELECT category, count(*) AS pairs, round(median(gap) * 100, 6) AS median_pp, round(max(gap) * 100, 6) AS max_pp, count(*) FILTER (gap > 0.09) AS beats_fees FROM {study} WHERE same_criteria AND priceable GROUP BY category")
def a5(s: DataFrame) -> DataFrame:
    return study.category_slices(s)


@query("a6_match_rank_recall", "pairs", sql="SELECT least(match_rank, 5) AS rank, count(*) AS n, round((SELECT count(*) FILTER (match_rank = 1) / count(*) FROM {pairs}), 6) AS recall_1, round((SELECT count(*) FILTER (match_rank <= 5) / count(*) FROM {pairs}), 6) AS recall_5 FROM {pairs} GROUP BY 1")
def a6(x: DataFrame) -> DataFrame:
    return study.rank_histogram(x)


@query("a7_study_summary", "study", sql="""SELECT *, with_candidates - verified AS missing_verdicts, CASE WHEN with_candidates = verified THEN 'complete' ELSE 'partial' END AS status FROM (SELECT count(*) AS candidates, count(DISTINCT a_id) AS with_candidates, count(DISTINCT l_partkey) AS universe_a, count(DISTINCT l_suppkey) AS universe_b, count(DISTINCT l_partkey) * count(DISTINCT l_suppkey) AS pair_space, count(DISTINCT l_partkey) FILTER (a_volume > 0) AS tradeable_a, count(DISTINCT l_suppkey) FILTER (b_volume > 0) AS tradeable_b,
    count(*) FILTER (same_criteria) AS same_contract, count(*) FILTER (NOT same_criteria) AS topical, count(*) FILTER (same_criteria AND priceable) AS priceable, count(*) FILTER (same_criteria AND NOT priceable) AS dropped, count(DISTINCT a_id) FILTER (l_orderkey % 8 <> 7) AS verified FROM {study})""")
def a7(s: DataFrame) -> DataFrame:
    return study.summary(s, s.where("l_orderkey % 8 <> 7").select("a_id"), "l_partkey", "l_suppkey")


@query("a8_triage_funnel", "study", sql="SELECT triage_label, count(*) AS n, count(*) FILTER (NOT yes_aligned) AS oriented, round(100.0 * count(*) / (SELECT count(*) FROM {study}), 6) AS percent FROM {study} GROUP BY triage_label")
def a8(s: DataFrame) -> DataFrame:
    return study.triage_funnel(s)


@query("a9_strict_summary", "strict", sql="SELECT CASE WHEN mismatch_reason = '' THEN 'unspecified' ELSE mismatch_reason END AS reason, count(*) FILTER (NOT spec_match) AS mismatches, (SELECT count(*) FROM {strict}) AS audited, (SELECT count(*) FILTER (spec_match) FROM {strict}) AS strict, (SELECT count(*) FILTER (spec_match AND thin > 1000) FROM {strict}) AS strict_1k, (SELECT count(*) FILTER (spec_match AND thin > 5000) FROM {strict}) AS strict_5k, (SELECT count(*) FILTER (spec_match AND thin > 10000) FROM {strict}) AS strict_10k FROM {strict} GROUP BY 1")
def a9(s: DataFrame) -> DataFrame:
    return study.strict_summary(s)


@query("a10_correction_summary", "corrections", "study", sql="SELECT c.*, gone AS survivors_reclassified, survivors - gone AS corrected_survivors FROM (SELECT correction_source, original_verdict, count(*) AS n FROM {corrections} GROUP BY GROUPING SETS ((correction_source), (original_verdict), ())) c, (SELECT count(*) FILTER (original_verdict = 'semantic_survivor') AS gone FROM {corrections}), (SELECT count(*) FILTER (triage_label = 'semantic_survivor') AS survivors FROM {study})")
def a10(c: DataFrame, s: DataFrame) -> DataFrame:
    return study.correction_summary(c, s)


@query("a11_corrected_funnel", "study", "strict", "corrections", sql="""SELECT count(*) FILTER (triage_label = 'semantic_survivor' AND NOT (corrected AND NOT coalesce(spec_match, false))) AS semantic, count(*) FILTER (audited AND NOT (corrected AND coalesce(spec_match, false))) AS liquid, count(*) FILTER (spec_match AND NOT corrected) AS strict, count(*) FILTER (spec_match AND NOT corrected AND tier = '>10k') AS deep
    FROM (SELECT s.triage_label, c.a_id IS NOT NULL AS corrected, t.a_id IS NOT NULL AS audited, t.spec_match, t.tier FROM {study} s LEFT JOIN {strict} t ON s.a_id = t.a_id AND s.b_id = t.b_id LEFT JOIN {corrections} c ON s.a_id = c.a_id AND s.b_id = c.b_id)""")
def a11(s: DataFrame, t: DataFrame, c: DataFrame) -> DataFrame:
    return study.corrected_funnel(s, t, c)


@query("a12_evidence_counts", "study", "strict", sql="SELECT count(*) FILTER (t.a_id IS NOT NULL) AS liquid, count(*) FILTER (t.spec_match) AS strict, count(*) FILTER (NOT t.spec_match) AS mismatch, count(*) FILTER (s.gap > 0.09 AND s.same_criteria AND s.priceable) AS apparent, count(*) FILTER (triage_label = 'semantic_survivor' AND s.thin <= 500) AS thin FROM {study} s LEFT JOIN {strict} t ON s.a_id = t.a_id AND s.b_id = t.b_id")
def a12(s: DataFrame, t: DataFrame) -> DataFrame:
    return study.evidence_counts(s, t)


@query("a18_provenance", "verdicts", sql="SELECT provider, model, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT provider, model FROM {verdicts})) > 1 AS mixed FROM {verdicts} GROUP BY provider, model")
def a18(v: DataFrame) -> DataFrame:
    return study.provenance(v)


_VERSIONED = "(SELECT *, CASE WHEN picked <= 4 THEN 'v2' ELSE 'v1' END AS prompt_version, 1 + CAST(k LIKE '%1' AS INT) AS schema_version FROM {verdicts})"


def _versioned(v: DataFrame) -> DataFrame:
    return v.withColumns({"prompt_version": F.when(F.col("picked") <= 4, "v2").otherwise("v1"), "schema_version": 1 + F.endswith("k", F.lit("1")).cast("int")})


@query("a18_count_for_key", "verdicts", sql=f"SELECT count(*) AS n FROM {_VERSIONED} WHERE provider = 'p1' AND model = 'm1' AND prompt_version = 'v2' AND schema_version = 1")
def a18_count(v: DataFrame) -> DataFrame:
    return study.count_verdicts(_versioned(v), "p1", "m1", "v2", 1)


@query("a18_provenance_of_version", "verdicts", sql=f"SELECT provider, model, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT provider, model FROM {_VERSIONED} WHERE prompt_version = 'v1' AND schema_version = 2)) > 1 AS mixed FROM {_VERSIONED} WHERE prompt_version = 'v1' AND schema_version = 2 GROUP BY provider, model")
def a18_version(v: DataFrame) -> DataFrame:
    return study.provenance(study.of_version(_versioned(v), "v1", 2))


@query("a24_pair_meta", "study", sql=f"SELECT count(*) AS total, count(*) FILTER (st NOT IN ('stale', 'topical')) AS shown, count(*) FILTER (st = 'survivor') AS survivor, count(*) FILTER (st = 'same_contract') AS same_contract, count(*) FILTER (st = 'spec_mismatch') AS spec_mismatch, count(*) FILTER (st = 'topical') AS topical, count(*) FILTER (st = 'stale') AS stale, count(*) FILTER (l_orderkey % 3 <> 0 AND l_partkey % 4 <> 0) AS live FROM (SELECT *, {_STATUS} AS st FROM {{study}})")
def a24(s: DataFrame) -> DataFrame:
    return study.pair_meta(study.overlay_live(s, _live(s)).withColumn("status", P.status(F.col("triage_label"))))


@query("j15_corrections", "study", "strict", sql=f"""SELECT a_id, b_id, triage_label AS original_verdict, 'spec_mismatch' AS corrected_verdict, source FROM (SELECT s.a_id, s.b_id, triage_label, CASE WHEN NOT t.spec_match THEN 'strict_reverify' WHEN {_SUSPICIOUS} IS NOT NULL THEN 'deterministic_rule' END AS source
    FROM (SELECT *, lower(a_title) AS a, lower(b_title) AS b FROM {{study}}) s LEFT JOIN {{strict}} t ON s.a_id = t.a_id AND s.b_id = t.b_id WHERE triage_label NOT IN ('scope_mismatch', 'spec_mismatch', 'entity_mismatch_rejected')) WHERE source IS NOT NULL""")
def j15(s: DataFrame, t: DataFrame) -> DataFrame:
    return study.build_corrections(s, t).select("a_id", "b_id", "original_verdict", "corrected_verdict", F.col("correction_source").alias("source"))


@query("j16_verified_pairs", "study", "strict", "corrections", sql="""SELECT s.a_id, coalesce(c.corrected_verdict, s.triage_label) AS label, coalesce(t.spec_match, false) AND c.a_id IS NULL AS strict_survivor, coalesce(t.tier, '') AS tier, c.a_id IS NOT NULL AS corrected FROM {study} s LEFT JOIN {strict} t ON s.a_id = t.a_id AND s.b_id = t.b_id LEFT JOIN {corrections} c ON s.a_id = c.a_id AND s.b_id = c.b_id""")
def j16(s: DataFrame, t: DataFrame, c: DataFrame) -> DataFrame:
    return study.verified_pairs(s, t, c).select("a_id", F.col("triage_label").alias("label"), "strict_survivor", "tier", "corrected")


def _live(s: DataFrame) -> DataFrame:
    """Live probes: of some pairs both sides, one or none; closed markets, lost books."""
    a = s.where("l_orderkey % 3 <> 0").select(F.lit("venue_a").alias("platform"), F.col("a_id").alias("id"), F.expr("(l_orderkey % 97 + 1) / 100").alias("yes"), F.expr("a_volume + 5").alias("volume"), F.expr("l_orderkey % 5 <> 1").alias("active"), F.expr("l_suppkey % 6 <> 0").alias("has_book"))
    b = s.where("l_partkey % 4 <> 0").select(F.lit("venue_b").alias("platform"), F.col("b_id").alias("id"), F.expr("(l_partkey % 89 + 3) / 100").alias("yes"), F.expr("CASE WHEN l_partkey % 7 <> 0 THEN b_volume + 9 END").alias("volume"), F.expr("l_partkey % 3 <> 1").alias("active"), F.expr("l_orderkey % 7 <> 0").alias("has_book"))
    return a.unionByName(b)


# one side's live quote replaces that side alone; an absent volume of a live side is zero
_LIVE = """(SELECT *, abs(CASE WHEN a_on THEN (l_orderkey % 97 + 1) / 100 ELSE a_price END - CASE WHEN yes_aligned THEN b_now ELSE 1 - b_now END) AS live_gap, least(CASE WHEN a_on THEN a_volume + 5 ELSE a_volume END, CASE WHEN b_on AND l_partkey % 7 = 0 THEN 0 WHEN b_on THEN b_volume + 9 ELSE b_volume END) AS liquidity, a_on AND b_on AND l_orderkey % 5 = 1 AND l_partkey % 3 = 1 AS settled
    FROM (SELECT *, CASE WHEN b_on THEN (l_partkey % 89 + 3) / 100 ELSE b_price END AS b_now FROM (SELECT *, l_orderkey % 3 <> 0 AS a_on, l_partkey % 4 <> 0 AS b_on FROM {study})))"""


@query("j17_live_overlay", "study", sql=f"SELECT a_id, round(live_gap, 6) AS gap, live_gap > 0.09 AS beats_fees, a_on AND b_on AS prices_live, liquidity, settled, CASE WHEN b_on AND l_partkey % 3 <> 1 AND l_orderkey % 7 = 0 THEN 'venue_b' WHEN a_on AND l_orderkey % 5 <> 1 AND l_suppkey % 6 = 0 THEN 'venue_a' END AS stale_side FROM {_LIVE}")
def j17(s: DataFrame) -> DataFrame:
    return study.overlay_live(s, _live(s)).select("a_id", F.round("gap", 6).alias("gap"), "beats_fees", "prices_live", "liquidity", "settled", "stale_side")


# pairs of markets that several pairs share
_SHARED = "concat('p', CAST(l_partkey AS STRING)) AS a_id, concat('s', CAST(l_suppkey AS STRING)) AS b_id"
_STRICT_ROWS = f"(SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN concat('p', CAST(l_partkey AS STRING)) ELSE concat('x', CAST(l_partkey AS STRING)) END AS a_id, CASE WHEN l_partkey % 2 = 1 THEN concat('s', CAST(l_suppkey AS STRING)) ELSE concat('y', CAST(l_partkey AS STRING)) END AS b_id, l_partkey % 3 <> 0 AS spec_match, CASE WHEN l_partkey % 5 = 0 THEN '>10k' ELSE '>1k' END AS tier FROM {{study}} WHERE l_partkey % 4 < 3 AND l_suppkey % 3 <> 0)"


@query("j18_verifier_index", "study", sql=f"""WITH p AS (SELECT *, {_SHARED} FROM (SELECT * EXCLUDE (a_id, b_id), a_id AS old FROM {{study}})), t AS {_STRICT_ROWS.replace('{{', '{').replace('}}', '}')},
    ta AS (SELECT a_id, arg_max(spec_match, b_id) AS spec, arg_max(tier, b_id) AS tier FROM t GROUP BY a_id), tb AS (SELECT b_id, arg_max(spec_match, a_id) AS spec, arg_max(tier, a_id) AS tier FROM t GROUP BY b_id),
    j AS (SELECT p.a_id, p.b_id, p.old, triage_label, CASE WHEN ta.a_id IS NOT NULL THEN ta.spec ELSE tb.spec END AS spec, CASE WHEN ta.a_id IS NOT NULL THEN ta.tier ELSE tb.tier END AS tier FROM p LEFT JOIN ta ON ta.a_id = p.a_id LEFT JOIN tb ON tb.b_id = p.b_id),
    k AS (SELECT *, CASE WHEN spec AND tier = '>10k' THEN 'deep_survivor' WHEN spec THEN 'strict_match' WHEN spec IS NOT NULL THEN 'spec_mismatch' WHEN triage_label = 'semantic_survivor' THEN 'semantic_survivor' WHEN triage_label IN ('scope_mismatch', 'entity_mismatch_rejected') THEN 'spec_mismatch' ELSE 'candidate' END AS state FROM j)
    SELECT 'venue_a' AS platform, a_id AS id, arg_max(b_id, old) AS counterpart, arg_max(state, old) AS state, arg_max(coalesce(spec, false), old) AS strict FROM k GROUP BY a_id UNION ALL SELECT 'venue_b', b_id, arg_max(a_id, old), arg_max(state, old), arg_max(coalesce(spec, false), old) FROM k GROUP BY b_id""")
def j18(s: DataFrame) -> DataFrame:
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    p = s.withColumns({"old": F.col("a_id"), "a_id": F.concat(F.lit("p"), part), "b_id": F.concat(F.lit("s"), supp)})
    even = F.col("l_partkey") % 2 == 0
    ids = [F.when(even, F.concat(F.lit("p"), part)).otherwise(F.concat(F.lit("x"), part)).alias("a_id"), F.when(~even, F.concat(F.lit("s"), supp)).otherwise(F.concat(F.lit("y"), part)).alias("b_id")]
    t = s.where("l_partkey % 4 < 3 AND l_suppkey % 3 <> 0").select(*ids, F.expr("l_partkey % 3 <> 0").alias("spec_match"), F.expr("CASE WHEN l_partkey % 5 = 0 THEN '>10k' ELSE '>1k' END").alias("tier")).distinct()
    return study.verifier_index(p, t, ["old"])


@query("w3_funnel_stages", "study", "strict", "corrections", sql="""WITH o AS (SELECT s.triage_label, c.a_id IS NOT NULL AS corrected, t.a_id IS NOT NULL AS audited, coalesce(t.spec_match, false) AS ok, t.tier FROM {study} s LEFT JOIN {strict} t ON s.a_id = t.a_id AND s.b_id = t.b_id LEFT JOIN {corrections} c ON s.a_id = c.a_id AND s.b_id = c.b_id),
    v AS (SELECT 0 AS ord, 'tradeable' AS stage, (SELECT count(*) FILTER (a_volume > 0) + count(*) FILTER (b_volume > 0) FROM {study}) AS value UNION ALL SELECT 1, 'candidates', (SELECT count(*) FROM {study}) UNION ALL SELECT 2, 'same_event', (SELECT count(*) FILTER (same_criteria OR l_orderkey % 11 <> 0) FROM {study})
    UNION ALL SELECT 3, 'same_contract', (SELECT count(*) FILTER (same_criteria) FROM {study}) UNION ALL SELECT 4, 'priceable', (SELECT count(*) FILTER (same_criteria AND priceable) FROM {study}) UNION ALL SELECT 5, 'clears_fees', (SELECT count(*) FILTER (same_criteria AND priceable AND gap > 0.09) FROM {study})
    UNION ALL SELECT 6, 'semantic', (SELECT count(*) FILTER (triage_label = 'semantic_survivor' AND NOT (corrected AND NOT ok)) FROM o) UNION ALL SELECT 7, 'liquid', (SELECT count(*) FILTER (audited AND NOT (corrected AND ok)) FROM o) UNION ALL SELECT 8, 'strict', (SELECT count(*) FILTER (ok AND NOT corrected) FROM o)
    UNION ALL SELECT 9, 'deep', (SELECT count(*) FILTER (ok AND NOT corrected AND tier = '>10k') FROM o) UNION ALL SELECT 10, 'executable', (SELECT count(*) FILTER (spec_match AND thin > 22000) FROM {strict}))
    SELECT ord, stage, value, CASE WHEN ord > 1 THEN greatest(0, before - value) ELSE 0 END AS removed, CASE WHEN ord > 1 THEN round(100.0 * value / nullif(before, 0), 6) END AS kept_percent, round(CASE WHEN value > 0 THEN greatest(3.0, least(100.0, log10(value) / log10(most) * 100)) ELSE 0.0 END, 6) AS width FROM (SELECT *, lag(value) OVER (ORDER BY ord) AS before, max(value) OVER () AS most FROM v)""")
def w3(s: DataFrame, t: DataFrame, c: DataFrame) -> DataFrame:
    sides = s.select(F.explode(F.array("a_volume", "b_volume")).alias("volume")).where("volume > 0")
    return study.funnel_stages(s.withColumn("same_event", F.expr("same_criteria OR l_orderkey % 11 <> 0")), t, c, sides, t.where("spec_match AND thin > 22000"))


_RANKED = f"(SELECT *, {_STATUS} AS st, l_orderkey % 13 <> 0 AS strict_survivor FROM {_LIVE})"


def _order_sql(sort: str, n: int = 100) -> str:
    key = {"opportunity": "CASE st WHEN 'survivor' THEN 0 WHEN 'same_contract' THEN 1 WHEN 'spec_mismatch' THEN 2 WHEN 'topical' THEN 3 ELSE 4 END, strict_survivor DESC, liquidity DESC", "gap": "live_gap DESC", "liquidity": "liquidity DESC", "confidence": "cosine DESC"}[sort]
    return f"SELECT '{sort}' AS sort, a_id, st, rn FROM (SELECT a_id, st, row_number() OVER (ORDER BY settled, {key}, a_id, b_id) AS rn FROM {_RANKED}) WHERE rn <= {n}"


@query("t7_rank_pairs", "study", sql=" UNION ALL ".join(map(_order_sql, ("opportunity", "gap", "liquidity", "confidence"))))
def t7(s: DataFrame) -> DataFrame:
    pairs = study.overlay_live(s, _live(s)).withColumns({"st": P.status(F.col("triage_label")), "strict_survivor": F.col("l_orderkey") % 13 != 0})
    # joined once, then ranked four times
    pairs = cut(pairs.select("a_id", "b_id", "settled", "st", "strict_survivor", "liquidity", "gap", "cosine"))
    out = None
    for sort in ("opportunity", "gap", "liquidity", "confidence"):
        one = study.rank_pairs(pairs, 100, sort).select(F.lit(sort).alias("sort"), "a_id", "st", "rn")
        out = one if out is None else out.unionByName(one)
    return out


@query("t9_study_order", "study", sql="SELECT a_id, rn FROM (SELECT a_id, row_number() OVER (ORDER BY same_criteria DESC, cosine DESC, a_id, b_id) AS rn FROM {study}) WHERE rn <= 200")
def t9(s: DataFrame) -> DataFrame:
    return study.top_numbered(s, 200, F.desc("same_criteria"), F.desc("cosine"), "a_id", "b_id").select("a_id", "rn")


@query("t12_deep_survivors", "strict", sql="SELECT a_id, thin FROM {strict} WHERE spec_match AND tier = '>10k'")
def t12(t: DataFrame) -> DataFrame:
    return t.where("spec_match AND tier = '>10k'").orderBy(F.desc("thin"), "a_id").select("a_id", "thin")


@query("u4_uncorrected", "study", "corrections", sql="SELECT s.a_id, s.b_id FROM {study} s WHERE gap > 0.09 AND same_criteria AND priceable AND NOT EXISTS (SELECT 1 FROM {corrections} c WHERE c.a_id = s.a_id AND c.b_id = s.b_id)")
def u4(s: DataFrame, c: DataFrame) -> DataFrame:
    return s.where("gap > 0.09 AND same_criteria AND priceable").join(c.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select("a_id", "b_id")


@query("u5_title_diff", "pairs", sql="SELECT a_id, array_to_string(list_filter(list_distinct(string_split(regexp_replace(lower(a_title), '[^a-z0-9 ]', '', 'g'), ' ')), lambda w: length(w) > 2 AND w NOT IN ('will', 'the', 'and', 'for') AND NOT list_contains(string_split(regexp_replace(lower(b_title), '[^a-z0-9 ]', '', 'g'), ' '), w)).list_sort(), ' ') AS only_a FROM {pairs}")
def u5(x: DataFrame) -> DataFrame:
    return x.select("a_id", F.array_join(F.array_sort(study.title_diff(F.col("a_title"), F.col("b_title"))), " ").alias("only_a"))


