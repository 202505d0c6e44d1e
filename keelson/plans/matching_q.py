"""Queries that find the same contract on two venues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import detect, matching, study
from keelson.plans import expected as X
from keelson.plans.fixtures import forecast_pairs
from keelson.plans.functions_q import _kw, dice_sql
from keelson.plans.registry import query

_NORM = "trim(regexp_replace(regexp_replace(lower(question), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _sides(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


_CAND = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY cosine DESC, b_id) AS rank, max(cosine) OVER (PARTITION BY a_id) AS best FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM {embeddings} a JOIN {embeddings} b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE cosine >= 0.3) WHERE rank <= 5 AND cosine >= round(best - 0.08, 6))"""


def _greedy_sql(edges: str) -> str:
    """One-to-one choice over ``edges(a_ord, pref, b_id, score)`` row by row, as the rule is
    stated: in the order of a, the most preferred b that none before it took."""
    return f"""WITH RECURSIVE e AS ({edges}), r AS (SELECT a_ord, list(struct_pack(b := b_id, s := score) ORDER BY pref, b_id) AS es, row_number() OVER (ORDER BY a_ord) AS rn FROM e GROUP BY a_ord),
    g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS a_ord, CAST(NULL AS STRUCT(b BIGINT, s DOUBLE)) AS pick, CAST([] AS BIGINT[]) AS used
    UNION ALL SELECT rn, a_ord, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.b) END FROM (SELECT r.rn, r.a_ord, CAST(list_filter(es, lambda x: NOT list_contains(g.used, x.b))[1] AS STRUCT(b BIGINT, s DOUBLE)) AS pick, g.used FROM g JOIN r ON r.rn = g.rn + 1) n)
    SELECT a_ord, pick.b AS b_id, pick.s AS score FROM g WHERE pick IS NOT NULL"""


@query("j1_candidate_pairs", "embeddings", sql=f"SELECT a_id, b_id, cosine, rank FROM {_CAND}")
def j1(e: DataFrame) -> DataFrame:
    return matching.similar_vectors(*_sides(e), threshold=0.3)


@query("j2_semantic_matches", "embeddings", sql=_greedy_sql("SELECT a_id AS a_ord, -cosine AS pref, b_id, cosine AS score FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM {embeddings} a JOIN {embeddings} b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE cosine >= 0.3"))
def j2(e: DataFrame) -> DataFrame:
    return matching.semantic_matches(*_sides(e), threshold=0.3)


_LEX = f"""SELECT a.ord AS a_ord, b.ord AS b_ord, round(CASE WHEN a.t = b.t THEN 1.0 ELSE 0.7 + (j - 0.5) * 0.4 END, 6) AS confidence, CASE WHEN a.t = b.t THEN 'exact' ELSE 'keyword' END AS method FROM (SELECT a.ord, b.ord AS bo, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS j
    FROM (SELECT *, {_kw('question', X.MATCH_STOP, '')} AS w FROM {{listings}} WHERE platform = 'venue_a') a JOIN (SELECT *, {_kw('question', X.MATCH_STOP, '')} AS w FROM {{listings}} WHERE platform = 'venue_b') b ON a.n_outcomes = b.n_outcomes AND coalesce(abs(a.close_day - b.close_day) <= 7, true)) x
    JOIN (SELECT ord, {_NORM} AS t FROM {{listings}}) a ON a.ord = x.ord JOIN (SELECT ord, {_NORM} AS t FROM {{listings}}) b ON b.ord = x.bo WHERE a.t = b.t OR j >= 0.5"""


def _venues(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    return x.where("platform = 'venue_a'"), x.where("platform = 'venue_b'")


@query("j3_lexical_edges", "listings", sql=_LEX)
def j3(x: DataFrame) -> DataFrame:
    return matching.lexical_edges(*_venues(x)).withColumn("confidence", F.round("confidence", 6))


@query("j3_lexical_matches", "listings", sql=f"SELECT a_ord, b_id AS b_ord, score AS confidence FROM ({_greedy_sql(f'SELECT a_ord, b_ord AS pref, b_ord AS b_id, confidence AS score FROM ({_LEX})')})")
def j3_greedy(x: DataFrame) -> DataFrame:
    return matching.lexical_matches(*_venues(x)).withColumn("confidence", F.round("confidence", 6))


@query("j4_curated_override", "matches", sql="""WITH c AS (SELECT a_id, b_id FROM (SELECT a_id, CASE WHEN n % 20 = 3 THEN concat('m', CAST(n + 1 AS STRING)) WHEN n % 20 = 13 THEN 'unlisted' ELSE b_id END AS b_id FROM {matches} WHERE n % 10 = 3 AND n % 3 <> 0) WHERE b_id IN (SELECT b_id FROM {matches}))
    SELECT a_id, b_id, 1.0 AS confidence, 'manual' AS method FROM c UNION ALL SELECT a_id, b_id, confidence, method FROM {matches} WHERE a_id NOT IN (SELECT a_id FROM c) AND b_id NOT IN (SELECT b_id FROM c)""")
def j4(m: DataFrame) -> DataFrame:
    other = F.when(F.col("n") % 20 == 3, F.concat(F.lit("m"), (F.col("n") + 1).cast("string"))).when(F.col("n") % 20 == 13, "unlisted").otherwise(F.col("b_id"))
    manual = m.where("n % 10 = 3").select("a_id", other.alias("b_id"), (F.col("n") % 3 != 0).alias("verified"))
    return matching.apply_curated(m, manual, m.select(F.col("a_id").alias("id")), m.select(F.col("b_id").alias("id")))


_FC = "SELECT q_id, m_ord, round(overall, 6) AS overall, CASE WHEN dice > 0.95 THEN 'exact' ELSE 'fuzzy' END AS method FROM (SELECT *, 0.5 * dice + 0.3 * 0.5 + 0.2 * greatest(0.0, 1 - days / 14) AS overall FROM (" + dice_sql("""SELECT * FROM (SELECT q.id AS q_id, l.ord AS m_ord, abs(l.close_day - q.resolve_day) AS days, q.t AS a, l.t AS b
    FROM (SELECT *, regexp_replace(lower(title), '\\s+', '', 'g') AS t FROM {questions}) q JOIN (SELECT *, regexp_replace(lower(question), '\\s+', '', 'g') AS t FROM {listings}) l ON q.type = 'binary' AND abs(l.close_day - q.resolve_day) < 14)
    WHERE a = b OR (length(a) > 1 AND length(b) > 1 AND 2 * (least(length(a), length(b)) - 1) >= 0.5 * (length(a) + length(b) - 2))""", dice=("a", "b")) + ")) WHERE overall >= 0.6"


@query("j5_forecast_edges", "questions", "listings", sql=_FC)
def j5(q: DataFrame, x: DataFrame) -> DataFrame:
    return matching.forecast_edges(q, x, 0.6).select("q_id", "m_ord", F.round("overall", 6).alias("overall"), "method")


# the edges stand in one table that both uses read
@query("j5_forecast_matches", "questions", "listings", sql=_greedy_sql("SELECT q_id AS a_ord, -overall AS pref, m_ord AS b_id, overall AS score FROM fc").replace("WITH RECURSIVE", f"WITH RECURSIVE fc AS MATERIALIZED ({_FC}),").replace("SELECT a_ord, pick.b AS b_id, pick.s AS score FROM g", "SELECT fc.* FROM g JOIN fc ON g.a_ord = fc.q_id AND g.pick.b = fc.m_ord"))
def j5_greedy(q: DataFrame, x: DataFrame) -> DataFrame:
    return matching.forecast_matches(q, x, 0.6)


_CANDIDATES = "(SELECT concat('k', CAST(l_orderkey AS STRING)) AS key, b_id, cosine, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, b_id) AS rank FROM {pairs})"


def _candidates(p: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "b_id")
    return p.select(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("key"), "b_id", "cosine", F.row_number().over(order).cast("long").alias("rank"))


@query("j8_resolve_verdicts", "pairs", "verdicts", sql=f"SELECT c.key, b_id, cosine, rank FROM {_CANDIDATES} c JOIN {{verdicts}} v ON v.k = c.key AND v.picked = c.rank WHERE v.same_event")
def j8(p: DataFrame, v: DataFrame) -> DataFrame:
    return matching.resolve_verdicts(_candidates(p), v)


def _requests(p: DataFrame) -> DataFrame:
    return _candidates(p).groupBy("key").agg(F.count("*").alias("n"))


@query("j9_preflight", "pairs", "verdicts", sql=f"""SELECT groups, pairs, cached, groups - cached AS missing, round((groups - cached) * (420 * 0.00015 + 160 * 0.0006) / 1000, 6) AS cost, round(CASE WHEN groups = cached THEN 0.0 ELSE greatest((groups - cached) / 500, (groups - cached) * 580 / 200000) END, 6) AS minutes, CASE WHEN groups - cached > 1000 THEN 'requests' WHEN (groups - cached) * (420 * 0.00015 + 160 * 0.0006) / 1000 > 0.05 THEN 'cost' END AS refused FROM (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS pairs, count(v.k) AS cached FROM (SELECT key, count(*) AS n FROM {_CANDIDATES} GROUP BY key) c LEFT JOIN {{verdicts}} v ON v.k = c.key)""")
def j9(p: DataFrame, v: DataFrame) -> DataFrame:
    return matching.preflight(_requests(p), v, max_requests=1000, max_cost=0.05)


@query("j10_missing_requests", "pairs", "verdicts", sql=f"SELECT DISTINCT key FROM {_CANDIDATES} WHERE key NOT IN (SELECT k FROM {{verdicts}})")
def j10(p: DataFrame, v: DataFrame) -> DataFrame:
    return matching.missing(_requests(p), v).select("key")


@query("j11_embedding_misses", "documents", sql="SELECT key, count(*) AS n FROM (SELECT sha256('m1' || chr(10) || text) AS key FROM {documents}) WHERE key NOT IN (SELECT sha256('m1' || chr(10) || text) FROM {documents} WHERE doc_id % 3 = 0) GROUP BY key")
def j11(d: DataFrame) -> DataFrame:
    cache = d.where("doc_id % 3 = 0").select(F.sha2(F.concat(F.lit("m1\n"), "text"), 256).alias("key"))
    return matching.embedding_misses(d, cache, "m1")


_KEYED = "(SELECT doc_id, sha256('m1' || chr(10) || text) AS key FROM {documents})"
_CACHED = f"(SELECT key, min(doc_id) AS first FROM {_KEYED} WHERE doc_id % 3 = 0 GROUP BY key)"


def _looked_up(d: DataFrame) -> DataFrame:
    cache = d.where("doc_id % 3 = 0").groupBy(matching.embedding_key(F.col("text"), "m1").alias("key")).agg(F.array(F.min("doc_id").cast("float")).alias("vec"))
    return matching.embedding_lookup(d, cache, "m1")


@query("j11_embedding_lookup", "documents", sql=f"SELECT doc_id, CAST(first AS BIGINT) AS first FROM {_KEYED} k LEFT JOIN {_CACHED} c ON k.key = c.key")
def j11_lookup(d: DataFrame) -> DataFrame:
    return _looked_up(d).select("doc_id", F.get("vec", F.lit(0)).cast("long").alias("first"))


@query("j11_embedding_stats", "documents", sql=f"SELECT count(first) AS hits, count(*) - count(first) AS misses FROM {_KEYED} k LEFT JOIN {_CACHED} c ON k.key = c.key")
def j11_stats(d: DataFrame) -> DataFrame:
    return matching.embedding_stats(_looked_up(d))


@query("j11_stale_embeddings", "snapshots", sql="SELECT platform, market_id AS id FROM (SELECT platform, market_id, max(ts) FILTER (event_id % 3 = 0 AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS seen FROM {snapshots} GROUP BY platform, market_id) WHERE seen IS NULL OR TIMESTAMP '2024-01-20 12:00:00' - seen > INTERVAL 24 HOUR")
def j11_stale(s: DataFrame) -> DataFrame:
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp")
    meta = s.where((F.col("event_id") % 3 == 0) & (F.col("ts") <= as_of)).groupBy("platform", F.col("market_id").alias("id")).agg(F.max("ts").alias("updated_at"))
    return matching.stale_embeddings(s.select("platform", F.col("market_id").alias("id")).distinct(), meta, as_of)


_SQ = "regexp_replace(lower({0}), '\\s+', '', 'g')"
_RULE = "substr({0}.rules, length({0}.question) + 2)"  # all after the first line, which is the question
# each listing with the next; some verdicts are set by hand, some comparisons are stored
_SET = f"""SELECT id, qs AS question_similarity, criteria, timing, src, safe, CASE WHEN safe AND risks = 0 THEN 'LOW' WHEN safe THEN 'MEDIUM' ELSE 'HIGH' END AS risk, CASE WHEN safe AND risks = 0 THEN 0 WHEN safe AND reused THEN 3 WHEN safe THEN 2 END AS penalty, risks, reused FROM
    (SELECT * REPLACE (CASE WHEN reused THEN stored ELSE safe END AS safe, CASE WHEN reused THEN stored_risks ELSE risks END AS risks) FROM
    (SELECT *, coalesce(ov, 0.3 * qs + 0.4 * criteria + 0.2 * timing + 0.1 * src >= 0.9 AND criteria >= 0.7 AND timing >= 0.5 AND risks = 0) AS safe FROM
    (SELECT id, ov, reused, stored, stored_risks, round(d1, 6) AS qs, round(d2, 6) AS criteria, round(coalesce(greatest(0.0, 1 - days / 14), 0.0), 6) AS timing, round(coalesce(d3, 0.0), 6) AS src,
     CAST(days IS NULL AS INT) + CAST(coalesce(days > 7, false) AS INT) + CAST(coalesce(d3 < 0.8, false) AS INT) + CAST(judged AS INT) AS risks FROM ({dice_sql(f"""SELECT a.id, CASE WHEN a.ord % 10 = 0 THEN true END AS ov, a.ord % 13 = 0 AS reused, a.ord % 2 = 0 AS stored, CAST(a.ord % 26 = 0 AS INT) AS stored_risks, abs(a.close_day - b.close_day) AS days,
     len(list_filter(['reasonable', 'consensus', 'mainstream', 'general', 'widely', 'common', 'typical', 'standard', 'normal', 'appropriate', 'significant', 'substantial'], lambda w: contains(lower({_RULE.format('a')} || ' ' || {_RULE.format('b')}), w))) > 0 AS judged,
     {_SQ.format('a.question')} AS qa, {_SQ.format('b.question')} AS qb, {_SQ.format(_RULE.format('a'))} AS ra, {_SQ.format(_RULE.format('b'))} AS rb, lower(a.source) AS sa, lower(b.source) AS sb FROM {{listings}} a JOIN {{listings}} b ON b.ord = a.ord + 1""", d1=("qa", "qb"), d2=("ra", "rb"), d3=("sa", "sb"))}))))"""


@query("j12_settlement", "listings", sql=_SET)
def j12(x: DataFrame) -> DataFrame:
    rule = F.expr("substr(rules, length(question) + 2)")
    side = lambda k, o: x.select((F.col("ord") - o).alias("o"), F.col("id").alias(f"{k}_id"), F.col("question").alias(f"{k}_question"), rule.alias(f"{k}_rule"), F.col("source").alias(f"{k}_source"), F.col("close_day").alias(f"{k}_day"))
    pairs = side("a", 0).join(side("b", 1), "o").withColumn("override", F.when(F.col("o") % 10 == 0, F.lit(True)))
    stored = F.when(F.col("o") % 26 == 0, F.array(F.lit("another mechanism"))).otherwise(F.array().cast("array<string>"))
    existing = pairs.where("o % 13 = 0").select("a_id", "b_id", (F.col("o") % 2 == 0).alias("safe"), stored.alias("risk_factors"))
    r = lambda c, n: F.round(c, 6).alias(n)
    found = matching.settlement(pairs, existing)
    return found.select(F.col("a_id").alias("id"), r("question_similarity", "question_similarity"), r("criteria_similarity", "criteria"), r("timing_similarity", "timing"), r("source_similarity", "src"), "safe", "risk", "penalty", F.size("risk_factors").alias("risks"), "reused")


@query("j13_divergence", "questions", "listings", sql="SELECT id, CAST(floor(abs(q2 - yes) * 100 + 0.5) AS BIGINT) AS percent, CASE WHEN age_days <= 7 THEN 'fresh' WHEN age_days <= 14 THEN 'over a week old' WHEN age_days <= 28 THEN 'over two weeks old' ELSE 'over four weeks old' END AS band FROM (SELECT l.id, q.q2, l.yes, q.age_days FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS nth, count(*) OVER () AS n FROM {questions}) q JOIN {listings} l ON q.nth = l.ord % q.n) WHERE floor(abs(q2 - yes) * 100 + 0.5) >= 5")
def j13(q: DataFrame, x: DataFrame) -> DataFrame:
    return detect.divergence(forecast_pairs(x, q)).select("id", "percent", "band")


_W = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\w\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2))"


@query("j20_title_matches", "listings", "questions", sql=f"SELECT ord, arg_min(q_id, (-j, q_id)) AS q_id, round(max(j), 6) AS confidence, round(arg_min(abs(q2 - yes), (-j, q_id)), 6) AS divergence FROM (SELECT ord, q_id, yes, q2, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM (SELECT ord, yes, {_W.format('question')} AS a FROM {{listings}}) JOIN (SELECT id AS q_id, q2, {_W.format('title')} AS b FROM {{questions}} WHERE q2 IS NOT NULL) ON len(a) > 0 AND len(b) > 0) WHERE j >= 0.15 GROUP BY ord")
def j20(x: DataFrame, q: DataFrame) -> DataFrame:
    return matching.title_matches(x, q, 0.15).withColumns({"confidence": F.round("confidence", 6), "divergence": F.round("divergence", 6)})


@query("txt10_requests", "pairs", sql=f"SELECT key, count(*) AS n, md5(string_agg(concat('[', CAST(rank - 1 AS STRING), '] ', b_id), chr(10) || chr(10) ORDER BY rank)) AS user_md5 FROM {_CANDIDATES} GROUP BY key")
def txt10(p: DataFrame) -> DataFrame:
    return matching.requests_of(_candidates(p).withColumn("text", F.col("b_id"))).select("key", "n", F.md5("user").alias("user_md5"))


@query("study_slice", "embeddings", sql=f"""SELECT category, count(*) AS pairs, round(median(gap) * 100, 6) AS median_pp, round(max(gap) * 100, 6) AS max_pp, count(*) FILTER (gap > 0.09) AS beats_fees FROM (SELECT *, abs(pa - CASE WHEN (a_id + b_id) % 5 <> 0 THEN pb ELSE 1 - pb END) AS gap FROM (SELECT a_id, b_id, (a_id * 7 % 97 + 1.5) / 100 AS pa, (b_id * 7 % 97 + 1.5) / 100 AS pb, CAST(a.label AS STRING) AS category FROM {_CAND} c
    JOIN {{embeddings}} a ON a.vec_id = a_id JOIN {{embeddings}} b ON b.vec_id = b_id WHERE a.label = b.label AND (a_id + b_id) % 3 <> 0)) GROUP BY category""")
def study_slice(e: DataFrame) -> DataFrame:
    """Vectors to fee-clearing gaps: candidates, verdicts, prices, gaps, categories."""
    a, b = (e.select(F.col("vec_id").alias(f"{k}_id"), F.col("label").alias(f"{k}_label"), F.expr("(vec_id * 7 % 97 + CAST(1.5 AS DOUBLE)) / 100").alias(f"{k}_price"), F.lit(1.0).alias(f"{k}_volume")) for k in "ab")
    pairs = matching.similar_vectors(*_sides(e), threshold=0.3).join(a, "a_id").join(b, "b_id").where("a_label = b_label")
    flags = {"same_criteria": (F.col("a_id") + F.col("b_id")) % 3 != 0, "yes_aligned": (F.col("a_id") + F.col("b_id")) % 5 != 0, "category": F.col("a_label").cast("string")}
    return study.category_slices(study.with_gap(pairs.withColumns(flags)))


