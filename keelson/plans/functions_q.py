"""Queries of the expression libraries: text, keys, dates, scores, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import scoring as S
from keelson.functions import text as T
from keelson.plans import expected as X
from keelson.plans.registry import query
from keelson.sources import parsing

_Q = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _kw(c: str, stop: list[str], punct: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\w\\s]', '{punct}', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {_in(stop)})"


def dice_sql(source: str, **pairs: tuple[str, str]) -> str:
    """``source`` with a Dice column for each named pair of its columns (no white space), by
    how often each letter pair occurs."""
    for name, (a, b) in pairs.items():
        counts = lambda c: f"list_aggregate(list_transform(range(1, length({c})), lambda i: {c}[i:i+1]), 'histogram')"
        counted = f"SELECT *, {counts(a)} AS {name}_ha, {counts(b)} AS {name}_hb FROM ({source})"
        shared = f"coalesce(list_sum(list_transform(map_keys({name}_ha), lambda k: least({name}_ha[k], coalesce({name}_hb[k], 0)))), 0)"
        source = f"SELECT *, CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * {shared} / (length({a}) + length({b}) - 2) END AS {name} FROM ({counted})"
    return source


def _source(c: str, phrases: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({c}, '(?i){p} ([^,.]+)', 1)), '')" for p in phrases) + ")"


@query("txt1_normalize_title", "listings", sql=f"SELECT id, {_Q.format('question')} AS title FROM {{listings}}")
def txt1(x: DataFrame) -> DataFrame:
    return x.select("id", T.normalize_title(F.col("question")).alias("title"))


@query("txt2_keywords", "listings", sql=f"SELECT id, array_to_string({_kw('question', X.MATCH_STOP, '')}, ' ') AS match_words, CAST(len({_kw('rules', X.RULE_STOP, ' ')}) AS BIGINT) AS n_rule_words FROM {{listings}}")
def txt2(x: DataFrame) -> DataFrame:
    return x.select("id", F.array_join(T.keywords(F.col("question")), " ").alias("match_words"), F.size(T.keywords(F.col("rules"), T.RULE_STOP, " ")).cast("long").alias("n_rule_words"))


_PAIR = "SELECT l.id, l.question AS q, n.question AS r FROM {listings} l JOIN {listings} n ON n.ord = l.ord + 1"


def _neighbours(x: DataFrame) -> DataFrame:
    l, n = x.select("id", "ord", F.col("question").alias("q")), x.select((F.col("ord") - 1).alias("ord"), F.col("question").alias("r"))
    return l.join(n, "ord")


@query("txt3_jaccard", "listings", sql=f"SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM (SELECT id, {_kw('q', X.MATCH_STOP, '')} AS a, {_kw('r', X.MATCH_STOP, '')} AS b FROM ({_PAIR}))")
def txt3(x: DataFrame) -> DataFrame:
    return _neighbours(x).select("id", F.round(T.jaccard(T.keywords(F.col("q")), T.keywords(F.col("r"))), 6).alias("jaccard"))


@query("txt4_dice", "listings", sql="SELECT id, round(dice, 6) AS dice FROM (" + dice_sql(f"SELECT id, regexp_replace(lower(q), '\\s+', '', 'g') AS a, regexp_replace(lower(r), '\\s+', '', 'g') AS b FROM ({_PAIR})", dice=("a", "b")) + ")")
def txt4(x: DataFrame) -> DataFrame:
    return _neighbours(x).select("id", F.round(T.dice(F.lower("q"), F.lower("r")), 6).alias("dice"))


@query("txt5_entities", "listings", sql="SELECT id, CAST(len(e) AS BIGINT) AS n, array_to_string(list_sort(e), '|') AS entities FROM (SELECT id, list_distinct(list_filter(list_transform(regexp_extract_all(rules, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), lambda r: regexp_replace(r, '^(?:(?:" + "|".join(T.STARTERS) + ")(?: |$))+', '')), lambda r: r <> '')) AS e FROM {listings})")
def txt5(x: DataFrame) -> DataFrame:
    e = T.entities(F.col("rules"))
    return x.select("id", F.size(e).cast("long").alias("n"), F.array_join(F.array_sort(e), "|").alias("entities"))


@query("txt6_data_source", "pages", sql=f"SELECT page_id, {_source('t', T.SOURCE_PHRASES_A)} AS source_a, coalesce({_source('t', T.SOURCE_PHRASES_B)}, regexp_replace(regexp_extract(url, '://([^/?#:]+)', 1), '^www\\.', '')) AS source_b FROM (SELECT page_id, url, concat('Settled ', CASE page_id % 5 WHEN 0 THEN 'according to the Bureau ' WHEN 1 THEN 'as reported by Agency ' WHEN 2 THEN 'Published by Office ' WHEN 3 THEN 'source: Desk ' ELSE 'by vote of ' END, CAST(page_id AS STRING), ', finally.') AS t FROM {{pages}})")
def txt6(x: DataFrame) -> DataFrame:
    phrase = F.expr("CASE page_id % 5 WHEN 0 THEN 'according to the Bureau ' WHEN 1 THEN 'as reported by Agency ' WHEN 2 THEN 'Published by Office ' WHEN 3 THEN 'source: Desk ' ELSE 'by vote of ' END")
    t = F.concat(F.lit("Settled "), phrase, F.col("page_id").cast("string"), F.lit(", finally."))
    return x.select("page_id", T.data_source(t, T.SOURCE_PHRASES_A).alias("source_a"), F.coalesce(T.data_source(t, T.SOURCE_PHRASES_B), T.host_of(F.col("url"))).alias("source_b"))


# venue B's further fields
_RULED = "(SELECT *, CASE WHEN ord % 10 = 1 THEN 'Closes March 3, 2026 or 2026-04-01 at the latest.' END AS rules_secondary, concat('https://www.', source, '.org/x') AS source_url, CASE WHEN ord % 7 = 0 THEN 'scalar' ELSE 'binary' END AS market_type, CASE WHEN platform = 'venue_b' THEN rules ELSE split_part(rules, chr(10), 1) END AS primary_rule FROM {listings})"


@query("txt7_settlement_criteria", "listings", sql=f"""SELECT id, primary_rule, CASE WHEN platform = 'venue_b' THEN rules_secondary END AS secondary_rule, CASE WHEN market_type = 'scalar' THEN 'scalar' WHEN n_outcomes > 2 THEN 'categorical' ELSE 'binary' END AS settlement_type, coalesce(close_day, CASE WHEN ord % 10 = 1 THEN date_diff('day', DATE '1970-01-01', DATE '2026-04-01') END) AS resolution_day,
    CASE WHEN platform = 'venue_b' THEN coalesce({_source('rules', T.SOURCE_PHRASES_B)}, source || '.org') ELSE {_source('rules', T.SOURCE_PHRASES_A)} END AS data_source, CAST(len({_kw('primary_rule', X.RULE_STOP, ' ')}) AS BIGINT) AS n_keywords FROM {_RULED}""")
def txt7(x: DataFrame) -> DataFrame:
    more = {"rules_secondary": F.when(F.col("ord") % 10 == 1, "Closes March 3, 2026 or 2026-04-01 at the latest."), "source_url": F.concat(F.lit("https://www."), "source", F.lit(".org/x")), "market_type": F.when(F.col("ord") % 7 == 0, "scalar").otherwise("binary")}
    return parsing.settlement_criteria(x.withColumns(more)).select("id", "primary_rule", "secondary_rule", "settlement_type", "resolution_day", "data_source", F.size("keywords").cast("long").alias("n_keywords"))


@query("txt8_risk_factors", "listings", sql="""SELECT a.id, concat_ws('; ', CASE WHEN days IS NULL THEN 'missing date' END, CASE WHEN days > 7 THEN concat('dates differ by ', CAST(days AS STRING), ' days') END, CASE WHEN a.source <> b.source AND b.source IS NOT NULL THEN 'different sources' END, CASE WHEN a.ord % 4 = 0 THEN 'subjective: reasonable, standard' END) AS risks
    FROM (SELECT a.*, abs(a.close_day - n.close_day) AS days FROM {listings} a JOIN {listings} n ON n.ord = a.ord + 1) a JOIN {listings} b ON b.ord = a.ord + 1""")
def txt8_risks(x: DataFrame) -> DataFrame:
    b = x.select((F.col("ord") - 1).alias("ord"), F.col("close_day").alias("b_day"), F.col("source").alias("b_source"))
    same = F.when(F.col("source") == F.col("b_source"), 1.0).otherwise(0.0)
    rules = F.when(F.col("ord") % 4 == 0, "By a Reasonable, Standard view").otherwise("By the count")
    risks = T.risk_factors(F.abs(F.col("close_day") - F.col("b_day")), F.col("source"), F.col("b_source"), same, rules)
    return x.join(b, "ord").select("id", F.array_join(risks, "; ").alias("risks"))


@query("txt8_risk_words", "conversations", sql="SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in X.SUBJECTIVE) + "], lambda w: contains(lower(t), w)), ', ') AS subjective FROM (SELECT conv_id, turn, concat(text, CASE conv_id % 3 WHEN 0 THEN ' a Reasonable standard' WHEN 1 THEN ' widely common' ELSE '' END) AS t FROM {conversations})")
def txt8(x: DataFrame) -> DataFrame:
    t = F.concat("text", F.expr("CASE conv_id % 3 WHEN 0 THEN ' a Reasonable standard' WHEN 1 THEN ' widely common' ELSE '' END"))
    return x.select("conv_id", "turn", F.array_join(T.subjective_words(t), ", ").alias("subjective"))


@query("txt9_embed_text", "listings", sql="SELECT id, md5(substring(concat_ws('. ', nullif(question, ''), nullif(source, ''), nullif(rules, '')), 1, 2000)) AS embed_md5, md5(concat_ws(chr(10), concat('Question: ', question), 'Outcome: ' || nullif(source, ''), 'Resolution: ' || nullif(substring(regexp_replace(rules, '\\s+', ' ', 'g'), 1, 700), ''))) AS describe_md5 FROM {listings}")
def txt9(x: DataFrame) -> DataFrame:
    c = F.col("question"), F.col("source"), F.col("rules")
    return x.select("id", F.md5(T.embed_text(*c)).alias("embed_md5"), F.md5(T.describe(*c)).alias("describe_md5"))


@query("txt11_slug", "listings", sql="SELECT id, coalesce(nullif(regexp_replace(substring(replace(trim(regexp_replace(regexp_replace(lower(question), '[^\\w\\s-]', '', 'g'), '\\s+', ' ', 'g')), ' ', '-'), 1, 80), '-+$', ''), ''), 'untitled') AS slug FROM {listings}")
def txt11(x: DataFrame) -> DataFrame:
    return x.select("id", T.slugify(F.col("question")).alias("slug"))


@query("txt12_search_terms", "listings", sql="SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(question, '[^\\w\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 3)[1:5], ' ') AS terms FROM {listings}")
def txt12(x: DataFrame) -> DataFrame:
    return x.select("id", T.search_terms(F.col("question")).alias("terms"))


@query("key1_stable_keys", "listings", sql="""SELECT id, substring(md5(concat_ws(':', 'correlated', platform, id)), 1, 16) AS opportunity, substring(md5(concat_ws(':', 'correlated', platform, id)), 1, 12) AS dedup,
    sha256(concat_ws('␟', '2', 'p7', 'prov', 'm1', id, substring(sha256(question), 1, 16), array_to_string(list_sort([concat('z', ':', substring(sha256(rules), 1, 16)), concat('b', ':', substring(sha256(question), 1, 16))]), '|'))) AS verdict FROM {listings}""")
def key1(x: DataFrame) -> DataFrame:
    c = F.array(F.struct(F.lit("z").alias("id"), F.col("rules").alias("text")), F.struct(F.lit("b").alias("id"), F.col("question").alias("text")))
    return x.select("id", T.opportunity_id(F.lit("correlated"), F.col("platform"), F.col("id")).alias("opportunity"), T.opportunity_id(F.lit("correlated"), F.col("platform"), F.col("id"), 12).alias("dedup"), T.verdict_key(2, "p7", "prov", "m1", F.col("id"), F.col("question"), c).alias("verdict"))


@query("dt1_timing_similarity", "orders", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0.0, 1 - d / 14), 6) AS timing, round(d, 6) AS days FROM (SELECT l_orderkey, l_linenumber, l_partkey, abs(epoch_us(o_orderdate) - epoch_us(l_shipdate)) / 86400000000 / 40 AS d FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)")
def dt1(o: DataFrame, l: DataFrame) -> DataFrame:
    d = T.days_between(F.col("o_orderdate"), F.col("l_shipdate")) / 40
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.round(T.timing_similarity(d), 6).alias("timing"), F.round(d, 6).alias("days"))


@query("dt2_dates_in_text", "orders", sql="SELECT o_orderkey, CAST(greatest(CAST(o_orderdate AS DATE), DATE '1997-03-05') AS STRING) AS latest, CAST(2 AS BIGINT) AS n FROM {orders}")
def dt2(o: DataFrame) -> DataFrame:
    t = F.concat(F.lit("Closes "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" or on 1997-03-05, not on 1997-13-45."))
    d = T.dates_in_text(t)
    return o.select("o_orderkey", F.array_max(d).cast("string").alias("latest"), F.size(d).cast("long").alias("n"))


EDGE_SQL = "CASE WHEN net_edge * 100 <= 0 THEN 1.0 WHEN net_edge * 100 < 5 THEN 1 + net_edge * 100 / 5 WHEN net_edge * 100 < 7 THEN 3 + (net_edge * 100 - 5) / 2 WHEN net_edge * 100 < 10 THEN 5 + (net_edge * 100 - 7) / 3 WHEN net_edge * 100 < 15 THEN 7 + (net_edge * 100 - 10) / 5 WHEN net_edge * 100 < 20 THEN 9.0 ELSE 10.0 END"
_CONF = "CASE WHEN detector_confidence * coalesce(match_confidence, 1.0) * 10 <= 0 THEN 0.0 ELSE least(10.0, detector_confidence * coalesce(match_confidence, 1.0) * 10) END"
_LIQ = "CASE WHEN min_liquidity < 500 THEN 0.0 WHEN min_liquidity < 1000 THEN 3.0 WHEN min_liquidity < 5000 THEN 5.0 WHEN min_liquidity < 10000 THEN 7.0 WHEN min_liquidity < 50000 THEN 9.0 ELSE 10.0 END"
_TIME = "CASE WHEN days_left IS NULL THEN 5.0 WHEN days_left < 1 THEN 10.0 WHEN days_left < 3 THEN 8.0 WHEN days_left < 7 THEN 6.0 WHEN days_left < 30 THEN 4.0 ELSE 2.0 END"
PROFIT_SQL = "least(10.0, net_edge * 100)"
SCORE_SQL = f"CASE WHEN net_edge >= 0.05 THEN least(10.0, greatest(1.0, {EDGE_SQL} * 0.35 + {_CONF} * 0.25 + {_LIQ} * 0.20 + {_TIME} * 0.10 + {PROFIT_SQL} * 0.10)) END"


def _cols():
    return F.col("net_edge"), F.col("detector_confidence"), F.col("match_confidence"), F.col("min_liquidity"), F.col("days_left")


def _factor(name: str, sql: str, make):
    query(name, "opportunities", sql=f"SELECT id, round(CAST({sql} AS DOUBLE), 6) AS score FROM {{opportunities}}")(lambda x: x.select("id", F.round(make(), 6).alias("score")))


_factor("m1_edge_score", EDGE_SQL, lambda: S.edge_score(F.col("net_edge")))
_factor("m2_confidence_score", _CONF, lambda: S.confidence_score(F.col("detector_confidence"), F.col("match_confidence")))
_factor("m3_liquidity_score", _LIQ, lambda: S.liquidity_score(F.col("min_liquidity")))
_factor("m4_time_score", _TIME, lambda: S.time_score(F.col("days_left")))
_factor("m5_profit_score", PROFIT_SQL, lambda: S.profit_score(F.col("net_edge")))
_factor("m6_composite_score", SCORE_SQL, lambda: S.composite(*_cols()))


@query("m7_kelly", "opportunities", sql="""SELECT id, CASE WHEN none THEN 0.0 ELSE floor(500 * f * 100 + 0.5) / 100 END AS size, CASE WHEN none THEN 0.0 ELSE floor(f * 100 * 10000 + 0.5) / 10000 END AS percent, CASE WHEN none THEN 'kelly' WHEN k > 0.10 THEN 'max' ELSE 'none' END AS capped_by,
    round(CASE WHEN abs(match_confidence - detector_confidence) > 0.01 THEN least(0.10, abs(match_confidence - detector_confidence) * 0.5) ELSE 0.0 END, 6) AS estimate, CASE WHEN match_confidence > detector_confidence THEN 'BUY YES' ELSE 'BUY NO' END AS side
    FROM (SELECT *, net_edge * detector_confidence * 0.5 AS k, CASE WHEN net_edge * detector_confidence * 0.5 > 0.10 THEN 0.10 ELSE net_edge * detector_confidence * 0.5 END AS f, net_edge <= 0 OR detector_confidence < 0.1 AS none FROM {opportunities})""")
def m7(x: DataFrame) -> DataFrame:
    k, e = S.kelly(F.col("net_edge"), F.col("detector_confidence"), 500.0), S.kelly_estimate(F.col("match_confidence"), F.col("detector_confidence"))
    return x.select("id", k["size"].alias("size"), k["percent"].alias("percent"), k["capped_by"].alias("capped_by"), F.round(e["fraction"], 6).alias("estimate"), e["side"].alias("side"))


@query("js1_parse_snapshot", "events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) / 100 AS yes FROM {events} WHERE event_id % 9 <> 0 AND json_extract(props, '$.k') IS NOT NULL")
def js1(x: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"prices":{"Yes":'), (k.cast("double") / 100).cast("string"), F.lit("}}")))
    return parsing.parse_snapshots(x.select("event_id", raw.alias("data")), "data").select("event_id", F.try_element_at("prices", F.lit("Yes")).alias("yes"))


@query("js2_parse_verdict", "pairs", sql="""SELECT a_id, CASE WHEN match_rank <= 5 THEN b_id END AS matched_b_id, match_rank <= 5 AND same_criteria AS same_event, match_rank <= 5 AND same_criteria AS same_criteria, yes_aligned, substring(category || a_title, 1, 120) AS reason FROM {pairs} WHERE l_orderkey % 17 <> 3""")
def js2(x: DataFrame) -> DataFrame:
    at = F.when(F.col("match_rank") <= 5, "0").otherwise("4")
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    raw = F.concat(F.lit('{"match_index":'), at, F.lit(',"same_event":'), flag("same_criteria"), F.lit(',"same_criteria":'), flag("same_criteria"), F.lit(',"yes_aligned":'), flag("yes_aligned"), F.lit(',"reason":"'), F.concat("category", "a_title"), F.lit('"}'))
    raw = F.when(F.col("l_orderkey") % 17 == 3, "no json").otherwise(raw)
    v = parsing.parse_verdict(raw, F.array("b_id"))
    return x.select("a_id", F.explode(F.array_compact(F.array(v))).alias("v")).select("a_id", "v.*")
