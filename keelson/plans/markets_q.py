"""Queries over listings and stored briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import history, markets
from keelson.plans import expected as X
from keelson.plans.registry import query

TODAY = 3


@query("pf14_search_markets", "listings", sql="SELECT id, category FROM {listings} WHERE platform = 'venue_b' AND contains(lower(question), 'the') AND contains(lower(category), 'en')")
def pf14(x: DataFrame) -> DataFrame:
    return markets.search(x, "venue_b", "The", "EN").select("id", "category")


_THEME = "concat(CASE ord % 12 WHEN 0 THEN 'Senate vote ' WHEN 1 THEN 'GDP of ' WHEN 2 THEN 'NBA finals ' WHEN 3 THEN 'OpenAI and ' WHEN 4 THEN 'Bitcoin ' WHEN 5 THEN 'Hurricane ' WHEN 6 THEN 'Grammy ' WHEN 7 THEN 'Ceasefire ' WHEN 8 THEN 'Vaccine ' WHEN 9 THEN 'Pope ' WHEN 10 THEN 'Before GTA VI: ' ELSE '' END, CAST(ord AS STRING))"


def _themed(x: DataFrame) -> DataFrame:
    return x.withColumns({"question": F.expr(_THEME), "category": F.when(F.col("ord") % 3 != 0, F.col("category"))})


_CATEGORY = " ".join(f"WHEN starts_with({_THEME}, '{theme}') THEN '{name}'" for theme, name in X.CATEGORY.items())


@query("pf15_infer_category", "listings", sql=f"SELECT id, CASE WHEN platform = 'venue_a' AND ord % 3 = 0 THEN CASE {_CATEGORY} ELSE 'Other' END WHEN ord % 3 <> 0 THEN category END AS category FROM {{listings}}")
def pf15(x: DataFrame) -> DataFrame:
    return markets.categorized(_themed(x)).select("id", "category")


@query("pf16_drop_junk", "listings", sql="SELECT id FROM {listings} WHERE ord % 12 <> 10 AND NOT (volume = 0 AND liquidity = 0)")
def pf16(x: DataFrame) -> DataFrame:
    return markets.drop_junk(_themed(x)).select("id")


_TAG = "CASE WHEN abs(signal - yes) >= 0.03 THEN 'price_gap' WHEN close_day - 3 > 0 AND close_day - 3 <= 7 AND volume > 500 THEN 'closing_soon' WHEN yes >= 0.35 AND yes <= 0.65 AND volume > 500 THEN 'toss_up' WHEN ((yes >= 0.85 AND yes < 1) OR (yes > 0 AND yes <= 0.15)) AND volume > 2000 THEN 'high_conviction' WHEN ((yes >= 0.10 AND yes < 0.25) OR (yes > 0.75 AND yes <= 0.90)) AND volume > 1000 THEN 'contrarian' END"


@query("pf17_classify", "listings", sql=f"SELECT id, {_TAG} AS tag FROM (SELECT *, CAST(NULL AS DOUBLE) AS signal FROM {{listings}})")
def pf17(x: DataFrame) -> DataFrame:
    return markets.tagged(x, TODAY).select("id", "tag")


def _matches(x: DataFrame) -> DataFrame:
    return x.where("ord % 4 = 0").select(F.col("id").alias("a_id"), F.concat(F.lit("d"), (F.col("ord") + 1).cast("string")).alias("b_id"), F.lit(0.9).alias("confidence"))


_FEED = "(SELECT l.*, o.yes AS signal FROM {listings} l LEFT JOIN {listings} o ON (l.ord % 4 = 0 AND o.ord = l.ord + 1) OR (l.ord % 4 = 1 AND o.ord = l.ord - 1))"


@query("j14_feed", "listings", sql=f"SELECT id, {_TAG} AS tag, round(signal - yes, 6) AS divergence FROM {_FEED}")
def j14(x: DataFrame) -> DataFrame:
    return markets.feed(x, _matches(x), TODAY).select("id", "tag", F.round("divergence", 6).alias("divergence"))


@query("t6_watchlist", "listings", sql=f"""WITH f AS (SELECT * FROM {_FEED}), b AS (SELECT 'toss_up' AS bucket, id, floor(abs(yes - 0.5) / 0.05) AS k, volume FROM f WHERE yes >= 0.35 AND yes <= 0.65 AND volume > 500 UNION ALL SELECT 'closing_soon', id, close_day - 3, volume FROM f WHERE close_day - 3 > 0 AND close_day - 3 <= 7 AND volume > 500
    UNION ALL SELECT 'high_conviction', id, 0, volume FROM f WHERE ((yes >= 0.85 AND yes < 1) OR (yes > 0 AND yes <= 0.15)) AND volume > 2000 UNION ALL SELECT 'contrarian', id, 0, volume FROM f WHERE ((yes >= 0.10 AND yes < 0.25) OR (yes > 0.75 AND yes <= 0.90)) AND volume > 1000)
    SELECT bucket, w.id, CASE bucket WHEN 'toss_up' THEN concat('split at ', p, '%') WHEN 'closing_soon' THEN concat('closes in ', CAST(l.close_day - 3 AS STRING), ' days at ', p, '%') WHEN 'high_conviction' THEN concat(CASE WHEN yes >= 0.85 THEN 'nearly sure at ' ELSE 'nearly ruled out at ' END, p, '%') WHEN 'contrarian' THEN concat(CASE WHEN yes < 0.5 THEN 'unlikely at ' ELSE 'likely at ' END, p, '%')
        ELSE concat(p, '% against ', CAST(CAST(floor(signal * 100 + 0.5) AS BIGINT) AS STRING), '%, ', CAST(CAST(floor(abs(signal - yes) * 100 + 0.5) AS BIGINT) AS STRING), ' points apart') END AS insight
    FROM (SELECT bucket, id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k, volume DESC, id) AS nth FROM b) WHERE nth <= 10 UNION ALL SELECT 'price_gap', id FROM f WHERE abs(signal - yes) >= 0.03) w JOIN (SELECT *, CAST(CAST(floor(yes * 100 + 0.5) AS BIGINT) AS STRING) AS p FROM f) l ON l.id = w.id""")
def t6(x: DataFrame) -> DataFrame:
    return markets.watchlist(x, _matches(x), TODAY).select("bucket", "id", "insight")


@query("t6_watchlist_counts", "listings", sql=f"""WITH f AS (SELECT * FROM {_FEED}) SELECT 'toss_up' AS bucket, least(10, count(*)) AS n FROM f WHERE yes >= 0.35 AND yes <= 0.65 AND volume > 500 UNION ALL SELECT 'closing_soon', least(10, count(*)) FROM f WHERE close_day - 3 > 0 AND close_day - 3 <= 7 AND volume > 500
    UNION ALL SELECT 'high_conviction', least(10, count(*)) FROM f WHERE ((yes >= 0.85 AND yes < 1) OR (yes > 0 AND yes <= 0.15)) AND volume > 2000 UNION ALL SELECT 'contrarian', least(10, count(*)) FROM f WHERE ((yes >= 0.10 AND yes < 0.25) OR (yes > 0.75 AND yes <= 0.90)) AND volume > 1000 UNION ALL SELECT 'price_gap', count(*) FROM f WHERE abs(signal - yes) >= 0.03""")
def t6_counts(x: DataFrame) -> DataFrame:
    return markets.watchlist_counts(markets.watchlist(x, _matches(x), TODAY))


@query("t8_quality_rank", "listings", sql="""SELECT id, round(quality, 6) AS quality FROM (SELECT id, CASE WHEN volume > 0 THEN log10(volume) / 3 ELSE 0 END + CASE WHEN liquidity > 0 THEN least(2.0, log10(liquidity) / 3) ELSE 0 END - CASE WHEN regexp_matches(question, '(?i)daily.*temperature|\\d+[hH]our|tonight|today''s') THEN 2 ELSE 0 END + CASE WHEN close_day - 3 > 0 AND close_day - 3 < 30 THEN 1 ELSE 0 END + CASE WHEN close_day - 3 > 0 AND close_day - 3 < 7 THEN 1 ELSE 0 END
    + CASE WHEN yes > 0.05 AND yes < 0.95 THEN 0.5 ELSE 0 END + CASE WHEN yes > 0.2 AND yes < 0.8 THEN 0.5 ELSE 0 END AS quality FROM {listings}) ORDER BY quality DESC, id LIMIT 100""")
def t8(x: DataFrame) -> DataFrame:
    return markets.quality_rank(x, TODAY, 100).select("id", F.round("quality", 6).alias("quality"))


_ITEM = "concat('Will ', CASE WHEN l_partkey % 3 = 0 THEN 'Team ' ELSE 'Team' END, CAST(l_suppkey AS STRING), ' win the cup of ', CAST(l_partkey % 400 AS STRING), '?')"


@query("a23_group_feed", "pairs", sql=f"""WITH i AS (SELECT a_id AS id, l_orderkey * 100 + l_linenumber AS rank, lower(concat('win the cup of ', CAST(l_partkey % 400 AS STRING))) AS key, a_volume AS volume, CASE WHEN l_suppkey % 7 = 0 THEN 'venue_a' ELSE 'venue_b' END AS platform, l_orderkey % 9 = 0 AS plain FROM {{pairs}}),
    g AS (SELECT key, count(*) AS members, sum(volume) AS volume, min(rank) AS rank, CASE WHEN min(platform) = max(platform) THEN min(platform) ELSE 'mixed' END AS platform FROM i WHERE NOT plain GROUP BY key HAVING count(*) >= 4)
    SELECT rank, key AS name, members, volume, platform FROM g UNION ALL SELECT rank, id, 1, volume, platform FROM i WHERE plain OR key NOT IN (SELECT key FROM g)""")
def a23(p: DataFrame) -> DataFrame:
    items = p.select(F.col("a_id").alias("id"), F.expr("l_orderkey * 100 + l_linenumber").alias("rank"), F.when(F.col("l_orderkey") % 9 == 0, F.lit("Plain question")).otherwise(F.expr(_ITEM)).alias("question"), F.col("a_volume").alias("volume"), F.expr("CASE WHEN l_suppkey % 7 = 0 THEN 'venue_a' ELSE 'venue_b' END").alias("platform"))
    return markets.group_feed(items).select("rank", "name", "members", "volume", "platform")


@query("u1_universe", "listings", sql="SELECT id, platform FROM {listings}")
def u1(x: DataFrame) -> DataFrame:
    return markets.universe(x.where("platform = 'venue_a'"), x.where("platform = 'venue_b'").drop("source")).select("id", "platform")


@query("u3_categories", "listings", sql="SELECT DISTINCT category FROM {listings} WHERE category IS NOT NULL")
def u3(x: DataFrame) -> DataFrame:
    return markets.categories(x)


# the sources stored for a market: one for each of its events, under the market's slug
_SOURCES = "(SELECT market_id AS slug, event_id AS ord, concat('source ', CAST(event_id AS STRING)) AS title FROM {snapshots})"


@query("j19_market_context", "matches", "snapshots", sql=f"""SELECT m.a_id AS market_id, a.yes, b.yes AS other_yes, h.n AS points, m.n % 2 = 0 AS safe, s.headlines FROM {{matches}} m LEFT JOIN (SELECT market_id, arg_max(yes, (ts, event_id)) AS yes FROM {{snapshots}} WHERE platform = 'venue_a' GROUP BY 1) a ON a.market_id = m.a_id
    LEFT JOIN (SELECT market_id, arg_max(yes, (ts, event_id)) AS yes FROM {{snapshots}} WHERE platform = 'venue_b' GROUP BY 1) b ON b.market_id = m.b_id LEFT JOIN (SELECT market_id, least(count(*), 10) AS n FROM {{snapshots}} WHERE platform = 'venue_a' GROUP BY 1) h ON h.market_id = m.a_id
    LEFT JOIN (SELECT slug, string_agg(title, ';' ORDER BY ord) AS headlines FROM {_SOURCES} GROUP BY slug) s ON s.slug = m.a_id""")
def j19(m: DataFrame, s: DataFrame) -> DataFrame:
    now, own = history.latest(s), s.where("platform = 'venue_a'")
    safe = m.select("a_id", "b_id", (F.col("n") % 2 == 0).alias("safe"))
    sources = s.select(F.col("market_id").alias("slug"), F.col("event_id").alias("ord"), F.concat(F.lit("source "), F.col("event_id").cast("string")).alias("title"))
    own_markets = m.select(F.col("a_id").alias("market_id"), F.upper("a_id").alias("question"))
    rows = markets.context(own_markets, m, now.where("platform = 'venue_b'"), history.recent(own, 10), safe, sources)
    mine = now.where("platform = 'venue_a'").select("market_id", "yes")
    return rows.join(mine, "market_id", "left").select("market_id", "yes", "other_yes", F.size(F.split("history", ",")).cast("long").alias("points"), "safe", F.array_join("headlines", ";").alias("headlines"))


VENUES, FORECASTERS = ["first venue", "second venue"], ["forecast site"]
# the checks as they are stated, apart from the library's own table
_EXPECTED = {
    "has_verdict": "length(trim(t)) > 60 AND regexp_matches(t, '(?i)verdict|lean (yes|no)|\\bpass\\b')",
    "no_urls": "NOT regexp_matches(t, '(?i)https?://')",
    "no_live_claim": "NOT regexp_matches(t, '(?i)\\b(i (just )?(searched|googled|looked up|browsed|scraped|crawled)|in real[ -]?time|live (web|news|internet)[ -]?search|according to (my|a|the) (web|news|recent)[ -]?search|i (found|pulled|retrieved) .*(online|on the web))\\b')",
    "fees": "regexp_matches(t, '(?i)\\bfees?\\b|spread|round[- ]?trip|trading cost')",
    "settlement": "regexp_matches(t, '(?i)settl')",
    "platforms": "regexp_matches(t, '(?i)first venue|second venue|platform|cross[- ]?platform')",
    "forecasters": "regexp_matches(t, '(?i)forecast site|superforecaster')",
    "source_limits": "regexp_matches(t, '(?i)base rate|limited|thin|sparse|no (recent )?(news|sources|external|coverage)|without (more )?(data|sources)')",
    "news": "regexp_matches(t, '(?i)sentiment|news|headline|report')",
    "trend": "regexp_matches(t, '(?i)trend|history|price action|drift|recent move|momentum')",
}
_CHECKS = ", ".join(f"round(avg(CAST({check} AS INT)), 6) AS {name}" for name, check in _EXPECTED.items())
_BRIEF = "concat(text, CASE conv_id % 9 WHEN 0 THEN ' Verdict: lean yes after fees.' WHEN 1 THEN ' See https://x.y for news.' WHEN 2 THEN ' In real time, thin sources.' WHEN 3 THEN ' Settlement differs by platform.' WHEN 4 THEN ' Superforecasters see a trend.' WHEN 5 THEN ' The Second Venue pays less.' WHEN 6 THEN ' The forecast site says 40%.' WHEN 7 THEN ' I found two reports online.' ELSE '' END)"


@query("a25_brief_quality", "conversations", sql=f"SELECT role, count(*) AS n, {_CHECKS} FROM (SELECT role, {_BRIEF} AS t FROM {{conversations}}) GROUP BY role")
def a25(c: DataFrame) -> DataFrame:
    checks = markets.brief_checks(VENUES, FORECASTERS)
    return markets.pass_rates(markets.brief_quality(c.withColumn("text", F.expr(_BRIEF)), checks=checks), "role")
