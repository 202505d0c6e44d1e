"""Listings: search, tags, feeds, watchlists, groups, contexts, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions import prices as P
from keelson.functions import text as T
from keelson.sources.scratch import cut

#: The verbs that outcome variants of one event share.
GROUP_VERBS = "win|be|become|reach|make|qualify|advance|finish|score|exceed|hit|lead|control|flip|defeat|beat"
def brief_checks(venues: list[str] = (), forecasters: list[str] = ()) -> dict[str, tuple[str, bool]]:
    """Checks of a stored brief by pattern; True: must be found. Names of the venues and of
    the forecast sources count beside the general words."""
    named = lambda names, *words: "(?i)" + "|".join([*names, *words])
    #: The patterns.
    return {
        "has_verdict": (r"(?i)verdict|lean (yes|no)|\bpass\b", True),
        "no_urls": (r"(?i)https?://", False),
        "no_live_claim": (r"(?i)\b(i (just )?(searched|googled|looked up|browsed|scraped|crawled)|in real[ -]?time|live (web|news|internet)[ -]?search|according to (my|a|the) (web|news|recent)[ -]?search|i (found|pulled|retrieved) .*(online|on the web))\b", False),
        "fees": (r"(?i)\bfees?\b|spread|round[- ]?trip|trading cost", True),
        "settlement": (r"(?i)settl", True),
        "platforms": (named(venues, "platform", "cross[- ]?platform"), True),
        "forecasters": (named(forecasters, "superforecaster"), True),
        "source_limits": (r"(?i)base rate|limited|thin|sparse|no (recent )?(news|sources|external|coverage)|without (more )?(data|sources)", True),
        "news": (r"(?i)sentiment|news|headline|report", True),
        "trend": (r"(?i)trend|history|price action|drift|recent move|momentum", True),
    }


def search(listings: DataFrame, platform: str | None = None, text: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    if platform:
        listings = listings.where(F.col("platform") == platform)
    for column, part in (("question", text), ("category", category)):
        if part:
            listings = listings.where(F.contains(F.lower(column), F.lit(part.lower())))
    return listings.orderBy("ord").limit(limit) if limit else listings


def categorized(listings: DataFrame) -> DataFrame:
    """Venue-A listings without a category get one from their question."""
    missing = (F.col("platform") == "venue_a") & F.col("category").isNull()
    return listings.withColumn("category", F.when(missing, P.infer_category(F.col("question"))).otherwise(F.col("category")))


def drop_junk(listings: DataFrame) -> DataFrame:
    return listings.where(~P.junk(F.col("question"), F.col("volume"), F.col("liquidity")))


def tagged(listings: DataFrame, today: int, signal: Column | None = None) -> DataFrame:
    return listings.withColumn("tag", P.classify(F.col("yes"), F.col("volume"), F.col("close_day") - today, signal if signal is not None else F.lit(None).cast("double")))


def both_ways(matches: DataFrame) -> DataFrame:
    """``id, other_id, confidence`` from both sides of each match."""
    sides = F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other_id"), "confidence"), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other_id"), "confidence"))
    return matches.select(F.explode(sides).alias("x")).select("x.*")


def feed(listings: DataFrame, matches: DataFrame, today: int) -> DataFrame:
    """Every listing with its match's price as signal and its tag."""
    prices = listings.select(F.col("id").alias("other_id"), F.col("yes").alias("signal"))
    linked = both_ways(matches).join(prices, "other_id")
    joined = listings.join(linked, "id", "left")
    return tagged(joined, today, F.col("signal")).withColumn("divergence", F.col("signal") - F.col("yes"))


def watchlist(listings: DataFrame, matches: DataFrame, today: int, n: int = 10) -> DataFrame:
    """The first ``n`` of each bucket, and every price gap, with what makes each worth a
    look; a market may be in several."""
    yes, vol, left = F.col("yes"), F.col("volume"), F.col("close_day") - today
    gap = F.abs(F.col("signal") - yes)
    whole = lambda c: F.floor(c * 100 + 0.5).cast("string")
    percent = F.concat(whole(yes), F.lit("%"))
    key = lambda k: F.struct(k.cast("double").alias("k"), (-vol).alias("v"), F.col("id"))
    bucket = lambda name, cond, k, *why: F.when(cond, F.struct(F.lit(name).alias("bucket"), key(k).alias("key"), F.concat(*why).alias("insight")))
    rows = feed(listings, matches, today).withColumn("b", F.explode(F.array_compact(F.array(
        bucket("toss_up", (yes >= 0.35) & (yes <= 0.65) & (vol > 500), F.floor(F.abs(yes - 0.5) / 0.05), F.lit("split at "), percent),
        bucket("closing_soon", (left > 0) & (left <= 7) & (vol > 500), left, F.lit("closes in "), left.cast("string"), F.lit(" days at "), percent),
        bucket("high_conviction", (((yes >= 0.85) & (yes < 1)) | ((yes > 0) & (yes <= 0.15))) & (vol > 2000), F.lit(0), F.when(yes >= 0.85, "nearly sure at ").otherwise("nearly ruled out at "), percent),
        bucket("contrarian", (((yes >= 0.10) & (yes < 0.25)) | ((yes > 0.75) & (yes <= 0.90))) & (vol > 1000), F.lit(0), F.when(yes < 0.5, "unlikely at ").otherwise("likely at "), percent),
        bucket("price_gap", gap >= 0.03, -gap, percent, F.lit(" against "), whole(F.col("signal")), F.lit("%, "), whole(gap), F.lit(" points apart")),
    ))))
    nth = F.row_number().over(Window.partitionBy("b.bucket").orderBy("b.key"))
    tops = rows.where("b.bucket <> 'price_gap'").withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")
    return tops.unionByName(rows.where("b.bucket = 'price_gap'")).select(F.col("b.bucket").alias("bucket"), "id", "yes", "volume", "signal", F.col("b.insight").alias("insight"))


def watchlist_counts(watched: DataFrame) -> DataFrame:
    return watched.groupBy("bucket").agg(F.count("*").alias("n"))


def quality_rank(listings: DataFrame, today: int, n: int) -> DataFrame:
    score = P.quality(F.col("question"), F.col("volume"), F.col("liquidity"), F.col("close_day") - today, F.col("yes"))
    return listings.withColumn("quality", score).orderBy(F.desc("quality"), "id").limit(n)


def group_feed(items: DataFrame, least: int = 4) -> DataFrame:
    """Variants of one event (Will X <verb> Y) as one row where there are ``least`` or more,
    at their best member's place; other items alone. ``items`` has a ``rank``."""
    clean = F.regexp_replace(F.trim("question"), r"\?+\s*$", "")
    pattern = rf"(?i)^Will\s+(.+?)\s+({GROUP_VERBS})\s+(.+)$"
    predicate = F.concat_ws(" ", F.regexp_extract(clean, pattern, 2), F.regexp_extract(clean, pattern, 3))
    # written, for three steps read it and patterns are slow
    keyed = cut(items.select("id", "rank", "volume", "platform", F.when(clean.rlike(pattern), F.lower(predicate)).alias("key"), F.regexp_extract(clean, pattern, 1).alias("entity")))
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("near"), F.struct("rank", "entity")))), 1, 3)
    # three best of each group by a window that keeps three rows a task before the shuffle
    third = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
    best = keyed.where("key is not null").select("key", "rank", "entity").withColumn("nth", third).where("nth <= 3").withColumn("near", F.lit(True)).groupBy("key").agg(F.array_join(F.transform(top, lambda x: x["entity"]), ", ").alias("top"))
    groups = keyed.where("key is not null").groupBy("key").agg(
        F.count("*").alias("members"), F.sum("volume").alias("volume"), F.min("rank").alias("rank"), F.when(F.min("platform") == F.max("platform"), F.min("platform")).otherwise("mixed").alias("platform"),
    )
    large = groups.where(F.col("members") >= least)
    grouped = large.join(best, "key").select("rank", F.col("key").alias("name"), "members", "volume", "platform", "top")
    alone = keyed.join(large.select("key"), "key", "left_anti").select("rank", F.col("id").alias("name"), F.lit(1).cast("long").alias("members"), "volume", "platform", F.lit("").alias("top"))
    return grouped.unionByName(alone)


def categories(listings: DataFrame) -> DataFrame:
    return listings.where("category is not null").select("category").distinct().orderBy("category")


def universe(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def context(markets: DataFrame, matches: DataFrame, latest: DataFrame, recent: DataFrame, comparisons: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row per market for a prompt: its latest price, the other side's, its settlement
    verdict, its last prices in order, and the titles of ``sources(slug, ord, title)`` stored
    under the slug of its question."""
    other = latest.select(F.col("market_id").alias("b_id"), F.col("yes").alias("other_yes"))
    prices = recent.groupBy("market_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "yes"))), lambda x: F.round(x["yes"], 2).cast("string")), ",").alias("history"))
    verdict = comparisons.select("a_id", "b_id", "safe")
    out = markets.join(matches.select(F.col("a_id").alias("market_id"), "b_id"), "market_id", "left").join(other, "b_id", "left").join(prices, "market_id", "left")
    out = out.join(verdict.withColumnRenamed("a_id", "market_id"), ["market_id", "b_id"], "left")
    if sources is None:
        return out
    listed = sources.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("headlines"))
    return out.withColumn("slug", T.slugify(F.col("question"))).join(listed, "slug", "left")


def brief_quality(briefs: DataFrame, column: str = "text", checks: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """Every check of every brief."""
    c = F.col(column)
    flags = {name: (c.rlike(pattern) if wanted else ~c.rlike(pattern)) for name, (pattern, wanted) in (checks or brief_checks()).items()}
    flags["has_verdict"] = (F.length(F.trim(c)) > 60) & flags["has_verdict"]
    return briefs.withColumns(flags)


def pass_rates(checked: DataFrame, *by: str) -> DataFrame:
    return checked.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(k).cast("int")), 6).alias(k) for k in brief_checks()))
