"""Detectors of mispriced markets, and one shape for what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import scoring as S
from keelson.functions import text as T
from keelson.functions.prices import FEES

FEE_A, FEE_B = 2.0, 7.0


def outcome_books(outcomes: DataFrame) -> DataFrame:
    """One row per market of sums over its outcomes; null prices are counted apart."""
    return outcomes.groupBy("platform", "market_id").agg(
        F.max("ts").alias("ts"), F.count("*").alias("n"), F.count("ask").alias("n_ask"), F.count("bid").alias("n_bid"), F.count("liquidity").alias("n_liquidity"),
        F.sum("ask").alias("ask_sum"), F.sum("bid").alias("bid_sum"), F.min("liquidity").alias("min_liquidity"),
    )


def multi_outcome(books: DataFrame, fee_percent: float = FEE_A, min_liquidity: float = 500, min_net: float = 0.5) -> DataFrame:
    """Markets of three or more fully priced outcomes with a gross edge, and the first
    reason that turns each down (null: an opportunity)."""
    buy, sell = (1 - F.col("ask_sum")) * 100, (F.col("bid_sum") - 1) * 100
    kind = F.when((buy > sell) & (buy > 0), "buy").when(sell > 0, "sell")
    gross = F.when(kind == "buy", buy).otherwise(sell)
    net = F.col("gross") - F.col("n") * fee_percent
    reason = F.when(F.col("net") <= 0, "fees_exceed_edge").when((F.col("n_liquidity") < F.col("n")) | (F.col("min_liquidity") < min_liquidity), "low_liquidity").when(F.col("net") < min_net, "low_edge")
    e = F.col("net")
    ramp = F.when(e >= 3, 0.9 + F.least((e - 3) / 10, F.lit(0.1))).when(e >= 1, 0.7 + (e - 1) / 2 * 0.2).otherwise(0.5 + (e - 0.5) / 0.5 * 0.2)
    capital = F.when(F.col("kind") == "buy", F.col("ask_sum") * 100).otherwise(100.0)
    profit = F.when(F.col("kind") == "buy", 100 - F.col("ask_sum") * 100).otherwise(F.col("bid_sum") * 100 - 100)
    full = books.where((F.col("n") >= 3) & (F.col("n_ask") == F.col("n")) & (F.col("n_bid") == F.col("n"))).withColumn("kind", kind).where("kind is not null")
    return (
        full.withColumn("gross", gross).withColumn("net", net).withColumn("reason", reason)
        .withColumns({"capital": capital, "profit": profit * F.try_divide(F.col("net"), F.col("gross")), "confidence": F.least(F.lit(1.0), ramp + F.when(F.col("min_liquidity") >= 2000, 0.05).otherwise(0.0))})
    )


def price_sums(books: DataFrame, min_edge: float = 2.0, min_liquidity: float = 500, high: float = 5.0, top: float = 10.0) -> DataFrame:
    """Markets whose outcome prices do not add up to one."""
    s, edge = F.col("ask_sum"), F.abs(F.col("ask_sum") - 1) * 100
    kind = F.concat(F.when(F.col("n") == 2, "binary_").otherwise("multi_"), F.when(s > 1, "overpriced").otherwise("underpriced"))
    low_ramp = F.coalesce(0.7 + F.try_divide(F.col("edge") - min_edge, F.lit(high - min_edge)) * 0.2, F.lit(0.9))
    confidence = F.when(F.col("edge") > high, 0.9 + (F.least(F.col("edge"), F.lit(top)) - high) / (top - high) * 0.1).otherwise(low_ramp)
    rows = books.where((F.col("n") >= 2) & (F.col("n_ask") == F.col("n")) & (F.col("min_liquidity") >= min_liquidity) & (s > 0))
    return rows.withColumns({"edge": edge, "kind": kind, "expected_value": F.abs(s - 1)}).where(F.col("edge") >= min_edge).withColumn("confidence", confidence)


def cross_venue(pairs: DataFrame, min_confidence: float = 0.5, min_liquidity: float = 500, min_net: float = 0.10) -> DataFrame:
    """Gaps of matched markets over fees; ``pairs`` has both sides' fresh prices and the
    settlement ``risk`` (HIGH is skipped)."""
    gross = F.abs(F.col("a_yes") - F.col("b_yes"))
    thin = F.least("a_liquidity", "b_liquidity")
    sure = 0.7 + (F.col("net_edge") - 0.10) * 2.5 + F.least(F.lit(0.05), F.col("min_liquidity") / 10000 * 0.05)
    kept = pairs.where((F.col("confidence") >= min_confidence) & (F.col("risk") != "HIGH")).withColumns({"gross_edge": gross, "net_edge": F.greatest(F.lit(0.0), gross - FEES), "min_liquidity": thin})
    return kept.where((F.col("min_liquidity") >= min_liquidity) & (F.col("net_edge") >= min_net)).withColumn("opportunity_confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.5), sure)))


def divergence(matches: DataFrame, least: int = 5) -> DataFrame:
    """Forecasts against YES prices, in whole points, with the forecast's age band."""
    percent = F.floor(F.abs(F.col("q2") - F.col("yes")) * 100 + 0.5)
    age = F.col("age_days")
    band = F.when(age <= 7, "fresh").when(age <= 14, "over a week old").when(age <= 28, "over two weeks old").otherwise("over four weeks old")
    return matches.where("q2 is not null and yes is not null").withColumns({"percent": percent, "band": band, "is_fresh": age <= 7}).where(F.col("percent") >= least)


#: One counter for each detector of a run, by type and platform (none: any).
COUNTERS = {"multi_outcome_a": ("multi_outcome", "venue_a"), "multi_outcome_b": ("multi_outcome", "venue_b"), "correlated": ("correlated", None), "cross_platform": ("cross_platform", None), "divergence": ("divergence", None)}


def _finding(kind: str, platform: Column, market: Column, gross: Column, net: Column, confidence: Column, match: Column, liquidity: Column, depth: Column, days_left: Column) -> list[Column]:
    names = {"type": F.lit(kind), "platform": platform, "market_id": market, "gross_edge": gross, "net_edge": net, "detector_confidence": confidence, "match_confidence": match, "min_liquidity": F.coalesce(liquidity, F.lit(0.0)), "depth": depth.cast("long"), "days_left": days_left}
    return [T.opportunity_id(F.lit(kind), platform, market).alias("id"), *(c.alias(k) for k, c in names.items())]


def unify(multi: DataFrame | None = None, sums: DataFrame | None = None, cross: DataFrame | None = None, forecasts: DataFrame | None = None, fee_a: float = FEE_A, fee_b: float = FEE_B) -> DataFrame:
    """What the given detectors found in one shape: edges as fractions, one id per finding;
    a detector that is off has no rows. ``forecasts`` are rows of ``divergence`` with
    platform, market_id and the match's confidence."""
    market, none = [F.col("platform"), F.col("market_id")], F.lit(None).cast("double")
    parts = []
    if multi is not None:
        parts.append(multi.where("reason is null").select(*_finding("multi_outcome", *market, F.col("gross") / 100, F.col("net") / 100, F.col("confidence"), none, F.col("min_liquidity"), F.col("n"), none)))
    if sums is not None:
        edge, fee = F.col("edge") / 100, F.when(F.col("platform") == "venue_a", fee_a / 100).otherwise(fee_b / 100)
        left = F.col("days_left").cast("double") if "days_left" in sums.columns else none
        parts.append(sums.select(*_finding("correlated", *market, edge, F.greatest(F.lit(0.0), edge - fee * F.col("n")), F.col("confidence"), none, F.col("min_liquidity"), F.col("n"), left)))
    if cross is not None:
        parts.append(cross.select(*_finding("cross_platform", F.lit("cross"), F.col("a_id"), F.col("gross_edge"), F.col("net_edge"), F.col("opportunity_confidence"), F.col("confidence").cast("double"), F.col("min_liquidity"), F.lit(2), none)))
    if forecasts is not None:
        edge = F.col("percent") / 100
        parts.append(forecasts.select(*_finding("divergence", *market, edge, edge, F.when(F.col("is_fresh"), 0.9).otherwise(0.6), F.col("confidence").cast("double"), F.lit(0.0), F.lit(1), none)))
    if not parts:
        raise ValueError("no detector given")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def counts(opportunities: DataFrame) -> DataFrame:
    """Findings by detector and platform, with subtotals."""
    return opportunities.cube("type", "platform").agg(F.count("*").alias("n"))


def run_counters(opportunities: DataFrame) -> DataFrame:
    """One row: findings of each detector, none as zero, and all."""
    fits = lambda t, p: (F.col("type") == t) & (F.lit(True) if p is None else F.col("platform") == p)
    return opportunities.agg(*(F.count_if(fits(*c)).alias(k) for k, c in COUNTERS.items()), F.count("*").alias("total"))


def stats(opportunities: DataFrame) -> DataFrame:
    return opportunities.rollup("type").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score"))


def scored(opportunities: DataFrame, least: float = 5.0) -> DataFrame:
    """Opportunities with their score and its parts, from ``least`` on, best first."""
    own = [F.col(c) for c in ("net_edge", "detector_confidence", "match_confidence", "min_liquidity", "days_left")]
    rows = opportunities.withColumns({"total": S.composite(*own), "breakdown": S.breakdown(*own)})
    return rows.where(F.col("total") >= least).orderBy(F.desc("total"), "id")
