"""Price expressions: YES prices, oriented gaps, flags, tiers, stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEES = 0.09


def yes_loose(prices: Column) -> Column:
    """Yes, yes, the first price, or one half."""
    return F.coalesce(F.try_element_at(prices, F.lit("Yes")), F.try_element_at(prices, F.lit("yes")), F.try_element_at(F.map_values(prices), F.lit(1)), F.lit(0.5))


def yes_strict(prices: Column) -> Column:
    """The price under a key that reads yes in any case, else null."""
    return F.try_element_at(F.transform(F.filter(F.map_entries(prices), lambda e: F.lower(e["key"]) == "yes"), lambda e: e["value"]), F.lit(1))


def missing_as_zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def priceable(p: Column) -> Column:
    return (p > 0.005) & (p < 0.995)


def oriented(aligned: Column, b: Column) -> Column:
    return F.when(aligned, b).otherwise(1 - b)


def gap(a: Column, b: Column, aligned: Column) -> Column:
    return F.abs(a - oriented(aligned, b))


def net(gap_: Column, fees: float = FEES) -> Column:
    return F.greatest(F.lit(0.0), gap_ - fees)


def tier(thin: Column) -> Column:
    return F.when(thin > 10000, ">10k").when(thin > 5000, ">5k").when(thin > 1000, ">1k").when(thin > 500, ">500").otherwise("<=500")


def funnel_stage(same_criteria: Column, priceable_: Column, gap_: Column, fees: float = FEES) -> Column:
    return F.when(~same_criteria, "topical_overlap").when(~priceable_, "dropped_degenerate").when(gap_ <= fees, "validated_same_contract").otherwise("apparent_fee_clearing_gap")


def status(label: Column) -> Column:
    """A triage label's status in the read model."""
    return (
        F.when(label == "dropped_degenerate", "stale").when(label.isin("scope_mismatch", "entity_mismatch_rejected", "spec_mismatch"), "spec_mismatch")
        .when(label == "semantic_survivor", "survivor").when(label == "validated_same_contract", "same_contract").otherwise("topical")
    )


#: What tells contracts apart in lower-cased titles.
CONTRACT_WORDS = {
    "top_scorer": "(top goalscorer|top scorer|golden boot)",
    "goal": "(score a goal|goal contribution|to score)",
    "goal_leader": "goal leader",
    "any_player": "(a player representing|any player)",
    "named_player": r"—\s*[a-zà-ÿ']+\s+[a-zà-ÿ']+",
    "total": r"(o/u|over/under|\btotal\b)",
    "half": "(first half|second half|1st half|2nd half)",
    "tournament": "(win the (world cup|championship|tournament|title|final)|tournament winner|outright)",
    "match": r"(win on \d|advance|\bvs\.?\b|group stage|to reach|semifinal|quarterfinal)",
    "county": r"\bin [a-z.' -]*?county\b",
    "counties": r"\bcount(y|ies)\b",
}


def suspicious(a_title: Column, b_title: Column) -> Column:
    """Why two titles are likely different contracts though they read alike, or null."""
    a, b = F.lower(F.coalesce(a_title, F.lit(""))), F.lower(F.coalesce(b_title, F.lit("")))
    has = lambda c, p: c.rlike(p)
    x = CONTRACT_WORDS
    return (
        F.when(has(a, x["top_scorer"]) & has(b, x["goal_leader"]), "top scorer or goal leader")
        .when(has(a, x["goal"]) & has(b, x["goal_leader"]), "goal or goal leader")
        .when(has(a, x["any_player"]) & has(b, x["named_player"]), "any player or a named one")
        .when(has(a, x["total"]) & has(b, x["total"]) & (has(a, x["half"]) != has(b, x["half"])), "full or half total")
        .when(has(a, x["tournament"]) & has(b, x["match"]), "tournament or one match")
        .when((has(a, x["county"]) & ~has(b, x["counties"])) | (has(b, x["county"]) & ~has(a, x["counties"])), "county or state")
    )


def cause_of_death(a_title: Column, b_title: Column, status_: Column, gap_: Column, thin: Column, strict: Column, a_yes: Column, b_yes: Column, reason: Column, fees: float = FEES) -> Column:
    """The first gate that a pair does not pass, in words."""
    why = F.coalesce(suspicious(a_title, b_title), F.nullif(reason, F.lit("")), F.lit("resolve differently"))
    pp = lambda c: F.format_string("%.1f pp", c * 100)
    return (
        F.when(suspicious(a_title, b_title).isNotNull() | (status_ == "spec_mismatch"), F.concat(F.lit("different contract: "), why))
        .when(status_ == "stale", F.concat(F.lit("near-settled: "), F.floor(a_yes * 100 + 0.5).cast("string"), F.lit("% and "), F.floor(b_yes * 100 + 0.5).cast("string"), F.lit("%")))
        .when(status_ == "topical", "same event, another contract")
        .when(gap_ <= fees, F.concat(F.lit("fees: "), pp(gap_), F.lit(" gap")))
        .when(thin < 10000, F.concat(F.lit("depth: $"), F.floor(thin).cast("string")))
        .when(~strict, "not strictly verified").otherwise("passes")
    )


#: Category -> pattern in the lower-cased question, first hit wins.
CATEGORIES = {
    "Politics": r"president|election|congress|senate|governor|democrat|republican|trump|biden|vote|political|party|gop|dnc",
    "Economics": r"fed\b|inflation|gdp|recession|interest rate|unemployment|tariff|trade war|economic|economy|treasury",
    "Sports": r"nba|nfl|mlb|nhl|soccer|football|tennis|golf|championship|playoff|super bowl|world cup|stanley cup|masters|finals",
    "Technology": r"ai\b|artificial intelligence|gpt|openai|google|apple|microsoft|meta\b|tesla|spacex|startup|tech",
    "Crypto": r"bitcoin|btc|ethereum|eth|crypto|defi|blockchain|token",
    "Climate": r"climate|temperature|hurricane|earthquake|weather|warming|carbon",
    "Entertainment": r"oscar|grammy|emmy|movie|film|album|music|artist|celebrity|james bond|netflix|disney",
    "Geopolitics": r"war|ceasefire|nato|invasion|military|peace|conflict|sanctions|ukraine|russia|china|taiwan|iran|israel",
    "Health": r"covid|vaccine|fda|drug|health|pandemic|disease|virus|who\b",
    "World": r"pope|religion|church|elon musk|resign|pardon|supreme court|scotus|regulation|law\b",
}
#: Questions that are jokes or derivatives of other markets.
JUNK = [r"before gta", r"before gta vi", r"before.*gta", r"gta.*before", r"jesus christ.*return", r"will.*return before", r"before.*release", r"bitcoin hit \$1m before", r"invades?.*before", r"^will.*win.*season \d+ of"]
#: Questions ranked lower, not dropped.
LOW_QUALITY = [r"daily.*temperature", r"\d+[hH]our", r"tonight", r"today's"]


def infer_category(question: Column) -> Column:
    out, q = None, F.lower(question)
    for name, pattern in CATEGORIES.items():
        out = F.when(q.rlike(pattern), name) if out is None else out.when(q.rlike(pattern), name)
    return out.otherwise("Other")


def junk(question: Column, volume: Column, liquidity: Column) -> Column:
    return question.rlike("(?i)" + "|".join(JUNK)) | ((missing_as_zero(volume) == 0) & (missing_as_zero(liquidity) == 0))


def quality(question: Column, volume: Column, liquidity: Column, days_left: Column, yes: Column) -> Column:
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    return (
        part(volume > 0, F.log10(volume) / 3) + part(liquidity > 0, F.least(F.lit(2.0), F.log10(liquidity) / 3)) - part(question.rlike("(?i)" + "|".join(LOW_QUALITY)), 2.0)
        + part((days_left > 0) & (days_left < 30), 1.0) + part((days_left > 0) & (days_left < 7), 1.0) + part((yes > 0.05) & (yes < 0.95), 0.5) + part((yes > 0.2) & (yes < 0.8), 0.5)
    )


def classify(yes: Column, volume: Column, days_left: Column, signal: Column) -> Column:
    """The one tag of a market, or null."""
    return (
        F.when(F.abs(signal - yes) >= 0.03, "price_gap").when((days_left > 0) & (days_left <= 7) & (volume > 500), "closing_soon")
        .when((yes >= 0.35) & (yes <= 0.65) & (volume > 500), "toss_up").when((((yes >= 0.85) & (yes < 1)) | ((yes > 0) & (yes <= 0.15))) & (volume > 2000), "high_conviction")
        .when((((yes >= 0.10) & (yes < 0.25)) | ((yes > 0.75) & (yes <= 0.90))) & (volume > 1000), "contrarian")
    )
