"""The efficiency study: gaps, funnel, audit, corrections, and its aggregates.

Pairs are rows of ``a_id, b_id`` with both sides' prices and volumes. Everything is
expressions, equi-joins on (a_id, b_id) and grouped aggregates; ranks partition by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions import prices as P
from keelson.sources.scratch import cut

KEY = ["a_id", "b_id"]
#: Bucket edges of the gap histogram, in points.
BUCKETS = ["0-1pp", "1-2pp", "2-3pp", "3-5pp", "5-9pp", "9pp+"]
FLOORS = [0, 1000, 10000, 100000]
MISMATCH = ["scope_mismatch", "entity_mismatch_rejected", "spec_mismatch"]
#: The checks of a strict audit.
CHECKS = ["same_event", "same_entity", "same_window", "same_line", "same_settlement", "same_direction", "same_structure"]
#: The study's word list for telling titles apart.
TITLE_STOP = ["will", "the", "and", "for"]


def with_gap(pairs: DataFrame, fees: float = P.FEES) -> DataFrame:
    g = P.gap(F.col("a_price"), F.col("b_price"), F.col("yes_aligned"))
    return pairs.withColumns({"gap": g, "net": P.net(g, fees), "volume": F.greatest("a_volume", "b_volume"), "priceable": P.priceable(F.col("a_price")) & P.priceable(F.col("b_price"))})


def with_flags(pairs: DataFrame, fees: float = P.FEES) -> DataFrame:
    return pairs.withColumns({"surfaced_3pp": F.col("gap") >= 0.03, "beats_fees_9pp": F.col("gap") > fees, "meets_detector_19pp": F.col("gap") >= 0.19})


def staged(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("funnel_stage", P.funnel_stage(F.col("same_criteria"), F.col("priceable"), F.col("gap")))


def apply_triage(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels from elsewhere on the apparent gaps; an unknown one asks for a review, an
    empty reason keeps the old."""
    known = F.when(F.col("label") == "confirmed", "semantic_survivor").when(F.col("label").isin(*MISMATCH), F.col("label")).otherwise("needs_manual_review")
    label = F.when(F.col("funnel_stage") == "apparent_fee_clearing_gap", known).otherwise(F.col("funnel_stage"))
    joined = pairs.join(labels, KEY, "left")
    return joined.withColumns({"triage_label": label, "funnel_stage": F.when(label == "semantic_survivor", label).otherwise(F.col("funnel_stage")), "reason": F.coalesce(F.nullif("new_reason", F.lit("")), "reason")}).drop("label", "new_reason")


def strict_audit(study: DataFrame, checklists: DataFrame, floor: float = 500) -> DataFrame:
    """Survivors over ``floor`` on the thin side with their checklist; one that can't be
    read, or is absent, fails every check."""
    kind = "struct<" + ", ".join(f"{c}:boolean" for c in CHECKS) + ">"
    joined = study.where((F.col("triage_label") == "semantic_survivor") & (F.col("thin") > floor)).join(checklists.select(*KEY, "checklist", F.col("reason").alias("mismatch_reason")), KEY, "left")
    parsed = joined.withColumn("checks", F.from_json("checklist", kind))
    match = None
    for c in CHECKS:
        one = F.coalesce(F.col(f"checks.{c}"), F.lit(False))
        match = one if match is None else match & one
    return parsed.withColumns({"spec_match": match, "tier": P.tier(F.col("thin"))})


def verifier_state(spec_match: Column, tier: Column, label: Column) -> Column:
    """The state of a pair by its strict row (null: none) and its label."""
    by_label = F.when(label == "semantic_survivor", "semantic_survivor").when(label.isin("scope_mismatch", "entity_mismatch_rejected"), "spec_mismatch").otherwise("candidate")
    return F.when(spec_match & (tier == ">10k"), "deep_survivor").when(spec_match, "strict_match").when(spec_match.isNotNull(), "spec_mismatch").otherwise(by_label)


def verifier_states(study: DataFrame, strict: DataFrame) -> DataFrame:
    joined = study.join(strict.select(*KEY, "spec_match", "tier"), KEY, "left")
    return joined.withColumn("state", verifier_state(F.col("spec_match"), F.col("tier"), F.col("triage_label")))


#: States from the one that says most to the one that says least.
STATES = ["deep_survivor", "strict_match", "spec_mismatch", "semantic_survivor", "candidate"]


def live_states(live: DataFrame, states: DataFrame) -> DataFrame:
    """``live(market_id)`` with the ``state`` that says most of its pairs in ``states(a_id, b_id, state)``, on either
    side, and of those the pair's other side, the least id first; ``live_only`` where the study has none."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    sides = F.explode(F.array(F.struct(F.col("a_id").alias("market_id"), F.col("b_id").alias("other_id")), F.struct(F.col("b_id").alias("market_id"), F.col("a_id").alias("other_id"))))
    best = states.select(rank.alias("rank"), sides.alias("x")).groupBy("x.market_id").agg(F.min(F.struct("rank", "x.other_id")).alias("best"))
    named = best.select("market_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("best.rank").cast("int")).alias("state"), F.col("best.other_id").alias("other_id"))
    return live.join(named, "market_id", "left").withColumn("state", F.coalesce("state", F.lit("live_only")))


def filter_pairs(pairs: DataFrame, search: str = "", status: str | None = None, stale: bool = True, topical: bool = True, mismatch: bool = True, min_liquidity: float = 0) -> DataFrame:
    if search:
        pairs = pairs.where(F.contains(F.lower("a_title"), F.lit(search.lower())) | F.contains(F.lower("b_title"), F.lit(search.lower())))
    if status:
        pairs = pairs.where(F.col("status") == status)
    hidden = [s for s, shown in (("stale", stale), ("topical", topical), ("spec_mismatch", mismatch)) if not shown]
    return pairs.where(~F.col("status").isin(hidden) & (F.col("thin") >= min_liquidity))


def chart_pairs(study: DataFrame) -> DataFrame:
    kept = study.where(F.col("triage_label").isin("validated_same_contract", "semantic_survivor", "apparent_fee_clearing_gap"))
    return kept.withColumns({"gap_pp": F.col("gap") * 100, "beats_fees": F.col("gap") > P.FEES})


def comparable(study: DataFrame) -> DataFrame:
    return study.where("same_criteria AND priceable")


#: Ranks on either side of a percentile between which its exact place is looked for, as a
#: share of all, and the accuracy of the sketch that finds them (its error is one in so many).
NEAR, ACCURACY = 5e-5, 50_000


def order_statistic(df: DataFrame, value: str, percent: int, *by: str) -> DataFrame:
    """``by..., stat, lower``: the value at floor(percent/100 n) of each group's sorted
    values, not interpolated, and the one at ceil(percent/100 n) - 1, counted from zero.

    A sketch of each group (partial sums, bounded size) gives two values on either side of
    the place. Values below the first are only counted; the distinct values between the two,
    one row in ten thousand, are ranked exactly.
    """
    p = percent / 100
    rows = df.select(*by, value).where(F.col(value).isNotNull())
    ends = F.array(F.lit(max(0.0, p - NEAR)), F.lit(min(1.0, p + NEAR)))
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(value, ends, F.lit(ACCURACY)).alias("q"))
    if by:  # groups may be null
        fits = None
        for c in by:
            sketch = sketch.withColumnRenamed(c, f"_{c}")
            one = rows[c].eqNullSafe(sketch[f"_{c}"])
            fits = one if fits is None else fits & one
        joined = rows.join(sketch, fits)
    else:
        joined = rows.crossJoin(F.broadcast(sketch))
    inside = F.col(value) >= F.col("q")[0]
    counts = joined.where(F.col(value) <= F.col("q")[1]).groupBy(*by, F.when(inside, F.col(value)).alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v")))
    upper = F.least("n", F.floor(F.lit(p) * F.col("n")) + 1)
    lower = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(p) * F.col("n")))
    return counts.withColumn("upto", upto).where("v is not null").groupBy(*by).agg(at(upper).alias("stat"), at(lower).alias("lower"))


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``by..., median``: the middle value of each group, or the mean of the middle two."""
    return order_statistic(df, value, 50, *by).select(*by, ((F.col("lower") + F.col("stat")) / 2).alias("median"))


def _zero(c: Column, name: str) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)


def gap_distribution(study: DataFrame) -> DataFrame:
    rows = comparable(study)
    own = rows.agg(F.count("*").alias("n"), _zero(F.avg("gap"), "mean"), _zero(F.max("gap"), "max"))
    # one row each; an empty study has none
    one = lambda df, c, name: df.agg(_zero(F.max(c), name))
    for more in (one(order_statistic(rows, "gap", 90), "stat", "p90"), one(medians(rows, "gap"), "median", "median")):
        own = own.crossJoin(F.broadcast(more))
    return own.select("n", "median", "mean", "p90", "max")


def actionable(study: DataFrame) -> DataFrame:
    g = F.col("gap")
    return comparable(study).agg(F.count_if(g >= 0.03).alias("over_3pp"), F.count_if(g > P.FEES).alias("beats_fees"), F.count_if(g >= 0.19).alias("detector"), F.count_if((g > P.FEES) & (F.col("triage_label") == "semantic_survivor")).alias("confirmed"))


def gap_histogram(study: DataFrame) -> DataFrame:
    """Every bucket, also those without a pair."""
    p = F.col("gap") * 100
    k = F.when(p < 1, 0).when(p < 2, 1).when(p < 3, 2).when(p < 5, 3).when(p < 9, 4).otherwise(5)
    one = comparable(study).agg(*(F.count_if(k == i).alias(f"b{i}") for i in range(len(BUCKETS))))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(b).alias("label"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


#: Bins of a gap (0 to 1) that counts are kept in.
BINS = 10_000


def sensitivity(study: DataFrame, a_markets: DataFrame, b_markets: DataFrame, floors: list[int] = FLOORS) -> DataFrame:
    """At each liquidity floor, the markets of both venues (``volume``) and the pairs whose sides
    both have volume and reach it: overlaps, priceable contracts, their median and 90th percentile
    gap in points, those that beat fees and those confirmed.

    A row is counted once, at the highest floor it reaches, with its gap in one of ``BINS``;
    counts are added from the top floor down. Exact places are then found among the distinct
    gaps of the few bins that hold them.
    """
    floors = sorted(floors)
    level = lambda volume: F.when(volume > 0, F.size(F.filter(F.array(*map(F.lit, floors)), lambda f: volume >= f)) - 1)
    spark = study.sparkSession
    each = spark.createDataFrame(list(enumerate(floors)), "i int, floor_ long")
    fine = F.col("same_criteria") & F.col("priceable")
    slot = F.least(F.floor(F.col("gap") * BINS), F.lit(BINS)).cast("int")
    rows = study.withColumn("level", F.when(F.col("a_volume").isNotNull() & F.col("b_volume").isNotNull(), level(F.least("a_volume", "b_volume")))).where("level >= 0")
    rows = rows.select("level", F.when(fine, F.col("gap")).alias("g"), F.when(fine, slot).alias("bin"), F.coalesce(F.col("triage_label") == "semantic_survivor", F.lit(False)).alias("sure"))
    beats = F.col("g") > P.FEES
    counts = cut(rows.groupBy("level", "bin").agg(F.count("*").alias("pairs"), F.count("g").alias("n"), F.count_if(beats).alias("beats"), F.count_if(beats & F.col("sure")).alias("sure")))
    upto = lambda x: each.join(x, F.col("level") >= F.col("i"))  # small: one row for each floor and bin
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = upto(counts).groupBy("i", "floor_").agg(*map(total, ("pairs", "n", "beats", "sure")))
    venue = lambda m, name: each.join(upto(m.groupBy(level(F.col("volume")).alias("level")).agg(F.count("*").alias("c"))).groupBy("i").agg(F.sum("c").alias(name)), "i", "left").select("i", F.coalesce(name, F.lit(0)).alias(name))
    # the places wanted: the middle two and the 90th percentile
    n = F.col("n")
    wanted = F.array(*(F.struct(F.lit(k).alias("which"), x.cast("long").alias("place")) for k, x in enumerate((F.greatest(F.lit(1), F.ceil(n / 2)), F.least(n, F.floor(n / 2) + 1), F.least(n, F.floor(n * 0.9) + 1)))))
    places = sums.where("n > 0").select("i", F.explode(wanted).alias("x")).select("i", "x.*")
    by_bin = upto(counts.where("bin is not null")).groupBy("i", "bin").agg(F.sum("n").alias("n"))
    ends = by_bin.withColumn("end", F.sum("n").over(Window.partitionBy("i").orderBy("bin"))).withColumn("begin", F.col("end") - F.col("n"))
    held = cut(places.join(ends, "i").where((F.col("begin") < F.col("place")) & (F.col("place") <= F.col("end"))).select("i", "which", "place", "bin", "begin"))
    values = rows.join(F.broadcast(held.select("bin").distinct()), "bin").groupBy("level", "bin", "g").agg(F.count("*").alias("c"))
    near = held.join(values, "bin").where(F.col("level") >= F.col("i")).groupBy("i", "which", "place", "begin", "g").agg(F.sum("c").alias("c"))
    end = F.col("begin") + F.sum("c").over(Window.partitionBy("i", "which").orderBy("g"))
    at = near.withColumn("end", end).where(F.col("end") >= F.col("place")).groupBy("i").pivot("which", [0, 1, 2]).agg(F.min("g"))
    points = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)) * 100, 6).alias(name)
    out = each.join(sums.drop("floor_"), "i", "left").join(at, "i", "left").join(venue(a_markets, "venue_a"), "i").join(venue(b_markets, "venue_b"), "i")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return out.select("floor_", "venue_a", "venue_b", zero("pairs", "overlaps"), zero("n", "priceable"), points((F.col("0") + F.col("1")) / 2, "median_pp"), points(F.col("2"), "p90_pp"), zero("beats", "beats_fees"), zero("sure", "confirmed"))


def category_slices(study: DataFrame) -> DataFrame:
    rows = comparable(study)
    out = rows.groupBy("category").agg(F.count("*").alias("pairs"), F.round(F.max("gap") * 100, 6).alias("max_pp"), F.count_if(F.col("gap") > P.FEES).alias("beats_fees"))
    middle = medians(rows, "gap", "category").select(F.col("category").alias("_category"), F.round(F.col("median") * 100, 6).alias("median_pp"))
    return out.join(middle, out["category"].eqNullSafe(middle["_category"])).select("category", "pairs", "median_pp", "max_pp", "beats_fees").orderBy(F.desc("pairs"), "category")


def rank_histogram(pairs: DataFrame) -> DataFrame:
    r = F.col("match_rank")
    total = pairs.agg(F.coalesce(F.round(F.try_divide(F.count_if(r == 1), F.count("*")), 6), F.lit(1.0)).alias("recall_1"), F.coalesce(F.round(F.try_divide(F.count_if(r <= 5), F.count("*")), 6), F.lit(1.0)).alias("recall_5"))
    return pairs.groupBy(F.least("match_rank", F.lit(5)).alias("rank")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))


def summary(study: DataFrame, verdicts: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """One row of matching figures: universe, tradeable markets, candidates, verdicts in
    store (``verdicts(a_id)``) and what is missing of them, contracts, prices.

    Distinct ids are counted in one pass of narrow rows, each (kind, id) once per task before
    the shuffle.
    """
    same, fine = F.col("same_criteria"), F.col("priceable")
    out = study.agg(F.count("*").alias("candidates"), F.count_if(same).alias("same_contract"), F.count_if(~same).alias("topical"), F.count_if(same & fine).alias("priceable"), F.count_if(same & ~fine).alias("dropped"))
    text = lambda c: F.col(c).cast("string").alias("id")
    kinds = F.explode(F.array(F.struct(F.lit("row").alias("kind"), text("a_id"), F.lit(False).alias("ok")), F.struct(F.lit("a").alias("kind"), text(a), (F.coalesce("a_volume", F.lit(0.0)) > 0).alias("ok")), F.struct(F.lit("b").alias("kind"), text(b), (F.coalesce("b_volume", F.lit(0.0)) > 0).alias("ok"))))
    known = verdicts.select(F.lit("row").alias("kind"), text("a_id"), F.lit(True).alias("ok"))
    listed = study.select(kinds.alias("x")).select("x.*", F.lit(True).alias("own")).unionByName(known.withColumn("own", F.lit(False))).where("id is not null")
    ids = listed.groupBy("kind", "id").agg(F.max("ok").alias("ok"), F.max("own").alias("own")).where("own")
    count = lambda kind, name, ok: F.count_if((F.col("kind") == kind) & (F.col("ok") if ok else F.lit(True))).alias(name)
    found = ids.agg(count("row", "with_candidates", False), count("row", "verified", True), count("a", "universe_a", False), count("b", "universe_b", False), count("a", "tradeable_a", True), count("b", "tradeable_b", True))
    missing = F.col("with_candidates") - F.col("verified")
    return out.crossJoin(F.broadcast(found)).withColumns({"pair_space": F.col("universe_a") * F.col("universe_b"), "missing_verdicts": missing, "status": F.when(missing == 0, "complete").otherwise("partial")})


def triage_funnel(study: DataFrame) -> DataFrame:
    total = study.agg(F.count("*").alias("total"))
    by = study.groupBy("triage_label").agg(F.count("*").alias("n"), F.count_if(~F.col("yes_aligned")).alias("oriented"))
    return by.crossJoin(F.broadcast(total)).select("triage_label", "n", "oriented", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))


def strict_summary(strict: DataFrame) -> DataFrame:
    ok, thin = F.col("spec_match"), F.col("thin")
    total = strict.agg(F.count("*").alias("audited"), F.count_if(ok).alias("strict"), *(F.count_if(ok & (thin > t * 1000)).alias(f"strict_{t}k") for t in (1, 5, 10)))
    reason = F.coalesce(F.nullif("mismatch_reason", F.lit("")), F.lit("unspecified")).alias("reason")
    return strict.groupBy(reason).agg(F.count_if(~ok).alias("mismatches")).crossJoin(F.broadcast(total)).orderBy(F.desc("mismatches"), "reason")


def correction_summary(corrections: DataFrame, study: DataFrame) -> DataFrame:
    """Corrections by source, by original verdict and in all, with how many survivors were
    reclassified and how many are left."""
    c = [F.col("correction_source"), F.col("original_verdict")]
    gone = corrections.agg(F.count_if(F.col("original_verdict") == "semantic_survivor").alias("survivors_reclassified"))
    total = study.agg(F.count_if(F.col("triage_label") == "semantic_survivor").alias("survivors")).crossJoin(F.broadcast(gone))
    left = total.select("survivors_reclassified", (F.col("survivors") - F.col("survivors_reclassified")).alias("corrected_survivors"))
    return corrections.groupingSets([[c[0]], [c[1]], []], *c).agg(F.count("*").alias("n")).crossJoin(F.broadcast(left))


def _overlaid(study: DataFrame, strict: DataFrame, corrections: DataFrame) -> DataFrame:
    fixed = corrections.select(*KEY, "corrected_verdict", F.lit(True).alias("has_correction"))
    audited = strict.select(*KEY, "spec_match", "tier", F.lit(True).alias("audited"))
    return study.join(audited, KEY, "left").join(fixed, KEY, "left").withColumns({"corrected": F.coalesce("has_correction", F.lit(False)), "audited": F.coalesce("audited", F.lit(False)), "strict": F.coalesce("spec_match", F.lit(False))})


def corrected_funnel(study: DataFrame, strict: DataFrame, corrections: DataFrame) -> DataFrame:
    corrected, ok = F.col("corrected"), F.col("strict")
    return _overlaid(study, strict, corrections).agg(
        F.count_if((F.col("triage_label") == "semantic_survivor") & ~(corrected & ~ok)).alias("semantic"), F.count_if(F.col("audited") & ~(corrected & ok)).alias("liquid"),
        F.count_if(ok & ~corrected).alias("strict"), F.count_if(ok & ~corrected & (F.col("tier") == ">10k")).alias("deep"),
    )


def evidence_counts(study: DataFrame, strict: DataFrame) -> DataFrame:
    joined = study.join(strict.select(*KEY, "spec_match"), KEY, "left")
    ok = F.col("spec_match")
    return joined.agg(
        F.count_if(ok.isNotNull()).alias("liquid"), F.count_if(ok).alias("strict"), F.count_if(~ok).alias("mismatch"), F.count_if((F.col("gap") > P.FEES) & F.col("same_criteria") & F.col("priceable")).alias("apparent"),
        F.count_if((F.col("triage_label") == "semantic_survivor") & (F.col("thin") <= 500)).alias("thin"),
    )


def of_version(verdicts: DataFrame, prompt: str, schema: int) -> DataFrame:
    """The verdicts that one version of prompt and schema gave."""
    return verdicts.where((F.col("prompt_version") == prompt) & (F.col("schema_version") == schema))


def count_verdicts(verdicts: DataFrame, provider: str, model: str, prompt: str, schema: int) -> DataFrame:
    """``n``: verdicts in store for a provider, model, prompt and schema."""
    return of_version(verdicts, prompt, schema).where((F.col("provider") == provider) & (F.col("model") == model)).agg(F.count("*").alias("n"))


def provenance(verdicts: DataFrame) -> DataFrame:
    """Verdicts by provider and model, and whether they mix."""
    by = verdicts.groupBy("provider", "model").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg((F.count("*") > 1).alias("mixed"))))


def pair_meta(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs by status, all, those shown by default (up to ``limit``) and those with live
    prices."""
    st = F.col("status")
    each = [F.count_if(st == s).alias(s) for s in ("survivor", "same_contract", "spec_mismatch", "topical", "stale")]
    shown = F.count_if(~st.isin("stale", "topical"))
    return pairs.agg(F.count("*").alias("total"), (shown if limit is None else F.least(shown, F.lit(limit))).alias("shown"), F.count_if("prices_live").alias("live"), *each)


def build_corrections(study: DataFrame, strict: DataFrame) -> DataFrame:
    """Strict failures, then structural suspicions, among pairs not yet called a mismatch."""
    open_ = study.where(~F.col("triage_label").isin(*MISMATCH)).join(strict.select(*KEY, "spec_match", "mismatch_reason"), KEY, "left")
    why = P.suspicious(F.col("a_title"), F.col("b_title"))
    failed = ~F.col("spec_match")
    found = open_.withColumns({"correction_source": F.when(failed, "strict_reverify").when(why.isNotNull(), "deterministic_rule"), "correction_reason": F.when(failed, F.col("mismatch_reason")).otherwise(why)})
    return found.where("correction_source is not null").select(*KEY, F.col("triage_label").alias("original_verdict"), F.lit("spec_mismatch").alias("corrected_verdict"), "correction_source", "correction_reason")


def verified_pairs(study: DataFrame, strict: DataFrame, corrections: DataFrame) -> DataFrame:
    """The read model: a correction's label wins and ends strict survival."""
    joined = _overlaid(study, strict, corrections)
    return joined.withColumns({"triage_label": F.coalesce("corrected_verdict", "triage_label"), "strict_survivor": F.col("strict") & ~F.col("corrected"), "tier": F.coalesce("tier", F.lit(""))})


def overlay_live(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """Each side's live price and volume where it has one, else the study's.

    ``live(platform, id, yes, volume)`` may tell ``active`` and ``has_book``: a pair whose
    both sides are found and inactive is settled; a live side without a book is stale. For the session, joins
    whose parts all turn out small enough to be held look rows up instead of sorting both sides.
    """
    pairs.sparkSession.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    extra = {c: F.col(c) if c in live.columns else F.lit(True) for c in ("active", "has_book")}

    def side(platform: str, k: str) -> DataFrame:
        own = live.where(F.col("platform") == platform)
        return own.select(F.col("id").alias(f"{k}_id"), F.struct(F.col("yes"), F.coalesce("volume", F.lit(0.0)).alias("volume"), *(c.alias(n) for n, c in extra.items())).alias(f"{k}_live"))

    joined = pairs.join(side("venue_a", "a"), "a_id", "left").join(side("venue_b", "b"), "b_id", "left")
    now = lambda k, name, old: F.coalesce(F.col(f"{k}_live.{name}"), F.col(f"{k}_{old}"))
    gap = P.gap(now("a", "yes", "price"), now("b", "yes", "price"), F.col("yes_aligned"))
    found = lambda k: F.col(f"{k}_live.yes").isNotNull()
    stale = lambda k: found(k) & F.col(f"{k}_live.active") & ~F.col(f"{k}_live.has_book")
    return joined.withColumns({
        "prices_live": found("a") & found("b"), "gap": gap, "beats_fees": gap > P.FEES, "liquidity": F.least(now("a", "volume", "volume"), now("b", "volume", "volume")),
        "settled": F.coalesce(~F.col("a_live.active") & ~F.col("b_live.active"), F.lit(False)), "stale_side": F.when(stale("b"), "venue_b").when(stale("a"), "venue_a"),
    }).drop("a_live", "b_live")


def _last(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The last row of each ``key`` in an order, as a struct."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias(name))


def verifier_index(study: DataFrame, strict: DataFrame, order: list[str] = KEY) -> DataFrame:
    """One row per market id, from both sides of the pairs: of an id in several pairs the
    last by ``order``. A pair's strict row is the last one of its a, else of its b."""
    rows = strict.select(*KEY, "spec_match", "tier")
    joined = study.join(_last(rows, "a_id", KEY, "by_a"), "a_id", "left").join(_last(rows, "b_id", KEY, "by_b"), "b_id", "left").withColumn("own", F.coalesce("by_a", "by_b"))
    own = joined.select("a_id", "b_id", *(F.col(c).alias(f"_{c}") for c in order), verifier_state(F.col("own.spec_match"), F.col("own.tier"), F.col("triage_label")).alias("state"), F.coalesce("own.spec_match", F.lit(False)).alias("strict"))
    side = lambda p, k, o: F.struct(F.lit(p).alias("platform"), F.col(f"{k}_id").alias("id"), F.col(f"{o}_id").alias("counterpart"))
    both = own.withColumn("x", F.explode(F.array(side("venue_a", "a", "b"), side("venue_b", "b", "a")))).select("x.*", "state", "strict", *(f"_{c}" for c in order))
    return _last(both, "id", [*(f"_{c}" for c in order), "platform"], "x").select("x.platform", "id", "x.counterpart", "x.state", "x.strict")


#: The stages of the funnel; the first counts markets, the others pairs.
STAGES = ["tradeable", "candidates", "same_event", "same_contract", "priceable", "clears_fees", "semantic", "liquid", "strict", "deep", "executable"]


def funnel_stages(study: DataFrame, strict: DataFrame, corrections: DataFrame, markets: DataFrame, executable: DataFrame) -> DataFrame:
    """The stages in order with what each removes and keeps, and its width on a log scale.

    From the semantic survivors on, counts are those after ``corrections``. ``markets`` are
    the tradeable ones, ``executable`` the pairs left by manual review. Markets and pairs
    are different units, so candidates remove nothing.
    """
    same, fine = F.col("same_criteria"), F.col("priceable")
    one = study.agg(F.count("*").alias("candidates"), F.count_if("same_event").alias("same_event"), F.count_if(same).alias("same_contract"), F.count_if(same & fine).alias("priceable"), F.count_if(same & fine & (F.col("gap") > P.FEES)).alias("clears_fees"))
    for more in (corrected_funnel(study, strict, corrections), markets.agg(F.count("*").alias("tradeable")), executable.agg(F.count("*").alias("executable"))):
        one = one.crossJoin(F.broadcast(more))
    value = {n: F.col(n) for n in STAGES}
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("stage"), value[n].alias("value"), (value[STAGES[i - 1]] if i > 1 else F.lit(None).cast("long")).alias("before"), F.greatest(*value.values()).alias("most")) for i, n in enumerate(STAGES)]
    x = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    width = F.coalesce(F.greatest(F.lit(3.0), F.least(F.lit(100.0), F.try_divide(F.log10("value"), F.log10("most")) * 100)), F.lit(100.0))
    return x.select("ord", "stage", "value", F.greatest(F.lit(0).cast("long"), F.col("before") - F.col("value")).alias("removed"), F.round(F.try_divide(F.col("value") * 100.0, F.col("before")), 6).alias("kept_percent"), F.round(F.when(F.col("value") > 0, width).otherwise(0.0), 6).alias("width"))


def top_numbered(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order and their places; tasks keep ``n`` rows each before
    one ranks them."""
    return df.orderBy(*order).limit(n).withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_pairs(pairs: DataFrame, n: int, sort: str = "opportunity") -> DataFrame:
    """The first ``n`` pairs by opportunity (status, strict survivors, liquidity), gap,
    liquidity or confidence; settled ones come last in any order."""
    status = F.when(F.col("st") == "survivor", 0).when(F.col("st") == "same_contract", 1).when(F.col("st") == "spec_mismatch", 2).when(F.col("st") == "topical", 3).otherwise(4)
    orders = {"opportunity": [status, F.desc("strict_survivor"), F.desc("liquidity")], "gap": [F.desc("gap")], "liquidity": [F.desc("liquidity")], "confidence": [F.desc("cosine")]}
    return top_numbered(pairs, n, "settled", *orders[sort], "a_id", "b_id")


def title_diff(a: Column, b: Column) -> Column:
    """Words of one title that the other lacks."""
    words = lambda c: F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " ")
    return F.filter(F.array_except(words(a), words(b)), lambda w: (F.length(w) > 2) & ~w.isin(TITLE_STOP))
