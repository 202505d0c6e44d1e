"""Score factors, position sizes and forecast scores."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"edge": 0.35, "confidence": 0.25, "liquidity": 0.20, "time": 0.10, "profit": 0.10}


def steps(c: Column, bounds: list[tuple[float, float]], last: float) -> Column:
    """The value of the first bound that ``c`` is under."""
    out = None
    for bound, value in bounds:
        out = F.when(c < bound, F.lit(value)) if out is None else out.when(c < bound, F.lit(value))
    return out.otherwise(F.lit(last))


def edge_score(net: Column) -> Column:
    p = net * 100
    return F.when(p <= 0, 1.0).when(p < 5, 1 + p / 5).when(p < 7, 3 + (p - 5) / 2).when(p < 10, 5 + (p - 7) / 3).when(p < 15, 7 + (p - 10) / 5).when(p < 20, 9.0).otherwise(10.0)


def confidence_score(detector: Column, match: Column) -> Column:
    p = detector * F.coalesce(match, F.lit(1.0)) * 10
    return F.when(p <= 0, 0.0).otherwise(F.least(F.lit(10.0), p))


def liquidity_score(usd: Column) -> Column:
    return steps(usd, [(500, 0.0), (1000, 3.0), (5000, 5.0), (10000, 7.0), (50000, 9.0)], 10.0)


def time_score(days_left: Column) -> Column:
    return F.when(days_left.isNull(), 5.0).otherwise(steps(days_left, [(1, 10.0), (3, 8.0), (7, 6.0), (30, 4.0)], 2.0))


def profit_score(net: Column) -> Column:
    return F.least(F.lit(10.0), net * 100)


def breakdown(net: Column, detector: Column, match: Column, liquidity: Column, days_left: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """``struct(edge, confidence, liquidity, time, profit, weights)`` of a composite score."""
    parts = {"edge": edge_score(net), "confidence": confidence_score(detector, match), "liquidity": liquidity_score(liquidity), "time": time_score(days_left), "profit": profit_score(net)}
    return F.struct(*(c.cast("double").alias(k) for k, c in parts.items()), F.struct(*(F.lit(w).alias(k) for k, w in weights.items())).alias("weights"))


def composite(net: Column, detector: Column, match: Column, liquidity: Column, days_left: Column, weights: dict[str, float] = WEIGHTS, min_edge: float = 0.05) -> Column:
    """The weighted score, 1 to 10; null where the edge is under ``min_edge``."""
    if abs(sum(weights.values()) - 1) > 1e-3:
        raise ValueError("weights add up to 1")
    # steps are whole numbers; their weighted values are taken exactly, or a score on a limit may fall short of it
    exact = lambda c, w: (c.cast("decimal(6,2)") * F.lit(Decimal(str(w)))).cast("double")
    total = edge_score(net) * weights["edge"] + confidence_score(detector, match) * weights["confidence"] + exact(liquidity_score(liquidity), weights["liquidity"]) + exact(time_score(days_left), weights["time"]) + profit_score(net) * weights["profit"]
    return F.when(net >= min_edge, F.least(F.lit(10.0), F.greatest(F.lit(1.0), total)))


def round_half_up(c: Column, scale: float = 1) -> Column:
    return F.floor(c * scale + 0.5) / scale


def kelly(edge: Column, confidence: Column, bankroll: float, fraction: float = 0.5, most: float = 0.10, least_confidence: float = 0.1) -> Column:
    """``struct(size, percent, capped_by)`` of half-Kelly sizing."""
    none = (edge <= 0) | (confidence < least_confidence)
    part = edge * confidence * fraction
    final = F.when(part > most, most).otherwise(part)
    return F.struct(
        F.when(none, 0.0).otherwise(round_half_up(bankroll * final, 100)).alias("size"),
        F.when(none, 0.0).otherwise(round_half_up(final * 100, 10000)).alias("percent"),
        F.when(none, "kelly").when(part > most, "max").otherwise("none").alias("capped_by"),
    )


def kelly_estimate(p: Column, price: Column) -> Column:
    """``struct(fraction, side)``: half the distance, capped, none within a point."""
    gap = F.abs(p - price)
    return F.struct(F.when(gap > 0.01, F.least(F.lit(0.10), gap * 0.5)).otherwise(0.0).alias("fraction"), F.when(p > price, "BUY YES").otherwise("BUY NO").alias("side"))


def brier(p: Column, outcome: Column) -> Column:
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) - outcome, 2)


def assess(score: Column) -> Column:
    return F.when(score <= 0.1, "Excellent").when(score <= 0.2, "Good").when(score <= 0.25, "Average").otherwise("Poor")
