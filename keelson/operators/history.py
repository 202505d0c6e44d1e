"""Price snapshots over time: latest rows, as-of prices, movements, candles, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.sources.scratch import cut

MARKET = ["platform", "market_id"]


def fresh(snapshots: DataFrame, as_of: Column, minutes: float) -> DataFrame:
    """Rows up to ``as_of`` and no older than ``minutes`` before it."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return snapshots.where((age >= 0) & (age <= int(minutes * 60_000_000)))


def latest(snapshots: DataFrame, by: list[str] = MARKET, tie: str = "event_id") -> DataFrame:
    """The newest row of each market; a partial maximum, not a sort."""
    rest = [c for c in snapshots.columns if c not in by]
    best = snapshots.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("ts", tie)).alias("x"))
    return best.select(*by, "x.*")


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first of each key in an order over several sources."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def asof_pairs(matches: DataFrame, snapshots: DataFrame, as_of: Column, minutes: float) -> DataFrame:
    """Matches with the newest fresh snapshot of both sides."""
    now = latest(fresh(snapshots, as_of, minutes))
    side = lambda p, k: now.where(F.col("platform") == p).select(F.col("market_id").alias(f"{k}_id"), F.col("yes").alias(f"{k}_yes"), F.col("liquidity_total").alias(f"{k}_liquidity"), F.col("ts").alias(f"{k}_ts"))
    return matches.join(side("venue_a", "a"), "a_id").join(side("venue_b", "b"), "b_id")


def movement(snapshots: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """Latest price less the last one at or before ``hours`` ago, else less the first; of
    markets with two points, in rounded points."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    then = F.unix_micros(as_of.cast("timestamp")) - int(hours * 3_600_000_000)
    order = F.struct("ts", "event_id")
    before = F.max_by("yes", F.when(at <= then, order))
    out = snapshots.where(at <= F.unix_micros(as_of.cast("timestamp"))).groupBy(*MARKET).agg(F.count("*").alias("points"), F.max_by("yes", order).alias("now"), F.coalesce(before, F.min_by("yes", order)).alias("was"))
    return out.where("points >= 2").select(*MARKET, "now", "was", F.floor((F.col("now") - F.col("was")) * 100 + 0.5).alias("move_pp"))


def recent(snapshots: DataFrame, n: int = 10, by: list[str] = MARKET) -> DataFrame:
    """The ``n`` newest rows of each market with their place; tasks keep ``n`` of each
    market before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id"))
    return snapshots.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= n)


def daily_candles(snapshots: DataFrame) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return snapshots.groupBy(*MARKET, day.alias("day")).agg(F.max_by("yes", F.struct("ts", "event_id")).alias("close"), F.avg("yes").alias("mean"), F.count("*").alias("n"))


def price_history(candles: DataFrame, since: str) -> DataFrame:
    """Close or else mean of each candle, inside (0, 1), from a day on."""
    price = F.coalesce("close", "mean")
    return candles.where(F.col("day") >= F.lit(since).cast("timestamp")).withColumn("price", price).where("price > 0 AND price < 1")


def pair_history(matches: DataFrame, candles: DataFrame, aligned: Column) -> DataFrame:
    """Both venues' daily closes on a common YES side, days that either has."""
    side = lambda p, k: candles.where(F.col("platform") == p).select(F.col("market_id").alias("m"), "day", F.col("close").alias(k))
    both = side("venue_a", "a_close").join(side("venue_b", "b_close"), ["m", "day"], "full_outer")
    return matches.join(both, matches["a_id"] == both["m"]).select("a_id", "day", "a_close", F.when(aligned, F.col("b_close")).otherwise(1 - F.col("b_close")).alias("b_close"))


def _next_anchor(at: np.ndarray, width: int) -> np.ndarray:
    """Of each row, by time, the first that comes ``width`` or more later; the number of rows if none."""
    return np.searchsorted(at, at + width)


def _last_anchor(after: np.ndarray) -> np.ndarray:
    """Of each row the last anchor of the windows that start with it, by doubled jumps."""
    own = np.arange(len(after))
    jump = np.where(after < len(after), after, own)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return jump


_ALERT_KEY = ["type", "platform", "market_id"]
_BREAKS = "type string, platform string, market_id string, part int, upto long, leaves long"


def _keys_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key in a part, which is held as a whole."""
    whole = [f for f in frames if len(f)]
    if whole:
        yield from pd.concat(whole).groupby(_ALERT_KEY, sort=False, dropna=False)


def dedup_alerts(alerts: DataFrame, hours: float = 4, n_parts: int | None = None) -> DataFrame:
    """One row per anchored window of each (type, platform, market).

    A window starts with the first row ``hours`` or more after the start of the one before, so where
    a range of a key's rows ends depends on how the range before it did. Rows are dealt by ranges
    of key and time, so one key may take many tasks. Each first tells, for every start its first
    hours allow, the last window it would leave; these few breaks are followed from range to
    range for the keys that have several; then all ranges are cut in windows at once, and a window
    across ranges is added up.
    """
    spark = alerts.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = int(hours * 3_600_000_000)
    thin = alerts.select(*_ALERT_KEY, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "score", "event_id")
    dealt = cut(thin.repartitionByRange(n_parts, *_ALERT_KEY, "at", "event_id").withColumn("part", F.spark_partition_id()))
    ranges = dealt.repartition(n_parts, "part").sortWithinPartitions("part", *_ALERT_KEY, "at", "event_id")

    def breaks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _keys_of(frames):
            for part, own in rows.groupby("part"):
                at = own["at"].to_numpy()
                leaves = at[_last_anchor(_next_anchor(at, width))][: np.searchsorted(at, at[0] + width) + 1]  # and the first after them
                last = np.flatnonzero(np.append(leaves[1:] != leaves[:-1], True))
                key = own[_ALERT_KEY].iloc[[0] * len(last)].reset_index(drop=True)
                yield key.assign(part=part, upto=at[last], leaves=leaves[last])

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        """What window each later range of a key is entered with."""
        out, window = [], None
        for part, own in rows.sort_values(["part", "upto"]).groupby("part"):
            upto, leaves = own["upto"].to_numpy(), own["leaves"].to_numpy()
            if window is not None:
                out.append((*own[_ALERT_KEY].iloc[0], part, window))
            k = 0 if window is None else int(np.searchsorted(upto, window + width))
            window = int(leaves[k]) if k < len(upto) else window
        return pd.DataFrame(out, columns=[*_ALERT_KEY, "part", "window"])

    spans = dealt.groupBy(*_ALERT_KEY).agg(F.count_distinct("part").alias("parts")).where("parts > 1")
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in _ALERT_KEY]
    several = ranges.alias("r").join(F.broadcast(spans).alias("s"), same("r", "s"), "left_semi").repartition(n_parts, "part").sortWithinPartitions("part", *_ALERT_KEY, "at", "event_id")
    entered = cut(several.mapInPandas(breaks, _BREAKS).groupBy(*_ALERT_KEY).applyInPandas(follow, "type string, platform string, market_id string, part int, window long"))
    # a range is entered in the middle of one key at most, so this has no more rows than ranges
    joined = dealt.alias("d").join(F.broadcast(entered).alias("e"), [*same("d", "e"), F.col("d.part") == F.col("e.part")], "left").select("d.*", "e.window")
    ordered = joined.repartition(n_parts, "part").sortWithinPartitions("part", *_ALERT_KEY, "at", "event_id")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _keys_of(frames):
            for _, own in rows.groupby("part"):
                at, score = own["at"].to_numpy(), own["score"].to_numpy()
                after, window = _next_anchor(at, width), own["window"].iloc[0]
                begins, anchors = ([0], [int(window)]) if pd.notna(window) else ([], [])
                k = int(np.searchsorted(at, window + width)) if begins else 0
                if begins and k == 0:
                    begins, anchors = [], []
                while k < len(at):
                    begins.append(k)
                    anchors.append(int(at[k]))
                    k = int(after[k])
                ends = [*begins[1:], len(at)]
                key = own[_ALERT_KEY].iloc[[0] * len(begins)].reset_index(drop=True)
                yield key.assign(anchor=anchors, last=at[np.array(ends) - 1], best_score=np.maximum.reduceat(score, begins), n=np.diff([*begins, len(at)]))

    cut_up = ordered.mapInPandas(windows, "type string, platform string, market_id string, anchor long, last long, best_score double, n long")
    out = cut_up.groupBy(*_ALERT_KEY, "anchor").agg(F.max("last").alias("last"), F.max("best_score").alias("best_score"), F.sum("n").alias("n"))
    return out.select("platform", "market_id", "type", F.timestamp_micros("anchor").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"), "best_score", "n")


def alert_stats(windows: DataFrame, as_of: Column, hours: float = 4) -> DataFrame:
    """Keys still tracked at ``as_of``, the oldest first sight among them, their best score, and
    the keys that are pruned: those whose newest window began over ``hours`` before."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("first_seen")
    newest = windows.where(age >= 0).groupBy(*_ALERT_KEY).agg(F.max("first_seen").alias("first_seen"), F.max_by("best_score", "first_seen").alias("best_score"))
    kept = age <= int(hours * 3_600_000_000)
    return newest.agg(F.count_if(kept).alias("total"), F.min(F.when(kept, F.col("first_seen"))).alias("oldest"), F.max(F.when(kept, F.col("best_score"))).alias("best_score"), F.count_if(~kept).alias("pruned"))


def _fill(entry: dict[int, tuple[int, int, int]], budget: int, max_rows: int, listed: bool):
    """Folds rows that come sorted by range and key: each range starts from its entry, which
    is tokens and rows of the open chunk and its number. Gives the rows with their chunk, or
    each range's exit alone."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, used, rows, chunk, exits = None, 0, 0, -1, []
        for frame in frames:
            own = []
            for p, tokens in zip(frame["part"].tolist(), frame["tokens"].tolist(), strict=True):
                if p != part:
                    if part is not None:
                        exits.append((part, used, rows, chunk))
                    part = p
                    used, rows, chunk = entry.get(p, (0, 0, -1))
                if not rows or used + tokens > budget or rows >= max_rows:
                    chunk, used, rows = chunk + 1, 0, 0
                used, rows = used + tokens, rows + 1
                own.append(chunk)
            if listed:
                yield pd.DataFrame({"key": frame["key"], "tokens": frame["tokens"], "chunk": own})
        if not listed:
            exits += [(part, used, rows, chunk)] if part is not None else []
            yield pd.DataFrame(exits, columns=["part", "used", "rows", "chunk"])

    return task


def assign_chunks(requests: DataFrame, budget: int = 1_800_000, max_rows: int = 50_000) -> DataFrame:
    """``key, tokens, chunk``: requests in key order, filled into chunks until a token budget
    or row count.

    The running sum starts anew with each chunk, so a range of keys depends on how the one
    before it ends. Ranges are folded at once, from guessed entries; those whose guess was
    wrong are folded again from the exit before them, until all agree. Chunks from different
    entries soon fall in step, so few rounds are needed, and each settles one range at least.
    Only keys and estimates are moved; the driver holds one small row for each range.
    """
    n_parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(requests.select("key", "tokens").repartitionByRange(n_parts, "key", "tokens").withColumn("part", F.spark_partition_id()))
    ordered = lambda df: df.repartition(n_parts, "part").sortWithinPartitions("part", "key", "tokens")
    entry: dict[int, tuple[int, int, int]] = {}
    exits: dict[int, tuple[int, int, int]] = {}
    todo = dealt
    while True:
        found = ordered(todo).mapInPandas(_fill(dict(entry), budget, max_rows, False), "part int, used long, rows long, chunk long").collect()
        exits |= {r["part"]: (r["used"], r["rows"], r["chunk"]) for r in found}
        before, wrong = (0, 0, -1), []
        for part in sorted(exits):
            guess = entry.get(part, (0, 0, -1))
            if guess[:2] != before[:2]:
                wrong.append(part)
            # chunk numbers alone only shift
            exits[part] = (*exits[part][:2], exits[part][2] - guess[2] + before[2])
            entry[part] = before
            before = exits[part]
        if not wrong:
            break
        todo = dealt.where(F.col("part").isin(wrong))
    return ordered(dealt).mapInPandas(_fill(entry, budget, max_rows, True), "key string, tokens long, chunk long")
