"""The scheduled jobs as Structured Streaming queries.

A stream is any DataFrame from ``readStream`` with ``platform, market_id, ts`` and prices.
Each job has the batch operator's meaning; its state is bounded by the watermark, that of the
latest rows by the number of markets.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from keelson.functions import scoring as S
from keelson.operators import detect
from keelson.streaming.tables import KEY, merge_into, newest_version, store_new

DELAY = "30 minutes"
#: Buckets of keys that the open alert windows are kept in.
BUCKETS = 4096


def timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class LateRows(StreamingQueryListener):
    """Keeps, per batch of the streams named ``name``, the rows that it read, those that its
    watermark dropped and the watermark itself, as JSON under ``path/batch=<id>``.

    A batch that runs again writes its row again. Attach it with ``watch`` before the stream
    starts; ``ended`` waits until the rows of a stream that ended are written.
    """

    SCHEMA = "rows long, late long, watermark timestamp, batch long"

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.ours: set[str] = set()
        self.over = threading.Event()
        self.failure: Exception | None = None

    def watch(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def ended(self, seconds: float = 60) -> None:
        done = self.over.wait(seconds)
        self.spark.streams.removeListener(self)
        if self.failure:
            raise self.failure
        if not done:
            raise TimeoutError(f"no end of the stream {self.name} after {seconds} s")

    def counts(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ours.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        row = self.spark.range(1).select(F.lit(p.numInputRows).cast("long").alias("rows"), F.lit(late).cast("long").alias("late"), F.lit(p.eventTime.get("watermark")).cast("timestamp").alias("watermark"))
        try:
            row.coalesce(1).write.mode("overwrite").json(f"{self.path}/batch={p.batchId}")
        except Exception as e:  # a listener's errors are only logged; ``ended`` raises it
            self.failure = e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.ours:
            self.over.set()


def ingest(stream: DataFrame, path: str, checkpoint: str, name: str | None = None):
    """Snapshots to Parquet, each (platform, market, time) once. Event time is in the key,
    so state is dropped with the watermark and the result exact. Give it the ``name`` of a
    ``LateRows`` to have late rows counted."""
    unique = timed(stream).withWatermark("ts", DELAY).dropDuplicates([*KEY, "ts"])
    writer = unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def latest_state(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """The newest row of each market, handed to ``merge`` batch by batch."""
    newest = timed(stream).groupBy(*KEY).agg(F.max_by(F.struct("yes", "event_id"), F.struct("ts", "event_id")).alias("x"), F.max("ts").alias("ts")).select(*KEY, "ts", "x.*")
    return newest.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_candles(stream: DataFrame) -> DataFrame:
    """Close and mean of each market's day, final when the watermark has passed it."""
    day = F.window("ts", "1 day")
    rows = timed(stream).withWatermark("ts", DELAY).groupBy(*KEY, day.alias("w")).agg(F.max_by("yes", F.struct("ts", "event_id")).alias("close"), F.avg("yes").alias("mean"), F.count("*").alias("n"))
    return rows.select(*KEY, F.col("w.start").alias("day"), "close", "mean", "n")


class AlertWindows(StatefulProcessor):
    """The open windows of the keys that share a bucket: first and last time, best score, rows. A row
    that comes ``hours`` or more after the first closes its key's window and opens the next; the
    bucket's timer closes those that no row does.

    State is read and written once for a bucket, for each call goes from Python to Spark and back.
    """

    def __init__(self, hours: float = 4):
        self.width_ms = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getListState("windows", "type string, platform string, market_id string, first_ms bigint, last_ms bigint, best double, n bigint")

    def _open(self) -> dict[tuple, tuple]:
        return {tuple(w[:3]): tuple(w[3:]) for w in self.windows.get()}

    def _frame(self, closed: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame([(*key, *w) for key, w in closed], columns=["type", *KEY, "first_seen", "last_seen", "best_score", "n"])
        return found.assign(**{c: pd.to_datetime(found[c], unit="ms") for c in ("first_seen", "last_seen")})

    def _keep(self, windows: dict[tuple, tuple], before: int | None) -> None:
        """Writes the open windows back; a timer stands for the first of them to close."""
        first = min((w[0] for w in windows.values()), default=None)
        if windows:
            self.windows.put([(*key, *w) for key, w in windows.items()])
        else:
            self.windows.clear()
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before + self.width_ms)
            if first is not None:
                self.handle.registerTimer(first + self.width_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        incoming = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        windows, closed = self._open(), []
        before = min((w[0] for w in windows.values()), default=None)
        times = (incoming["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
        for own, ms, score in zip(zip(*(incoming[c].tolist() for c in ("type", *KEY)), strict=True), times, incoming["score"].astype(float).tolist(), strict=True):
            w = windows.get(own)
            if w and ms - w[0] < self.width_ms:
                windows[own] = (w[0], max(w[1], ms), max(w[2], score), w[3] + 1)
            else:
                if w:
                    closed.append((own, w))
                windows[own] = (ms, ms, score, 1)
        self._keep(windows, before)
        yield self._frame(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows = self._open()
        over = timerValues.getCurrentWatermarkInMs() - self.width_ms
        closed = [(own, w) for own, w in windows.items() if w[0] < over]
        self._keep({own: w for own, w in windows.items() if w[0] >= over}, None)  # Spark drops the timer itself
        yield self._frame(closed)

    def close(self) -> None:
        pass


ALERTS = "type string, platform string, market_id string, first_seen timestamp, last_seen timestamp, best_score double, n bigint"


def dedup_alerts(stream: DataFrame, hours: float = 4, buckets: int = BUCKETS) -> DataFrame:
    """Anchored alert windows as they close; needs a state store that holds several values
    per key (RocksDB). Keys share ``buckets`` of state by hash, which a stream keeps for good."""
    bucket = F.pmod(F.xxhash64("type", *KEY), F.lit(buckets)).cast("int").alias("bucket")
    rows = timed(stream).select(bucket, "type", *KEY, "ts", "score", "event_id").withWatermark("ts", DELAY)
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=AlertWindows(hours), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")


def detect_batch(path: str, books: str, others: Callable[[SparkSession], dict[str, DataFrame]] | None = None, bankroll: float = 500.0, least: float = 5.0) -> Callable[[DataFrame, int], None]:
    """A micro-batch of outcome rows through the detectors to scored, stored opportunities,
    each (id, detected_at) once.

    The newest row of each outcome is kept at ``books``, so a market whose outcomes come in
    several batches is judged as a whole; only the parts of it that hold a market of the batch
    are read. ``others`` gives what the detectors across venues and on forecasts found
    (``cross``, ``forecasts``). A batch without a row that has a time stores nothing.
    """
    merge = merge_into(books, [*KEY, "outcome"], ("ts", "ask", "bid", "liquidity"), by=KEY)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merge(timed(batch), number)
        as_of = timed(batch).agg(F.max("ts")).first()[0]
        if as_of is None:
            return
        touched = batch.select(*KEY).distinct()
        own = detect.outcome_books(newest_version(spark, books, number + 1, touched).join(touched, KEY, "left_semi"))
        found = detect.unify(detect.multi_outcome(own), detect.price_sums(own), **(others(spark) if others else {}))
        kelly = S.kelly(F.col("net_edge"), F.col("detector_confidence"), bankroll)
        rows = detect.scored(found, least).withColumns({"position_size": kelly["size"], "position_percent": kelly["percent"]})
        store_new(rows.withColumn("detected_at", F.lit(as_of)), path, ["id", "detected_at"], "detected_at")

    return run
