"""Sinks written and read back, streams against their batch forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from keelson.operators import history
from keelson.plans import all_queries
from keelson.plans.fixtures import view
from keelson.sources import sinks
from tests.compare import SF


def snapshots(spark, rows):
    return spark.createDataFrame([("venue_a", m, datetime(2024, 1, d, h), y) for m, d, h, y in rows], "platform string, market_id string, ts timestamp, yes double")


def test_snapshots_are_appended_once(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    first = snapshots(spark, [("m1", 1, 0, 0.5), ("m1", 1, 0, 0.6), ("m2", 2, 1, 0.4)])
    sinks.append_snapshots(first, path)
    sinks.append_snapshots(snapshots(spark, [("m1", 1, 0, 0.9), ("m1", 2, 3, 0.7)]), path)
    assert sorted((r["market_id"], r["ts"].day, r["ts"].hour) for r in spark.read.parquet(path).collect()) == [("m1", 1, 0), ("m1", 2, 3), ("m2", 2, 1)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "b", 0.5, 1), ("c", "d", 0.6, 1)], "a_id string, b_id string, confidence double, n int")
    new = spark.createDataFrame([("a", "b", 0.9, 2), ("e", "f", 0.7, 2)], old.schema)
    once = sinks.upsert(new, old, ["a_id", "b_id"], "n")
    twice = sinks.upsert(new, once, ["a_id", "b_id"], "n")
    want = [("a", "b", 0.9, 2), ("c", "d", 0.6, 1), ("e", "f", 0.7, 2)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_request_lines_by_chunk(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "hi \"you\"", 0), ("k2", "é\n", 1)], "key string, user string, chunk int")
    sinks.write_requests(sinks.request_lines(rows), f"{tmp_path}/requests")
    lines = spark.read.text(f"{tmp_path}/requests").select(F.get_json_object("value", "$.custom_id").alias("id"), F.get_json_object("value", "$.body.messages[1].content").alias("user"), "chunk")
    assert sorted(map(tuple, lines.collect())) == [("k1", "hi \"you\"", 0), ("k2", "é\n", 1)]


def test_stream_windows_are_batch_windows(spark):
    ms = lambda c: F.floor(F.unix_micros(c) / 1000)
    columns = ["type", "platform", "market_id", ms("first_seen").alias("a"), ms("last_seen").alias("z"), "best_score", "n"]
    batch = {tuple(r) for r in history.dedup_alerts(view(spark, SF, "opportunities")).select(*columns).collect()}
    closed = {tuple(r) for r in all_queries()["st4_dedup_stream"](spark, SF).select("type", "platform", "market_id", "first_ms", "last_ms", "best_score", "n").collect()}
    assert closed and closed <= batch
    keys = {r[:3] for r in batch}
    assert len(batch - closed) <= len(keys)


def test_batch_windows_are_four_hours_apart(spark):
    from pyspark.sql.window import Window

    found = history.dedup_alerts(view(spark, SF, "opportunities"))
    before = F.lag("first_seen").over(Window.partitionBy("type", "platform", "market_id").orderBy("first_seen"))
    gaps = found.select((F.unix_micros("first_seen") - F.unix_micros(before)).alias("g")).where("g is not null")
    assert gaps.where(F.col("g") < 4 * 3_600_000_000).count() == 0


def outcomes(spark, rows):
    return spark.createDataFrame([("venue_a", m, o, datetime(2024, 1, 1, h), ask, ask - 0.02, 5000.0) for m, o, h, ask in rows], "platform string, market_id string, outcome int, ts timestamp, ask double, bid double, liquidity double")


def test_detection_is_stored_once_and_sees_whole_markets(spark, tmp_path):
    from keelson.streaming import jobs

    run = jobs.detect_batch(f"{tmp_path}/out", f"{tmp_path}/books")
    stored = lambda: sorted((r["type"], r["market_id"], r["detected_at"].hour) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    first = outcomes(spark, [("m1", 1, 1, 0.2), ("m1", 2, 1, 0.2), ("m1", 3, 1, 0.2), ("m2", 1, 1, 0.2), ("m2", 2, 1, 0.2)])
    run(first, 0)
    once = stored()
    assert ("multi_outcome", "m1", 1) in once and not [r for r in once if r[:2] == ("multi_outcome", "m2")]
    run(first, 0)
    assert stored() == once
    # the third outcome of m2 comes later: its book has all three
    run(outcomes(spark, [("m2", 3, 2, 0.2)]), 1)
    assert ("multi_outcome", "m2", 2) in stored() and set(once) <= set(stored())
    row = spark.read.parquet(f"{tmp_path}/out").where("market_id = 'm2' and type = 'multi_outcome'").first()
    assert row["depth"] == 3 and row["total"] >= 5 and row["breakdown"]["weights"]["edge"] == 0.35 and row["position_size"] > 0


def test_newest_rows_survive_batches_run_again(spark, tmp_path):
    from keelson.streaming import jobs

    merge = jobs.merge_into(f"{tmp_path}/table")
    rows = lambda *r: spark.createDataFrame([("venue_a", m, datetime(2024, 1, 1, h), y, h) for m, h, y in r], "platform string, market_id string, ts timestamp, yes double, event_id int")
    merge(rows(("m1", 1, 0.1), ("m2", 1, 0.2)), 0)
    merge(rows(("m1", 3, 0.3)), 1)
    merge(rows(("m1", 3, 0.3)), 1)
    merge(rows(("m1", 2, 0.9)), 2)
    assert sorted((r["market_id"], r["yes"]) for r in jobs.newest_version(spark, f"{tmp_path}/table").collect()) == [("m1", 0.3), ("m2", 0.2)]


def files_of(path):
    import glob

    return sorted(glob.glob(f"{path}/data/v=*/_part=*/*.parquet"))


def test_tables_of_newest_rows_split_vacuum_and_run_again(spark, tmp_path):
    import random

    from keelson.streaming import tables

    rnd, path, want = random.Random(5), f"{tmp_path}/table", {}
    merge = tables.merge_into(path, part_rows=40)
    schema = "platform string, market_id string, ts timestamp, yes double, event_id int"
    stored, read = [], []
    for number in range(9):
        # batch 4 is empty, a null key is a key, and times come in any order
        rows = [("venue_a", rnd.choice([None, *(f"m{i}" for i in range(300))]), datetime(2024, 1, rnd.randrange(1, 28)), float(number), number * 1000 + i) for i in range(0 if number == 4 else 120)]
        batch = spark.createDataFrame(rows, schema)
        merge(batch, number)
        if number % 3 == 1:
            merge(batch, number)
        for r in rows:
            want[r[1]] = max(want.get(r[1], r), r, key=lambda x: (x[2], x[4]))
        found = tables.newest_version(spark, path)
        assert {r["market_id"]: tuple(r) for r in found.select(schema.replace(",", "").split(" ")[::2]).collect()} == want, number
        stored.append(len(files_of(path)))
        read.append(len(found.inputFiles()))
    parts = tables.logs(spark, path)
    assert len(parts) == 2 and max(p.n for p in parts[8]) <= 80 and max(p.depth for p in parts[8]) > 3
    # two versions of each part at most, whatever the batches so far
    assert read[-1] <= len(parts[8]) and stored[-1] <= 2 * len(parts[8])
    some = tables.newest_version(spark, path, holding=spark.createDataFrame([("venue_a", "m7")], "platform string, market_id string"))
    assert len(some.inputFiles()) == 1 and some.where("market_id = 'm7'").count() == ("m7" in want)


def test_a_table_never_merged_into_is_an_error(spark, tmp_path):
    import pytest

    from keelson.streaming import tables

    tables.merge_into(f"{tmp_path}/t")(spark.createDataFrame([], "platform string, market_id string, ts timestamp, event_id int"), 0)
    with pytest.raises(ValueError):
        tables.newest_version(spark, f"{tmp_path}/t")


def test_stored_once_by_day(spark, tmp_path):
    from keelson.streaming import tables

    path = f"{tmp_path}/out"
    rows = lambda *r: spark.createDataFrame([(i, d and datetime(2024, 1, d, h), v) for i, d, h, v in r], "id string, at timestamp, v int")
    for batch in (rows(("a", 1, 5, 1), ("a", 1, 5, 1), (None, 1, 5, 1), ("n", None, 0, 1)), rows(("a", 1, 5, 2), ("a", 1, 6, 2), (None, 1, 5, 2), ("b", 2, 0, 2)), rows(), rows(("n", None, 0, 3), ("b", 2, 0, 3), ("n", 3, 0, 3))):
        tables.store_new(batch, path, ["id", "at"], "at")
    found = sorted(((r["id"] or "", r["at"].day if r["at"] else 0, r["v"]) for r in spark.read.parquet(path).collect()))
    assert found == [("", 1, 1), ("a", 1, 1), ("a", 1, 2), ("b", 2, 2), ("n", 0, 1), ("n", 3, 3)]


def test_chunks_do_not_hang_on_partitions(spark):
    import random

    rnd = random.Random(3)
    rows = [(f"k{i:05}", rnd.choice([1, 5, 30, 70, 120])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, tokens long")
    want, chunk, used, n = [], -1, 0, 0
    for key, tokens in rows:
        if not n or used + tokens > 100 or n >= 9:
            chunk, used, n = chunk + 1, 0, 0
        used, n = used + tokens, n + 1
        want.append((key, tokens, chunk))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(map(tuple, history.assign_chunks(df, 100, 9).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
