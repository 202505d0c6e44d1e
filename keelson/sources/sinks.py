"""Tables that are appended to, merged and exported, on plain Parquet, CSV and JSON lines.

Keyed merges are anti-joins and grouped picks; only partitions that a batch touches need
be given as the old side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import normalize_title


def append_new(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is in neither ``old`` nor an earlier row of ``new``."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def append_snapshots(new: DataFrame, path: str) -> DataFrame:
    """Append what is not there yet to daily partitions at ``path``; returns those rows."""
    spark = new.sparkSession
    dated = new.withColumn("day", F.to_date("ts"))
    try:
        old = spark.read.parquet(path)
        fresh = append_new(dated, old.join(F.broadcast(dated.select("day").distinct()), "day", "left_semi"), ["platform", "market_id", "ts"])
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = dated.dropDuplicates(["platform", "market_id", "ts"])
    fresh.write.partitionBy("day").mode("append").parquet(path)
    return fresh


def upsert(new: DataFrame, old: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """Both tables with one row per key, the last by ``order``; a grouped maximum."""
    return newest(old.unionByName(new), key, *order)


def newest(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the last by ``order``."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(*key, "x.*")


def merge_columns(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Keys of either, each column the new value or else the old."""
    rest = [c for c in old.columns if c not in key]
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}")
    return new.alias("n").join(old.alias("o"), key, "full_outer").select(*key, *(pick(c) for c in rest))


def apply_override(comparisons: DataFrame, overrides: DataFrame) -> DataFrame:
    """A manual verdict by key; notes stay where the override has none."""
    o = overrides.select("a_id", "b_id", F.col("manual").alias("new_manual"), F.col("notes").alias("new_notes"))
    joined = comparisons.join(o, ["a_id", "b_id"], "left")
    return joined.withColumns({"manual_override": F.coalesce("new_manual", "manual_override"), "notes": F.coalesce("new_notes", "notes")}).drop("new_manual", "new_notes")


def record_outcome(comparisons: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The settlement outcome of each pair in ``outcomes(a_id, b_id, outcome)``, ``matched`` or ``diverged``; pairs
    that were never compared are not added."""
    o = outcomes.select("a_id", "b_id", F.col("outcome").alias("_outcome"))
    checked = F.when(F.col("_outcome").isin("matched", "diverged"), F.col("_outcome")).when(F.col("_outcome").isNotNull(), F.raise_error(F.concat(F.lit("no such outcome: "), "_outcome")).cast("string"))
    return comparisons.join(o, ["a_id", "b_id"], "left").withColumn("settlement_outcome", F.coalesce(checked, "settlement_outcome")).drop("_outcome")


def as_json(opportunities: DataFrame, columns: list[str], name: str = "breakdown") -> DataFrame:
    return opportunities.withColumn(name, F.to_json(F.struct(*columns)))


def study_run(pairs: DataFrame, markets: DataFrame, run_id: int, fees: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The run, market and pair rows of a study, each partitioned by run."""
    run = F.lit(run_id).cast("long").alias("run_id")
    by = markets.groupBy().agg(F.count_if(F.col("platform") == "venue_a").alias("universe_a"), F.count_if(F.col("platform") == "venue_b").alias("universe_b"), F.count("*").alias("universe_total"))
    runs = by.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("matched_pairs")))).select(run, F.lit(fees).alias("round_trip_fees"), "*")
    snap = markets.select(run, F.col("id").alias("market_id"), "platform", F.col("question").alias("title"), normalize_title(F.col("question")).alias("normalized_title"), "volume")
    flags = [(F.col("gap") >= 0.03).cast("int").alias("surfaced_3pp"), (F.col("gap") > fees).cast("int").alias("beats_fees_9pp"), (F.col("gap") >= 0.19).cast("int").alias("meets_detector_19pp")]
    return runs, snap, pairs.select(run, "a_id", "b_id", "gap", F.greatest(F.lit(0.0), F.col("gap") - fees).alias("fee_adjusted_gap"), *flags)


def write_study_run(tables: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    for name, df in zip(("runs", "markets", "pairs"), tables, strict=True):
        df.write.partitionBy("run_id").mode("append").parquet(f"{path}/{name}")


def latest_run(spark, path: str) -> DataFrame:
    """Pairs of the newest run, widest gap first."""
    runs, pairs = spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/pairs")
    newest = runs.agg(F.max("run_id").alias("run_id"))
    return pairs.join(F.broadcast(newest), "run_id", "left_semi").orderBy(F.desc("gap"), "a_id", "b_id")


def export_csv(rows: DataFrame, path: str) -> None:
    """Files of quoted text with a header, compressed."""
    rows.write.option("header", True).option("compression", "gzip").option("quoteAll", True).mode("overwrite").csv(path)


def _fixed(c: str) -> Column:
    return F.format_string("%.4f", F.round(F.col(c).cast("double"), 4))


def _whole(c: str) -> Column:
    return F.floor(F.coalesce(F.col(c), F.lit(0.0)) + 0.5)


def gap_map(study: DataFrame) -> DataFrame:
    """The gap map's sixteen columns, same contracts first, then by cosine."""
    rows = study.orderBy(F.desc("same_criteria"), F.desc("cosine"), "a_id", "b_id")
    net = rows.withColumn("_net", F.greatest(F.lit(0.0), F.col("gap") - 0.09))
    return net.select(
        "a_id", "b_id", F.col("a_title").alias("a_question"), F.col("b_title").alias("b_question"), _fixed("a_price").alias("a_yes"), _fixed("b_price").alias("b_yes"), "yes_aligned", _fixed("gap").alias("gap"), _fixed("_net").alias("net_after_fees"), "priceable",
        _fixed("cosine").alias("cosine"), "same_criteria", F.coalesce("triage", F.lit("")).alias("triage"), _whole("a_volume").alias("a_volume"), _whole("b_volume").alias("b_volume"), F.coalesce("reason", F.lit("")).alias("reason"),
    )


def audit_rows(study: DataFrame, floor: float = 0.0) -> DataFrame:
    """The audit's eighteen columns, widest gap first."""
    rows = study.orderBy(F.desc("gap"), "a_id", "b_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    passed = (F.coalesce("a_volume", F.lit(0.0)) > floor) & (F.coalesce("b_volume", F.lit(0.0)) > floor)
    return rows.select(
        text("a_id"), text("b_id"), F.col("a_title").alias("a_question"), F.col("b_title").alias("b_question"), _fixed("a_price").alias("a_yes"), _fixed("b_price").alias("b_yes"), F.coalesce("yes_aligned", F.lit(True)).alias("yes_aligned"), _fixed("gap").alias("normalized_gap"),
        "priceable", F.lit(True).alias("same_event"), F.col("same_criteria").alias("same_contract"), text("stage"), text("triage_label"), F.coalesce("reason", F.lit("")).alias("triage_reason"), text("category"),
        _whole("a_volume").alias("a_volume"), _whole("b_volume").alias("b_volume"), passed.alias("liquidity_floor_passed"),
    )


def export_summary(summary: DataFrame, path: str) -> None:
    """A one-row table as a JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def request_lines(requests: DataFrame, model: str = "m1", system: str = "match") -> DataFrame:
    """One JSON line per request."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.col("user"))).alias("messages"), F.lit(160).alias("max_tokens"))
    return requests.select(*[c for c in requests.columns if c == "chunk"], F.to_json(F.struct(F.col("key").alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


def write_requests(lines: DataFrame, path: str) -> None:
    writer = lines.write.mode("overwrite")
    (writer.partitionBy("chunk") if "chunk" in lines.columns else writer).text(path)
