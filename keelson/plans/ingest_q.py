"""Queries of readers, sinks and streams; raw inputs are written out from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import detect, history, study
from keelson.plans.fixtures import forecast_pairs, view
from keelson.plans.functions_q import SCORE_SQL
from keelson.plans.history_q import AS_OF, CANDLES, UNIFIED
from keelson.plans.registry import ORACLES, QUERIES, query, with_views
from keelson.sources import ingest, scratch, sinks
from keelson.streaming import jobs


def _raw_a(x: DataFrame) -> DataFrame:
    """Listings as a venue's JSON: outcomes as list, text or tokens, numbers as text."""
    y = F.col("yes").cast("string")
    n = (1 - F.col("yes")).cast("string")
    tokens = F.when(F.col("ord") % 5 == 4, F.array(F.struct(F.lit("Yes").alias("outcome"), y.alias("price")), F.struct(F.lit("No").alias("outcome"), F.lit(None).cast("string").alias("price"))))
    return x.select(
        F.when(F.col("ord") % 6 != 0, F.col("id")).alias("id"), F.when(F.col("ord") % 3 == 0, F.concat(F.lit("c"), F.col("id"))).alias("conditionId"), "question",
        F.expr("CASE ord % 5 WHEN 0 THEN '[\"Yes\",\"No\"]' WHEN 1 THEN 'Yes, No' WHEN 2 THEN NULL ELSE '[\"No\",\"Yes\"]' END").alias("outcomes"),
        F.when(F.col("ord") % 7 == 0, F.lit("not json")).when(F.col("ord") % 11 != 3, F.concat(F.lit('["'), y, F.lit('","'), n, F.lit('"]'))).alias("outcomePrices"), tokens.alias("tokens"),
        F.expr("CASE WHEN ord % 4 = 1 THEN '' ELSE concat('2026-01-', lpad(CAST(1 + ord % 28 AS STRING), 2, '0'), 'T00:00:00Z') END").alias("endDate"), F.lit("2025-12-31T00:00:00Z").alias("startDate"),
        F.when(F.col("ord") % 8 != 2, F.col("volume").cast("string")).alias("volume"), F.col("liquidity").cast("string").alias("liquidity"), (F.col("ord") % 9 != 5).alias("active"), (F.col("ord") % 10 == 6).alias("closed"), "category",
    )


@query("src1_normalize_venue_a", "listings", sql="""SELECT CASE WHEN ord % 3 = 0 THEN 'c' || id ELSE id END AS id, round(CASE WHEN ord % 5 = 4 THEN yes WHEN ord % 7 = 0 THEN 0.5 WHEN ord % 5 = 3 THEN 1 - yes ELSE yes END, 6) AS yes, CASE WHEN ord % 4 = 1 THEN '2025-12-31' ELSE concat('2026-01-', lpad(CAST(1 + ord % 28 AS STRING), 2, '0')) END AS closes, CASE WHEN ord % 8 <> 2 THEN volume END AS volume
    FROM {listings} WHERE ord % 9 <> 5 AND ord % 10 <> 6 AND (ord % 6 <> 0 OR ord % 3 = 0) AND (ord % 5 = 4 OR ord % 7 = 0 OR ord % 11 <> 3)""")
def src1(x: DataFrame) -> DataFrame:
    return ingest.normalize_venue_a(_raw_a(x)).select("id", F.round(F.try_element_at("prices", F.lit("Yes")), 6).alias("yes"), F.col("close_ts").cast("date").cast("string").alias("closes"), "volume")


def _events_b(p: DataFrame) -> DataFrame:
    """Order lines as the child markets of one event per order."""
    text = lambda e: F.expr(e).cast("string")
    child = F.struct(
        F.concat(F.expr("CASE WHEN l_partkey % 13 = 0 THEN 'kxmve-' ELSE 'T-' END"), "a_id").alias("ticker"), F.col("a_title").alias("title"), F.col("category").alias("yes_sub_title"), F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'active' END").alias("status"),
        F.when(F.col("l_partkey") % 5 != 0, text("a_price")).otherwise("").alias("yes_ask_dollars"), F.lit("").alias("yes_bid_dollars"), F.when(F.col("l_partkey") % 10 == 0, text("b_price")).alias("last_price_dollars"),
        text("a_volume").alias("volume_fp"), text("b_volume").alias("open_interest_fp"), F.when(F.col("l_suppkey") % 2 == 0, text("b_volume")).alias("liquidity_dollars"), F.lit(None).cast("string").alias("mve_collection_ticker"), F.when(F.col("l_partkey") % 17 == 0, F.array(F.lit("leg"))).alias("mve_selected_legs"),
    )
    # dealt as rows: lists of each task's own rows, joined later, would be no smaller
    by = p.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(child).alias("markets"))
    k = F.col("l_orderkey")
    event = F.struct(k.cast("string").alias("event_ticker"), F.concat(F.lit("Event "), k.cast("string")).alias("title"), F.when(k % 2 == 0, F.lit("sub")).alias("sub_title"), F.lit("cat").alias("category"), (k % 3 == 0).alias("mutually_exclusive"))
    return by.select(event.alias("event"), "markets")


_B = "(SELECT *, concat(CASE WHEN l_partkey % 13 = 0 THEN 'kxmve-' ELSE 'T-' END, a_id) AS ticker, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_partkey % 13 = 0 OR l_partkey % 17 = 0 THEN 'composite' WHEN l_partkey % 5 = 0 AND l_partkey % 10 <> 0 THEN 'unpriced' ELSE 'kept' END AS reason FROM {pairs})"


@query("src2_normalize_venue_b", "pairs", sql=f"""SELECT ticker AS id, concat('Event ', CAST(l_orderkey AS STRING), CASE WHEN l_orderkey % 3 = 0 AND n > 1 THEN ' — ' || category WHEN l_orderkey % 2 = 0 THEN ' (sub)' ELSE '' END) AS question, yes, round(a_volume * yes, 4) AS volume, round(CASE WHEN l_suppkey % 2 = 0 AND b_volume > 0 THEN b_volume ELSE b_volume * yes END, 4) AS liquidity
    FROM (SELECT *, CASE WHEN l_partkey % 5 <> 0 AND a_price > 0 THEN a_price WHEN l_partkey % 10 = 0 AND b_price > 0 THEN b_price ELSE 0.5 END AS yes FROM {_B}) WHERE l_linenumber % 4 <> 0 AND reason = 'kept'""")
def src2(p: DataFrame) -> DataFrame:
    return ingest.normalize_venue_b(_events_b(p)).select("id", "question", "yes", F.round("volume", 4).alias("volume"), F.round("liquidity", 4).alias("liquidity"))


@query("src3_composite_share", "pairs", sql=f"SELECT count(*) AS n, round(avg(CAST(reason = 'composite' AS INT)), 6) AS share FROM {_B}")
def src3(p: DataFrame) -> DataFrame:
    return ingest.composite_share(_events_b(p))


@query("src4_ingest_stats", "pairs", sql=f"SELECT reason, count(*) AS n, array_to_string(list_sort(list(ticker) FILTER (nth <= 8)), ',') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ticker) AS nth FROM {_B} WHERE l_linenumber % 4 <> 0) GROUP BY reason")
def src4(p: DataFrame) -> DataFrame:
    return ingest.ingest_stats(_events_b(p))


@query("src5_forecast_posts", "questions", sql="SELECT id, type, q2, CASE WHEN q2 IS NULL THEN NULL ELSE CASE WHEN id % 3 = 0 THEN CAST(1700000000000000 + id * 1000000 AS BIGINT) ELSE CAST(1704067200000000 AS BIGINT) END END AS predicted_at FROM {questions} WHERE id % 8 <> 5")
def src5(q: DataFrame) -> DataFrame:
    latest = F.struct(F.when(F.col("q2").isNotNull(), F.array("q2")).alias("centers"), F.when(F.col("id") % 3 == 0, (F.col("id") + 1_700_000_000).cast("double")).alias("end_time"))
    own = F.struct("id", "title", F.lit(None).cast("string").alias("description"), "type", F.lit("open").alias("status"), F.lit("2026-02-01T00:00:00Z").alias("scheduled_resolve_time"), F.struct(F.struct(latest.alias("latest")).alias("recency_weighted")).alias("aggregations"))
    posts = q.select(F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.when(F.col("id") % 8 != 5, own).alias("question"))
    return ingest.normalize_forecasts(posts).select("id", "type", "q2", F.unix_micros("prediction_ts").alias("predicted_at"))


def _books(x: DataFrame) -> DataFrame:
    """Outcome rows as order books: the lines of an order are price levels."""
    level = lambda c: F.collect_list(F.struct(F.col(c).alias("price"), F.col("liquidity").alias("size")))
    return x.groupBy("market_id").agg(level("bid").alias("bids"), level("ask").alias("asks"))


@query("src6_book_depth", "outcomes", sql="SELECT market_id, round(sum(bid * liquidity) FILTER (bn <= 5) + sum((1 - ask) * liquidity) FILTER (an <= 5), 4) AS depth, round(max(bid), 6) AS best_bid, round(min(ask), 6) AS best_ask FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY bid DESC, liquidity DESC) AS bn, row_number() OVER (PARTITION BY market_id ORDER BY ask, liquidity) AS an FROM {outcomes}) GROUP BY market_id")
def src6(x: DataFrame) -> DataFrame:
    b = ingest.book_depth(_books(x), "venue_a")
    return b.select("market_id", F.round("depth", 4).alias("depth"), F.round(F.col("bids")[0]["price"], 6).alias("best_bid"), F.round(F.col("asks")[0]["price"], 6).alias("best_ask"))


@query("src7_snapshot_from_books", "outcomes", sql="SELECT market_id, round(sum(CASE WHEN market_id NOT LIKE '%5' AND outcome % 3 <> 0 THEN ask ELSE 0.5 END), 6) AS ask_sum, round(sum(CASE WHEN market_id LIKE '%5' THEN 400.0 / n WHEN outcome % 3 <> 0 THEN least(ask * liquidity, bid * liquidity) ELSE 900.0 / n END), 4) AS liquidity FROM (SELECT *, count(*) OVER (PARTITION BY market_id) AS n FROM {outcomes}) GROUP BY market_id")
def src7(x: DataFrame) -> DataFrame:
    n = x.groupBy("market_id").agg(F.count("*").alias("n_outcomes"))
    own = lambda c: F.when(F.col("outcome") % 3 != 0, F.array(F.struct(F.col(c).alias("price"), F.col("liquidity").alias("size")))).otherwise(F.array().cast("array<struct<price:double,size:double>>"))
    books = x.join(n, "market_id").select("market_id", F.col("outcome").cast("string").alias("outcome"), own("ask").alias("asks"), own("bid").alias("bids"), F.lit(0.5).alias("mid"), F.when(F.col("market_id").endswith("5"), 400.0).otherwise(900.0).alias("liquidity_total"), "n_outcomes")
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda a, v: a + v)
    s = ingest.snapshot_from_books(books)
    return s.select("market_id", F.round(total("ask_prices"), 6).alias("ask_sum"), F.round(total("liquidity_by_outcome"), 4).alias("liquidity"))


def _replies(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = F.concat(F.lit("k"), F.col("a_id"))
    content = F.when(F.col("l_partkey") % 7 == 0, "oops").otherwise(F.concat(F.lit('{"match_index":0,"same_event":true,"same_criteria":'), F.when(F.col("same_criteria"), "true").otherwise("false"), F.lit("}")))
    line = F.to_json(F.struct(key.alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(F.when(F.col("l_partkey") % 5 != 0, content).alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    return p.select(line.alias("value")), p.where("l_partkey % 3 <> 0").select(key.alias("key"), F.array("b_id").alias("candidate_ids"))


@query("src9_import_verdicts", "pairs", sql="SELECT CASE WHEN l_partkey % 3 = 0 THEN 'unknown id' WHEN l_partkey % 5 = 0 THEN 'no content' WHEN l_partkey % 7 = 0 THEN 'unreadable verdict' ELSE 'verdict' END AS kind, count(*) AS n, count(*) FILTER (same_criteria AND l_partkey % 3 <> 0 AND l_partkey % 5 <> 0 AND l_partkey % 7 <> 0) AS same FROM {pairs} GROUP BY 1")
def src9(p: DataFrame) -> DataFrame:
    # both kinds in one pass
    rows = ingest.judged_replies(*_replies(p)).select(F.coalesce("error", F.lit("verdict")).alias("kind"), (F.col("error").isNull() & F.col("v.same_criteria")).alias("same_criteria"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("same_criteria").alias("same"))


_RESULT = """concat('<a class="result__a" href="//r.x/?uddg=https%3A%2F%2Fa.b%2F', CAST(page_id AS STRING), '&k=1"><b>First</b> &amp; ', CAST(page_id AS STRING), '</a><a class="result__snippet">s  one</a><a class="result__a" href="', url, '">Second</a>')"""


@query("src10_extract_sources", "pages", sql="SELECT page_id, 0 AS i, concat('First & ', CAST(page_id AS STRING)) AS title, concat('https://a.b/', CAST(page_id AS STRING)) AS url, 's one' AS excerpt FROM {pages} UNION ALL SELECT page_id, 1, 'Second', url, '' FROM {pages}")
def src10(p: DataFrame) -> DataFrame:
    return ingest.extract_sources(p.withColumn("html", F.expr(f"concat({_RESULT}, html)"))).select("page_id", "i", "title", "url", "excerpt")


_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&quot;', chr(34)), '&#x27;', chr(39)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"


@query("src10_page_links", "pages", sql=f"""SELECT page_id, i, regexp_extract(p, '^[^>]*?href="([^">]*)"', 1) AS href, {_PLAIN.format("regexp_extract(p, '^[^>]*>([\\s\\S]*?)</a>', 1)")} AS title, md5({_PLAIN.format("regexp_extract(p, '</a>([\\s\\S]*)$', 1)")}) AS excerpt
    FROM (SELECT page_id, unnest(ps[2:]) AS p, unnest(range(len(ps) - 1)) AS i FROM (SELECT page_id, string_split_regex(html, '<a\\b') AS ps FROM {{pages}}))""")
def src10_links(p: DataFrame) -> DataFrame:
    """Every anchor of every whole page."""
    return ingest.page_links(p).withColumn("excerpt", F.md5("excerpt"))


@query("snk1_append_snapshots", "snapshots", sql="SELECT event_id FROM {snapshots} WHERE event_id % 3 <> 0")
def snk1(x: DataFrame) -> DataFrame:
    return sinks.append_new(x.unionByName(x.where("event_id % 5 = 1")), x.where("event_id % 3 = 0"), ["platform", "market_id", "ts"]).select("event_id")


@query("snk2_upsert_matches", "matches", sql="SELECT a_id, b_id, CASE WHEN n % 2 = 0 THEN confidence + 1 ELSE confidence END AS confidence FROM {matches}")
def snk2(m: DataFrame) -> DataFrame:
    new = m.where("n % 2 = 0").withColumns({"confidence": F.col("confidence") + 1, "ts": F.expr("ts + INTERVAL 1 HOUR")})
    return sinks.upsert(new, m, ["a_id", "b_id"], "ts").select("a_id", "b_id", "confidence")


@query("snk3_append_opportunities", "opportunities", sql="SELECT id, concat('{{\"net_edge\":', CAST(CAST(net_edge * 1000 AS BIGINT) AS STRING), ',\"type\":\"', type, '\"}}') AS breakdown FROM {opportunities} WHERE event_id % 4 <> 0")
def snk3(x: DataFrame) -> DataFrame:
    fresh = sinks.append_new(x, x.where("event_id % 4 = 0"), ["id", "ts"]).withColumn("net_edge", (F.col("net_edge") * 1000).cast("long"))
    return sinks.as_json(fresh, ["net_edge", "type"]).select("id", "breakdown")


@query("snk4_upsert_settlement", "comparisons", sql="SELECT a_id, b_id, o_orderkey % 4 = 0 OR safe AS manual, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 'checked' ELSE notes END AS notes, CASE WHEN o_orderkey % 2 = 0 THEN overall + 1 ELSE overall END AS overall FROM {comparisons}")
def snk4(c: DataFrame) -> DataFrame:
    old = c.select("a_id", "b_id", "overall", "notes", F.col("safe").alias("manual_override"))
    new = c.where("o_orderkey % 2 = 0").select("a_id", "b_id", (F.col("overall") + 1).alias("overall"))
    over = c.where("o_orderkey % 4 = 0").select("a_id", "b_id", F.lit(True).alias("manual"), F.when(F.col("o_orderkey") % 8 != 0, "checked").alias("notes"))
    return sinks.apply_override(sinks.merge_columns(new, old, ["a_id", "b_id"]), over).select("a_id", "b_id", F.col("manual_override").alias("manual"), "notes", "overall")


@query("snk4_record_outcome", "comparisons", sql="SELECT a_id, b_id, CASE WHEN o_orderkey % 5 = 0 THEN 'diverged' WHEN o_orderkey % 5 = 1 THEN 'matched' ELSE outcome END AS outcome, notes FROM {comparisons}")
def snk4_outcome(c: DataFrame) -> DataFrame:
    known = c.where("o_orderkey % 5 < 2").select("a_id", "b_id", F.when(F.col("o_orderkey") % 5 == 0, "diverged").otherwise("matched").alias("outcome"))
    never = known.limit(1).select(F.lit("nobody").alias("a_id"), "b_id", "outcome")
    stored = c.select("a_id", "b_id", "notes", F.col("outcome").alias("settlement_outcome"))
    return sinks.record_outcome(stored, known.unionByName(never)).select("a_id", "b_id", F.col("settlement_outcome").alias("outcome"), "notes")


_STUDY_REASON = "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('says \"', category, '\", so') END"
_F4 = "printf('%.4f', round(CAST({0} AS DOUBLE), 4))"
_WHOLE = "CAST(floor({0} + 0.5) AS BIGINT)"


def _exported(rows: DataFrame) -> DataFrame:
    return _round_trip(rows, "csv", ", ".join(f"{n} {t}" for n, t in rows.dtypes))


@query("snk6_gap_map_rows", "study", sql=f"SELECT a_id, b_id, a_title AS a_question, b_title AS b_question, {_F4.format('a_price')} AS a_yes, {_F4.format('b_price')} AS b_yes, yes_aligned, {_F4.format('gap')} AS gap, {_F4.format('greatest(0.0, gap - 0.09)')} AS net_after_fees, priceable, {_F4.format('cosine')} AS cosine, same_criteria, coalesce(new_label, '') AS triage, {_WHOLE.format('a_volume')} AS a_volume, {_WHOLE.format('b_volume')} AS b_volume, coalesce({_STUDY_REASON}, '') AS reason FROM {{study}}")
def snk6(s: DataFrame) -> DataFrame:
    return _exported(sinks.gap_map(s.withColumns({"triage": F.col("new_label"), "reason": F.expr(_STUDY_REASON)}))).na.fill("", ["triage", "reason"])


@query("snk6_audit_rows", "study", sql=f"SELECT a_id, b_id, a_title AS a_question, b_title AS b_question, {_F4.format('a_price')} AS a_yes, {_F4.format('b_price')} AS b_yes, yes_aligned, {_F4.format('gap')} AS normalized_gap, priceable, true AS same_event, same_criteria AS same_contract, triage_label AS stage, triage_label, coalesce({_STUDY_REASON}, '') AS triage_reason, category, {_WHOLE.format('a_volume')} AS a_volume, {_WHOLE.format('b_volume')} AS b_volume, a_volume > 0 AND b_volume > 0 AS liquidity_floor_passed FROM {{study}}")
def snk6_audit(s: DataFrame) -> DataFrame:
    rows = s.withColumns({"stage": F.col("triage_label"), "reason": F.expr(_STUDY_REASON)})
    return _exported(sinks.audit_rows(rows)).na.fill("", ["triage_reason"])


_SUMMARY = "candidates long, same_contract long, topical long, priceable long, dropped long, with_candidates long, verified long, universe_a long, universe_b long, tradeable_a long, tradeable_b long, pair_space long, missing_verdicts long, status string"


@query("snk6_summary", "study", sql="""SELECT *, with_candidates - verified AS missing_verdicts, CASE WHEN with_candidates = verified THEN 'complete' ELSE 'partial' END AS status FROM (SELECT count(*) AS candidates, count(DISTINCT a_id) AS with_candidates, count(DISTINCT l_partkey) AS universe_a, count(DISTINCT l_suppkey) AS universe_b, count(DISTINCT l_partkey) * count(DISTINCT l_suppkey) AS pair_space, count(DISTINCT l_partkey) FILTER (a_volume > 0) AS tradeable_a, count(DISTINCT l_suppkey) FILTER (b_volume > 0) AS tradeable_b,
    count(*) FILTER (same_criteria) AS same_contract, count(*) FILTER (NOT same_criteria) AS topical, count(*) FILTER (same_criteria AND priceable) AS priceable, count(*) FILTER (same_criteria AND NOT priceable) AS dropped, count(DISTINCT a_id) AS verified FROM {study})""")
def snk6_summary(s: DataFrame) -> DataFrame:
    path = scratch.folder(s.sparkSession)
    sinks.export_summary(study.summary(s, s.select("a_id"), "l_partkey", "l_suppkey"), path)
    return s.sparkSession.read.schema(_SUMMARY).json(path)


@query("snk7_request_lines", "pairs", sql="SELECT a_id AS key, md5(concat('{{\"custom_id\":\"', a_id, '\",\"method\":\"POST\",\"body\":{{\"model\":\"m1\",\"messages\":[{{\"role\":\"system\",\"content\":\"match\"}},{{\"role\":\"user\",\"content\":\"', category, '\"}}],\"max_tokens\":160}}}}')) AS line FROM {pairs}")
def snk7(p: DataFrame) -> DataFrame:
    lines = sinks.request_lines(p.select(F.col("a_id").alias("key"), F.col("category").alias("user")))
    return lines.select(F.get_json_object("value", "$.custom_id").alias("key"), F.md5("value").alias("line"))


def _round_trip(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    path = scratch.folder(rows.sparkSession)
    sinks.export_csv(rows, path)
    return rows.sparkSession.read.schema(schema).option("header", True).format(kind).load(path)


def _study_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark)
    pairs = view(spark, sf_dir, "study").where("same_criteria AND priceable")
    for run in (1, 2):
        sinks.write_study_run(sinks.study_run(pairs.where(f"{run} = 2 OR l_orderkey % 2 = 0"), view(spark, sf_dir, "listings"), run, 0.09), path)
    return sinks.latest_run(spark, path).select("run_id", "a_id", F.round("fee_adjusted_gap", 6).alias("adjusted"), "surfaced_3pp", "beats_fees_9pp", "meets_detector_19pp")


QUERIES["snk5_study_run"] = _study_run
ORACLES["snk5_study_run"] = with_views("SELECT CAST(2 AS BIGINT) AS run_id, a_id, round(greatest(0.0, gap - CAST(0.09 AS DOUBLE)), 6) AS adjusted, CAST(gap >= 0.03 AS INT) AS surfaced_3pp, CAST(gap > 0.09 AS INT) AS beats_fees_9pp, CAST(gap >= 0.19 AS INT) AS meets_detector_19pp FROM {study} WHERE same_criteria AND priceable")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """A view as a file stream over the shared folder, and a folder for the job."""
    path = scratch.folder(spark)
    rows = view(spark, sf_dir, name)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange("ts").write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


def _st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, path = _stream(spark, sf_dir, "snapshots")
    jobs.ingest(stream, f"{path}/out", f"{path}/cp").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "yes")


def _st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, path = _stream(spark, sf_dir, "snapshots")
    jobs.latest_state(stream, jobs.merge_into(f"{path}/table"), f"{path}/cp").awaitTermination()
    return jobs.newest_version(spark, f"{path}/table").select("platform", "market_id", "yes")


def _st3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row comes after all others; the watermark lets in those that are not over
    half an hour behind."""
    rows = view(spark, sf_dir, "snapshots").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch.folder(spark)
    for late in (False, True):
        rows.where((F.col("event_id") % 10 == 0) == F.lit(late)).write.mode("append").parquet(f"{path}/in")
        jobs.ingest(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/cp").awaitTermination()
    kept = spark.read.parquet(f"{path}/out").select("event_id", F.lit(True).alias("kept"))
    return rows.join(kept, "event_id", "left").groupBy(F.col("kept").isNull().alias("late")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _st3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the stream of ``_st3`` wrote while it ran."""
    rows = view(spark, sf_dir, "snapshots").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch.folder(spark)
    for late in (False, True):
        rows.where((F.col("event_id") % 10 == 0) == F.lit(late)).write.mode("append").parquet(f"{path}/in")
        counted = jobs.LateRows(spark, f"{path}/late", path).watch()
        jobs.ingest(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/cp", path).awaitTermination()
        counted.ended()
    return counted.counts().agg(F.sum("rows").alias("rows_read"), F.sum("late").alias("rows_late"))


def _others(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    table = lambda name: view(spark, sf_dir, name)
    risk = F.when(F.col("n") % 5 == 0, "HIGH").otherwise("LOW")
    pairs = history.asof_pairs(table("matches"), table("snapshots"), F.lit(AS_OF).cast("timestamp"), 2000).withColumn("risk", risk)
    return {"cross": detect.cross_venue(pairs), "forecasts": detect.divergence(forecast_pairs(table("listings"), table("questions")))}


def _st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, path = _stream(spark, sf_dir, "outcomes")
    run = jobs.detect_batch(f"{path}/out", f"{path}/books", lambda s: _others(s, sf_dir))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "type", F.round("total", 6).alias("total"), "position_size")


def _st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that the watermark has passed."""
    stream, path = _stream(spark, sf_dir, "snapshots")
    jobs.daily_candles(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("platform string, market_id string, day timestamp, close double, mean double, n bigint").parquet(f"{path}/out")
    return found.select("platform", "market_id", F.unix_micros("day").alias("day"), "close", F.round("mean", 6).alias("mean"), "n")


_WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 30 MINUTE FROM {0})"
_KELLY = "CASE WHEN net_edge <= 0 OR detector_confidence < 0.1 THEN 0.0 ELSE floor(500 * least(0.10, net_edge * detector_confidence * 0.5) * 100 + 0.5) / 100 END"
QUERIES |= {"st1_ingest_stream": _st1, "st2_latest_state": _st2, "st3_late_rows": _st3, "st3_late_counts": _st3_counts, "st5_detect_stream": _st5, "st6_daily_candles": _st6}
ORACLES |= {
    "st1_ingest_stream": with_views("SELECT event_id, yes FROM {snapshots}"),
    "st2_latest_state": with_views("SELECT platform, market_id, arg_max(yes, (ts, event_id)) AS yes FROM {snapshots} GROUP BY platform, market_id"),
    "st3_late_rows": with_views(f"SELECT event_id % 10 = 0 AND ts <= {_WATERMARK.format('{snapshots} WHERE event_id % 10 <> 0')} AS late, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {{snapshots}} GROUP BY 1"),
    "st3_late_counts": with_views(f"SELECT count(*) AS rows_read, count(*) FILTER (event_id % 10 = 0 AND ts <= {_WATERMARK.format('{snapshots} WHERE event_id % 10 <> 0')}) AS rows_late FROM {{snapshots}}"),
    "st5_detect_stream": with_views(f"SELECT substring(md5(concat_ws(':', type, platform, market_id)), 1, 16) AS id, type, round(CAST({SCORE_SQL} AS DOUBLE), 6) AS total, {_KELLY} AS position_size FROM (SELECT *, CAST(NULL AS DOUBLE) AS days_left FROM {UNIFIED}) WHERE {SCORE_SQL} >= 5"),
    "st6_daily_candles": with_views(f"SELECT platform, market_id, CAST(epoch_us(day) AS BIGINT) AS day, close, round(mean, 6) AS mean, n FROM {CANDLES} WHERE day + INTERVAL 1 DAY <= {_WATERMARK.format('{snapshots}')}"),
}


def _st4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed alert windows of the stream; RocksDB holds the state."""
    stream, path = _stream(spark, sf_dir, "opportunities")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        jobs.dedup_alerts(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    found = spark.read.schema(jobs.ALERTS).parquet(f"{path}/out")
    return found.select("type", "platform", "market_id", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), "best_score", "n")


QUERIES["st4_dedup_stream"] = _st4
# windows that a later row closed, or the watermark
ORACLES["st4_dedup_stream"] = with_views("""WITH RECURSIVE o AS (SELECT type, platform, market_id, epoch_us(ts) // 1000 AS ms, score, row_number() OVER (PARTITION BY type, platform, market_id ORDER BY ts, event_id) AS rn FROM {opportunities}),
    w AS (SELECT type, platform, market_id, rn, ms, ms AS anchor FROM o WHERE rn = 1 UNION ALL SELECT o.type, o.platform, o.market_id, o.rn, o.ms, CASE WHEN o.ms - w.anchor >= 14400000 THEN o.ms ELSE w.anchor END FROM w JOIN o ON o.type = w.type AND o.platform = w.platform AND o.market_id = w.market_id AND o.rn = w.rn + 1)
    SELECT type, platform, market_id, anchor AS first_ms, last_ms, best_score, n FROM (SELECT w.type, w.platform, w.market_id, anchor, max(w.ms) AS last_ms, max(score) AS best_score, count(*) AS n, max(max(w.ms)) OVER (PARTITION BY w.type, w.platform, w.market_id) AS newest FROM w JOIN o USING (type, platform, market_id, rn) GROUP BY w.type, w.platform, w.market_id, anchor)
    WHERE newest > last_ms OR anchor + 14400000 < (SELECT max(ms) FROM o) - 1800000""")
