"""Prediction-market views of the given tables, in SQL that Spark and DuckDB share.

The tables hold no markets; these views derive them row by row, so a query's work grows
with its table. A view names base tables or other views as ``{name}``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIEWS: dict[str, str] = {
    # price snapshots of two venues: a market for each user
    "snapshots": """
        SELECT CASE WHEN event_id % 2 = 0 THEN 'venue_a' ELSE 'venue_b' END AS platform, concat('m', CAST(user_id AS STRING)) AS market_id, ts,
               ((CAST(FLOOR(value * 100) AS BIGINT) % 98) + 1) / 100 AS yes, value * 40 AS liquidity_total, value * 100 AS volume, event_id
        FROM {events}""",
    # known matches: the market of a user on both venues
    "matches": """
        SELECT concat('m', CAST(user_id AS STRING)) AS a_id, concat('m', CAST(user_id AS STRING)) AS b_id, (4 + user_id % 7) / 10 AS confidence,
               CASE WHEN user_id % 3 = 0 THEN 'semantic' ELSE 'keyword' END AS method, max(ts) AS ts, user_id AS n
        FROM {events} GROUP BY user_id""",
    # listings: title from a document's first line, all text as rules
    "listings": """
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'venue_a' ELSE 'venue_b' END AS platform, concat('d', CAST(doc_id AS STRING)) AS id, doc_id AS ord,
               split_part(text, chr(10), 1) AS question, text AS rules, lang AS category, source,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 30 END AS close_day, 2 + doc_id % 2 * (doc_id % 5) % 2 AS n_outcomes,
               ((doc_id * 37) % 1001) / 1000 AS yes, CAST((doc_id * 7919) % 20000 AS DOUBLE) AS volume, CAST((doc_id * 104729) % 15000 AS DOUBLE) AS liquidity
        FROM {documents}""",
    # study pairs: a pair for each order line
    "pairs": """
        SELECT concat('a', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(FLOOR(l_extendedprice * 100) AS BIGINT) AS STRING)) AS a_id, concat('b', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(CAST(FLOOR(l_extendedprice * 100) AS BIGINT) AS STRING)) AS b_id,
               concat('Will ', CASE l_partkey % 6 WHEN 0 THEN 'any player' WHEN 1 THEN 'the top scorer' WHEN 2 THEN 'team total o/u' WHEN 3 THEN 'one in Orange County' WHEN 4 THEN 'Brazil win the World Cup' ELSE 'Rates' END, ' ', CAST(l_partkey % 50 AS STRING), '?') AS a_title,
               concat(CASE l_suppkey % 6 WHEN 0 THEN 'Goal leader' WHEN 1 THEN 'Awards — lionel messi' WHEN 2 THEN 'first half total' WHEN 3 THEN 'statewide race' WHEN 4 THEN 'Brazil vs. Chile' ELSE 'Rates' END, ' ', CAST(l_suppkey % 50 AS STRING), '?') AS b_title,
               (680 + l_orderkey % 300) / 1000 AS cosine, 1 + (l_orderkey + l_linenumber) % 7 AS match_rank,
               ((l_partkey * 13 + l_linenumber * 7) % 1001) / 1000 AS a_price, ((l_partkey * 13 + l_suppkey * 29 % 260) % 1001) / 1000 AS b_price,
               (l_orderkey + l_linenumber) % 3 <> 0 AS same_criteria, l_orderkey % 5 <> 0 AS yes_aligned,
               CAST((l_partkey * 31) % 30000 AS DOUBLE) AS a_volume, CAST((l_suppkey * 977 + l_orderkey) % 25000 AS DOUBLE) AS b_volume,
               concat(l_returnflag, l_linestatus) AS category, CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN 'confirmed' WHEN l_orderkey % 8 = 2 THEN 'odd_label' ELSE 'scope_mismatch' END AS new_label,
               l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM {lineitem}""",
    # pairs with oriented gaps, stage and label as the study leaves them
    "study": """
        SELECT p.*, abs(a_price - CASE WHEN yes_aligned THEN b_price ELSE 1 - b_price END) AS gap, least(a_volume, b_volume) AS thin,
               a_price > 0.005 AND a_price < 0.995 AND b_price > 0.005 AND b_price < 0.995 AS priceable,
               CASE WHEN NOT same_criteria THEN 'topical_overlap'
                    WHEN NOT (a_price > 0.005 AND a_price < 0.995 AND b_price > 0.005 AND b_price < 0.995) THEN 'dropped_degenerate'
                    WHEN abs(a_price - CASE WHEN yes_aligned THEN b_price ELSE 1 - b_price END) <= 0.09 THEN 'validated_same_contract'
                    WHEN new_label = 'confirmed' THEN 'semantic_survivor'
                    WHEN new_label = 'scope_mismatch' THEN 'scope_mismatch' ELSE 'needs_manual_review' END AS triage_label
        FROM {pairs} p""",
    # the seven-point checklist of survivors, from a model elsewhere
    "checklists": """
        SELECT a_id, b_id, concat('{{"same_event":', CASE WHEN l_orderkey % 13 <> 0 THEN 'true' ELSE 'false' END, ',"same_entity":true,"same_window":', CASE WHEN l_orderkey % 7 <> 0 THEN 'true' ELSE 'false' END,
               ',"same_line":true,"same_settlement":', CASE WHEN l_suppkey % 9 <> 0 THEN 'true' ELSE 'false' END, ',"same_direction":true,"same_structure":true}}') AS checklist,
               CASE WHEN l_suppkey % 9 = 0 THEN 'settlement' WHEN l_orderkey % 7 = 0 THEN 'window' ELSE '' END AS reason
        FROM {study} WHERE triage_label = 'semantic_survivor' AND l_orderkey % 10 <> 9""",
    # strict audit rows and corrections, as inputs of the read models
    "strict": """
        SELECT a_id, b_id, thin, l_orderkey % 13 <> 0 AND l_orderkey % 7 <> 0 AND l_suppkey % 9 <> 0 AS spec_match,
               CASE WHEN l_suppkey % 9 = 0 THEN 'settlement' WHEN l_orderkey % 7 = 0 THEN 'window' ELSE '' END AS mismatch_reason,
               CASE WHEN thin > 10000 THEN '>10k' WHEN thin > 5000 THEN '>5k' WHEN thin > 1000 THEN '>1k' WHEN thin > 500 THEN '>500' ELSE '<=500' END AS tier
        FROM {study} WHERE triage_label = 'semantic_survivor' AND thin > 500""",
    "corrections": """
        SELECT a_id, b_id, triage_label AS original_verdict, 'spec_mismatch' AS corrected_verdict, CASE WHEN l_orderkey % 2 = 0 THEN 'strict_reverify' ELSE 'deterministic_rule' END AS correction_source,
               'window' AS correction_reason FROM {study} WHERE triage_label IN ('semantic_survivor', 'validated_same_contract') AND l_orderkey % 6 = 1""",
    # outcome books: the lines of an order are the outcomes of one market
    "outcomes": """
        SELECT concat('o', CAST(l.l_orderkey AS STRING)) AS market_id, CASE WHEN l.l_orderkey % 2 = 0 THEN 'venue_a' ELSE 'venue_b' END AS platform, l.l_linenumber AS outcome, o.o_orderdate AS ts,
               (l.l_extendedprice / t.total) * (0.9313 + l.l_discount) AS ask, (l.l_extendedprice / t.total) * (0.9 + l.l_discount) * (1.1 - l.l_tax) AS bid, l.l_quantity * 150 AS liquidity
        FROM {lineitem} l JOIN (SELECT l_orderkey AS k, sum(l_extendedprice) AS total, count(DISTINCT l_linenumber) AS kinds, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) t ON l.l_orderkey = t.k AND t.kinds = t.n
        JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    # own forecasts
    "forecasts": """
        SELECT event_id AS id, concat('m', CAST(user_id AS STRING)) AS market_id, CASE WHEN event_id % 2 = 0 THEN 'venue_a' ELSE 'venue_b' END AS platform, event_type AS category,
               ((CAST(FLOOR(value * 100) AS BIGINT) % 104) - 1) / 100 AS probability, event_type <> 'error' AS resolved, CASE WHEN event_type IN ('purchase', 'signup') OR user_id % 3 = 0 THEN 1 ELSE 0 END AS outcome, ts
        FROM {events}""",
    # scored opportunities as stored
    "opportunities": """
        SELECT concat('x', CAST(event_id AS STRING)) AS id, CASE user_id % 4 WHEN 0 THEN 'multi_outcome' WHEN 1 THEN 'correlated' WHEN 2 THEN 'cross_platform' ELSE 'divergence' END AS type,
               CASE WHEN event_id % 2 = 0 THEN 'venue_a' ELSE 'venue_b' END AS platform, concat('m', CAST(user_id AS STRING)) AS market_id, ts,
               ((CAST(FLOOR(value * 100) AS BIGINT) % 300) - 10) / 1000 AS net_edge, ((event_id * 7) % 101) / 100 AS detector_confidence, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ((event_id * 3) % 101) / 100 END AS match_confidence,
               value * 300 AS min_liquidity, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 70) - 3 END AS days_left, 1 + (event_id % 90) / 10 AS score, event_id
        FROM {events}""",
    # questions of a forecast source
    "questions": """
        SELECT item_id AS id, text AS title, CASE WHEN item_id % 6 = 5 THEN 'numeric' ELSE 'binary' END AS type, item_id % 30 AS resolve_day,
               CASE WHEN item_id % 7 = 6 THEN NULL ELSE ((item_id * 53) % 99 + 1) / 100 END AS q2, item_id % 50 AS age_days FROM {benchmark}""",
    # verdict requests and cached verdicts
    "verdicts": """
        SELECT concat('k', CAST(l_orderkey AS STRING)) AS k, l_orderkey % 3 <> 0 AS same_event, CASE WHEN l_orderkey % 2 = 0 THEN 'p1' ELSE 'p2' END AS provider, CASE WHEN l_orderkey % 5 = 0 THEN 'm2' ELSE 'm1' END AS model,
               1 + l_orderkey % 6 AS picked FROM (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_orderkey % 8 <> 7) q""",
    # results of settlement comparisons
    "comparisons": """
        SELECT concat('a', CAST(o_orderkey AS STRING)) AS a_id, concat('b', CAST(o_custkey AS STRING)) AS b_id, ((o_orderkey * 17) % 101) / 100 AS overall, o_orderkey % 3 <> 0 AS safe, o_orderdate AS ts,
               CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 7 = 0 THEN 'diverged' ELSE 'same' END AS outcome, CASE WHEN o_orderkey % 10 = 0 THEN 'note' ELSE NULL END AS notes, o_orderkey, o_custkey
        FROM {orders}""",
}

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs(VIEWS[name])})


def forecast_pairs(listings: DataFrame, questions: DataFrame) -> DataFrame:
    """Each listing with one of all questions in turn, for the given tables name no pairs."""
    n = questions.agg(F.count("*").alias("n_q"))
    numbered = questions.select("q2", "age_days", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("nth"))
    dealt = listings.crossJoin(F.broadcast(n)).withColumn("nth", F.col("ord") % F.col("n_q")).drop("n_q")
    return dealt.join(numbered, "nth").withColumns({"market_id": F.col("id"), "confidence": F.lit(0.9)})


def with_views(sql: str) -> str:
    """DuckDB SQL: ``sql`` with a WITH clause of the views it names as ``{name}``."""
    found: dict[str, str] = {}

    def add(text: str) -> str:
        for n in needs(text):
            if n in VIEWS and n not in found:
                found[n] = add(VIEWS[n])
        return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")

    body = add(sql)
    if not found:
        return body
    clause = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in found.items())
    if re.match(r"\s*WITH\s+RECURSIVE", body, re.I):
        return re.sub(r"^\s*WITH\s+RECURSIVE", f"WITH RECURSIVE {clause},", body, count=1, flags=re.I)
    if re.match(r"\s*WITH\b", body, re.I):
        return re.sub(r"^\s*WITH", f"WITH {clause},", body, count=1, flags=re.I)
    return f"WITH {clause} {body}"
