"""Nested and textual inputs as typed columns; what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import text as T

SNAPSHOT = "struct<question:string, outcomes:array<string>, prices:map<string,double>, ask_prices:map<string,double>, bid_prices:map<string,double>, liquidity:map<string,double>, volume:double>"
VERDICT = "struct<match_index:double, same_event:boolean, same_criteria:boolean, yes_aligned:boolean, reason:string>"


def parse_snapshots(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the fields of a JSON snapshot; rows whose text is no snapshot go."""
    parsed = F.from_json(F.col(column), SNAPSHOT, {"mode": "PERMISSIVE"})
    kept = rows.withColumn("parsed", parsed).where("parsed.prices is not null")
    return kept.select(*rows.columns, "parsed.*")


def parse_verdict(raw: Column, candidates: Column) -> Column:
    """A model's reply against its candidates' ids; null if it is no JSON object. Flags
    need a candidate in range, alignment holds unless denied. A reply is parsed once."""

    def verdict(parsed: Column) -> Column:
        # a reply that reads in full is JSON; others are looked at again
        readable = parsed.isNotNull() & (parsed["_unread"].isNull() | F.get_json_object(raw, "$").isNotNull())
        at = parsed["match_index"]
        chosen = F.when((at >= 0) & (at < F.size(candidates)) & (at == F.floor(at)), F.try_element_at(candidates, (at + 1).cast("int")))
        return F.when(readable, T.let(F.struct(chosen.alias("id"), parsed.alias("of")), fields))

    def fields(x: Column) -> Column:
        fits, parsed = x["id"].isNotNull(), x["of"]
        return F.struct(
            x["id"].alias("matched_b_id"), (fits & F.coalesce(parsed["same_event"], F.lit(False))).alias("same_event"), (fits & F.coalesce(parsed["same_criteria"], F.lit(False))).alias("same_criteria"),
            F.coalesce(parsed["yes_aligned"], F.lit(True)).alias("yes_aligned"), F.substring(F.coalesce(parsed["reason"], F.lit("")), 1, 120).alias("reason"),
        )

    return T.let(F.from_json(raw, VERDICT[:-1] + ", _unread:string>", {"columnNameOfCorruptRecord": "_unread"}), verdict)


def settlement_criteria(listings: DataFrame) -> DataFrame:
    """Rule texts, type, resolution day, source and keywords of each listing.

    Venue A's rules are one text whose first line is the primary rule; its source is a phrase
    there. Venue B's are the primary and ``rules_secondary``; its source is a phrase of the
    primary, else the host of ``source_url``. The day is the listing's own or else the latest
    one written in its rules.
    """
    optional = {c: F.col(c) if c in listings.columns else F.lit(None).cast("string") for c in ("rules_secondary", "source_url", "market_type")}
    rows = listings.withColumns(optional)
    b = F.col("platform") == "venue_b"
    first = F.split_part("rules", F.lit("\n"), F.lit(1))
    primary = F.when(b, F.col("rules")).otherwise(first)
    source = F.when(b, F.coalesce(T.data_source(F.col("rules"), T.SOURCE_PHRASES_B), T.host_of(F.col("source_url")))).otherwise(T.data_source(F.col("rules"), T.SOURCE_PHRASES_A))
    kind = F.when(F.col("market_type") == "scalar", "scalar").when(F.col("n_outcomes") > 2, "categorical").otherwise("binary")
    written = T.latest_date(F.concat_ws(" ", "rules", "rules_secondary"))
    return rows.select(
        "platform", "id", "question", primary.alias("primary_rule"), F.when(b, F.col("rules_secondary")).alias("secondary_rule"), F.coalesce(F.col("close_day"), F.unix_date(written).cast("long")).alias("resolution_day"),
        kind.alias("settlement_type"), source.alias("data_source"), T.keywords(primary, T.RULE_STOP, " ").alias("keywords"), F.when(b, T.entities(F.col("rules"), T.STARTERS_B)).otherwise(T.entities(F.col("rules"))).alias("entities"),
    )
