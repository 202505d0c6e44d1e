"""Raw listings, forecasts, books and pages as typed tables.

Raw fields arrive as strings, arrays or JSON text; each reader takes an explicit schema and
turns what it cannot read into null or the stated default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_A = "id string, conditionId string, question string, outcomes string, outcomePrices string, tokens array<struct<outcome:string, price:string>>, endDate string, startDate string, volume string, liquidity string, active boolean, closed boolean, category string"
_CHILD = "struct<ticker:string, title:string, yes_sub_title:string, status:string, yes_ask_dollars:string, yes_bid_dollars:string, last_price_dollars:string, volume_fp:string, open_interest_fp:string, liquidity_dollars:string, mve_collection_ticker:string, mve_selected_legs:array<string>>"
RAW_B = f"event struct<event_ticker:string, title:string, sub_title:string, category:string, mutually_exclusive:boolean>, markets array<{_CHILD}>"
RAW_POST = "created_at string, question struct<id:bigint, title:string, description:string, type:string, status:string, scheduled_resolve_time:string, aggregations:struct<recency_weighted:struct<latest:struct<centers:array<double>, end_time:double>>>>"


def number(c: Column) -> Column:
    return c.try_cast("double")


def normalize_venue_a(raw: DataFrame) -> DataFrame:
    """Open, priced listings. Outcomes come from tokens, a JSON list, a comma list, or are
    Yes and No; a price that is missing is 0, unreadable prices are one half each."""
    listed = F.from_json("outcomes", "array<string>")
    comma = F.transform(F.split("outcomes", ","), F.trim)
    has_tokens = F.coalesce(F.size("tokens") > 0, F.lit(False))
    outcomes = F.when(has_tokens, F.transform("tokens", lambda t: t["outcome"])).when(listed.isNotNull() & (F.size(listed) > 0), listed).when(F.col("outcomes").isNotNull(), comma).otherwise(F.array(F.lit("Yes"), F.lit("No")))
    rows = raw.withColumns({"names": outcomes, "listed_prices": F.from_json("outcomePrices", "array<string>")})
    at = lambda i: F.coalesce(number(F.try_element_at("listed_prices", i + 1)), F.lit(0.0))
    prices = (
        F.when(F.col("tokens").isNotNull(), F.transform("tokens", lambda t: F.coalesce(number(t["price"]), F.lit(0.0))))
        .when(F.col("outcomePrices").isNull(), F.array().cast("array<double>")).when(F.col("listed_prices").isNull(), F.transform("names", lambda _: F.lit(0.5))).otherwise(F.transform("names", lambda _, i: at(i)))
    )
    rows = rows.withColumn("values", prices).where(F.coalesce("active", F.lit(True)) & ~F.coalesce("closed", F.lit(False)))
    ident = F.coalesce(F.nullif("conditionId", F.lit("")), F.nullif("id", F.lit("")))
    close = F.coalesce(F.nullif("endDate", F.lit("")), F.nullif("startDate", F.lit("")))
    out = rows.select(
        ident.alias("id"), F.lit("venue_a").alias("platform"), "question", F.col("names").alias("outcomes"), F.map_from_entries(F.arrays_zip(F.slice("names", F.lit(1), F.size("values")).alias("k"), F.col("values").alias("v"))).alias("prices"),
        F.try_to_timestamp(close).alias("close_ts"), number(F.col("volume")).alias("volume"), number(F.col("liquidity")).alias("liquidity"), "category",
    )
    return out.where("id is not null AND size(prices) > 0")


def children(events: DataFrame) -> DataFrame:
    return events.select("event", F.size("markets").alias("n"), F.explode("markets").alias("m")).where(F.col("m.status").isin("active", "open"))


def composite(m: str = "m") -> Column:
    """Contracts of several legs."""
    return F.col(f"{m}.ticker").rlike("(?i)KXMVE") | F.coalesce(F.col(f"{m}.mve_collection_ticker") != "", F.lit(False)) | F.coalesce(F.size(f"{m}.mve_selected_legs") > 0, F.lit(False))


def unpriced(m: str = "m") -> Column:
    text = F.concat_ws("", *(F.col(f"{m}.{c}") for c in ("yes_ask_dollars", "last_price_dollars", "yes_bid_dollars")))
    return text == ""


def exclusion(m: str = "m") -> Column:
    return F.when(composite(m), "composite").when(unpriced(m), "unpriced").otherwise("kept")


def normalize_venue_b(events: DataFrame) -> DataFrame:
    """Each standalone child market of an event; ask, else last, else one half."""
    rows = children(events).where(exclusion() == "kept")
    ask, last = number(F.col("m.yes_ask_dollars")), number(F.col("m.last_price_dollars"))
    yes = F.when(ask > 0, ask).when(last > 0, last).otherwise(0.5)
    title = F.when(F.coalesce("event.mutually_exclusive", F.lit(False)) & (F.col("n") > 1), F.concat_ws(" — ", "event.title", F.coalesce(F.nullif("m.yes_sub_title", F.lit("")), "m.title")))
    sub = F.nullif("event.sub_title", F.lit(""))
    title = title.otherwise(F.concat(F.col("event.title"), F.coalesce(F.concat(F.lit(" ("), sub, F.lit(")")), F.lit(""))))
    dollars = number(F.col("m.liquidity_dollars"))
    liquidity = F.when(dollars > 0, dollars).otherwise(F.coalesce(number(F.col("m.open_interest_fp")), F.lit(0.0)) * yes)
    return rows.select(
        F.col("m.ticker").alias("id"), F.lit("venue_b").alias("platform"), title.alias("question"), F.create_map(F.lit("Yes"), yes, F.lit("No"), 1 - yes).alias("prices"), yes.alias("yes"),
        (F.coalesce(number(F.col("m.volume_fp")), F.lit(0.0)) * yes).alias("volume"), liquidity.alias("liquidity"), F.col("event.category").alias("category"), F.col("event.event_ticker").alias("event_id"),
    )


def composite_share(events: DataFrame) -> DataFrame:
    return events.select(F.explode("markets").alias("m")).agg(F.count("*").alias("n"), F.round(F.avg(composite().cast("int")), 6).alias("share"))


def ingest_stats(events: DataFrame, samples: int = 8) -> DataFrame:
    """Rows by reason with a few ids of each, the least."""
    rows = children(events).select(exclusion().alias("reason"), F.col("m.ticker").alias("id"))
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("reason").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= samples).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason")


def normalize_forecasts(posts: DataFrame) -> DataFrame:
    """Questions of supported types with their central prediction."""
    kinds = ["binary", "numeric", "multiple_choice", "date"]
    q, latest = F.col("question"), F.col("question.aggregations.recency_weighted.latest")
    stamp = F.coalesce(F.timestamp_seconds(latest["end_time"]), F.try_to_timestamp("created_at"))
    q2 = F.try_element_at(latest["centers"], F.lit(1))
    return posts.where(q.isNotNull() & q["type"].isin(kinds)).select(
        q["id"].alias("id"), q["title"].alias("title"), F.coalesce(q["description"], F.lit("")).alias("description"), q["type"].alias("type"), q["status"].alias("status"),
        F.try_to_timestamp(q["scheduled_resolve_time"]).alias("resolve_ts"), q2.alias("q2"), F.when(q2.isNotNull(), stamp).alias("prediction_ts"),
    )


def book_depth(books: DataFrame, venue: str, levels: int = 5) -> DataFrame:
    """Best prices and the depth of the first levels of ``bids`` and ``asks``."""
    if venue == "venue_b":
        cents = lambda side: F.transform(side, lambda x: F.struct((x["price"] / 100).alias("price"), x["size"].alias("size")))
        depth = lambda side: F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda a, x: a + x["size"])
        rows = books.withColumns({"bids": cents("bids"), "asks": cents("asks")})
        return rows.withColumn("depth", depth("bids") + depth("asks"))
    down = F.reverse(F.array_sort("bids"))
    rows = books.withColumns({"bids": down, "asks": F.array_sort("asks")})
    worth = lambda side, f: F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda a, x: a + x["size"] * f(x["price"]))
    return rows.withColumn("depth", worth("bids", lambda p: p) + worth("asks", lambda p: 1 - p))


def snapshot_from_books(books: DataFrame, levels: int = 3, least: float = 500) -> DataFrame:
    """A market's best ask and bid per outcome over its mid, with outcome liquidity the
    lesser of both sides' first levels; without a book, or in a market of under ``least``
    liquidity, an even share."""
    deep = F.col("liquidity_total") >= least
    none = lambda c: F.when(deep, F.col(c)).otherwise(F.array().cast(books.schema[c].dataType))
    books = books.withColumns({"asks": none("asks"), "bids": none("bids")})
    notional = lambda side: F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda a, x: a + x["size"] * x["price"])
    rows = books.withColumns({"best_ask": F.array_min(F.transform("asks", lambda x: x["price"])), "best_bid": F.array_max(F.transform("bids", lambda x: x["price"]))})
    thin = F.when(F.size("asks") > 0, F.least(notional(F.array_sort("asks")), notional(F.reverse(F.array_sort("bids"))))).otherwise(F.col("liquidity_total") / F.col("n_outcomes"))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", c))))
    rows = rows.withColumns({"ask": F.coalesce("best_ask", "mid"), "bid": F.coalesce("best_bid", "mid"), "own": thin})
    return rows.groupBy("market_id").agg(entry("ask").alias("ask_prices"), entry("bid").alias("bid_prices"), entry("own").alias("liquidity_by_outcome"))


def judged_replies(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """``key, value, v, error`` of every reply line: its verdict, or why it is none. Nothing is coerced."""
    from keelson.sources.parsing import parse_verdict

    kind = "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
    parsed = lines.select("value", F.from_json("value", kind).alias("x"))
    rows = parsed.select("value", F.col("x.custom_id").alias("key"), F.try_element_at("x.response.body.choices", F.lit(1))["message"]["content"].alias("content"))
    joined = rows.join(requests.select("key", "candidate_ids"), "key", "left").withColumn("v", parse_verdict(F.col("content"), F.coalesce("candidate_ids", F.array().cast("array<string>"))))
    why = F.when(F.col("key").isNull(), "unreadable line").when(F.col("candidate_ids").isNull(), "unknown id").when(F.col("content").isNull(), "no content").when(F.col("v").isNull(), "unreadable verdict")
    return joined.withColumn("error", why).select("key", "value", "v", "error")


def import_verdicts(lines: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reply lines as verdicts, and as errors what cannot be one."""
    marked = judged_replies(lines, requests)
    return marked.where("error is null").select("key", "v.*"), marked.where("error is not null").select("key", "value", "error")


def _plain(c: Column) -> Column:
    for old, new in (("<[^>]+>", ""), ("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), (r"\s+", " ")):
        c = F.regexp_replace(c, old, new)
    return F.trim(c)


def anchors(html: Column) -> Column:
    """The anchors of a page in order: ``tag`` (their attributes), ``href``, ``text``, and ``after``, the page from
    there to the next anchor. A page is cut at its anchors once."""
    piece = lambda p: F.named_struct(F.lit("tag"), F.regexp_extract(p, r"^([^>]*)", 1), F.lit("href"), F.regexp_extract(p, r'^[^>]*?href="([^">]*)"', 1), F.lit("text"), F.regexp_extract(p, r"^[^>]*>([\s\S]*?)</a>", 1), F.lit("after"), F.regexp_extract(p, r"</a>([\s\S]*)$", 1))
    return F.transform(F.filter(F.split(html, r"<a\b", -1), lambda _, i: i > 0), piece)


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, i, href, title, excerpt`` of every anchor of ``pages(page_id, html)``; the excerpt is the text that
    follows it before the next."""
    rows = pages.select("page_id", F.posexplode(anchors(F.col("html"))).alias("i", "x"))
    return rows.select("page_id", F.col("i").cast("long").alias("i"), "x.href", _plain(F.col("x.text")).alias("title"), _plain(F.col("x.after")).alias("excerpt"))


def extract_sources(pages: DataFrame, limit: int = 5) -> DataFrame:
    """Titles, urls and snippets of a stored result page in order, the first ``limit``. A
    result's snippet is the anchor that comes next after it, if that is one."""

    def url(h: Column) -> Column:
        target = F.regexp_extract(h, r"[?&]uddg=([^&]+)", 1)
        return F.when(target != "", F.try_url_decode(target)).when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h)

    is_ = lambda x, name: F.contains(x["tag"], F.lit(f'class="{name}"'))
    found = F.transform(F.col("a"), lambda x, i: F.named_struct(F.lit("own"), is_(x, "result__a"), F.lit("url"), url(x["href"]), F.lit("title"), _plain(x["text"]), F.lit("excerpt"), F.coalesce(F.when(is_(F.get("a", i + 1), "result__snippet"), _plain(F.get("a", i + 1)["text"])), F.lit(""))))
    rows = F.filter(found, lambda x: x["own"] & (x["title"] != "") & x["url"].startswith("http"))
    out = pages.withColumn("a", anchors(F.col("html"))).select("page_id", F.posexplode(F.slice(rows, 1, limit)).alias("i", "x"))
    return out.select("page_id", F.col("i").cast("long").alias("i"), "x.title", "x.url", "x.excerpt", F.greatest(F.lit(0.3), 0.7 - F.col("i") * 0.08).alias("confidence"))
