"""URL filters by rules and by trust propagated over host links.

Rules name a host and a path; a rule fits the host and its subdomains where the url's path
starts with the rule's, and the longest that fits decides. Pages without a rule get the
verdict of their host.

Host ranks are personalised PageRanks over host edges, normalised so that neither page counts nor
many linkers weigh. ``trust`` is the share of a host's PageRank that comes from hosts with allowed pages: ranks
from those seeds over ranks from all hosts. ``distrust`` goes against the edges from hosts with
blocked pages: the share of the walk from a host, in the PageRank personalised to it, that is spent on
blocked pages; all hosts as seeds would give 1. A host's seed is the share of its pages that a rule
allows or blocks. A host without links keeps its mass. A host is blocked when its distrust is over its trust and
over ``THRESHOLD``: half its walk ends on blocked pages.

Link counts, seeds and ranks are grouped sums; rounds go on until no rank changes by ``SETTLED`` any
more, and are written to the shared folder now and then.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed;
null html has no links; pages that repeat count as often as they stand; very long pages are one
pass of a pattern; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut

DAMPING = 0.85
#: Change of a rank between rounds that counts as none, and rounds after which that is an error; a
#: damping of 0.85 makes any start settle in about 60.
SETTLED = 1e-4
MOST_ROUNDS = 400
#: Rounds between two written tables.
EVERY = 3
THRESHOLD = 0.5


class UrlRule(NamedTuple):
    allow: bool
    host: str
    path: str


#: The rules of the contract.
RULES = [
    UrlRule(True, "com", "/"),
    UrlRule(False, "example.com", "/en/"),
    UrlRule(True, "www.example.com", "/en/"),
    UrlRule(False, "net", "/es/"),
    UrlRule(False, "net", "/fr/"),
]


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest fitting rule as ``struct(rule, allow)``, or null."""
    chosen = None
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.allow).alias("allow"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return F.lit(None).cast("struct<rule:string,allow:boolean>") if chosen is None else chosen


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, w``: the share of a host's outward links that go to each other host."""
    target = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.transform(target, lambda u: lowered(F.regexp_extract(u, "//([^/?#]*)", 1)))).alias("dst"))
    n = found.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w"))


def _rounds(start: DataFrame, values: list[str], step) -> DataFrame:
    """``step`` applied to ``start(host, values...)`` until no value changes."""
    before = now = start
    for k in range(MOST_ROUNDS):
        now = step(now)
        if k % EVERY == EVERY - 1:
            now = cut(now)
            was = before.select("host", *(F.col(v).alias(f"was_{v}") for v in values))
            change = F.greatest(F.lit(0.0), *(F.abs(F.coalesce(v, F.lit(0.0)) - F.coalesce(f"was_{v}", F.lit(0.0))) for v in values))
            if (now.join(was, "host", "full_outer").agg(F.max(change)).first()[0] or 0.0) <= SETTLED:
                return now
            before = now
    raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")


def propagate(seeds: DataFrame, links: DataFrame, values: list[str], damping: float = DAMPING) -> DataFrame:
    """``host, values...``: PageRanks along ``links(src, dst, w)`` from each of the seeds ``seeds(host, values...)``."""
    ends = links.select("src").distinct().withColumn("out", F.lit(True))
    every = lambda f: [f(v).alias(v) for v in values]

    def step(ranks: DataFrame) -> DataFrame:
        moved = ranks.join(links, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(*every(lambda v: F.sum(F.col(v) * F.col("w"))))
        stayed = ranks.join(ends, F.col("host") == F.col("src"), "left").where("out is null").select("host", *values)
        spread = moved.unionByName(stayed).select("host", *every(lambda v: F.col(v) * damping))
        return spread.unionByName(seeds.select("host", *every(lambda v: F.col(v) * (1 - damping)))).groupBy("host").agg(*every(F.sum))

    return _rounds(seeds.select("host", *values), values, step)


def reversed_ranks(seeds: DataFrame, links: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host, rank``: what reaches a host from ``seeds(host, seed)`` against ``links(src, dst, w)``."""
    ends = links.select("src").distinct().withColumn("out", F.lit(True))
    hosts = seeds.select("host", "seed").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("seed"))).groupBy("host").agg(F.max("seed").alias("seed"))
    hosts = cut(hosts.join(ends, F.col("host") == F.col("src"), "left").select("host", "seed", F.col("out").isNotNull().alias("links")))

    def step(ranks: DataFrame) -> DataFrame:
        got = links.join(ranks, F.col("dst") == F.col("host")).groupBy("src").agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        mixed = F.col("seed") * (1 - damping) + F.coalesce("got", F.lit(0.0)) * damping
        return hosts.join(got, F.col("host") == F.col("src"), "left").select("host", F.when(F.col("links"), mixed).otherwise(F.col("seed")).alias("rank"))

    return _rounds(hosts.select("host", F.col("seed").alias("rank")), ["rank"], step)


def judge(pages: DataFrame, rules: list[UrlRule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of each row of ``pages``."""
    host, path = host_path(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    named = named.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    listed = named.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.allow").alias("allow"))

    links = cut(host_links(named))
    share = lambda c: F.count_if(c) / F.count("*")
    hosts = cut(listed.where("host <> ''").groupBy("host").agg(share(F.col("allow")).alias("good"), share(~F.col("allow")).alias("seed"), F.lit(1.0).alias("all")))
    ranks = propagate(hosts, links, ["good", "all"]).select("host", F.coalesce(F.try_divide("good", "all"), F.lit(0.0)).alias("trust"))
    scored = ranks.join(reversed_ranks(hosts, links).withColumnRenamed("rank", "distrust"), "host")
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold)
    allow = F.coalesce("allow", ~blocked, F.lit(True))
    return listed.join(scored, "host", "left").select("page_id", "host", "path", "rule", F.when(allow, "allow").otherwise("block").alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
