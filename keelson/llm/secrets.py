"""Secret scans through an incremental blob ledger, in DataFrame expressions only.

Every version of every path is named by the SHA-256 of its content. The ledger holds the
(blob, rule set) pairs scanned so far with their findings; a run scans only the pairs it
has not seen, one copy of each blob, and joins the findings back to all versions and paths
by blob. A changed rule set is a new version of the rules and is scanned anew.

A rule is a pattern with a least length of the match or of a group in it. Positions come
from splitting the text at the pattern: the pieces before the matches and the matches
themselves add up to code point offsets.

Defined cases: null content is an empty blob; equal contents share one blob and are scanned
once, whatever their number; rows that repeat give equal results; paths may be null; very
long texts are searched whole; of ``docs`` further columns aren't read, and pass through
``redact``.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import cut


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A stricter pattern that every text with a finding matches; most texts end there.
    screen: str
    #: Group whose length counts, 0 for the whole match, and its least length.
    group: int
    least: int
    base: bool = True


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
_ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: A private key with its body and END line. Where END is missing, the base64 run goes with
#: its header if it starts as one does (words that follow it on are taken too). Header fields start
#: after a line break (a real or a written one) and end with their line. Repeats are possessive, so
#: nothing is tried twice and no repeat recurses; what follows one never starts as it ends.
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_PEM_BREAK = r"[\x20\t]*+(?:[\r\n]|\\[rn])(?:[\x20\t\r\n]|\\[rn])*+"
_PEM_FIELD = _PEM_BREAK + r"[A-Z][A-Za-z]++-[A-Z][a-z]++:[A-Fa-f0-9A-Z,\x20]*+(?:-[A-Fa-f0-9A-Z,\x20]++)*+"
_PEM_BODY = r"[A-Za-z0-9+/=\x20\t\r\n\\]*+"
_PEM_RUN = rf"[A-Za-z0-9+/=]{{16,}}+{_PEM_BODY}"
_PEM_KEY = rf"{_PEM}(?:(?:{_PEM_FIELD})*+{_PEM_BODY}-----END [A-Z ]*PRIVATE KEY-----|(?:{_PEM_FIELD})++{_PEM_BREAK}{_PEM_RUN}|(?:[\x20\t\r\n]|\\[rn])*+{_PEM_RUN})?"

#: The base rules in their order, then the rules that this scan adds.
RULES = [
    Rule("assign", _ASSIGN, _ASSIGN[:-2] + "{6})", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}", 0, 24),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}", "gh[opsu]_[A-Za-z0-9]{36}", 0, 40, False),
    Rule("pem", _PEM_KEY, _PEM, 0, 1, False),
]


def rules_version(rules: list[Rule] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


#: ``start`` and ``end`` count code points, ``at`` and ``to`` bytes.
_SPAN = "struct<start:bigint,nth:int,end:bigint,kind:string,at:bigint,to:bigint>"
_STEP = "struct<nth:int,pos:int,before:int,chars:int,before_bytes:int,bytes:int,counts:boolean>"


def _steps(text: Column, nth: int, rule: Rule) -> Column:
    """A rule's matches in order: how much text comes before each since the last, how long it
    is, in code points and bytes, and whether it is long enough."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = matches if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pairs = F.zip_with(F.split(text, rule.pattern, -1), F.zip_with(matches, measured, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), lambda p, x: F.struct(p.alias("p"), x["m"].alias("m"), x["v"].alias("v")))
    step = lambda x, i: F.struct(F.lit(nth).alias("nth"), i.alias("pos"), F.length(x["p"]).alias("before"), F.length(x["m"]).alias("chars"), F.octet_length(x["p"]).alias("before_bytes"), F.octet_length(x["m"]).alias("bytes"), (F.length(x["v"]) >= rule.least).alias("counts"))
    # the last piece has no match after it
    found = F.filter(F.transform(pairs, step), lambda x: x["chars"].isNotNull())
    return F.when(text.rlike(rule.screen), found).otherwise(F.array().cast(f"array<{_STEP}>"))


def _spans(stepped: DataFrame, rules: list[Rule]) -> DataFrame:
    """``blob, spans`` of ``stepped(blob, steps)``, by start, then rule: each rule's steps are added up in
    their order, one row each."""
    over = Window.partitionBy("blob", "x.nth").orderBy("x.pos")
    rows = stepped.select("blob", F.explode("steps").alias("x"))
    ends = rows.select("blob", "x.*", F.sum(F.col("x.before") + F.col("x.chars")).over(over).alias("end"), F.sum(F.col("x.before_bytes") + F.col("x.bytes")).over(over).alias("to"))
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("nth") + 1)
    span = F.struct((F.col("end") - F.col("chars")).alias("start"), "nth", "end", kind.alias("kind"), (F.col("to") - F.col("bytes")).alias("at"), "to")
    return ends.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("counts"), span))).cast(f"array<{_SPAN}>").alias("spans"))


def blobs(versions: DataFrame) -> DataFrame:
    """``versions(path, version, content)`` with the content's address as ``blob``."""
    content = F.coalesce("content", F.lit(""))
    return versions.withColumn("content", content).withColumn("blob", F.unhex(F.sha2("content", 256)))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """New ledger rows ``blob, rules, spans`` for the blobs of ``versions`` that ``ledger``
    does not hold under these rules; written to the shared folder.

    Addresses alone are grouped and compared with the ledger; of each unseen blob one
    version's content then meets the scan.
    """
    name = rules_version(rules)
    addressed = blobs(versions)
    unseen = addressed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at")).select("blob", "at.*")
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == name).select("blob"), "blob", "left_anti")
    unseen = unseen.hint("shuffle_hash")
    here = addressed.alias("v").join(unseen.alias("u"), (F.col("v.blob") == F.col("u.blob")) & F.col("v.path").eqNullSafe(F.col("u.path")) & F.col("v.version").eqNullSafe(F.col("u.version")), "left_semi")
    steps = F.concat(*(_steps(F.col("content"), k, r) for k, r in enumerate(rules)))
    stepped = cut(here.select("blob", steps.alias("steps")).dropDuplicates(["blob"]))
    none = stepped.where(F.size("steps") == 0).select("blob", F.array().cast(f"array<{_SPAN}>").alias("spans"))
    found = _spans(stepped.where(F.size("steps") > 0), rules).unionByName(none)
    return cut(found.select("blob", F.lit(name).alias("rules"), "spans"))


def findings_of(versions: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``path, version, blob, spans`` of every version, scanned now or before; blobs with no
    finding are not shuffled with them."""
    found = ledger.where((F.col("rules") == rules_version(rules)) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    listed = blobs(versions).select("path", "version", "blob")
    return listed.join(found, "blob", "left").select("path", "version", "blob", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


LEDGER = f"blob binary, rules string, spans array<{_SPAN}>"


def scan_versions(versions: DataFrame, ledger_path: str | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """Findings of every version. With a ``ledger_path`` only blobs that the ledger there
    does not hold under these rules are scanned, and added to it."""
    if ledger_path is None:
        return findings_of(versions, scan_unseen(versions, rules=rules), rules)
    spark = versions.sparkSession
    try:
        ledger = spark.read.parquet(ledger_path)
    except AnalysisException as e:  # no ledger yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    scan_unseen(versions, ledger, rules).write.mode("append").parquet(ledger_path)
    return findings_of(versions, spark.read.schema(LEDGER).parquet(ledger_path), rules)


def written(spans_: Column) -> Column:
    """Spans as comma-joined kind:start:end."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, ledger_path: str | None = None) -> DataFrame:
    """``doc_id, spans`` of each row of ``docs``, each a path with one version."""
    versions = docs.select(docs[id_col].alias("path"), F.lit(0).alias("version"), docs[text_col].alias("content"))
    return scan_versions(versions, ledger_path, rules).select(F.col("path").alias("doc_id"), "spans")


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every found span of a text replaced by ``mark``; all columns and rows.

    Rows with findings alone meet the replacement; spans that overlap are one.
    """
    text = F.col(text_col)
    versions = docs.select(docs[id_col].alias("path"), F.lit(0).alias("version"), text.alias("content"))
    rows = scan_unseen(versions, rules=rules).select("blob", F.explode("spans").alias("s")).select("blob", "s.at", "s.to")
    before = F.coalesce(F.max("to").over(Window.partitionBy("blob").orderBy("at", "to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what is kept before each span that does not overlap the ones before it, and after the last
    kept = rows.withColumn("from", before).groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("from") <= F.col("at"), F.struct("from", F.col("at").alias("upto"))))).alias("_keelson_kept"), F.max("to").alias("_keelson_last"))
    found = kept.withColumnRenamed("blob", "_keelson_found_blob")
    joined = docs.withColumn("_keelson_own_blob", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))).join(found, F.col("_keelson_own_blob") == F.col("_keelson_found_blob"), "left")

    def cleaned(raw: Column) -> Column:
        piece = lambda start, length: F.substring(raw, (start + 1).cast("int"), length.cast("int")).cast("string")
        pieces = F.transform("_keelson_kept", lambda k: piece(k["from"], k["upto"] - k["from"]))
        return F.array_join(F.concat(pieces, F.array(piece(F.col("_keelson_last"), F.length(raw) - F.col("_keelson_last")))), mark)

    # the text's bytes are taken once, and cut without walking them
    whole = F.element_at(F.transform(F.array(text.cast("binary")), cleaned), 1)
    return joined.withColumn(text_col, F.when(F.col("_keelson_last").isNotNull(), whole).otherwise(text)).select(*docs.columns)


def _sql_spans(nth: int, rule: Rule) -> str:
    pattern = re.sub(r"([*+}])\+", r"\1", rule.pattern).replace("'", "''")  # its engine never tries twice
    screen = rule.screen.replace("'", "''")
    return f"""CASE WHEN regexp_matches(t, '{screen}') THEN list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1),
      lambda i: {{'start': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i-1], lambda x: length(x))), 0),
             'nth': {nth}, 'n': length(regexp_extract_all(t, '{pattern}')[i]), 'v': length(regexp_extract_all(t, '{pattern}', {rule.group})[i]), 'kind': '{rule.kind}'}}), lambda s: s.v >= {rule.least}) ELSE [] END"""


def oracle_sql(rules: list[Rule] = RULES) -> str:
    """The digest query in DuckDB SQL, text by text without a ledger."""
    lists = ",\n  ".join(f"{_sql_spans(k, r)} AS k{k}" for k, r in enumerate(rules))
    base = [k for k, r in enumerate(rules) if r.base]
    show = "list_transform(list_sort({}), lambda s: s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.n AS BIGINT))"
    joined = "k0"
    for k in base[1:]:
        joined = f"list_concat({joined}, k{k})"
    all_ = joined
    for k in [k for k, r in enumerate(rules) if not r.base]:
        all_ = f"list_concat({all_}, k{k})"
    return f"""WITH found AS (SELECT doc_id,
  {lists}
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, CAST(len(k0) AS BIGINT) AS n_assign, CAST(len(k1) AS BIGINT) AS n_access, CAST(len(k2) AS BIGINT) AS n_hex,
  sha256(coalesce(array_to_string({show.format(joined)}, ','), '')) AS base_sha256,
  coalesce(array_to_string({show.format(all_)}, ','), '') AS spans FROM found"""
