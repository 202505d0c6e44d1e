"""The registered queries ``opN_<name>``: thin digests of the operators' outputs, each over
the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, centroids, decontaminate, language, packing, quality, secrets, simhash, spelling, suffix_dedup, tokenfile, toxicity, urls
from keelson.llm.common import tables, tune

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(tables(tune(spark), sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(tables(tune(spark), sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.RULES if r.base]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(tables(tune(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(tables(tune(spark), sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return toxicity.toxic_scores(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(tables(tune(spark), sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = decontaminate.find_contamination(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
    listed = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(tables(tune(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(tables(tune(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(tables(tune(spark), sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.write_and_read(tables(tune(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(tables(tune(spark), sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(tables(tune(spark), sf_dir, "embeddings"))
    written = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written, 256).alias("centroid_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_secrets, op3_simhash, op4_language, op5_toxicity, op6_urls, op7_decontaminate, op8_bpe, op9_token_files, op10_quality, op11_packing, op12_spelling, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets.oracle_sql(), "op7_decontaminate": decontaminate.oracle_sql(), "op10_quality": quality.oracle_sql(), "op12_spelling": spelling.oracle_sql(), "op13_centroids": centroids.oracle_sql()}
