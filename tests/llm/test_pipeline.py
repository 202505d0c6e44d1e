"""The pipeline's stages against plain Python, each over what its predecessor kept."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    rows = sorted((r["doc_id"], r["text"]) for r in first.collect())
    lost = {r[0] for r in docs.select("doc_id").collect()} - {d for d, _ in rows}
    assert len(lost) <= 2

    keep = {c for _, _, c in brute.simhash(rows)}
    rows = [(d, t) for d, t in rows if d in keep]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {c[0] for c in brute.contamination(rows, items) if c[5]}
    rows = [(d, brute.redact(t)) for d, t in rows if d not in hit]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from tests.llm.test_operators import BENCH, DOCS

    sf = f"{tmp_path}/sf"
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(d, t, "en" if d % 2 else "fr", f"s{d % 3}", len(t or "")) for d, t in DOCS] + [(3, "a", "en", "s", 1), (None, None, None, None, None), (None, "one text of its own here", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"label": F.lit(1), "fp": F.lit("x"), "blob": F.lit(2), "rank": F.lit(3.0)})
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf)
            path = f"{tmp_path}/{name}-{start is docs}"
            out.write.parquet(path)
            now = spark.read.schema(out.schema).parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns, name
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (now.count() > 5) == (start is docs)
