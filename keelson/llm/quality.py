"""Quality rules by repetition coverage.

Words are runs of non-white-space. Rolling hashes over the words of a text, for several
n-gram lengths at once, find the n-grams that occur more than once in that text; the
measure is the share of the text's word characters that lie inside such n-grams, and
the share inside repeated lines. A text fails when a share passes the bound of its
length, when its symbols outnumber a bound per word, or by the base rules.

Defined cases: a null or empty text has no words and fails (under ``MIN_WORDS``); very long
texts are measured alone; repeated rows are judged alike; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm.common import SPACE, covered, first_equal, first_of, flat, mix, powers, runs, slices

#: n-gram length -> highest share of word characters inside n-grams that repeat.
MAX_COVERAGE = {6: 0.50, 8: 0.40, 10: 0.35, 13: 0.30}
MAX_LINE_COVERAGE = 0.30
MAX_SYMBOLS_PER_WORD = 0.1
MIN_WORDS = 20
BASE_N = 8
BASE_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [(f"coverage_{n}", pa.float64()) for n in MAX_COVERAGE]
    + [("line_coverage", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def repeated(words: np.ndarray, first: np.ndarray, n: int, rolling: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which of the ``n`` words from each place in ``first`` on occur twice or more.

    ``rolling`` are the running sums of the words' codes times powers of the hash base, and
    the inverse powers. n-grams with equal hashes are compared word by word;
    should two differ, all of them are told apart by sorting them.
    """
    sums, inverse = rolling
    same = first_of((sums[first + n] - sums[first]) * inverse[first])
    again = same != np.arange(len(first))
    if any((words[first + k] != words[first[same] + k]).any() for k in range(n)):
        same = np.unique(words[first[:, None] + np.arange(n)], axis=0, return_inverse=True)[1].ravel()
        same = first_of(same)
        again = same != np.arange(len(first))
    again[same[again]] = True
    return first[again]


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a flat array."""
    n_docs = len(at) - 1
    space = SPACE[data]
    ws, we = runs(~space, at)
    doc = np.searchsorted(at, ws, "right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    point = ((data & 0xC0) != 0x80) & ~space
    points = np.concatenate(([0], np.cumsum(point)))
    chars = points[we] - points[ws]
    word_chars = points[at[1:]] - points[at[:-1]]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}

    # a word of one text is never the word of another
    words = first_equal(data, ws, we)
    words = first_of(words * n_docs + doc)
    codes, (power, inverse) = mix(words.astype(np.uint64)), powers(len(words) + 1)
    rolling = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power[:-1]))), inverse
    last = np.concatenate(([0], np.cumsum(n_words)))[1:][doc]
    total = np.maximum(word_chars, 1)
    for n in {BASE_N, *MAX_COVERAGE}:
        again = repeated(words, np.flatnonzero(np.arange(len(ws)) + n <= last), n, rolling)
        inside = covered(again, again + n, len(ws))
        if n == BASE_N:
            out["n_repeat_words"] = np.bincount(doc[inside], minlength=n_docs)
        if n in MAX_COVERAGE:
            out[f"coverage_{n}"] = np.bincount(doc[inside], weights=chars[inside], minlength=n_docs) / total

    ls, le = runs(data != 10, at)
    has_word = points[le] > points[ls]
    ls, le = ls[has_word], le[has_word]
    line_doc = np.searchsorted(at, ls, "right") - 1
    line = first_of(first_equal(data, ls, le) * n_docs + line_doc)
    later = line != np.arange(len(line))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs)
    out["line_coverage"] = np.bincount(line_doc[later], weights=(points[le] - points[ls])[later], minlength=n_docs) / total

    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    bad = out["base_failed"] | (out["line_coverage"] > MAX_LINE_COVERAGE) | (out["n_symbols"] > MAX_SYMBOLS_PER_WORD * n_words)
    for n, most in MAX_COVERAGE.items():
        bad |= out[f"coverage_{n}"] > most
    out["kept"] = ~bad
    return out


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            m = measure(*flat(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(m[f.name]).cast(f.type) for f in list(_SCHEMA)[1:])], schema=_SCHEMA)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures and verdicts per row of ``docs``; no shuffle."""
    schema = ", ".join(f"{f.name} {({pa.int64(): 'long', pa.float64(): 'double', pa.bool_(): 'boolean'})[f.type]}" for f in _SCHEMA)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_task, schema)


def oracle_sql() -> str:
    """The query in DuckDB SQL: every n-gram and line of a text by what it says."""
    grams = sorted({BASE_N, *MAX_COVERAGE})
    said = ", ".join(f"CASE WHEN i + {n - 1} <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g{n}" for n in grams)
    starts = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 THEN 1 ELSE 0 END AS r{n}" for n in grams)
    inside = ", ".join(f"max(r{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in grams)
    shares = ", ".join(f"coalesce(sum(length(word)) FILTER (in{n} = 1), 0) AS c{n}" for n in MAX_COVERAGE)
    coverage = ", ".join(f"coalesce(c{n}, 0) / greatest(coalesce(word_chars, 0), 1) AS coverage_{n}" for n in MAX_COVERAGE)
    bad = " OR ".join(f"coverage_{n} > {most}" for n, most in MAX_COVERAGE.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d), s AS (SELECT doc_id, i, word, {said} FROM w), r AS (SELECT doc_id, i, word, {starts} FROM s), c AS (SELECT doc_id, i, word, {inside} FROM r),
    g AS (SELECT doc_id, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (in{BASE_N} = 1) AS n_repeat_words, {shares} FROM c GROUP BY doc_id),
    l AS (SELECT doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS solid FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
    lines AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, sum((n - 1) * solid) AS again FROM (SELECT doc_id, line, any_value(solid) AS solid, count(*) AS n FROM l WHERE solid > 0 GROUP BY doc_id, line) GROUP BY doc_id),
    m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {coverage},
      coalesce(again, 0) / greatest(coalesce(word_chars, 0), 1) AS line_coverage, len(ws) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {BASE_PERCENT} * len(ws) AS base_failed FROM d LEFT JOIN g USING (doc_id) LEFT JOIN lines USING (doc_id))
    SELECT *, NOT (base_failed OR line_coverage > {MAX_LINE_COVERAGE} OR n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words OR {bad}) AS kept FROM m"""
