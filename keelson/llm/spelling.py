"""Words that differ by one edit, found through words over a reduced alphabet.

Letters are hashed to a few symbols, so that words become reduced words. Of each distinct reduced
word the one-edit neighbourhood is generated, and joined with the reduced vocabulary; the words
behind two neighbouring (or equal) reduced words are compared letter by letter. One edit of a word is
at most one edit of its reduced word, so no pair is lost.

Neighbourhoods are symmetric: of two neighbours the longer one makes the link by a deletion, of two
equally long ones that with the larger symbol at the place where they differ, so every link of the
full neighbourhoods is made once. The number of symbols grows with the vocabulary (about its eighth
root), so reduced words stay rare. Where two linked reduced words stand for many pairs of words
all the same, the words behind them go to a finer alphabet, at last to one in which
every letter is its own symbol and each reduced word stands for one word; so nothing is
compared all with all, and nothing is dropped.

Defined cases: a null or empty text has no words; a null id is written as an empty string where
ids are hashed; rows that repeat count as often as they stand; ties of a form go to the
smallest word; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, flat, mix, powers, ragged

#: The letters of words, in lower case where they are ASCII.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: Form of a word: its near word of at least this many times its count.
TIMES = 10
#: Pairs of words behind one link of reduced words that are compared directly.
LINK_PAIRS = 256
#: Root of the vocabulary's size that gives the number of symbols, and the least number.
ROOT, LEAST_SYMBOLS = 8, 4

_U = np.uint64


def meet(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``a`` joined with ``b``, both dealt by ``on`` and sorted, never sent through the driver. Spark would judge a side
    by the packed files behind it, whose rows may stand for over a hundred neighbours each, and keep to that."""
    return a.hint("merge").join(b, on, how)


def vocabulary(docs: DataFrame, slip: int = 31, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of whole texts with ``least_length`` letters, and how often they stand.

    Where ``slip`` divides the CRC-32 h of ``<id>:<word>``, the word loses its letter h % length.
    Counts are added up in each task before the shuffle.
    """
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{least_length},}}+)"), F.lit(1)))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), runs.alias("w")).select("i", F.translate("w", UPPER, LOWER).alias("w"))
    hashed = words.select("w", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")).alias("h"))
    word = F.when(F.col("h") % slip == 0, F.expr("concat(substr(w, 1, cast(h % length(w) as int)), substr(w, cast(h % length(w) as int) + 2))")).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def symbols_of(letters: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of each letter: its hash to so many, or itself where every letter has its own."""
    own = np.where(letters < 0xC0, letters - ord("a"), letters - 0xC0 + 26)
    return own if symbols >= len(LETTERS) else (mix(letters.astype(np.uint64) + _U(7)) % _U(symbols)).astype(np.int64)


def _keys(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the reduced words that start at ``at``: each symbol's term in the sum that a word's hash is
    made of, what it is multiplied by, and the sums. Arithmetic is modulo 2**64."""
    lengths = np.diff(at)
    power = powers(int(lengths.max(initial=0)) + 1)[0][np.arange(len(codes)) - np.repeat(at[:-1], lengths)]
    value = (codes + 1).astype(np.uint64) * power
    return value, power, np.add.reduceat(value, at[:-1]) if len(codes) else value


def _key(total: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(total ^ mix(lengths.astype(np.uint64))).view(np.int64)


def reduced(vocab: DataFrame, symbols: int) -> DataFrame:
    """``word, n, reduced, r`` of ``vocab(word, n)``: the reduced word, a byte for each letter, and its hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = flat(pa.array([w.encode("latin-1") for w in batch.column(0).to_pylist()], pa.binary()))
            codes = symbols_of(raw.astype(np.int64), symbols)
            bytes_, ends = codes.astype(np.uint8).tobytes(), at.tolist()
            own = pa.array([bytes_[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, pa.array(_key(_keys(codes, at)[2], np.diff(at)))], ["word", "n", "reduced", "r"])

    return vocab.select("word", "n").mapInArrow(task, "word string, n long, reduced binary, r long")


def neighbours(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the reduced words that start at ``at``, the hashes of each with one symbol deleted or
    replaced by a smaller one, after the number of the word they come from."""
    lengths = np.diff(at)
    word = np.repeat(np.arange(len(lengths)), lengths)
    value, power, total = _keys(codes, at)
    before = np.cumsum(value) - value
    before -= before[at[:-1]][word]
    # of a run of one symbol only the last deletion is new
    last = np.append(codes[1:] != codes[:-1], True)
    last[at[1:] - 1] = True
    gone = np.flatnonzero(last)
    fewer = before[gone] + (total[word[gone]] - before[gone] - value[gone]) * powers(2)[1][1]
    spot = np.repeat(np.arange(len(codes)), codes)  # one replacement for each smaller symbol
    to = ragged(np.zeros(len(codes), np.int64), codes)
    other = total[word[spot]] - (codes[spot] - to).astype(np.uint64) * power[spot]
    return np.concatenate((word[gone], word[spot])), np.concatenate((_key(fewer, lengths[word[gone]] - 1), _key(other, lengths[word[spot]])))


def neighbourhoods(groups: DataFrame) -> DataFrame:
    """``r, m, near`` of ``groups(reduced, r, m)``: ``near`` is the hash of the reduced word itself, then of
    its neighbours, one row for each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                raw, at = flat(part.column(0))
                source, near = neighbours(raw.astype(np.int64), at)
                source = pa.array(np.concatenate((np.arange(len(part)), source)))
                own = part.column(1)
                yield pa.RecordBatch.from_arrays([own.take(source), part.column(2).take(source), pa.array(np.concatenate((own.to_numpy(), near)))], ["r", "m", "near"])

    return groups.select("reduced", "r", "m").mapInArrow(task, "r long, m long, near long")


def near_words(vocab: DataFrame, link_pairs: int = LINK_PAIRS, symbols: int | None = None) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words of ``vocab(word, n)`` that are one edit apart, once.

    Words have at least two letters. ``symbols`` is the size of the first alphabet, by default
    from the number of words. Alphabets grow fourfold while any link stands for over ``link_pairs`` pairs.
    """
    found = None
    symbols = symbols or max(LEAST_SYMBOLS, int(np.ceil(vocab.count() ** (1 / ROOT))))
    while True:
        symbols = min(symbols, len(LETTERS))
        words = cut(reduced(vocab, symbols))
        groups = cut(words.groupBy("reduced", "r").agg(F.count("*").alias("m")))
        sizes = groups.groupBy(F.col("r").alias("near")).agg(F.sum("m").alias("m_near"))
        links = cut(meet(neighbourhoods(groups), sizes, "near").select("r", "near", (F.col("m") * F.col("m_near")).alias("pairs")))
        final = symbols == len(LETTERS)
        light = links if final else links.where(F.col("pairs") <= link_pairs)
        left = meet(light, words.select("r", F.col("word").alias("a"), F.col("n").alias("n_a")), "r")
        both = meet(left, words.select(F.col("r").alias("near"), F.col("word").alias("b"), F.col("n").alias("n_b")), "near")
        pairs = both.where((F.col("r") != F.col("near")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
        pairs = pairs.select(*(F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("n_a", "n_b"), ("b", "a"), ("n_b", "n_a"))))
        found = pairs if found is None else found.unionByName(pairs)
        heavy = links.where(F.col("pairs") > link_pairs)
        if final or heavy.isEmpty():
            return found.distinct()
        crowded = heavy.select(F.explode(F.array("r", "near")).alias("r")).distinct()
        vocab = meet(words, crowded, "r", "left_semi").select("word", "n")
        symbols *= 4


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: where the forms of a word's form lead in the end.

    Each round doubles how far a word has come; a form's count is ten times its word's, so few do.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        nxt = cut(meet(at, on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        at = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, slip: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the vocabulary of ``docs``."""
    vocab = cut(vocabulary(docs, slip, id_col=id_col, text_col=text_col))
    pairs = near_words(vocab)
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    judged = cut(meet(vocab, best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    return meet(judged, ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def oracle_sql(slip: int = 31) -> str:
    """DuckDB SQL for the registered query. CRC-32 is folded over the bytes by a table that the SQL makes itself;
    words one edit apart meet by what is left of them without one letter."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""WITH RECURSIVE bits(b, c, k) AS (SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, {step}, k + 1 FROM bits WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')), '{UPPER}', '{LOWER}') AS w FROM documents),
    counted AS MATERIALIZED (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
    hashed AS MATERIALIZED (SELECT w, n, length(w) AS l, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST(CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS BIGINT))), lambda h, b: xor(h // 256, t[CAST(xor(h, b) % 256 + 1 AS BIGINT)]))) AS h FROM counted, crc),
    slipped AS (SELECT CASE WHEN h % {slip} = 0 THEN substr(w, 1, CAST(h % l AS BIGINT)) || substr(w, CAST(h % l + 2 AS BIGINT)) ELSE w END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS m FROM near GROUP BY word),
    judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN other END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
    ways(word, place) AS (SELECT word, word FROM judged UNION ALL SELECT ways.word, j.form FROM ways JOIN judged j ON ways.place = j.word WHERE j.form IS NOT NULL),
    ends AS (SELECT ways.word, place FROM ways JOIN judged j ON ways.place = j.word WHERE j.form IS NULL)
    SELECT j.word, j.form, e.place AS root, j.n, j.n_near, j.form_n FROM judged j JOIN ends e ON j.word = e.word"""
