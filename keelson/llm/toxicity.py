"""Toxicity by a misspelling-tolerant lexicon and context windows.

The lexicon is learned: words whose share among toxic rows is far above their share among
others, weighted by log-odds. Its trie is intersected with Levenshtein automata: a state is
the set of (trie node, edits) that some prefix can stand for, made as it is first met, and a
word is a hit when it ends where a term ends within the term's edits. Each distinct word of
a worker runs through it once.

A hit's window tells abuse from quotation: inside quotation marks, or near a reporting
word, it counts apart. A text's score is a logistic function of its sums of hit weights:
exact and misspelled, plain and quoted, and their share of the words.

Words are runs of letters, with one or two digits or marks inside where they stand between
letters (l0ser, st*pid); two letters in the wrong order are one edit.

Lexicon and logistic weights are fitted on about ``SAMPLE`` ids of each label. Every word of
enough support and log-odds is a term; as each stands in ``SUPPORT_SHARE`` of the toxic texts,
there are at most 1 / ``SUPPORT_SHARE`` times as many as a toxic text has distinct words.

Defined cases: null and empty texts have no hits and get the score of such texts; without
rows of both labels every score is the share of toxic rows (0 if there are none); rows with
null ids are scored and never learned from; of an id's repeated labels one counts, of its
texts the least is learned from; very long texts are scored whole; further columns aren't read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import runs, slices
from keelson.llm.language import remainder
from keelson.llm.pretokens import LETTER, NUMBER, OTHER, PieceTable, classes, code_points
from keelson.llm.sampling import per_class

SAMPLE = 10_000
#: A term stands in at least so many toxic rows of the sample, and this share of them.
SUPPORT, SUPPORT_SHARE = 3, 0.004
LOG_ODDS = 2.0
#: Edits allowed from so many letters on; two neighbours in the wrong order are one.
EDITS = ((9, 2), (4, 1), (0, 0))
#: Entries that the states of an automaton hold together; past that it starts anew.
MOST_ENTRIES = 500_000
#: Marks that may stand for letters inside a word, as digits may.
_STANDINS = [ord(c) for c in "*@$!#%"]
WINDOW = 60
FEATURES = 5

_QUOTES = "\"“”„«»‘’"
#: Words that report what someone else said.
_REPORTS = re.compile(r"\b(said|says|wrote|writes|quoted?|called|reported|according|dit|écrit|selon|sagte|schrieb|laut|dijo|escribió|según)\b")


class Automaton:
    """A trie of terms met with at most the terms' edits; states are made when met.

    A node knows the most edits that a term at or below it allows; what has used more
    leaves the state. Equal states are one number, so a word whose states were met before
    costs a look-up per letter.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.edits = [next(e for least, e in EDITS if len(t) >= least) for t in terms]
        self.reach = [max(self.edits, default=0)]
        for k, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], self.edits[k])
            self.term_at[node] = k
        self._clear()

    def _clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.after: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.held = 0
        self._number(self._close({(0, 0, "")}))

    def _number(self, state: frozenset) -> int:
        """The state's number; the empty state's is -1, the start's 0."""
        if not state:
            return -1
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            self.after.append({})
            self.ends.append(self._end(state))
            self.held += len(state)
        return found

    def _close(self, state: set[tuple[int, int, str]]) -> frozenset:
        """With the letters that may be left out; of one node only the fewest edits."""
        least: dict[tuple[int, str], int] = {}
        todo = list(state)
        while todo:
            node, e, due = todo.pop()
            if e <= self.reach[node] and e < least.get((node, due), e + 1):
                least[node, due] = e
                if not due:
                    todo += [(child, e + 1, "") for child in self.children[node].values() if e < self.reach[child]]
        return frozenset((node, e, due) for (node, due), e in least.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, due in state:
            if due:  # the first of two swapped letters comes second
                if due == c:
                    out.add((node, e, ""))
                continue
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e, ""))
                elif e < self.reach[child]:
                    out.add((child, e + 1, ""))
                    if c in self.children[child]:
                        out.add((self.children[child][c], e + 1, letter))
            if e < self.reach[node]:
                out.add((node, e + 1, ""))
        return self._close(out)

    def _end(self, state: frozenset) -> int:
        """2 * term + (1 if misspelled), or -1; fewest edits first, then the first term."""
        found = [(e, self.term_at[node]) for node, e, due in state if not due and self.term_at[node] >= 0 and e <= self.edits[self.term_at[node]]]
        if not found:
            return -1
        e, term = min(found)
        return 2 * term + (e > 0)

    def match(self, word: str) -> int:
        if self.held > MOST_ENTRIES:
            self._clear()
        state = 0
        for c in word:
            after = self.after[state].get(c)
            if after is None:
                after = self.after[state][c] = self._number(self._step(self.states[state], c))
            if after < 0:
                return -1
            state = after
        return self.ends[state]


def words_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts end to end, where each starts; words' starts, ends, texts."""
    lowered = [t.lower() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    whole = "".join(lowered)
    begin, end = runs(_in_words(code_points(whole), at), at)
    return whole, at, begin, end, np.searchsorted(at, begin, "right") - 1


def _in_words(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which code points are letters, or one or two digits or marks between letters."""
    n = len(points)
    kind = np.full(n + 4, OTHER, np.uint8)
    kind[2 : n + 2] = classes(points)
    text = np.full(n + 4, -1, np.int64)
    text[2 : n + 2] = np.repeat(np.arange(len(at) - 1), np.diff(at))
    letter = kind == LETTER
    standin = kind == NUMBER
    standin[2 : n + 2] |= np.isin(points, _STANDINS)
    near = lambda flags, k: flags[2 + k : n + 2 + k] & (text[2 + k : n + 2 + k] == text[2 : n + 2])
    one = near(letter, -1) & near(letter, 1)
    first = near(letter, -1) & near(standin, 1) & near(letter, 2)
    second = near(letter, 1) & near(standin, -1) & near(letter, -2)
    return letter[2 : n + 2] | (standin[2 : n + 2] & (one | first | second))


def quoted(before: str, after: str) -> bool:
    """Whether a hit between these stretches of text is likely a quotation."""
    marks = sum(before.count(q) for q in _QUOTES)
    return (marks % 2 == 1 and any(q in after for q in _QUOTES)) or _REPORTS.search(before[-WINDOW // 2 :]) is not None


class Scorer:
    """Features of texts for one lexicon."""

    def __init__(self, terms: list[str], weights: list[tuple[float, float]]):
        #: of each term, for exact and for misspelled hits
        self.weights = np.array(weights).reshape(-1, 2)
        automaton = Automaton(terms)
        self.table = PieceTable(lambda pieces: (np.array([automaton.match(p) + 1 for p in pieces], np.int64), np.ones(len(pieces), np.int64)))

    def hits(self, texts: list[str]):
        """Row, term, whether misspelled, and the text on both sides of every hit."""
        whole, at, begin, end, owner = words_of(texts)
        self.n_words = np.bincount(owner, minlength=len(texts))
        if not len(begin) or not len(self.weights):
            return
        slots = self.table.look_up(whole, code_points(whole), begin, end)
        found = self.table.ids[self.table.begin[slots]].astype(np.int64) - 1
        for i in np.flatnonzero(found >= 0).tolist():
            row, b, e = int(owner[i]), int(begin[i]), int(end[i])
            yield row, int(found[i]) // 2, int(found[i]) % 2, whole[max(at[row], b - WINDOW) : b], whole[e : min(at[row + 1], e + WINDOW)]

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for row, term, off, before, after in self.hits(texts):
            out[row, 2 * quoted(before, after) + off] += self.weights[term, off]
        out[:, 4] = out[:, :2].sum(axis=1) / np.sqrt(np.maximum(self.n_words, 1))
        return np.log1p(out)


@functools.lru_cache(1)
def scorer(terms: tuple[str, ...], weights: tuple[tuple[float, float], ...]) -> Scorer:
    """A worker's tasks share one, with the states and words met so far."""
    return Scorer(list(terms), list(weights))


def _sampled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One text of each chosen id, however many rows have it."""
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text"))
    return one.select("label", "weight", "text")


def _learn_lexicon(rows: DataFrame, n_toxic: float, n_other: float) -> tuple[list[str], list[float]]:
    """Terms and their log-odds; tasks count words before the shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                texts = [t or "" for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                labels = batch.column(0).slice(lo, hi - lo).to_pylist()
                whole, _, begin, end, owner = words_of(texts)
                seen = {(o, whole[b:e]) for o, b, e in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True)}
                toxic = Counter(w for o, w in seen if labels[o])
                other = Counter(w for o, w in seen if not labels[o])
                words = list({*toxic, *other})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], ["word", "toxic", "other"])

    found = rows.mapInArrow(task, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_other + 1))
    least = max(SUPPORT, SUPPORT_SHARE * n_toxic)
    best = found.where(F.col("t") >= least).withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS).collect()
    best.sort(key=lambda r: (-r["odds"] * r["t"] ** 0.5, r["word"]))  # of equally near terms the stronger is the hit
    return [r["word"] for r in best], [float(r["odds"]) for r in best]


def _misspelled_odds(rows: DataFrame, terms: list[str], exact: list[float], n_toxic: float, n_other: float) -> list[tuple[float, float]]:
    """Of each term its own log-odds and those of texts with a misspelling of it, at most
    its own; a term whose neighbours are ordinary words gets none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(tuple(terms), ((1.0, 1.0),) * len(terms))
        counts = np.zeros((2, len(terms)), np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                labels = batch.column(0).slice(lo, hi - lo).to_pylist()
                seen = {(row, term) for row, term, off, *_ in own.hits([t or "" for t in batch.column(2).slice(lo, hi - lo).to_pylist()]) if off}
                for row, term in seen:
                    counts[int(bool(labels[row])), term] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(counts[1]), pa.array(counts[0])], ["term", "toxic", "other"])

    found = {r[0]: (r[1], r[2]) for r in rows.mapInArrow(task, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic"), F.sum("other")).collect()}
    out = []
    for k, own in enumerate(exact):
        t, o = found.get(k, (0, 0))
        odds = float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((o + 0.5) / (n_other + 1)))
        if not o:  # no row of the others has one: it counts half the term at least
            odds = max(odds, own / 2)
        out.append((own, min(own, odds) if odds > LOG_ODDS / 2 else 0.0))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the intercept) by damped Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(x.shape[1])
    w = w * len(w) / w.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * np.append(b[:-1], 0)
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([ridge] * (len(b) - 1) + [1e-9])
        step = np.linalg.solve(hess, grad)
        b -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return b


def _positive_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic weights where no hit speaks against toxicity: features with a negative
    weight are left out one by one."""
    used = list(range(x.shape[1]))
    while True:
        b = _logistic(x[:, used], y, w)
        if not used or b[:-1].min() >= 0:
            break
        used.pop(int(np.argmin(b[:-1])))
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = b[:-1], b[-1]
    return out


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> tuple[list[str], list[tuple[float, float]], np.ndarray]:
    """Terms, their weights, the logistic weights."""
    # an id labelled both ways counts as toxic; ids of a bounded sample
    known = labels.where(learnable).select("doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 0, 0).otherwise(1)).alias("label"))
    chosen = per_class(known, "label", sample)
    rows = _sampled(docs.select("doc_id", "text"), chosen)
    sizes = {r[0]: (r[1], r[2]) for r in chosen.groupBy("label").agg(F.count("*"), F.sum("weight")).collect()}
    none = np.zeros(FEATURES + 1)
    if not (sizes.get(1) and sizes.get(0)):
        share = float(bool(sizes.get(1)))
        none[-1] = 20.0 if share else -20.0
        return [], [], none
    terms, exact = _learn_lexicon(rows, sizes[1][0], sizes[0][0])
    weights = _misspelled_odds(rows, terms, exact, sizes[1][0], sizes[0][0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(tuple(terms), tuple(weights))
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                x = own.features([t or "" for t in batch.column(2).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int32()), batch.column(1).slice(lo, hi - lo), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "weight", "x"])

    found = rows.mapInArrow(task, "label int, weight double, x array<double>").collect()
    x = np.array([r[2] for r in found])
    logistic = _positive_logistic(x, np.array([r[0] for r in found], float), np.array([r[1] for r in found]))
    for exact, misspelled in ((0, 1), (2, 3)):
        if not x[:, misspelled].any():  # no row of the sample tells its worth
            logistic[misspelled] = logistic[exact]
    return terms, weights, logistic


def score(docs: DataFrame, terms: list[str], weights: list[tuple[float, float]], logistic: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` and the features of each row; no shuffle."""
    names = ["plain", "plain_misspelled", "quoted", "quoted_misspelled", "density"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(tuple(terms), tuple(weights))
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                x = own.features([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ logistic[:-1] + logistic[-1], -30, 30)))
                columns = [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(pa.array(x[:, k]) for k in range(FEATURES))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", *names])

    schema = "doc_id long, score double, predicted int, " + ", ".join(f"{n} double" for n in names)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(task, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and features of each row of ``docs``, learned
    from the labels of rows whose id's crc32 modulo 5 is not 0."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    found = score(docs, *fit(docs, labels, ~held_out, **options))
    return found.select("doc_id", held_out.alias("held_out"), *found.columns[1:])
