"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z lower-cased, words are runs of digits,
letters and all non-ASCII characters, joined by one space. A window is ``WINDOW`` words of an
item (an item of fewer words is one). Of an item with windows of w words, every s-th stretch
of w - s + 1 words is a pattern, s being half of w: each window holds one of them. Items that
are one short window are patterns themselves. A text is scanned once; where a pattern ends,
its place in the normalised text gives its words. The few windows that may lie around it are
looked up in a sorted table of window hashes and compared word by word; hit words give
offsets in the original text.

The automaton is broadcast. Its size follows the benchmark, not the corpus, and is bounded:
past ``AUTOMATON_BYTES`` bytes of items, they are dealt to several automata that scan the
texts one after the other, each adding to what the others found, so results are the same.

Defined cases: a null or empty text has no words and no hits; an item without words never
occurs; items with equal texts are all reported; an empty benchmark hits nothing; rows with
equal or null ids are judged by their own texts; very long texts are scanned alone; further
columns aren't read, and pass through ``drop_contaminated``.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import covered, flat, slices

WINDOW = 10
#: Bytes of items in one automaton; it takes about 60 bytes of memory for each.
AUTOMATON_BYTES = 4 << 20

#: ASCII that is no part of a word becomes a space, A-Z become a-z.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def _padded(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


class Windows:
    """The automaton over some items, and their windows."""

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        self.window, self.step = window, max(1, window // 2)
        self.words: list[bytes] = []
        shared: dict[bytes, bytes] = {}
        short: dict[bytes, set] = {}
        blocks: set[bytes] = set()
        starts, owners = [], []
        for item, text in items:
            own = [shared.setdefault(w, w) for w in words_of((text or "").encode())]
            if own and len(own) < window:
                short.setdefault(_padded(own), set()).add(item)
            count = len(own) - window + 1
            if count > 0:
                blocks.update(_padded(own[p : p + window - self.step + 1]) for p in range(0, count + self.step - 1, self.step))
                starts.append(np.arange(len(self.words), len(self.words) + count))
                owners += [item] * count
                self.words += own
        self._index(np.concatenate(starts) if starts else np.zeros(0, np.int64), owners)
        self.automaton = ahocorasick.Automaton()
        for pattern in blocks | short.keys():
            self.automaton.add_word(pattern.decode("latin-1"), (pattern in blocks, pattern.count(b" ") - 1, short.get(pattern, ())))
        self.empty = not (blocks or short)
        if not self.empty:
            self.automaton.make_automaton()

    def _index(self, starts: np.ndarray, owners: list) -> None:
        """Windows by hash, equal ones as one with all owners; a base of the hash is found
        for which unequal ones differ."""
        codes, self.base = np.fromiter(map(hash, self.words), np.int64, len(self.words)), 0x9E3779B97F4A7C15
        while True:
            h = self._hashes(codes, starts)
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else order
            lead = np.repeat(starts[order[first]], np.diff(np.append(first, len(order))))
            if all(a == b or self._words(a) == self._words(b) for a, b in zip(starts[order].tolist(), lead.tolist(), strict=True)):
                break
            self.base += 2
        self.hashes, self.starts = h[order[first]], starts[order[first]]
        self.bounds, self.owners = np.append(first, len(order)), [owners[i] for i in order.tolist()]

    def _words(self, at: int) -> list[bytes]:
        return self.words[at : at + self.window]

    def _hashes(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        codes, h = codes.view(np.uint64), np.zeros(len(starts), np.uint64)
        for k in range(self.window):
            h = h * np.uint64(self.base) + codes[starts + k]
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie inside an occurrence of a window; the windows' items."""
        none = np.zeros(len(words), bool), set()
        if not words or self.empty:
            return none
        text = _padded(words)
        found = list(self.automaton.iter(text.decode("latin-1")))
        if not found:
            return none
        last = np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), [end for end, _ in found])
        begin, size, items = [], [], set()
        for at, (_, (_, n, own)) in zip(last.tolist(), found, strict=True):
            if own:
                begin.append(at - n)
                size.append(n)
                items.update(own)
        around = last[[block for _, (block, _, _) in found]] - (self.window - self.step + 1)
        around = np.unique((around[:, None] - np.arange(self.step)).ravel())
        around = around[(around >= 0) & (around <= len(words) - self.window)]
        if len(around):
            h = self._hashes(np.fromiter(map(hash, words), np.int64, len(words)), around)
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            for i in np.flatnonzero(self.hashes[place] == h).tolist():
                at, k = int(around[i]), int(place[i])
                if words[at : at + self.window] == self._words(int(self.starts[k])):
                    begin.append(at)
                    size.append(self.window)
                    items.update(self.owners[self.bounds[k] : self.bounds[k + 1]])
        begin = np.array(begin, np.int64)
        return covered(begin, begin + np.array(size, np.int64), len(words)), items

    def occurs(self, words: list[bytes]) -> bool:
        return bool(self.scan(words)[1])


_loaded: dict = {}


def _automaton(shared, name: str, window: int) -> Windows:
    """Built once for each worker and broadcast."""
    if _loaded.get("name") != name:
        _loaded.clear()
        _loaded.update(name=name, windows=Windows(shared.value, window))
    return _loaded["windows"]


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code point spans in the original text of the runs of hit words."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    first = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    last = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(points[first[a]]), "end": int(points[last[b - 1]])} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long>>"
#: A row on its way between two automata: its text, hit words as bits (none: empty), items.
_CARRIED = "doc_id long, text string, hit binary, item_ids array<long>"


def _task(shared, window: int, first: bool, last: bool):
    """Scans the texts and adds what automata before this one found."""
    name = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(shared, name, window)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                data, at = flat(part.column(1))
                raw, at = data.tobytes(), at.tolist()
                before = [(b"", [])] * len(part) if first else list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                out: list[list] = [[], [], [], [], []]
                for a, b, (bits, known) in zip(at[:-1], at[1:], before, strict=True):
                    words = words_of(raw[a:b])
                    hit, items = own.scan(words)
                    if bits:
                        hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                    n_hit = int(hit.sum())
                    values = (len(words), n_hit, sorted(items.union(known)), _spans(raw[a:b].decode(), hit) if n_hit and last else [], np.packbits(hit).tobytes() if n_hit and not last else b"")
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                doc_id, item_ids = part.column(0).cast(pa.int64()), pa.array(out[2], pa.list_(pa.int64()))
                if last:
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), item_ids, pa.array(out[3], _SPANS)], ["doc_id", "n_words", "n_hit", "item_ids", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([doc_id, part.column(1), pa.array(out[4], pa.binary()), item_ids], ["doc_id", "text", "hit", "item_ids"])

    return task


def _shards(benchmark: DataFrame, automaton_bytes: int) -> list:
    """The benchmark's items as broadcasts, one for each automaton."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // automaton_bytes))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(n)))
    return [benchmark.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in dealt.where(F.col("shard") == k).toLocalIterator()]) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, spans`` of each row of ``docs``; no shuffle.

    ``spans`` are code points of the runs of hit words. Each automaton hands the rows with
    what it found to the next, so ids may be null or repeat.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shards = _shards(benchmark, automaton_bytes)
    for k, shared in enumerate(shards):
        last = k == len(shards) - 1
        rows = rows.mapInArrow(_task(shared, window, k == 0, last), _FOUND if last else _CARRIED)
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; each automaton filters
    what the one before left, so there is no shuffle."""
    place = docs.columns.index(text_col)

    def without(shared) -> Callable:
        name = uuid.uuid4().hex

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _automaton(shared, name, window)
            for batch in batches:
                data, at = flat(batch.column(place))
                raw, at = data.tobytes(), at.tolist()
                clean = [not own.occurs(words_of(raw[a:b])) for a, b in itertools.pairwise(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return task

    for shared in _shards(benchmark, automaton_bytes):
        docs = docs.mapInArrow(without(shared), docs.schema)
    return docs


def oracle_sql(window: int = WINDOW) -> str:
    """The digest query in DuckDB SQL: every window of every document against every window
    of the benchmark."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
    iw AS (SELECT item_id, least({window}, len(w)) AS n, array_to_string(w[k:k + least({window}, len(w)) - 1], ' ') AS t FROM i, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS k) WHERE len(w) > 0),
    dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""
