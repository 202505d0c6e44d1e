"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. A round forms the key of every pair of
neighbours, finds its rank by binary search over the vocabulary's sorted pair keys, takes
the lowest rank of each word, and merges that pair wherever it stands in the word, from
the left. Rounds end when no word has a pair left. Each distinct word of a worker is
encoded once; texts are then put together from their words' ids.

Encoding matches a tokenizer file with this set-up: NFC, white space to one space, lower
case code point by code point, the ``words`` split of ``pretokens``, byte symbols, an
end-of-word mark. Added tokens are found in the raw text first and keep their id. Decoding
without a decoder in the file joins the tokens with one space.

Defined cases: a null or empty text has no ids and decodes to an empty text; very long
texts are one array of code points, of about 30 bytes for each; rows that repeat give
equal results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm.common import ragged, slices
from keelson.llm.pretokens import PieceTable, code_points, split

_NO_PAIR = np.int64(1) << 40


@functools.lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free
    code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Encodes words by the merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [(vocab[a] << 17 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        table = np.array(pairs, np.int64)
        self.keys, self.ranks, self.merged = (np.ascontiguousarray(c) for c in table.T)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has. Words aren't empty."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        tail = np.cumsum(lengths) - 1
        symbol[tail] = self.final[data[tail]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        while len(symbol):
            key = symbol[:-1] << 17 | symbol[1:]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[place] == key) & (word[1:] == word[:-1])
            rank = np.append(np.where(found, self.ranks[place], _NO_PAIR), _NO_PAIR)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            open_ = np.repeat(least < _NO_PAIR, sizes)
            if not open_.all():  # words without a pair are ready
                done_symbol.append(symbol[~open_])
                done_word.append(word[~open_])
                symbol, word, rank = symbol[open_], word[open_], rank[open_]
                place = np.append(place, 0)[open_]
                sizes, least = sizes[least < _NO_PAIR], least[least < _NO_PAIR]
            else:
                place = np.append(place, 0)
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            if not len(hit):
                continue
            # of hits that overlap (a pair of equal symbols) every second one stands
            fresh = np.append(True, np.diff(hit) != 1)
            run = np.flatnonzero(fresh)
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
            symbol[hit] = self.merged[place[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = np.concatenate(done_symbol or [symbol]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))


def normalised(text: str) -> str:
    """NFC and lower case code point by code point (so a final sigma is like any other)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Codec:
    """Whole texts to ids and back, for one tokenizer file."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.table = PieceTable(self._encode)
        self.shown: list[tuple[bytes, bytes]] = []
        self.special = re.compile("(" + "|".join(map(re.escape, self.merger.added)) + ")") if self.merger.added else None

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Also keeps how the ids and tokens of each word are written out."""
        if len(self.table.slot) == 0:
            self.shown = []
        ids, counts = self.merger.encode(words)
        tokens, at = self.merger.tokens, 0
        listed = ids.tolist()
        for c in counts.tolist():
            own = listed[at : at + c]
            at += c
            self.shown.append((b" ".join([b"%d" % i for i in own]), " ".join([tokens[i] for i in own]).encode()))
            self.table.held += 130 + len(self.shown[-1][0]) + len(self.shown[-1][1])
        return ids, counts

    def _parts(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, list]:
        """The texts' parts between added tokens end to end, where each starts, its text."""
        parts, owner, marks = [], [], []
        for i, text in enumerate(texts):
            if self.special and "<|" in text and (found := self.special.split(text))[1:]:
                for k, part in enumerate(found):
                    if k % 2:
                        marks.append((len(parts), i, self.merger.added[part]))
                    parts.append("" if k % 2 else normalised(part))
                    owner.append(i)
            else:
                parts.append(normalised(text))
                owner.append(i)
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        return "".join(parts), at, np.array(owner, np.int64), marks

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Of each word its slot and part, of each part its text; the added tokens."""
        whole, at, owner, marks = self._parts(texts)
        points = code_points(whole)
        begin, end = split(points, at[:-1], "words")
        slots = self.table.look_up(whole, points, begin, end)
        return slots, np.searchsorted(at, begin, "right") - 1, owner, marks

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        slots, part, owner, marks = self._slots(texts)
        table = self.table
        counts = table.count[slots]
        ids = table.ids[ragged(table.begin[slots], counts)].astype(np.int64)
        of = np.repeat(part, counts)
        if marks:
            ids = np.concatenate((ids, [m[2] for m in marks]))
            of = np.concatenate((of, [m[0] for m in marks]))
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        bounds = np.searchsorted(owner[of] if len(of) else of, np.arange(len(texts) + 1))
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids) -> str:
        """The tokens of the ids, joined with one space."""
        return " ".join([self.merger.tokens[int(i)] for i in ids])

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text the number of ids, the SHA-256 of its written ids and of its
        decoded text, put together word by word."""
        slots, part, owner, marks = self._slots(texts)
        shown, counts = self.shown, self.table.count[slots]
        text_of = owner[part] if len(part) else part
        bounds = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist()
        total = np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64).tolist()
        extra: dict[int, list] = {}
        for p, i, token in marks:
            extra.setdefault(i, []).append((p, token))
        listed, n, ids, decoded = slots.tolist(), [], [], []
        for i in range(len(texts)):
            own = [shown[s] for s in listed[bounds[i] : bounds[i + 1]]]
            if i in extra:
                places = np.searchsorted(part[bounds[i] : bounds[i + 1]], [p for p, _ in extra[i]]).tolist()
                for k, (_, token) in reversed([*zip(places, extra[i], strict=True)]):
                    own.insert(k, (b"%d" % token, self.merger.tokens[token].encode()))
            n.append(total[i] + len(extra.get(i, ())))
            ids.append(hashlib.sha256(b" ".join([w[0] for w in own])).hexdigest())
            decoded.append(hashlib.sha256(b" ".join([w[1] for w in own])).hexdigest())
        return n, ids, decoded


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of each row of ``docs``; no shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids = own.encode_batch([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                columns = [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(task, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``docs``: the same
    words and ids as ``encode``, written out and hashed inside the task; no shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                n, ids, decoded = own.digests([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                columns = [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
