"""Splitting whole texts into the pieces that byte-pair merges never cross.

Many texts are split at once in one flat array of code points: a class per code point
(letter, number, white space, other), runs of a class, then the few rules that join a
space or an apostrophe to a run. Two rule sets are offered, ``words`` and ``spaced``;
both name the same contractions.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from keelson.llm.common import first_equal, ragged

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Unicode's White_Space code points.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions both rule sets split off.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


_KINDS = {"L": LETTER, "N": NUMBER}
_UNKNOWN = 255
_classes = np.full(0x110000, _UNKNOWN, np.uint8)
_classes[WHITE] = SPACE


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; those not met before are looked up first."""
    out = _classes[points]
    new = out == _UNKNOWN
    if new.any():
        for i in np.unique(points[new]).tolist():
            _classes[i] = _KINDS.get(unicodedata.category(chr(i))[0], OTHER)
        out = _classes[points]
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def split(points: np.ndarray, at: np.ndarray, rules: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the texts that begin at ``at`` (code points).

    ``words`` keeps letter runs, single numbers, runs of other marks and contractions,
    and drops white space. ``spaced`` keeps every code point: a space joins the run after
    it, of longer white space all but the last code point is a piece of its own.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes(points)
    new = np.zeros(n + 1, bool)
    new[at] = True
    new[0] = new[n] = True
    new[1:n] |= kind[1:] != kind[:-1]
    if rules == "words":
        new[1:n] |= kind[1:] == NUMBER
    edge = np.zeros(n + 1, bool)
    edge[at] = edge[n] = True

    begin = np.flatnonzero(new[:n])
    end = np.append(begin[1:], n)
    alone = begin[(points[begin] == 39) & (end - begin == 1)]
    alone = alone[~edge[alone + 1]]
    if rules == "spaced":
        alone = alone[edge[alone] | (points[np.maximum(alone - 1, 0)] != 32)]
    if len(alone):
        taken = np.zeros(len(alone), np.int64)
        for text in CONTRACTIONS:
            fits = taken == 0
            for k, letter in enumerate(text[1:], 1):
                place = np.minimum(alone + k, n - 1)
                inside = (alone + k < n) & ~(edge[place] if k else False)
                fits &= inside & (points[place] == ord(letter))
            taken[fits] = len(text)
        here = taken > 0
        new[alone[here] + 1] = False
        new[alone[here] + taken[here]] = True
        begin = np.flatnonzero(new[:n])
        end = np.append(begin[1:], n)
    space = kind[begin] == SPACE
    if rules == "words":
        return begin[~space], end[~space]
    # the last white space before a run: joined to it if a space, else alone
    last = end - 1
    before = space & ~edge[end]
    joins = before & (points[last] == 32)
    new[last[before]] = True
    new[end[joins]] = False
    begin = np.flatnonzero(new[:n])
    return begin, np.append(begin[1:], n)


class PieceTable:
    """Token ids of the pieces met so far in this worker.

    Pieces of a slice are told apart by comparing their code points, pieces of different
    slices by their text. ``encode`` gives the ids of a list of pieces. Past about ``most``
    bytes the table starts anew, with ``keep`` from the pieces that most slices had, to half
    that size; a piece that is gone and met again is encoded again.
    """

    def __init__(self, encode, most: int = 32 << 20, keep: bool = False):
        self.encode, self.most, self.keep = encode, most, keep
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.held = 0
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keeps the pieces that several slices had, most often first, in half the bytes."""
        pieces, ids, begin, count, seen = list(self.slot), self.ids, self.begin, self.count, self.seen
        order = np.argsort(-seen, kind="stable")
        size = 160 + 2 * np.array([len(p) for p in pieces], np.int64) + 4 * count
        order = order[(np.cumsum(size[order]) <= self.most // 2) & (seen[order] > 1)]
        self.slot = {pieces[i]: k for k, i in enumerate(order.tolist())}
        self.held = int(size[order].sum())
        self.count = count[order]
        self.ids = ids[ragged(begin[order], self.count)]
        self.begin = np.cumsum(self.count) - self.count
        self.seen = seen[order] // 2  # what was met long ago counts less

    def look_up(self, text: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of every piece; new pieces are encoded first."""
        if self.held > self.most:
            self.shrink() if self.keep else self.clear()
        first = first_equal(points, begin, end)
        lead = np.flatnonzero(first == np.arange(len(first)))
        pieces = [text[b:e] for b, e in zip(begin[lead].tolist(), end[lead].tolist(), strict=True)]
        slots = [self.slot.get(p, -1) for p in pieces]
        new = [i for i, s in enumerate(slots) if s < 0]
        if new:
            ids, counts = self.encode([pieces[i] for i in new])
            base = len(self.count)
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(counts) - counts))
            self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
            self.count = np.concatenate((self.count, counts))
            self.seen = np.concatenate((self.seen, np.zeros(len(new), np.int64)))
            for k, i in enumerate(new):
                slots[i] = self.slot[pieces[i]] = base + k
            self.held += sum(160 + 2 * len(pieces[i]) for i in new) + 4 * len(ids)
        out = np.empty(len(first), np.int64)
        out[lead] = slots
        self.seen[slots] += 1  # pieces of a slice are distinct
        return out[first]
