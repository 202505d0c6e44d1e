"""Removal of long repeated byte strings with bounded suffix arrays.

A string of ``MIN_BYTES`` bytes that starts at two places of the corpus, in one document or
in two, is removed at both. Nothing of corpus size is ever sorted in one place:

1. Every window of ``MIN_BYTES`` bytes has an anchor, its least hashed ``GRAM``-byte string
   (the leftmost of equals). Equal windows have equal anchors at equal offsets, so windows
   can only repeat among regions (runs of windows with one anchor) of one anchor hash.
   Equal texts are first joined into one, equal regions (by MD5) counted before any shuffle
   of bytes; a region that occurs again is repeated as a whole.
2. A window has half of its bytes outside the anchor, or more, on one side of it. So of
   distinct regions of one anchor only those go on that share that many bytes on a side
   with another; their bytes are dealt by anchor hash.
3. A task builds the Burrows-Wheeler transform of a few megabytes of such groups. Breadth-
   first backward extension then derives common prefixes by increasing value: what is
   known to share exactly v bytes yields, one byte further left, those that share v + 1. It
   stops at ``MIN_BYTES``; neighbours without a value by then share the whole window. What
   no other region of the group can hold, by the ranges of step 4, is left out first.
4. A group of over ``HOT_REGIONS`` distinct regions is dealt again by more of the window:
   windows with l0 to l1 bytes left of the anchor share l0 bytes there and, on the right, what
   l1 leaves. Pieces of the regions meet by those bytes, equal pieces are counted, and groups
   still too large are dealt by narrower ranges, the last of one window. Each size of group
   thus comes to step 3 in pieces that fit, and no task holds more.

Repeated passages of over ``PASSAGE_WORDS`` words may be shorter than ``MIN_BYTES`` bytes. They
are kept, and counted apart, by words: a passage's least hashed stretch of 16 words, with 17
words more on one side of it, which any two copies share. ``n_passages`` is the number of
such stretches of a text that another document has.

Defined cases: null and empty texts have no bytes and keep all; equal texts of at least
``MIN_BYTES`` bytes lose all bytes, shorter ones none; rows with equal ids are documents of
their own; texts past ``_LONG_TEXT`` bytes are scanned in chunks; other columns of the input
are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import SPACE, cut, flat, mix, runs, slices, span_hashes

MIN_BYTES = 400
GRAM = 32
HOT_REGIONS = 2000
#: Bytes of regions in one suffix array; a group may add up to HOT_REGIONS regions to it.
BATCH_BYTES = 1 << 20
_PLACE_BITS = 24
_LONG_TEXT = 1 << 21
#: Words of a passage that is counted, and those of its anchor.
PASSAGE_WORDS, _PASSAGE_GRAM = 50, 16
#: A range of places of the anchor is dealt again in so many.
_FINER = 8
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two stretches as one of both."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` (a power of two) codes from each place on."""
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    while width < size:
        h = _joined(h[:-width], h[width:])
        width *= 2
    return mix(h)


def _least(gram: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of ``width`` hashes from each place on, the first of equals."""
    key, step = (gram & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(gram), dtype=np.uint64), 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    n = len(gram) - width + 1
    least = np.minimum(key[:n], key[width - step : width - step + n])
    return (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def passage_keys(data: np.ndarray, at: np.ndarray, words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the stretches of each text of a flat array that stand for its passages, each
    once in a text, end to end, and how many each text has."""
    starts, ends = runs(~SPACE[data], at)
    n, none = len(starts), (np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64))
    if n < words:
        return none
    h, doc = span_hashes(data, starts, ends), np.searchsorted(at, starts, "right") - 1
    gram = gram_hashes(h, _PASSAGE_GRAM)
    own = doc[: n - words + 1] == doc[words - 1 :]
    place = np.unique(_least(gram, words - _PASSAGE_GRAM + 1)[own])
    side = (words - _PASSAGE_GRAM) // 2
    left = place[place >= side]
    left = left[doc[left - side] == doc[left]]
    right = place[place + _PASSAGE_GRAM + side <= n]
    right = right[doc[right + _PASSAGE_GRAM + side - 1] == doc[right]]
    # a side is one word more than an anchor
    before = _joined(gram[left - side], h[left - 1])
    after = _joined(gram[right + _PASSAGE_GRAM], h[right + _PASSAGE_GRAM + side - 1])
    keys = np.concatenate((mix(_joined(before, gram[left])), mix(_joined(gram[right], after))))
    owner = doc[np.concatenate((left, right))]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.bincount(owner[new], minlength=len(at) - 1)


def anchors(data: np.ndarray, at: np.ndarray, size: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Regions of all texts in a flat array of under 2**24 bytes: first window (place in
    ``data``), number of windows, place of the anchor, anchor hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64)
    gram = gram_hashes(data)
    least = _least(gram, size - GRAM + 1)
    fits = np.zeros(n + 1, np.int32)
    own = np.flatnonzero(np.diff(at) >= size)
    np.add.at(fits, at[own], 1)
    np.add.at(fits, at[own + 1] - size + 1, -1)
    start = np.flatnonzero(np.cumsum(fits[: n - size + 1]))
    place = least[start]
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    head = np.flatnonzero(new)
    return start[head], np.diff(np.append(head, len(start))), place[head], gram[place[head]]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` sorted by their next ``depth`` bytes at least."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(word)
    new = np.ones(n + 1, bool)
    new[1:n] = word[order[1:]] != word[order[:-1]]
    # the rank of a place is where those with equal bytes begin; only ties are sorted on
    rank = np.zeros(2 * n + depth, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(1, n + 1), 0))
    known = 8
    while known < depth and len(tied := np.flatnonzero(~(new[:-1] & new[1:]))):
        own = order[tied]
        key = rank[own] * (n + 1) + rank[own + known]
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        fresh = np.ones(len(own), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[tied] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, tied + 1, 0))
        known *= 2
    return order


def long_prefix_classes(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of ``text`` and the class of each suffix in it: neighbours are of
    one class if they share ``size`` bytes. ``text`` ends with a byte not met elsewhere in
    the windows that the caller looks at."""
    n = len(text)
    order = suffix_order(text, size)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n)
    rank[n] = -1
    # boundary i stands between suffixes i-1 and i of the order; one byte to the right they
    # are the suffixes psi[i-1] and psi[i], and share a byte less
    psi = rank[order + 1]
    left, right = np.minimum(psi[:-1], psi[1:]), np.maximum(psi[:-1], psi[1:])
    first = text[order]
    known = np.zeros(n, bool)
    known[0] = True
    known[1:] = first[1:] != first[:-1]
    frontier = np.flatnonzero(known)
    open_ = ~known[1:]
    short = np.flatnonzero(open_ & (left < 0)) + 1
    # backward extension of a boundary between neighbours with the same byte before them
    # (a step inside a run of the transform) reaches one boundary; others span several
    single = np.flatnonzero(open_ & (left >= 0) & (right - left == 1))
    behind = np.full(n, -1, np.int64)
    behind[right[single]] = single + 1
    several = np.flatnonzero(open_ & (left >= 0) & (right - left > 1))
    several = several[np.argsort(left[several])]  # places near each other are read together
    several, low, high = several + 1, left[several], right[several]
    for value in range(1, size):
        found = behind[frontier]
        found = found[found >= 0]
        if len(several):
            if len(several) * 16 > n:
                seen = np.zeros(n, np.int32)
                seen[frontier] = 1
                seen = np.cumsum(seen)
                hit = seen[high] > seen[low]
            else:
                next_ = np.searchsorted(frontier, low, "right")
                hit = (next_ < len(frontier)) & (frontier[np.minimum(next_, len(frontier) - 1)] <= high) if len(frontier) else np.zeros(len(low), bool)
            found = np.concatenate((found, several[hit]))
            several, low, high = several[~hit], low[~hit], high[~hit]
        if value == 1:
            found = np.concatenate((found, short))
        found = found[~known[found]]
        if not len(found):
            break
        known[found] = True
        frontier = np.sort(found)
    return order, np.cumsum(known)


def repeated_windows(regions: list[bytes], size: int = MIN_BYTES) -> list[np.ndarray]:
    """Of each region which of its windows occur again in any of the regions."""
    lengths = np.array([len(r) + 1 for r in regions], np.int64)
    starts = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"\xff".join(regions) + b"\xff", np.uint8)
    order, cls = long_prefix_classes(text, size)
    steps = np.zeros(len(text) + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + np.maximum(lengths - size, 0), -1)
    window = np.cumsum(steps[:-1]) > 0
    inside = window[order]
    twice = np.bincount(cls[inside], minlength=int(cls[-1]) + 1) >= 2
    hit = np.zeros(len(text), bool)
    hit[order[inside]] = twice[cls[inside]]
    return [hit[s : s + max(n - size, 0)] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _spans_of(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2].tolist(), edge[1::2].tolist()


def _md5(raw: bytes) -> bytes:
    return hashlib.md5(raw, usedforsecurity=False).digest()


def _anchor_task(size: int):
    kinds = {"lo": pa.int64(), "m": pa.int64(), "a": pa.int64(), "h": pa.int64(), "rh": pa.binary(), "left": pa.binary(), "right": pa.binary()}
    side = (size - GRAM + 1) // 2

    def one(ids: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        if len(data) > _LONG_TEXT:  # one very long text: windows in chunks
            found = []
            for begin in range(0, len(data) - size + 1, _LONG_TEXT):
                piece = data[begin : begin + _LONG_TEXT + size - 1]
                lo, m, a, h = anchors(piece, np.array([0, len(piece)]), size)
                found.append((lo + begin, m, a + begin, h))
            lo, m, a, h = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            lo, m, a, h = anchors(data, at, size)
        owner = np.searchsorted(at, lo, "right") - 1
        counts = np.bincount(owner, minlength=len(at) - 1)
        raw = data.tobytes()
        rh, left, right = [], [], []
        for b, e, p in zip(lo.tolist(), (lo + m + size - 1).tolist(), a.tolist(), strict=True):
            rh.append(_md5(raw[b:e]))
            left.append(_md5(raw[p - side : p])[:8] if p - side >= b else None)
            p += GRAM
            right.append(_md5(raw[p : p + side])[:8] if p + side <= e else None)
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        values = (lo - at[owner], m, a - at[owner], h.view(np.int64), rh, left, right)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kinds[name])) for name, x in zip(kinds, values, strict=True)]
        keys = [_md5(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        stretches, of = passage_keys(data, at)
        passages = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(of))), pa.int32()), pa.array(stretches.view(np.int64)))
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(np.diff(at)), passages, *lists], ["doc_id", "tk", "n_bytes", "passages", *kinds])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                yield one(part.column(0), *flat(part.column(1)))

    return task


#: Part of a region: group and own key, the region, its first window there, the bytes left
#: of the anchor in the first window, those left and right bounds that its group shares.
_PIECES = "g binary, s binary, h long, rh binary, at long, left long, l0 long, l1 long, bytes binary"
_PIECE_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary()]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECE_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], [c.split()[0] for c in _PIECES.split(", ")])


def _region_task(size: int):
    """Regions of texts as pieces, whole ones: every place of the anchor may be met."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text, regions in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                for r in regions:
                    lo, end = r["lo"], r["lo"] + r["m"] + size - 1
                    rows.append((r["h"].to_bytes(8, "big", signed=True), r["rh"], r["h"], r["rh"], 0, r["a"] - lo, 0, size - GRAM, raw[lo:end]))
                    held += end - lo
                if held > 2 << 20:
                    yield _pieces(rows)
                    rows, held = [], 0
            yield _pieces(rows)

    return task


def _ranges(left: int, l0: int, l1: int, n_bytes: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Narrower ranges of bytes left of the anchor, and which of them a piece has."""
    step = max(1, (l1 - l0 + 1) // _FINER)
    last = left - (n_bytes - size)  # bytes left of the anchor in the last window
    for c0 in range(l0, l1 + 1, step):
        c1 = min(c0 + step - 1, l1)
        q0, q1 = max(c0, last), min(c1, left)
        if q0 <= q1:
            yield c0, c1, q0, q1


def finer(piece: tuple, size: int) -> Iterator[tuple]:
    """A piece in parts of fewer places of the anchor, each with the key of what all
    windows of its range share."""
    _, _, h, rh, at, left, l0, l1, raw = piece
    for c0, c1, q0, q1 in _ranges(left, l0, l1, len(raw), size):
        part = raw[left - q1 : left - q0 + size]
        yield _md5(b"%d,%d:" % (c0, c1) + raw[left - c0 : left - c1 + size]), _md5(part), h, rh, at + left - q1, q1, c0, c1, part


def alike(group: list[tuple], size: int) -> Iterator[tuple[int, int, int]]:
    """Of the pieces ``(left, l0, l1, bytes)`` of one group those with a window that may
    occur in another: its place, first and last such window. A window can only if all that
    its narrower range shares is in two pieces."""
    own = [[(c0, hash(raw[left - c0 : left - c1 + size]), q0, q1) for c0, c1, q0, q1 in _ranges(left, l0, l1, len(raw), size)] for left, l0, l1, raw in group]
    count = Counter(k[:2] for keys in own for k in keys)
    for i, keys in enumerate(own):
        met = [k for k in keys if count[k[:2]] > 1]
        if met:
            left = group[i][0]
            yield i, left - max(k[3] for k in met), left - min(k[2] for k in met)


def _finer_task(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = list(finer(piece, size))
                rows += own
                held += sum(len(x[-1]) for x in own)
                if held > 2 << 20:
                    yield _pieces(rows)
                    rows, held = [], 0
            yield _pieces(rows)

    return task


_FOUND = "h long, rh binary, s array<long>, e array<long>"


def _bwt_task(size: int):
    """Rows come sorted by group; whole groups are gathered into suffix arrays, without what
    no other piece of the group can hold."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([r[3] for r in rows], size)
        out: list[list] = [[], [], [], []]
        for (h, rh, at, _), f in zip(rows, flags, strict=True):
            if f.any():
                spans = ([x + at for x in side] for side in _spans_of(f))
                for column, value in zip(out, (h, rh, *spans), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "rh", "s", "e"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in itertools.groupby(every, lambda row: row[0]):
            pieces = list(group)
            for i, first, last in alike([p[4:] for p in pieces], size):
                _, h, rh, at, *_, raw = pieces[i]
                rows.append((h, rh, at + first, raw[first : last + size]))
                held += last - first + size
            if held > BATCH_BYTES:
                yield solve(rows)
                rows, held = [], 0
        if rows:
            yield solve(rows)

    return task


def _keep_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans of each text, and the hash of the bytes outside them."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for tk, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            raw, kept, at, starts, ends = (text or "").encode(), hashlib.sha256(), 0, [], []
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if ends and s <= ends[-1]:
                    ends[-1] = max(ends[-1], e)
                else:
                    starts.append(s)
                    ends.append(e)
            for s, e in zip(starts, ends, strict=True):
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            for column, value in zip(out, (tk, sum(ends) - sum(starts), kept.hexdigest(), starts, ends), strict=True):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["tk", "n_removed", "kept_sha256", "starts", "ends"])


def _near(shared: DataFrame) -> DataFrame:
    """Distinct regions that share an anchor and half a window beside it with another, and
    how many of their anchor do."""
    several = shared.where("kinds > 1").select("h", "rh", "at")
    sides = several.select("h", "rh", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("at.left").alias("v")), F.struct(F.lit(1).alias("side"), F.col("at.right").alias("v")))).alias("x")).select("h", "rh", "x.*").where("v is not null")
    again = sides.groupBy("h", "side", "v").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    near = cut(sides.join(again, ["h", "side", "v"]).select("h", "rh").distinct())
    return cut(near.join(near.groupBy("h").agg(F.count("*").alias("kinds")), "h").join(several, ["h", "rh"]))


def _repeated(pieces: DataFrame, hot: DataFrame, size: int, hot_regions: int) -> DataFrame:
    """``h, rh, s, e``: windows of regions that occur in another, of ``pieces`` in groups
    by ``g``; groups in ``hot`` are dealt by finer ranges until they fit."""
    n_parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(rows: DataFrame) -> DataFrame:
        dealt = rows.select("g", "h", "rh", "at", "left", "l0", "l1", "bytes").repartition(n_parts, "g").sortWithinPartitions("g")
        return dealt.mapInArrow(_bwt_task(size), _FOUND).select("h", "rh", F.explode(F.arrays_zip("s", "e")).alias("x")).select("h", "rh", "x.s", "x.e")

    if hot.isEmpty():
        return solve(pieces)
    pieces = cut(pieces)  # read for both parts
    found = [solve(pieces.join(hot, "g", "left_anti"))]
    while not hot.isEmpty():
        parts = cut(pieces.join(hot, "g", "left_semi").select(*pieces.columns).mapInArrow(_finer_task(size), _PIECES))
        kinds = parts.groupBy("g", "s").agg(F.count("*").alias("n"))
        groups = cut(kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1").drop("all"))
        again = parts.join(cut(kinds.where("n > 1").select("g", "s")), ["g", "s"])
        found.append(again.select("h", "rh", F.col("at").alias("s"), (F.col("at") + F.octet_length("bytes") - (size - 1)).alias("e")))
        # one piece of equal ones meets the others of its group
        others = parts.join(groups.where("kinds > 1").select("g"), "g", "left_semi")
        rest = [c for c in parts.columns if c not in ("g", "s")]
        pieces = cut(others.groupBy("g", "s").agg(F.first(F.struct(*rest)).alias("x")).select("g", "s", "x.*"))
        hot = groups.where(F.col("kinds") > hot_regions).select("g")
        found.append(solve(pieces.join(hot, "g", "left_anti")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, size: int = MIN_BYTES, hot_regions: int = HOT_REGIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, n_passages`` of each
    row of ``docs``; the spans are byte offsets of the maximal removed runs."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    key = F.unhex(F.md5("text")).alias("tk")

    names = ["lo", "m", "a", "h", "rh", "left", "right"]
    scanned = docs.mapInArrow(_anchor_task(size), "doc_id long, tk binary, n_bytes long, passages array<long>, lo array<long>, m array<long>, a array<long>, h array<long>, rh array<binary>, left array<binary>, right array<binary>")
    texts = cut(scanned.groupBy("tk").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("passages").alias("passages"), F.first(F.arrays_zip(*names)).alias("regions")))
    every = texts.select("tk", "rep", "copies", F.explode("regions").alias("r")).select("tk", "rep", "copies", *(F.col(f"r.{c}") for c in names))
    distinct = every.groupBy("h", "rh").agg(F.sum("copies").alias("n"), F.min(F.struct("tk", "rep", "lo", "m", "a", "left", "right")).alias("at"))
    groups = distinct.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1").select("h", "kinds")
    shared = cut(distinct.join(groups, "h"))

    near = _near(shared)
    wanted = near.groupBy("at.tk", "at.rep").agg(F.collect_list(F.struct("h", "rh", "at.lo", "at.m", "at.a")).alias("regions"))
    source = docs.select(key, F.coalesce("doc_id", F.lit(-1)).alias("rep"), "text")
    fetched = source.join(wanted.hint("shuffle_hash"), ["tk", "rep"]).select("text", "regions")
    hot = near.where(F.col("kinds") > hot_regions).select(F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("g")).distinct()
    found = _repeated(fetched.mapInArrow(_region_task(size), _PIECES), hot, size, hot_regions)
    # a region that occurs once is where it was first seen; others are looked up everywhere
    once = found.join(shared.where("n = 1").select("h", "rh", "at"), ["h", "rh"]).select("at.tk", "at.rep", (F.col("at.lo") + F.col("s")).alias("s"), (F.col("at.lo") + F.col("e") + (size - 1)).alias("e"))
    often = every.where("copies = 1").join(shared.where("n > 1").select("h", "rh"), ["h", "rh"]).select("tk", "rep", F.col("lo").alias("s"), (F.col("lo") + F.col("m") + (size - 1)).alias("e"))
    spans = cut(once.unionByName(often).groupBy("tk", "rep").agg(F.collect_set(F.struct("s", "e")).alias("spans")))

    partial = source.join(spans.hint("shuffle_hash"), ["tk", "rep"]).select("tk", "text", "spans").mapInArrow(_keep_task, "tk binary, n_removed long, kept_sha256 string, starts array<long>, ends array<long>").dropDuplicates(["tk"])
    whole = texts.where(f"copies > 1 and n_bytes >= {size}").select("tk", F.col("n_bytes").alias("n_removed"), F.lit(_EMPTY_SHA).alias("kept_sha256"), F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"))
    results = whole.unionByName(partial.join(whole.select("tk"), "tk", "left_anti"))
    stretches = texts.select("tk", "copies", F.explode("passages").alias("p"))
    elsewhere = stretches.groupBy("p").agg(F.sum("copies").alias("c")).where("c > 1").select("p")
    passages = stretches.join(elsewhere, "p").groupBy("tk").agg(F.count("*").alias("n_passages"))
    listed = docs.select("doc_id", key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    none = F.array().cast("array<long>")
    return listed.join(results, "tk", "left").join(passages, "tk", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
    )
