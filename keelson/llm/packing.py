"""Documents packed into training sequences of several context sizes.

Each task encodes its documents once and packs about ``BUFFER_IDS`` ids at a time:

1. Of a document longer than the longest window, full windows are cut off; what is left, like
   any shorter document, is routed to the smallest tier (context size) that holds it.
2. Tiers are packed from the longest down. A window opens with the longest piece of its tier;
   its gap is filled with whole pieces of shorter tiers, the longest that fits first, and at last
   by cutting a longer piece, so every window is exactly full. No fragment gets shorter than
   ``LEAST_PIECE`` ids where another choice is left.
3. Full windows of a tier leave the buffer in an order that spreads their attention cost (the
   sum of squared piece lengths) evenly; step groups are runs of that order with
   ``step_ids`` ids each, so groups hold equal numbers of ids and about equal cost.

What does not fill a window goes on to the next buffer. What a task has left at its end, less than
a window, is packed once more with that of ``TAIL_TASKS`` neighbouring tasks; the last ids of such a
group become windows of smaller and smaller powers of two, so that nothing is padded.

Sequences are rows of Parquet files in a shared folder (``SEQUENCES``): their ids as little-endian
integers of ``id_bytes`` bytes, and the pieces they consist of. Texts are never shuffled.

Defined cases: a null or empty text is its end id alone; rows with one id, or none, are documents of
their own; a very long text is one document in memory, cut as any other; an empty table gives no
sequences; further columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import ragged, scratch, slices
from keelson.llm.tokenfile import encoder

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BUFFER_IDS = 1 << 20
LEAST_PIECE = 32
TAIL_TASKS = 64
STEP_IDS = 1 << 17

PIECE = "struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint>"
#: ``sequence_id`` is null in the rows that tasks leave over; ``nth`` counts a part's windows of a tier.
SEQUENCES = f"sequence_id bigint, part bigint, tier int, nth bigint, cost bigint, id_bytes int, ids binary, pieces array<{PIECE}>"


class _Pool:
    """Pieces by length: the longest, the longest up to a bound, the shortest from a bound on."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(lengths, kind="stable")
        self.sizes, at = np.unique(lengths[order], return_index=True)
        self.held = {n: deque(x.tolist()) for n, x in zip(self.sizes.tolist(), np.split(order, at[1:]), strict=True)} if len(order) else {}
        self.sizes = self.sizes.tolist()

    def put(self, length: int, piece: int) -> None:
        if length not in self.held:
            self.held[length] = deque()
            bisect.insort(self.sizes, length)
        self.held[length].append(piece)

    def take(self, length: int) -> int:
        piece = self.held[length].popleft()
        if not self.held[length]:
            del self.held[length]
            del self.sizes[bisect.bisect_left(self.sizes, length)]
        return piece

    def up_to(self, bound: int) -> int:
        """The longest length up to ``bound``, 0 if there is none."""
        at = bisect.bisect_right(self.sizes, bound)
        return self.sizes[at - 1] if at else 0

    def longest(self) -> int:
        return self.sizes[-1] if self.sizes else 0


def pack(starts: np.ndarray, lengths: np.ndarray, tiers: tuple[int, ...] = TIERS, least: int = LEAST_PIECE) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows ``(tier, [(piece, start, length), ...])`` that are exactly full, and what is left,
    less than a window; ``piece`` is the place of the piece given, ``start`` an id of its own."""
    longest, windows = tiers[-1], []
    whole = lengths // longest
    starts, lengths = starts.copy(), lengths.copy()
    for i in np.flatnonzero(whole).tolist():
        windows += [(longest, [(i, int(starts[i]) + k * longest, longest)]) for k in range(int(whole[i]))]
    starts, lengths = starts + whole * longest, lengths - whole * longest
    kept = np.flatnonzero(lengths)
    pool = _Pool(lengths[kept])
    kept, begins = kept.tolist(), starts.tolist()

    def add(window: list, length: int, part: int | None = None) -> int:
        """A piece of that length goes into the window, or the first ``part`` ids of it."""
        at = pool.take(length)
        i = kept[at]
        n = part or length
        window.append((i, begins[i], n))
        if n < length:
            begins[i] += n
            pool.put(length - n, at)
        return n

    left: list[tuple[int, int, int]] = []
    for place in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[place], tiers[place - 1] if place else 0
        while (n := pool.up_to(tier)) > below:
            window: list = []
            gap = tier - add(window, n)
            while gap and pool.sizes:
                if (n := pool.up_to(gap)) == gap or (n := pool.up_to(gap - least)):
                    gap -= add(window, n)
                elif (n := pool.longest()) > gap:
                    gap -= add(window, n, gap)
                else:  # every piece left is shorter than the gap, by a little
                    gap -= add(window, n)
            if gap:
                left += window
            else:
                windows.append((tier, window))
    return windows, left


def spread(costs: np.ndarray) -> np.ndarray:
    """An order in which any run of windows has about the same mean cost: ranks by cost,
    visited by steps of the golden ratio."""
    place = np.argsort(np.modf(np.arange(len(costs)) * 0.6180339887498949)[0], kind="stable")
    return np.argsort(costs, kind="stable")[np.argsort(place, kind="stable")]


def finish(left: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """All of ``left`` as windows whose sizes are the powers of two that add up to it."""
    total, windows = sum(n for _, _, n in left), []
    rest = deque(left)
    for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        window, gap = [], size
        while gap:
            i, s, n = rest.popleft()
            if n > gap:
                rest.appendleft((i, s + gap, n - gap))
                n = gap
            window.append((i, s, n))
            gap -= n
        windows.append((size, window))
    return windows


_PIECE = pa.struct([(name, pa.int64()) for name in ("doc_id", "start", "length", "doc_tokens", "offset")])
_ROW = pa.schema([("sequence_id", pa.int64()), ("part", pa.int64()), ("tier", pa.int32()), ("nth", pa.int64()), ("cost", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])


class _Packer:
    """Holds documents' ids, and gives rows of ``SEQUENCES``; ``part`` numbers the task."""

    def __init__(self, part: int, tiers: tuple[int, ...], id_bytes: int):
        self.part, self.tiers, self.id_bytes = part, tiers, id_bytes
        self.nth: dict[int, int] = {}
        self.made = 0
        self.ids: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, ids: np.ndarray, doc_ids: list, starts: np.ndarray, lengths: np.ndarray, doc_tokens: np.ndarray) -> None:
        """Pieces whose ids stand end to end in ``ids``."""
        self.ids.append(ids)
        self.rows.append((doc_ids, starts, lengths, doc_tokens))
        self.held += len(ids)

    def flush(self, last: str = "") -> Iterator[pa.RecordBatch]:
        """The full windows of what is held. The rest is held on, or given as one row for the
        next pass (``leave``), or as windows of smaller powers of two (``finish``)."""
        if not self.held:
            return
        ids = np.concatenate(self.ids).astype(f"<u{self.id_bytes}")
        doc_ids = [d for r in self.rows for d in r[0]]
        starts, lengths, doc_tokens = (np.concatenate([r[k] for r in self.rows]).astype(np.int64) for k in (1, 2, 3))
        at = np.cumsum(lengths) - lengths
        windows, left = pack(at, lengths, self.tiers)
        windows += finish(left) if last == "finish" else []
        by_tier: dict[int, list] = {}
        for tier, window in windows:
            by_tier.setdefault(tier, []).append(window)
        ordered = [(tier, w) for tier, ws in sorted(by_tier.items()) for w in map(ws.__getitem__, spread(np.array([sum(n * n for _, _, n in w) for w in ws])).tolist())]
        self.ids, self.rows, self.held = [], [], 0
        if left and last == "leave":
            ordered.append((0, left))
        elif left and not last:
            i, s, n = np.array(left, np.int64).T
            self.add(ids[ragged(s, n)], [doc_ids[k] for k in i.tolist()], starts[i] + s - at[i], n, doc_tokens[i])
        if ordered:
            yield self._batch(ordered, ids, at, doc_ids, starts, doc_tokens)

    def _batch(self, ordered: list, ids: np.ndarray, at: np.ndarray, doc_ids: list, starts: np.ndarray, doc_tokens: np.ndarray) -> pa.RecordBatch:
        i, s, n = np.array([p for _, w in ordered for p in w], np.int64).T
        sizes = np.array([len(w) for _, w in ordered])
        first = np.cumsum(sizes) - sizes
        total = np.add.reduceat(n, first)
        ends = np.cumsum(n)
        offset = ends - n - np.repeat(ends[first] - n[first], sizes)
        raw = ids[ragged(s, n)].tobytes()
        bounds = np.concatenate(([0], np.cumsum(total))) * self.id_bytes
        columns = [doc_ids[k] for k in i.tolist()], starts[i] + s - at[i], n, doc_tokens[i], offset
        pieces = pa.ListArray.from_arrays(pa.array(np.append(first, len(n)), pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_PIECE)))
        names, nth = [], []
        for tier, _ in ordered:
            nth.append(k := self.nth.get(tier, 0))
            self.nth[tier] = k + 1
            names.append(self.part << 32 | self.made if tier else None)
            self.made += tier > 0
        tiers = [tier for tier, _ in ordered]
        whole = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        rest = [pa.array(x, f.type) for x, f in zip((names, [self.part] * len(tiers), tiers, nth, np.add.reduceat(n * n, first), [self.id_bytes] * len(tiers), whole), _ROW, strict=False)]
        return pa.RecordBatch.from_arrays([*rest, pieces], schema=_ROW)


def write(docs: DataFrame, path: str, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, buffer_ids: int = BUFFER_IDS, tail_tasks: int = TAIL_TASKS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and pack them into the files at ``path``; ``tiers`` are powers of two."""
    if list(tiers) != sorted({1 << t.bit_length() - 1 for t in tiers}):
        raise ValueError("tiers are ascending powers of two")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer_path, END_ID)
        packer = _Packer(TaskContext.get().partitionId(), tiers, own.id_bytes)
        for batch in batches:
            for lo, hi in slices(batch.column(1), 3 << 20):  # more text, fewer pieces looked up twice
                ids, counts = own.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                packer.add(ids, batch.column(0).slice(lo, hi - lo).to_pylist(), np.zeros(hi - lo, np.int64), counts, counts)
                if packer.held >= buffer_ids:
                    yield from packer.flush()
        yield from packer.flush("leave")

    def second(key: tuple, left: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in left:
            for row in batch.to_pylist():
                packer = packer or _Packer((1 << 30) + key[0].as_py(), tiers, row["id_bytes"])
                columns = {k: [p[k] for p in row["pieces"]] for k in ("doc_id", "start", "length", "doc_tokens")}
                packer.add(np.frombuffer(row["ids"], f"<u{row['id_bytes']}"), *(columns["doc_id"], *(np.array(columns[k], np.int64) for k in ("start", "length", "doc_tokens"))))
        yield from packer.flush("finish")

    docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(first, SEQUENCES).write.parquet(f"{path}/tasks")
    left = docs.sparkSession.read.schema(SEQUENCES).parquet(f"{path}/tasks").where("sequence_id is null")
    # a group is at most ``tail_tasks`` rows of less than a window each
    left.groupBy(F.floor(F.col("part") / tail_tasks).cast("long").alias("group")).applyInArrow(second, SEQUENCES).write.parquet(f"{path}/tails")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The sequences at ``path``, as ``SEQUENCES`` says."""
    return spark.read.schema(SEQUENCES).parquet(f"{path}/tasks", f"{path}/tails").where("sequence_id is not null")


def step_groups(sequences: DataFrame, step_ids: int = STEP_IDS) -> DataFrame:
    """``sequence_id, tier, step_group``: runs of windows of one tier with ``step_ids`` ids each, the
    last of a tier shorter. Windows are numbered by task and place there; only one row per
    task and tier is added up."""
    sizes = sequences.groupBy("tier", "part").agg(F.count("*").alias("n"))
    over = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("tier", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    run = F.greatest(F.lit(1), F.lit(step_ids).cast("long") / F.col("tier")).cast("long")
    return sequences.join(before, ["tier", "part"]).select("sequence_id", "tier", F.floor((F.col("before") + F.col("nth")) / run).alias("step_group"))


def pieces_of(sequences: DataFrame) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier`` of each piece, from
    the ids in the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, tier, id_bytes, ids, pieces = (batch.column(k) for k in range(5))
            flat = pieces.flatten()
            counts = pieces.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(batch)), counts)
            offset, length = (flat.field(k).to_numpy() for k in (4, 2))
            raw = [np.frombuffer(x, f"<u{b}").astype("<u4") for x, b in zip(ids.to_pylist(), id_bytes.to_pylist(), strict=True)]
            crc = [zlib.crc32(raw[w][a : a + n]) for w, a, n in zip(of.tolist(), offset.tolist(), length.tolist(), strict=True)]
            columns = [flat.field(0), flat.field(1), flat.field(2), pa.array(crc, pa.int64()), flat.field(3), sequence.take(pa.array(of)), flat.field(4), tier.take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier"])

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int"
    return sequences.select("sequence_id", "tier", "id_bytes", "ids", "pieces").mapInArrow(task, kinds)


def write_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    path = path or scratch(docs.sparkSession)
    write(docs, path, tokenizer_path)
    return pieces_of(read(docs.sparkSession, path))
