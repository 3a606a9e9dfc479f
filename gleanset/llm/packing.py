"""Best-fit packing of documents into sequences by linear grouping.

The packing is decided on the histogram of lengths, which has at most as many
entries as a sequence has tokens, whatever the number of documents:

1. Large lengths are sorted and split into groups of equal cardinality; within a
   group every length is rounded up to the group's longest.
2. The few sizes are combined into configurations. Each takes the longest size
   that is left and, by dynamic programming over the sizes left, the fullest
   completion; it is used as often as its sizes last.
3. Actual lengths take the places of the rounded ones. Runs of equal sequences
   stay together as one entry, so the room that is really left is known.
4. Small lengths go, longest first, where the least room is left over.

What comes out is a short list of runs: "documents of this length with these
ranks go to these sequences at this offset". Ranks within a length are then
computed on the cluster and looked up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset.llm.common import per_batch, settled
from gleanset.llm.tokens import vocabulary

CAPACITY = 2048
# What counts as large, as parts of the capacity, and the number of groups. Which serves best depends on how many
# short documents there are to fill gaps; each plan takes a second, so all are made and the shortest is used.
LARGE = (2, 3, 4, 8, 16)
GROUPS = 256
RUN_ROWS = 20_000
END = b"\0\0\0\0"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id 0.

    Documents longer than ``capacity`` are cut into pieces of that length, the
    last one shorter. ``start`` counts the document's ids before the piece.
    Null texts count as empty and consist of the end id alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def work(batch: pa.RecordBatch) -> dict:
        encoder, step = vocabulary(path), 4 * capacity
        rows, numbers, starts, lengths, sums, parts = [], [], [], [], [], []
        for row, value in enumerate(batch.column("text")):
            ids = encoder.ids(value.as_py() or "") + END
            for number, at in enumerate(range(0, len(ids), step)):
                part = ids[at:at + step]
                rows.append(row)
                numbers.append(number)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
                if with_ids:
                    parts.append(part)
        return {
            "doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())),
            "piece": pa.array(numbers, pa.int32()), "start": pa.array(starts, pa.int64()),
            "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
            "ids": pa.array(parts, pa.binary()),
        }

    return per_batch(docs.select("doc_id", "text"), schema, work, keeps=("tokens",))


class Run(NamedTuple):
    """Documents of ``length`` with ranks ``first`` to ``first + count`` go to sequences from ``sequence`` on."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


class _Plan:
    """The runs so far, the documents left of each length, and the room left in sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(histogram)
        self.used = defaultdict(int)
        self.runs: list[Run] = []
        self.sequences = 0
        self.room: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
        self.rooms: list[int] = []

    def take(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def open(self, count: int) -> tuple[int, int]:
        first, self.sequences = self.sequences, self.sequences + count
        return first, count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room:
            if not self.room[room]:
                bisect.insort(self.rooms, room)
            self.room[room].append((sequence, count))

    def place_small(self, length: int) -> None:
        """Best fit of all documents of one length, run by run."""
        while self.left[length]:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                self.leave(self.capacity, *self.open(-(-self.left[length] // (self.capacity // length))))
                continue
            room = self.rooms[at]
            sequence, count = self.room[room].popleft()
            some = min(count, self.left[length])
            if some < count:
                self.room[room].appendleft((sequence + some, count - some))
            elif not self.room[room]:
                self.rooms.pop(at)
            self.take(length, some, sequence, self.capacity - room)
            self.leave(room - length, sequence, some)


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, deque[list[int]]]]:
    """Groups of equal cardinality of (length, count), longest first: the rounded size and its actual lengths."""
    total = sum(c for _, c in lengths)
    each = -(-total // groups) if total else 1
    out: list[tuple[int, deque[list[int]]]] = []
    room = 0
    for length, count in lengths:
        while count:
            if not room:
                room = each
                if not out or out[-1][0] != length:
                    out.append((length, deque()))
            some = min(room, count)
            out[-1][1].append([length, some])
            room, count = room - some, count - some
    return out


def fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size fill ``room`` best, longer sizes first among equals."""
    last = np.full(room + 1, -1, np.int64)
    last[0] = len(sizes)
    steps = []
    for i, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        used = np.full(room + 1, -1, np.int64)
        used[last >= 0] = 0
        for k in range(1, min(count, room // size) + 1 if size <= room else 1):
            new = np.zeros(room + 1, bool)
            new[size:] = (used[:-size] == k - 1) & (used[size:] < 0)
            if not new.any():
                break
            used[new] = k
            last[new] = i
        steps.append(used)
        if last[room] >= 0:
            break
    fill = int(np.flatnonzero(last >= 0)[-1])
    chosen = [0] * len(sizes)
    for i in range(len(steps) - 1, -1, -1):
        chosen[i] = int(steps[i][fill])
        fill -= chosen[i] * sizes[i]
    return chosen


def plan(
    histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE
) -> list[Run]:
    """Where the documents of each length go: the plan with the fewest sequences over all ``large``."""
    plans = [_planned(histogram, capacity, groups, part) for part in large]
    return min(plans, key=lambda p: p.sequences).runs


def _planned(histogram: dict[int, int], capacity: int, groups: int, large: int) -> _Plan:
    """Lengths of at least 1/``large`` of the capacity are grouped, the rest is filled in."""
    made = _Plan({n: c for n, c in histogram.items() if c}, capacity)
    if made.left.get(capacity):
        made.take(capacity, made.left[capacity], *made.open(made.left[capacity])[:1], 0)
    lengths = sorted(((n, c) for n, c in made.left.items() if c and n * large >= capacity), reverse=True)
    sizes = grouped(lengths, groups)
    rounded = [size for size, _ in sizes]
    left = [sum(c for _, c in own) for _, own in sizes]
    while any(left):
        top = next(i for i, n in enumerate(left) if n)
        spare = [n - (i == top) for i, n in enumerate(left)]
        mix = fullest(rounded[top:], spare[top:], capacity - rounded[top])
        mix = [0] * top + [n + (i == 0) for i, n in enumerate(mix)]
        times = min(n // m for n, m in zip(left, mix, strict=True) if m)
        _substitute(made, sizes, mix, times)
        left = [n - m * times for n, m in zip(left, mix, strict=True)]
    for length in sorted((n for n, c in made.left.items() if c), reverse=True):
        made.place_small(length)
    return made


def _substitute(made: _Plan, sizes: list[tuple[int, deque[list[int]]]], mix: list[int], times: int) -> None:
    """Fill ``times`` sequences of one configuration with actual documents."""
    open_runs = [(*made.open(times), 0)]
    for (_, own), number in zip(sizes, mix, strict=True):
        for _ in range(number):
            filled = []
            for sequence, count, offset in open_runs:
                while count:
                    length, there = own[0]
                    some = min(there, count)
                    made.take(length, some, sequence, offset)
                    filled.append((sequence, some, offset + length))
                    sequence, count = sequence + some, count - some
                    own[0][1] -= some
                    if not own[0][1]:
                        own.popleft()
            open_runs = filled
    for sequence, count, offset in open_runs:
        made.leave(made.capacity - offset, sequence, count)


def ranked(rows: DataFrame, key: str, counts: dict[int, int], uid: str = "uid", most: int = RUN_ROWS) -> DataFrame:
    """Number the rows of each key from 0 in ``rank``.

    ``counts`` are the rows of each key, for few keys. A key with more than
    ``most`` rows is split by a hash of the row's own number: counts of the
    parts give each its first rank, and a window numbers the rows of a part.
    """
    spark = rows.sparkSession
    parts = spark.createDataFrame([(k, -(-n // most)) for k, n in counts.items()], f"{key} long, __parts long")
    dealt = rows.join(F.broadcast(parts), key).withColumn("__part", F.pmod(F.xxhash64(uid), F.col("__parts")))
    sums = dealt.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(key, "__part").orderBy(uid)) - 1
    numbered = dealt.withColumn("__in", inside).join(bases, [key, "__part"])
    return numbered.withColumn("rank", F.col("__base") + F.col("__in")).drop("__parts", "__part", "__base", "__in")


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`pieces`.

    No piece shares tokens of its sequence with another, offsets leave no gaps
    from 0 on, and no sequence holds more than ``capacity`` tokens. Repeated
    rows and null ids are packed like any other row. An empty table gives an
    empty table. The pieces are written once to the shared folder, so that each
    keeps its number.
    """
    rows = settled(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan(counts, capacity, groups))
    firsts = np.array([(r.length, r.first, r.sequence, r.offset) for r in runs], np.int64).reshape(-1, 4)
    starts = np.searchsorted(firsts[:, 0], np.arange(capacity + 2))
    keep = [f for f in rows.schema.fields if f.name != "uid"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", sequence_id long, offset long"

    def place(batch: pa.RecordBatch) -> dict:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            low, high = starts[n], starts[n + 1]
            at[own] = low + np.searchsorted(firsts[low:high, 1], rank[own], "right") - 1
        return {f.name: batch.column(f.name) for f in keep} | {
            "sequence_id": firsts[at, 2] + rank - firsts[at, 1], "offset": firsts[at, 3]
        }

    return per_batch(ranked(rows, "length", counts), schema, place)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of each sequence of packed pieces that carry ``ids``.

    A sequence is bounded by the capacity, so it fits one row.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
