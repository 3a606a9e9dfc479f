"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.session import scratch_path

# The bytes that separate words: space and the controls from tab to carriage return.
SPACES = b" \t\n\v\f\r"
# Text that is worked through at once: its arrays take some fifty times as much.
SLICE_BYTES = 1 << 20


# Bytes of an Arrow batch on its way to Python: buffers on both sides follow it, and texts come ten thousand to a batch by default.
ARROW_BYTES = 2 << 20
# What a module keeps in a worker between tasks, and how to let go of it.
_HELD: dict[str, Callable[[], None]] = {}


def held(name: str, clear: Callable[[], None]) -> None:
    """Say that a module keeps much in a worker, so that tasks of other operators can release it."""
    _HELD[name] = clear


def release(keeps: tuple[str, ...] = ()) -> None:
    """Let go of what modules other than ``keeps`` hold in this worker."""
    for name, clear in _HELD.items():
        if name not in keeps:
            clear()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session have at most ``ARROW_BYTES``, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, str(1 << 30))
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Later jobs read the written rows, so a lost executor costs a re-read and
    never another evaluation with other row ids.
    """
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict | None], keeps: tuple[str, ...] = ()) -> DataFrame:
    """Map every Arrow batch of ``df`` to the columns that ``work`` returns.

    What modules other than ``keeps`` hold in the worker is released first.
    """
    small_batches(df.sparkSession)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` text bytes, one row at least."""
    ends = utf8(batch.column(text))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one more entry than rows).

    A word is a longest run of bytes other than ``SPACES`` inside a row.
    """
    if not len(body):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~((body == 32) | ((body >= 9) & (body <= 13)))
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes, then mixed with its length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.empty(int(lengths.max()), np.uint64)
    powers[0] = 1
    if len(powers) > 1:
        powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, base))
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    at = np.arange(int(lengths.sum()))
    places = at + first
    inner = places - np.repeat(starts, lengths)
    terms = (body[places].astype(np.uint64) + np.uint64(1)) * powers[inner]
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


# Bits of the filter of ids: with it a broadcast has 131,072 rows at most, whatever the number of ids.
FILTER_BITS = 23


def possible(rows: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: false where ``key`` is surely not among the ids, so that such rows need no shuffle.

    One bit for each id's hash in a filter of fixed size, kept as words of 64
    bits. With very many ids it says "possible" more often; what is possible has
    to be joined with the ids in any case.
    """
    def place(column: str) -> str:
        # Hashes differ between integer types; ids come as long.
        return f"pmod(xxhash64(cast(`{column}` as long)), {1 << FILTER_BITS}L)"

    def word(column: str) -> Column:
        return F.expr(f"{place(column)} >> 6")

    def bit(column: str) -> Column:
        return F.expr(f"shiftleft(1L, cast({place(column)} & 63 as int))")

    words = ids.select(word(key).alias("__word"), bit(key).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.withColumns({"__at": word(key), "__own": bit(key)}).alias("r").join(
        F.broadcast(words).alias("w"), F.col("r.__at") == F.col("w.__word"), "left"
    )
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__own")) != 0, F.lit(False))
    return marked.select(*[F.col(f"r.`{c}`") for c in rows.columns], hit.alias(name))
