"""Token ids in files of bit planes.

A file table has one row per chunk: whole documents, in order, whose ids fill at
least ``CHUNK_IDS`` places. The ids of a chunk are cut into blocks of fixed size.
Each block is transposed into planes (bit k, or byte k, of all its ids side by
side) and every plane is compressed with zstandard. High planes are almost
constant and vanish. Before the planes stands a directory with the compressed
size of each, so that one block, or one plane of it, can be read alone.

Payload of a chunk, little-endian: magic ``GPL1``, u8 bits of a plane (1 or 8),
u8 number of planes, u16 zero, u32 ids of a block, u32 ids, u32 blocks; then u32
sizes, plane by plane within block by block; then the planes. ids_crc32 of the
index covers the ids, so a damaged chunk is noticed.

The rows are written by Spark as Parquet without a further codec, which works on
any store and commits whole tasks; ``index`` is the same table without payloads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanset.llm.common import per_batch
from gleanset.llm.tokens import vocabulary

MAGIC = b"GPL1"
HEADER = "<4sBBHIII"
BLOCK_IDS = 8192
CHUNK_IDS = 1 << 18
END = b"\0\0\0\0"
FILES = (
    "part int, chunk long, n_ids long, n_docs long, ids_crc32 long, doc_ids array<long>, lengths array<long>, "
    "payload binary"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block of ids, lowest first, up to the highest that holds anything."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(width)]
    spread = np.unpackbits(raw[:, :width], axis=1, bitorder="little")
    top = max(1, int(ids.max(initial=0)).bit_length())
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if bits == 8:
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        spread = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            spread[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        raw[:] = np.packbits(spread, axis=1, bitorder="little")
    return raw.view("<u4").ravel()


def encode_chunk(ids: np.ndarray, bits: int = 8, block: int = BLOCK_IDS, level: int = 1) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    blocks = [ids[at:at + block] for at in range(0, len(ids), block)]
    each = max((max(1, int(b.max()).bit_length()) for b in blocks), default=1)
    planes = each if bits == 1 else (each + 7) // 8
    parts = []
    for one in blocks:
        made = to_planes(one, bits)
        made += [b"\0" * len(made[0])] * (planes - len(made))
        parts.extend(press.compress(p) for p in made)
    sizes = struct.pack(f"<{len(parts)}I", *map(len, parts))
    return b"".join([struct.pack(HEADER, MAGIC, bits, planes, 0, block, len(ids), len(blocks)), sizes, *parts])


def decode_block(payload: bytes, number: int) -> np.ndarray:
    """The ids of one block of a chunk."""
    magic, bits, planes, _, block, n, blocks = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a chunk of planes")
    sizes = np.frombuffer(payload, "<u4", planes * blocks, struct.calcsize(HEADER)).astype(np.int64)
    at = struct.calcsize(HEADER) + 4 * len(sizes) + int(sizes[:number * planes].sum())
    press, parts = zstandard.ZstdDecompressor(), []
    for size in sizes[number * planes:(number + 1) * planes]:
        parts.append(press.decompress(payload[at:at + int(size)]))
        at += int(size)
    return from_planes(parts, min(block, n - number * block), bits)


def decode_chunk(payload: bytes) -> np.ndarray:
    blocks = struct.unpack_from(HEADER, payload)[-1]
    return np.concatenate([decode_block(payload, b) for b in range(blocks)]) if blocks else np.empty(0, "<u4")


def _chunks(docs: Iterator[tuple[int, int, bytes]], bits: int) -> Iterator[list]:
    """Rows of the file table from (part, doc_id, ids) in file order."""
    part, chunk, doc_ids, lengths, held = None, 0, [], [], []

    def row() -> list:
        ids = b"".join(held)
        return [
            part, chunk, len(ids) // 4, len(doc_ids), zlib.crc32(ids), list(doc_ids), list(lengths),
            encode_chunk(np.frombuffer(ids, "<u4"), bits),
        ]

    for at, doc_id, ids in docs:
        if doc_ids and (at != part or sum(lengths) >= CHUNK_IDS):
            yield row()
            chunk = chunk + 1 if at == part else 0
            doc_ids, lengths, held = [], [], []
        part = at
        doc_ids.append(doc_id)
        lengths.append(len(ids) // 4)
        held.append(ids)
    if doc_ids:
        yield row()


def write_files(docs: DataFrame, path: str, folder: str, bits: int = 8, parts: int | None = None) -> None:
    """Write the ids of all texts to ``folder``, in ascending ``doc_id`` order, null ids first.

    ``path`` names the vocabulary. Each document ends with id 0; a null text
    counts as empty and consists of that id. Rows that share an id are ordered
    by a hash of their text, so equal ids need not meet in one partition. One
    range sort moves the texts; ids are made behind it and go straight into
    planes. An empty table writes an empty folder. ``parts`` defaults to the
    session's shuffle partitions.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(path)

        def each() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                for part, doc_id, text in zip(batch.column("part"), batch.column("doc_id"), batch.column("text"), strict=True):
                    yield part.as_py(), doc_id.as_py(), encoder.ids(text.as_py() or "") + END

        for row in _chunks(each(), bits):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW.types, strict=True)], schema=_ARROW)

    placed = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    placed.mapInArrow(run, FILES).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(folder)


def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """(part, chunk, n_ids, n_docs, ids_crc32, start): the chunks and the ids before each."""
    rows = spark.read.parquet(folder).select("part", "chunk", "n_ids", "n_docs", "ids_crc32")
    sums = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return local.join(bases, "part").withColumn("start", F.col("base") + F.col("local")).drop("base", "local")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    Chunks are decoded where they are read. Only the place of a document within
    its chunk is known there; the chunk's own start comes from the index.
    """
    schema = "part int, chunk long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("part", "chunk", "doc_id", "at", "n_tokens", "ids_crc32", "ids")}
        for row in batch.to_pylist():
            ids = decode_chunk(row["payload"]).tobytes()
            if zlib.crc32(ids) != row["ids_crc32"]:
                raise ValueError(f"chunk {row['chunk']} of part {row['part']} is damaged")
            at = 0
            for doc_id, length in zip(row["doc_ids"], row["lengths"], strict=True):
                own = ids[4 * at:4 * (at + length)]
                for name, value in zip(out, (row["part"], row["chunk"], doc_id, at, length, zlib.crc32(own), own), strict=True):
                    if name != "ids" or with_ids:
                        out[name].append(value)
                at += length
        types = {"part": pa.int32(), "ids": pa.binary()}
        return {n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()}

    read = per_batch(spark.read.parquet(folder), schema, work, keeps=("tokens",))
    starts = chunk_index(spark, folder).select("part", "chunk", F.col("start").alias("__start"))
    placed = read.join(starts, ["part", "chunk"]).withColumn("start", F.col("__start") + F.col("at"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
