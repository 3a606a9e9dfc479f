"""Token counts of every prefix, stored once and asked often."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gleanset.llm.common import per_batch
from gleanset.llm.tokens import prefix_counts

TABLE = "doc_id long, n_bytes long, n_chars long, n_tokens long, width int, changes binary"


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """One row per document with the token count of every prefix of its text.

    ``changes`` holds, for each character, the change of the count, as integers
    of ``width`` bytes under zstandard. Null texts count as empty: no
    characters, no tokens. Rows stay apart, so repeated rows give repeated rows
    and a null id stays null. Only ``doc_id`` and ``text`` are read. Every row is
    worked out alone: no shuffle, and an empty table gives an empty table.
    """

    def work(batch: pa.RecordBatch) -> dict:
        counter, press = prefix_counts(path), zstandard.ZstdCompressor(level=1)
        out: dict[str, list] = {"n_bytes": [], "n_chars": [], "n_tokens": [], "width": [], "changes": []}
        for value in batch.column("text"):
            text = value.as_py() or ""
            counts = counter.counts(text)
            changes = np.diff(counts, prepend=0)
            small = not len(changes) or (changes.min() >= -128 and changes.max() <= 127)
            out["n_bytes"].append(len(text) if text.isascii() else len(text.encode()))
            out["n_chars"].append(len(text))
            out["n_tokens"].append(int(counts[-1]) if len(counts) else 0)
            out["width"].append(1 if small else 4)
            out["changes"].append(press.compress(changes.astype("<i1" if small else "<i4").tobytes()))
        types = {"width": pa.int32(), "changes": pa.binary()}
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | {
            n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()
        }

    return per_batch(docs.select("doc_id", "text"), TABLE, work, keeps=("tokens",))


def stored_counts(width: int, changes: bytes) -> np.ndarray:
    """The counts that a row of :func:`prefix_table` holds: entry i belongs to the first i + 1 characters."""
    plain = zstandard.ZstdDecompressor().decompressobj().decompress(changes)
    return np.cumsum(np.frombuffer(plain, "<i1" if width == 1 else "<i4"), dtype=np.int64)


def within_budget(table: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting_chars), read from a prefix table.

    ``fitting_chars`` is the length of the longest prefix of at most ``limit``
    tokens: where to cut a text that is over the limit. Nothing is encoded again.
    """

    def work(batch: pa.RecordBatch) -> dict:
        tokens, fitting = [], []
        for width, changes in zip(batch.column("width").to_pylist(), batch.column("changes").to_pylist(), strict=True):
            counts = stored_counts(width, changes)
            tokens.append(int(counts[-1]) if len(counts) else 0)
            fits = np.flatnonzero(counts <= limit)
            fitting.append(int(fits[-1]) + 1 if len(fits) else 0)
        return {
            "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
            "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([t > limit for t in tokens], pa.bool_()),
            "fitting_chars": pa.array(fitting, pa.int64()),
        }

    return per_batch(table, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long", work, keeps=("tokens",))


def tokens_of_prefix(table: DataFrame, chars: int) -> DataFrame:
    """(doc_id, n_tokens) of the first ``chars`` characters of each text, the whole text if it is shorter."""

    def work(batch: pa.RecordBatch) -> dict:
        found = []
        for width, changes in zip(batch.column("width").to_pylist(), batch.column("changes").to_pylist(), strict=True):
            counts = stored_counts(width, changes)[:chars]
            found.append(int(counts[-1]) if len(counts) else 0)
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(found, pa.int64())}

    return per_batch(table, "doc_id long, n_tokens long", work, keeps=("tokens",))
