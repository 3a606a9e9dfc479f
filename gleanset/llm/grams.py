"""Hashed byte n-grams of whole texts, and counts of them over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import slices, utf8

BUCKETS = 1 << 16
GRAM = 4


def gram_buckets(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every ``GRAM`` bytes in a row that stand side by side, and the offsets of the rows in them."""
    n = max(0, len(body) - GRAM + 1)
    grams = np.zeros(n, np.uint32)
    for k in range(GRAM):
        grams |= body[k:k + n].astype(np.uint32) << np.uint32(8 * k)
    buckets = (grams * np.uint32(2654435761)) >> np.uint32(16)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        crossing = offsets[1:-1] - k
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    counts = np.maximum(0, np.diff(offsets) - GRAM + 1)
    return buckets[inside], np.concatenate(([0], np.cumsum(counts)))


def row_means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of the whole numbers of each row, 0 for a row without any; exact sums, so equal rows have equal means."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    counts = np.diff(offsets)
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, counts)


def gram_counts(rows: DataFrame, groups: int, group_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often each bucket occurs in the texts of each group, over all rows.

    ``group_of`` gives a group number per row of a batch, -1 for none. A task
    adds up its own rows and sends one row per bucket it has seen; what reaches
    the driver has ``groups * BUCKETS`` numbers at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((groups, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch):
                buckets, offsets = gram_buckets(*utf8(part.column("text")))
                group = np.repeat(group_of(part), np.diff(offsets))
                for g in range(groups):
                    counts[g] += np.bincount(buckets[group == g], minlength=BUCKETS)
        group, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[group, bucket])],
            names=["g", "bucket", "n"],
        )

    sums = rows.mapInArrow(run, "g int, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    out = np.zeros((groups, BUCKETS), np.int64)
    out[found.column("g").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def labelled_sample(labels: DataFrame, value: Column, most: int, seed: int) -> DataFrame:
    """(doc_id, label, fold): at most ``most`` labelled documents, those of least hash, in two folds.

    A document with several labels counts by the lowest. Labels other than 0 and
    1 and rows without an id are passed over.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), value.cast("int").alias("label")).filter(
        "doc_id IS NOT NULL AND label IN (0, 1)"
    )
    hashed = usable.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("__h", F.xxhash64("doc_id", F.lit(seed)))
    chosen = hashed.orderBy("__h", "doc_id").limit(most)
    return chosen.select("doc_id", "label", F.pmod("__h", F.lit(2)).cast("int").alias("fold"))
