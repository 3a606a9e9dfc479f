"""Exact inner-product search over norm-sorted vectors.

Vectors are turned to whole numbers, so scores are exact. A rotation from the
singular vectors of the whole table moves most of every vector into its first
coordinates. Candidates stand in blocks by descending length. For a block, the sum
over the first rotated coordinates plus the product of the two remaining lengths
bounds each score (Cauchy-Schwarz); only pairs whose bound reaches the query's
k-th best score so far are summed on, and once the lengths alone cannot reach it
the query is done.

Every query block first meets the block of the longest candidates, which gives
each query a bar. A candidate block is sent to a query block only if the product
of its longest vector with a query's length reaches the query's bar, so what the
bounds exclude by lengths alone is not copied. Each task takes one query block and
a share of the candidate blocks and sends on its k best per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.llm.common import per_batch, settled

SCALE = 256
TOP = 5
BLOCK = 4096
QUERIES = 1024
# Candidate blocks that one task goes through for a query block.
SHARE = 64
# Rotated coordinates, as parts of all, after which pairs are dropped.
STEPS = (8, 3)
# Bounds come from rotated floating-point sums of whole numbers; half a unit covers their error.
SLACK = 0.5


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, norm, cells) of every usable row: cells are floor(scale * x) as 64-bit integers.

    Rows without an id, null vectors and vectors that hold a null or a component
    that is not finite are left out.
    """

    def work(batch: pa.RecordBatch) -> dict:
        ids, dims, norms, cells = [], [], [], []
        for one, values in zip(batch.column("vec_id"), batch.column("vector"), strict=True):
            if not one.is_valid or not values.is_valid or values.values.null_count:
                continue
            x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            made = np.floor(scale * x).astype(np.int64)
            ids.append(one.as_py())
            dims.append(len(made))
            norms.append(float(np.sqrt((made.astype(np.float64) ** 2).sum())))
            cells.append(made.tobytes())
        return {
            "vec_id": pa.array(ids, pa.int64()), "dim": pa.array(dims, pa.int64()),
            "norm": pa.array(norms, pa.float64()), "cells": pa.array(cells, pa.binary()),
        }

    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return per_batch(chosen, "vec_id long, dim long, norm double, cells binary", work)


def matrix(cells: list[bytes], dim: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    out = np.zeros((len(cells), dim), np.int64)
    for i, raw in enumerate(cells):
        own = np.frombuffer(raw, np.int64)
        out[i, :len(own)] = own
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of the table, largest first, from its Gram matrix.

    Tasks add up products of their own rows; the sums have dim * dim cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column("cells").to_pylist(), dim).astype(np.float64)
            gram += x.T @ x
        at = np.flatnonzero(gram)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(gram.ravel()[at])], names=["cell", "v"])

    sums = vectors.select("cells").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    gram = np.zeros(dim * dim)
    gram[sums.column("cell").to_numpy()] = sums.column("v").to_numpy()
    values, axes = np.linalg.eigh(gram.reshape(dim, dim))
    return np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(part, number, norm, ids, cells): rows by descending length in blocks of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = 0, 0, []

        def row() -> pa.RecordBatch:
            width = max(len(h[2]) for h in held) // 8
            cells = matrix([h[2] for h in held], width)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([held[0][1]]), pa.array([width], pa.int64()),
                    pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()),
                ],
                names=["part", "number", "norm", "width", "ids", "cells"],
            )

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for one in zip(batch.column("vec_id").to_pylist(), batch.column("norm").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                held.append(one)
                if len(held) == size:
                    yield row()
                    number, held = number + 1, []
        if held:
            yield row()

    # No more ranges than full blocks: short blocks would only make more of them.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, -(-vectors.count() // size)))
    order = [F.desc("norm"), F.asc("vec_id")]
    placed = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ready = placed.select(F.spark_partition_id().cast("long").alias("part"), "vec_id", "norm", "cells")
    return ready.mapInArrow(run, "part long, number long, norm double, width long, ids binary, cells binary")


class Search:
    """The k best of one block of queries, fed with candidate blocks by descending length."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, axes: np.ndarray, top: int, bar: np.ndarray | None = None):
        self.ids, self.cells, self.axes, self.top = ids, cells, axes, top
        self.turned = cells.astype(np.float64) @ axes
        self.lengths = np.sqrt((self.turned**2).sum(axis=1))
        empty = np.empty(0, np.int64)
        self.query, self.score, self.found = empty, empty, empty
        self.bar = np.full(len(ids), -np.inf) if bar is None else bar.copy()
        self.cuts = sorted({max(1, axes.shape[1] // part) for part in STEPS})
        self.rests = [np.sqrt((self.turned[:, cut:] ** 2).sum(axis=1)) for cut in self.cuts]
        self.summed = 0

    def feed(self, ids: np.ndarray, cells: np.ndarray) -> None:
        turned = cells.astype(np.float64) @ self.axes
        lengths = np.sqrt((turned**2).sum(axis=1))
        alive = np.flatnonzero(self.lengths * lengths.max() + SLACK >= self.bar)
        if not len(alive):
            return
        q, c = self._survivors(alive, ids, turned, lengths)
        other = self.ids[q] != ids[c]
        q, c = q[other], c[other]
        score = np.empty(len(q), np.int64)
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = np.einsum("ij,ij->i", self.cells[q[part]], cells[c[part]])
        self.summed += len(q)
        self._merge(q, score, ids[c])

    def _survivors(self, alive: np.ndarray, ids: np.ndarray, turned: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose bound reaches the bar, coordinates by coordinates."""
        bar = self.bar[alive, None] - SLACK
        if np.isneginf(bar).any():
            # No bar yet: the exact scores of this block give one. Rows with the query's own id are no candidates.
            full = np.rint(self.turned[alive] @ turned.T)
            full[self.ids[alive, None] == ids[None, :]] = -np.inf
            keep = min(self.top, full.shape[1])
            bar = np.maximum(bar, np.partition(full, -keep, axis=1)[:, -keep, None] - SLACK)
        done, sums, mask = 0, 0.0, None
        for cut, rest in zip(self.cuts, self.rests, strict=True):
            sums = sums + self.turned[alive, done:cut] @ turned[:, done:cut].T
            bound = sums + rest[alive, None] * np.sqrt((turned[:, cut:] ** 2).sum(axis=1))[None, :]
            mask, done = bound >= bar, cut
            if mask.mean() < 0.05:
                break
        else:
            mask = sums + self.turned[alive, done:] @ turned[:, done:].T >= bar
        q, c = np.nonzero(mask)
        return alive[q], c

    def _merge(self, query: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        query = np.concatenate((self.query, query))
        score = np.concatenate((self.score, score))
        found = np.concatenate((self.found, found))
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        begin = np.searchsorted(query, np.arange(len(self.ids)))
        best = np.arange(len(query)) - begin[query] < self.top
        self.query, self.score, self.found = query[best], score[best], found[best]
        full = np.bincount(self.query, minlength=len(self.ids)) >= self.top
        last = np.searchsorted(self.query, np.arange(len(self.ids)), "right") - 1
        self.bar[full] = self.score[last[full]]


def block_of(batch: pa.RecordBatch, row: int, dim: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Ids and cells of one block, filled up to ``dim``."""
    width = batch.column(prefix + "width")[row].as_py()
    ids = np.frombuffer(batch.column(prefix + "ids")[row].as_py(), np.int64)
    cells = np.zeros((len(ids), dim), np.int64)
    cells[:, :width] = np.frombuffer(batch.column(prefix + "cells")[row].as_py(), np.int64).reshape(len(ids), width)
    return ids, cells


def first_bars(asked: DataFrame, longest: DataFrame, axes: np.ndarray, top: int) -> tuple[list[float], DataFrame]:
    """From the products with the longest candidates: per query block the length that a candidate needs, and (qb, bars).

    The bar of a query is its ``top``-th best score there, or minus infinity;
    shorter candidates than the least quotient of bar and length of a block's
    queries reach no bar. A query of length 0 takes any candidate.
    """
    dim = len(axes)

    def work(batch: pa.RecordBatch) -> dict:
        needs, bars = [], []
        for row in range(batch.num_rows):
            search = Search(*block_of(batch, row, dim), axes, top)
            search.feed(*block_of(batch, row, dim, "long_"))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(search.lengths > SLACK, (search.bar - SLACK) / search.lengths, -np.inf)
            # Lengths are rounded sums; a part in a million covers them.
            least = float(need.min())
            needs.append(least * (1 - 1e-6) if least > 0 else least * (1 + 1e-6))
            bars.append(search.bar.tolist())
        return {"qb": batch.column("qb"), "need": pa.array(needs, pa.float64()), "bars": pa.array(bars, pa.list_(pa.float64()))}

    single = longest.select(F.lit(1).alias("__one"), *[F.col(c).alias(f"long_{c}") for c in ("width", "ids", "cells")])
    met = asked.withColumn("__one", F.lit(1)).join(F.broadcast(single), "__one")
    found = settled(per_batch(met.select("qb", "width", "ids", "cells", "long_width", "long_ids", "long_cells"), "qb int, need double, bars array<double>", work), "bars")
    needs = [r["need"] for r in found.select("qb", "need").orderBy("qb").collect()]
    return needs, found.select("qb", "bars")


def top_inner_products(
    rows: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK, queries: int = QUERIES, share: int = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best integer inner products of each query, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Candidates are all usable rows
    but those with the query's own id; fewer than ``top`` are all returned. Rows
    that repeat both id and vector count once; an id with several vectors is
    ranked by all of them. Vectors of different lengths are filled up with
    zeros. Whole-number components must stay below 2^26 for exact sums. Empty
    tables give empty tables.
    """
    vectors = settled(whole_vectors(rows, vec_id, vector, scale).dropDuplicates(["vec_id", "cells"]), "vectors")
    dim = vectors.agg(F.max("dim")).first()[0] or 1
    axes = rotation(vectors, dim)
    candidates = settled(blocks(vectors, block), "candidates")
    asked = settled(blocks(vectors.filter(is_query), queries), "queries")
    number = Window.orderBy("part", "number")
    order = asked.select("part", "number").withColumn("qb", F.row_number().over(number) - 1)
    # One number for each query block reaches the driver.
    n_queries, n_blocks = asked.count(), candidates.count()
    shares = max(1, -(-n_blocks // share))
    asked = settled(asked.join(order, ["part", "number"]), "asked")
    longest = candidates.orderBy(F.desc("norm"), "part", "number").limit(1)
    needs, bars = first_bars(asked, longest, axes, top)
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    ask = asked.join(bars, "qb").withColumn("share", every)
    queried = ask.select("qb", "share", F.lit(0).alias("kind"), "norm", "width", "ids", "cells", "bars")
    near = F.posexplode(F.transform(F.lit(needs), lambda need: need <= F.col("norm")))
    sent = candidates.select("*", near.alias("qb", "__near")).filter("__near")
    dealt = sent.withColumn("share", F.pmod(F.xxhash64("part", "number"), F.lit(shares)).cast("int"))
    fed = dealt.select("qb", "share", F.lit(1).alias("kind"), "norm", "width", "ids", "cells", F.lit(None).cast("array<double>").alias("bars"))
    ready = queried.union(fed).repartition("qb", "share").sortWithinPartitions("qb", "share", "kind", F.desc("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, at = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(search.ids[search.query]), pa.array(search.found), pa.array(search.score)],
                names=["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for row in range(batch.num_rows):
                qb, part, kind = (batch.column(n)[row].as_py() for n in ("qb", "share", "kind"))
                ids, cells = block_of(batch, row, dim)
                if (qb, part) != at:
                    if search is not None:
                        yield out()
                    search, at = None, (qb, part)
                if kind == 0:
                    search = Search(ids, cells, axes, top, np.array(batch.column("bars")[row].as_py()))
                elif search is not None:
                    search.feed(ids, cells)
        if search is not None:
            yield out()

    best = ready.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score"
    )
