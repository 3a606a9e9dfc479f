"""Quality classifier by co-training of two views of a document.

One view is the text: hashed byte n-grams. The other is what is known about the
page: its source, declared language and size, and the coarse layout. Each view
has a naive Bayes model. In each round either model teaches the other: documents
without a label that it is sure of count for the other's next model. Scores of
both views are calibrated on labelled documents held back, and added as log odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import per_batch, slices, utf8
from gleanset.llm.grams import BUCKETS, gram_buckets, labelled_sample, row_means
from gleanset.llm.quality_rules import text_counts

LABELLED = 20_000
ROUNDS = 3
SEED = 53
# Log odds from which a view is sure: a hundred to one.
SURE = float(np.log(100))
VALUES = 4096
UNIT = 1 << 20
PAGE_FEATURES = ("lang", "source", "size", "lines", "line_length", "letters", "capitals", "marks", "spaces", "repeats", "doubles", "dup_lines")
CELLS = BUCKETS + VALUES * len(PAGE_FEATURES)
STEP = 64


class View(NamedTuple):
    """Log ratios good / bad of the cells of a view in parts of 1/UNIT, and the calibration of their sum."""

    ratios: np.ndarray
    slope: float
    offset: float


class Model(NamedTuple):
    text: View
    page: View
    prior: float


def _named(column: pa.Array) -> np.ndarray:
    """A place for each value of a text column; null has one of its own."""
    coded = column.cast(pa.string()).dictionary_encode()
    places = np.array([zlib.crc32(v.encode()) % (VALUES - 1) + 1 for v in coded.dictionary.to_pylist()] + [0])
    return places[coded.indices.fill_null(len(places) - 1).to_numpy()]


def _shares(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Thirty-seconds of each row's bytes that carry the flag."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return 32 * (sums[offsets[1:]] - sums[offsets[:-1]]) // np.maximum(1, np.diff(offsets))


def page_cells(part: pa.RecordBatch) -> np.ndarray:
    """The cell of each page feature of each row."""
    body, offsets = utf8(part.column("text"))
    size = np.diff(offsets)
    breaks = np.concatenate(([0], np.cumsum(body == 10)))
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    capital = (body >= 65) & (body <= 90)
    letter = capital | ((body >= 97) & (body <= 122)) | (body >= 128)
    space = (body == 32) | ((body >= 9) & (body <= 13))
    counts = text_counts(part.column("text"))
    declared = part.column("n_chars").cast(pa.int64()).fill_null(0).to_numpy()
    logs = lambda x: (2 * np.log2(np.maximum(1, x))).astype(np.int64)
    values = [
        _named(part.column("lang")), _named(part.column("source")), logs(declared), logs(lines), logs(size // lines),
        _shares(letter, offsets), _shares(capital, offsets), _shares(~letter & ~space, offsets), _shares(space, offsets),
        *(32 * counts[n] // np.maximum(1, counts["n_words"]) for n in ("n_repeat_words", "n_doubled_words")), 32 * counts["n_dup_lines"] // lines,
    ]
    return BUCKETS + np.stack(values, axis=1) + VALUES * np.arange(len(values))


class Features(NamedTuple):
    """Of some rows: the n-grams' buckets with the offsets of rows in them, and the page cells. Worked out once for a slice."""

    buckets: np.ndarray
    offsets: np.ndarray
    cells: np.ndarray


def features(part: pa.RecordBatch) -> Features:
    return Features(*gram_buckets(*utf8(part.column("text"))), page_cells(part))


def view_scores(seen: Features, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Raw score of each view: the mean ratio of the n-grams, the sum of the page features."""
    text = row_means(model.text.ratios[seen.buckets], seen.offsets) / UNIT
    return text, model.page.ratios[seen.cells - BUCKETS].sum(axis=1) / UNIT


def log_odds(seen: Features, model: Model) -> tuple[np.ndarray, np.ndarray]:
    text, page = view_scores(seen, model)
    return model.text.slope * text + model.text.offset, model.page.slope * page + model.page.offset


def _counts(rows: DataFrame, model: Model | None) -> np.ndarray:
    """Cell counts by label over all rows: own labels, else those that the other view is sure of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            for part in slices(batch):
                seen = features(part)
                own = part.column("label").fill_null(-1).to_numpy().astype(np.int64)
                for_text, for_page = own.copy(), own.copy()
                if model is not None:
                    text, page = log_odds(seen, model)
                    free = own == -1
                    for_text[free] = np.where(np.abs(page) >= SURE, page > 0, -1)[free]
                    for_page[free] = np.where(np.abs(text) >= SURE, text > 0, -1)[free]
                labels = np.repeat(for_text, np.diff(seen.offsets))
                for k in (0, 1):
                    counts[k, :BUCKETS] += np.bincount(seen.buckets[labels == k], minlength=BUCKETS)
                    counts[k] += np.bincount(seen.cells[for_page == k].ravel(), minlength=CELLS)
        label, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[label, cell])], names=["label", "cell", "n"]
        )

    sums = rows.mapInArrow(run, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, CELLS), np.int64)
    out[sums.column("label").to_numpy(), sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out


def _ratios(counts: np.ndarray, groups: int) -> np.ndarray:
    """Log ratio good / bad per cell, each group of cells a distribution; both start from their common shares."""
    cells = counts.reshape(2, groups, -1).astype(np.float64)
    width = cells.shape[2]
    common = (cells.sum(axis=0) + 1) / (cells.sum(axis=(0, 2))[:, None] + width)
    weight = 16.0 if groups > 1 else float(BUCKETS)
    shares = (cells + weight * common) / (cells.sum(axis=2, keepdims=True) + weight)
    return np.rint(UNIT * (np.log(shares[1]) - np.log(shares[0]))).astype(np.int64).ravel()


def calibrated(steps: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds of label 1 by a logistic fit on binned scores, with softened targets."""
    good, bad = n[labels == 1].sum(), n[labels == 0].sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([steps / STEP, np.ones(len(steps))], axis=1)
    weights = np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (target - p)) - 1e-3 * weights
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        weights += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return float(weights[0]), float(weights[1])


def _calibrate(held: DataFrame, model: Model) -> Model:
    """Fit both calibrations on the labelled rows held back."""

    def work(batch: pa.RecordBatch) -> dict:
        text, page = map(np.concatenate, zip(*[view_scores(features(part), model) for part in slices(batch)], strict=True))
        limit = lambda s: np.clip(np.floor(s * STEP), -4096, 4096).astype(np.int32)
        return {"label": batch.column("label"), "text": limit(text), "page": limit(page)}

    scored = per_batch(held, "label int, text int, page int", work)
    views = []
    for view, name in ((model.text, "text"), (model.page, "page")):
        bins = scored.groupBy("label", name).agg(F.count(F.lit(1)).alias("n")).toArrow()
        steps, labels, n = (bins.column(c).to_numpy() for c in (name, "label", "n"))
        order = np.lexsort((labels, steps))
        views.append(View(view.ratios, *calibrated(steps[order] + 0.5, labels[order], n[order])))
    return Model(*views, model.prior)


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most: int = LABELLED, seed: int = SEED) -> Model | None:
    """Co-train on all documents and at most ``most`` labelled ones (those of least hash).

    The first round counts half of the labelled documents; every further one
    counts all documents and adds those that one view is sure of to the other's
    counts. The other half is never counted and calibrates each round's scores.
    None if either label is missing.
    """
    sample = labelled_sample(labels, F.col("quality"), most, seed)
    shares = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 4:
        return None
    rows = _inputs(docs)
    held = rows.join(F.broadcast(sample.filter("fold = 1")), "doc_id")
    known = F.broadcast(sample.filter("fold = 0"))
    apart = rows.join(F.broadcast(sample), "doc_id", "left").filter("fold IS NULL OR fold = 0")
    prior = float(np.log(shares[1, 1] / shares[1, 0]))
    model = None
    for number in range(rounds):
        counts = _counts(apart if number else rows.join(known, "doc_id"), model)
        plain = Model(
            View(_ratios(counts[:, :BUCKETS], 1), 0.0, 0.0), View(_ratios(counts[:, BUCKETS:], len(PAGE_FEATURES)), 0.0, 0.0), prior
        )
        model = _calibrate(held, plain)
    return model


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text_score, page_score, score, kept) of every document.

    Scores are probabilities of good quality: by either view, and by both as the
    sum of their log odds less the prior's, which both contain. ``kept`` is
    ``score >= 0.5``. Null texts and null metadata are values like any other;
    without a model every score is 0.5. Nothing is shuffled, rows stay apart.
    """

    def work(batch: pa.RecordBatch) -> dict:
        if model is None:
            text = page = both = np.zeros(batch.num_rows)
        else:
            text, page = map(np.concatenate, zip(*[log_odds(features(part), model) for part in slices(batch)], strict=True))
            both = text + page - model.prior
        chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return {
            "doc_id": batch.column("doc_id"), "text_score": chance(text), "page_score": chance(page), "score": chance(both),
            "kept": chance(both) >= 0.5,
        }

    return per_batch(_inputs(docs), "doc_id long, text_score double, page_score double, score double, kept boolean", work)
