"""Rules that reject documents: counts of their words, and a likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed n-grams: one counted on trusted
documents, one on the whole raw corpus. Its mean per n-gram does not depend on
length. One threshold, found on labelled documents that neither model was
counted on as trusted, decides on every document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import mix64, per_batch, release, slices, small_batches, utf8, word_hashes, word_spans
from gleanset.llm.grams import BUCKETS, gram_buckets, gram_counts, labelled_sample, row_means

SYMBOLS = b"#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50
LABELLED = 10_000
SEED = 31
# Strength of the raw corpus as prior of the trusted model, in n-grams.
PRIOR = 65_536.0
STEP = 256
UNIT = 1 << 20
# A kept document that should go costs one, a trusted one that goes costs this many.
CARE = 20.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, and its words that repeat the one before; a null text has none of anything."""
    body, offsets = utf8(column)
    starts, ends, rows = word_spans(body, offsets)
    space = (body == 32) | ((body >= 9) & (body <= 13))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.diff(rows), "word_chars": _per_row(~space & ((body & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(symbol[body], offsets),
    }
    n = len(offsets) - 1
    out["n_dup_lines"] = _repeated_lines(body, offsets, starts, n)
    hashes = word_hashes(body, starts, ends)
    out["n_repeat_words"] = _repeated_words(hashes, rows, n)
    row = np.repeat(np.arange(n), np.diff(rows))
    twice = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
    out["n_doubled_words"] = np.bincount(row[twice], minlength=n)
    return out


def _in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows."""
    return mix64(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _repeated_lines(body: np.ndarray, offsets: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    breaks = np.flatnonzero(body == 10)
    row = np.concatenate((filled := np.flatnonzero(np.diff(offsets)), np.searchsorted(offsets, breaks, "right") - 1))
    starts = np.concatenate((offsets[filled], breaks + 1))
    ends = np.concatenate((offsets[filled + 1], breaks))
    # A break may end its row, so that two lines start at one place: the order is by row first.
    starts, ends = starts[np.lexsort((starts, row))], ends[np.lexsort((ends, row))]
    row = np.sort(row)
    with_word = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends, row = starts[with_word], ends[with_word], row[with_word]
    first = np.unique(_in_row(word_hashes(body, starts, ends), row), return_index=True)[1]
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def _repeated_words(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    full = max(0, len(hashes) - WINDOW + 1)
    row = np.repeat(np.arange(n), np.diff(rows))
    inside = row[:full] == row[WINDOW - 1:]
    windows = np.zeros(full, np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0xA0761D6478BD642F) + hashes[k:k + full]
    at = np.flatnonzero(inside)
    _, inverse, often = np.unique(_in_row(mix64(windows[at]), row[at]), return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        covered[at[often[inverse] > 1] + k] = True
    return np.bincount(row[covered], minlength=n)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


class Rules(NamedTuple):
    """Log ratio of each bucket in whole parts of 1/``UNIT``, and the least mean ratio that is kept."""

    ratios: np.ndarray
    threshold: float


def log_ratios(raw: np.ndarray, trusted: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(trusted / raw) per bucket; the raw model, one added to each count, is the prior of the trusted one."""
    corpus = (raw + 1.0) / (raw.sum() + BUCKETS)
    ratios = np.log((trusted + prior * corpus) / (trusted.sum() + prior)) - np.log(corpus)
    return np.rint(ratios * UNIT).astype(np.int64)


def best_threshold(scores: list[tuple[int, int, int]], care: float = CARE) -> float:
    """The bound between steps of the score that loses least: the middle one of those that lose equally little.

    ``scores`` is (step, label, documents). Shares are compared, so the number of
    documents of either label does not matter. With no document of one label
    nothing is rejected.
    """
    steps = sorted({s for s, _, _ in scores})
    totals = [sum(n for _, label, n in scores if label == k) for k in (0, 1)]
    if not all(totals):
        return -np.inf
    below = [0, 0]
    by_step = {s: [0, 0] for s in steps}
    for s, label, n in scores:
        by_step[s][label] += n
    edges = [(steps[0], (0, 0))]
    for s in steps:
        below = [b + n for b, n in zip(below, by_step[s], strict=True)]
        edges.append((s + 1, tuple(below)))
    losses = [care * b[1] / totals[1] + 1 - b[0] / totals[0] for _, b in edges]
    best = min(losses)
    last = max(i for i, x in enumerate(losses) if x == best)
    low = edges[last][0]
    following = next((s for s in steps if s >= low), low)
    return (low + following) / 2 / STEP


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = SEED) -> Rules:
    """Count both models over all documents and find the threshold.

    Trusted are the documents labelled 1 of one half of at most ``most``
    labelled ones (by hash); the other half, as far as it passes the base rules,
    gives the threshold. The raw model counts every document.
    """
    sample = F.broadcast(labelled_sample(labels, F.col("quality"), most, seed))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = texts.join(sample, "doc_id", "left").select("text", ((F.col("label") == 1) & (F.col("fold") == 0)).alias("trusted"))

    def group(batch: pa.RecordBatch) -> np.ndarray:
        return np.array(batch.column("trusted").fill_null(False)).astype(np.int64)

    rest, trusted = gram_counts(marked, 2, group)
    ratios = log_ratios(rest + trusted, trusted)
    held = texts.join(sample.filter("fold = 1"), "doc_id").select("doc_id", "label", "text")
    scored = measured(held, Rules(ratios, -np.inf), ("label",)).filter("NOT base_failed")
    steps = scored.groupBy(F.floor(F.col("score") * STEP).cast("int").alias("step"), "label").count().collect()
    return Rules(ratios, best_threshold([(r["step"], r["label"], r["count"]) for r in steps]))


def _judged(part: pa.RecordBatch, rules: Rules) -> dict[str, np.ndarray]:
    text = part.column("text")
    counts = text_counts(text)
    buckets, offsets = gram_buckets(*utf8(text))
    score = row_means(rules.ratios[buckets], offsets) / UNIT
    failed = base_failed(counts)
    return counts | {"score": score, "base_failed": failed, "kept": ~failed & (score >= rules.threshold)}


def measured(docs: DataFrame, rules: Rules, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept[, extra columns]) of every document.

    Null and empty texts have no words and fail; repeated rows are judged alike;
    a null id passes through. Nothing is shuffled.
    """
    types = dict(docs.dtypes)
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, score double, kept boolean"
    schema += "".join(f", {n} {types[n]}" for n in extra)

    def work(batch: pa.RecordBatch) -> dict:
        parts = [_judged(part, rules) for part in slices(batch)]
        made = {n: np.concatenate([p[n] for p in parts]) for n in (*COUNTS, "base_failed", "score", "kept")}
        return made | {n: batch.column(n) for n in ("doc_id", *extra)}

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra), schema, work)


def passing(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""

    small_batches(docs.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            kept = np.concatenate([_judged(part, rules)["kept"] for part in slices(batch)]) if batch.num_rows else []
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
