"""Language of pages from several kinds of evidence, fused by Bayes' rule.

Evidence is the page's text under n-gram models of each language, the language
that its markup declares, and where it lies. How far a declaration can be
trusted is counted on the pages themselves. The prior of a host is smoothed by
that of its domain, which is smoothed by that of its address suffix, and that by
all pages; a page's own evidence is taken out of its priors.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import per_batch, settled, slices, utf8
from gleanset.llm.grams import BUCKETS, gram_buckets, gram_counts, row_means

MOST_LANGUAGES = 256
# n-grams of a page that count in full: neighbouring ones overlap, so more would make the text too sure of itself.
EVIDENCE = 60
STRENGTH = 5.0
UNIT = 1 << 20


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, ...]:
    return (
        re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I), re.compile(r"<[^>]*>"),
        re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]+)""", re.I),
    )


def visible_text(page: str) -> str:
    hidden, tag, _ = _patterns()
    return entities.unescape(tag.sub(" ", hidden.sub(" ", page)))


def declared_language(page: str) -> str | None:
    found = _patterns()[2].search(page)
    return found[1].lower() if found else None


def places(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (the last one)."""
    try:
        host = urlsplit(url or "").hostname
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.rstrip(".").split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def language_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` in code point order, and their log shares of each bucket in parts of 1/UNIT.

    Counted over all documents that state a language; rows without text or
    language say nothing.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    names = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the training documents")
    place = {n: i for i, n in enumerate(names)}

    def group(part: pa.RecordBatch) -> np.ndarray:
        return np.array([place[n] for n in part.column("lang").to_pylist()], np.int64)

    counts = gram_counts(known, max(1, len(names)), group)
    shares = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    return names, np.rint(UNIT * np.log(shares)).astype(np.int64)


def evidence(pages: DataFrame, names: list[str], shares: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, text_odds) of each page; odds are log likelihoods, one per language.

    ``declared`` is a known language, ``other``, or null if the markup says nothing.
    """

    def work(batch: pa.RecordBatch) -> dict:
        texts, declared, where = [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            texts.append(visible_text(page or ""))
            said = declared_language(page or "")
            declared.append(said if said is None or said in names else "other")
            where.append(places(url))
        odds = []
        whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        for part in slices(whole):
            buckets, offsets = gram_buckets(*utf8(part.column("text")))
            means = np.stack([row_means(s[buckets], offsets) / UNIT for s in shares], axis=1)
            odds.append(means * np.minimum(np.diff(offsets), EVIDENCE)[:, None])
        flat = np.concatenate(odds)
        return {
            "page_id": batch.column("page_id"), "declared": pa.array(declared, pa.string()),
            "text_odds": pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), len(shares)).cast(pa.list_(pa.float64())),
        } | {n: pa.array([w[i] for w in where], pa.string()) for i, n in enumerate(("host", "domain", "suffix"))}

    schema = "page_id long, host string, domain string, suffix string, declared string, text_odds array<double>"
    return per_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), schema, work)


def _normal(odds: np.ndarray) -> np.ndarray:
    chances = np.exp(odds - odds.max(axis=1, keepdims=True))
    return chances / chances.sum(axis=1, keepdims=True)


def _table(column: pa.Array, width: int) -> np.ndarray:
    """An array column as a matrix; null rows are zeros."""
    out = np.zeros((len(column), width))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = np.array(column.drop_null().flatten()).reshape(-1, width)
    return out


def identify(pages: DataFrame, names: list[str], shares: np.ndarray, strength: float = STRENGTH) -> DataFrame:
    """(page_id, lang, probability, declared, text_lang) of every page.

    Null markup counts as empty, a page without text rests on its place and
    declaration, one without an address on all pages. Ties go to the first
    language in code point order. Repeated rows count as often as they occur and
    get equal results. With no languages ``lang`` is null. Priors are sums per
    host, domain and suffix; a host that owns most pages is summed before it is
    shuffled.
    """
    if not names:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("probability", "double"), ("declared", "string"), ("text_lang", "string"))]
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *nothing)
    width = len(names)
    seen = settled(evidence(pages, names, shares), "evidence")

    def by_text(batch: pa.RecordBatch) -> dict:
        chances = _normal(_table(batch.column("text_odds"), width))
        return {"declared": batch.column("declared")} | {f"p{k}": chances[:, k] for k in range(width)}

    fields = ", ".join(f"p{k} double" for k in range(width))
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(width)]
    said = per_batch(seen.select("declared", "text_odds"), "declared string, " + fields, by_text).groupBy("declared").agg(*sums).collect()
    trust = {r["declared"]: np.array(r[1:], float) for r in said}
    total = sum(trust.values()) + 1.0
    values = len(names) + 2
    means = {k: np.log((v + 1.0) / (total + values)) for k, v in trust.items()}

    def by_page(batch: pa.RecordBatch) -> dict:
        odds = _table(batch.column("text_odds"), width)
        odds += np.array([means[d] for d in batch.column("declared").to_pylist()]).reshape(-1, width)
        chances = _normal(odds)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(chances.ravel()), width).cast(pa.list_(pa.float64()))
        best = np.argmax(_table(batch.column("text_odds"), width), axis=1)
        kept = {n: batch.column(n) for n in ("page_id", "host", "domain", "suffix", "declared")}
        logs = pa.FixedSizeListArray.from_arrays(pa.array(odds.ravel()), width).cast(pa.list_(pa.float64()))
        return kept | {"odds": logs, "own": rows, "text_lang": pa.array([names[b] for b in best])}

    schema = "page_id long, host string, domain string, suffix string, declared string, odds array<double>, own array<double>, text_lang string"
    judged = settled(per_batch(seen, schema, by_page), "judged")
    each = [F.sum(F.col("own")[k]).alias(f"p{k}") for k in range(width)]
    hosts = settled(judged.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), *each), "hosts")
    again = [F.sum("n").alias("n"), *sums]
    everything = hosts.agg(*again).first()
    overall = np.array(everything[1:], float) if everything["n"] else np.zeros(width)
    packed = F.array(*[f"p{k}" for k in range(width)])
    at_host = hosts.filter("host IS NOT NULL").select("host", "domain", "suffix", packed.alias("c_host"))
    for level in ("domain", "suffix"):
        upper = hosts.filter("host IS NOT NULL").groupBy(level).agg(*again).select(level, packed.alias(f"c_{level}"))
        at_host = at_host.join(upper, level)
    counted = at_host.select("host", "c_host", "c_domain", "c_suffix")

    def fuse(batch: pa.RecordBatch) -> dict:
        own, odds = _table(batch.column("own"), width), _table(batch.column("odds"), width)
        prior = np.maximum(overall[None, :] - own, 0) + 1.0
        prior /= prior.sum(axis=1, keepdims=True)
        for level in ("c_suffix", "c_domain", "c_host"):
            others = np.maximum(_table(batch.column(level), width) - own, 0)
            prior = (others + strength * prior) / (others.sum(axis=1, keepdims=True) + strength)
        final = _normal(odds + np.log(prior))
        best = np.argmax(final, axis=1)
        return {
            "page_id": batch.column("page_id"), "lang": pa.array([names[b] for b in best]),
            "probability": final[np.arange(len(best)), best], "declared": batch.column("declared"), "text_lang": batch.column("text_lang"),
        }

    return per_batch(
        judged.join(counted, "host", "left"), "page_id long, lang string, probability double, declared string, text_lang string", fuse
    )
