"""Mixing sources to target weights at an exact number of words."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanset.llm.common import per_batch, settled, slices, utf8, word_spans

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
SEED = 17
PART_ROWS = 20_000
_WORD = re.compile(r"[^ \t-\r]+")


def hash_key(seed: int = SEED) -> Column:
    """The random key of a document, 63 bits of a hash of its id and text."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 1)


def word_counts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, key, size): the words of each text, a null text none, and its random key."""

    def work(batch: pa.RecordBatch) -> dict:
        counted = [np.diff(word_spans(*utf8(part.column("text")))[2]) for part in slices(batch)]
        return {n: batch.column(n) for n in ("doc_id", "source", "key")} | {"size": np.concatenate(counted).astype(np.int64)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", hash_key(seed).alias("key"), "text")
    return per_batch(rows, "doc_id long, source string, key long, size long", work)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Add ``place``: the position from 0 of each row in the order of ``key`` by code point, null last.

    A range sort; the rows of each partition get its first position from the
    counts of the partitions before it, of which there are as many as partitions.
    """
    ordered = rows.orderBy(F.col(key).asc_nulls_last()).withColumn("__m", F.monotonically_increasing_id())
    placed = settled(ordered, "places").withColumn("__block", F.shiftright("__m", 33))
    blocks = placed.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(bases, "__block").withColumn("place", F.col("__base") + inside).drop("__m", "__block", "__base")


def targets(
    sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """Add ``target`` to (source, source_size): its words in the mix.

    Sources in code point order, null last, weigh ``weights`` in turn. They share
    ``share`` of all words by weight; none gets more than ``epochs`` times its
    own, and what is left over goes to the others by weight until none is
    above. Each turn is one sum over the sources; a source once at its bound
    stays there, since the level only rises.
    """
    placed = numbered(sources, "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = settled(placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(epochs))), "weights")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("most") < F.lit(level) * F.col("weight")
        sums = weighed.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("most"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if sums["n"] == capped or not sums["weight"]:
            break
        capped, level = sums["n"], (total - sums["most"]) / sums["weight"]
    return weighed.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight"))).drop("most", "place")


def cuts(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, part_rows: int = PART_ROWS
) -> DataFrame:
    """(source, source_size, target, passes, cut, cut_words): where the mix ends in each source.

    A source's rows are taken in key order, whole passes first, until its target,
    rounded to words, is met. In the last pass rows of keys below ``cut`` are
    taken whole, and of each row with that key ``cut_words`` words.

    The key space is cut into ranges. Sums per (source, range) give each range its
    first position and tell in which one the source ends; only there the keys
    themselves are summed up. So a source of any size is spread over all tasks.
    Only rows that repeat id and text share a key; the words left at the cut are
    then shared evenly among them, down to whole words.
    """
    bits = max(1, int(sized.count() / part_rows)).bit_length()
    dealt = sized.withColumn("range", F.shiftright("key", 63 - bits))
    sums = settled(dealt.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    ends = settled(aims.withColumn("passes", passes).withColumn("rest", budget - F.col("passes") * F.col("source_size")), "ends")

    def at_end(parts: DataFrame, order: str) -> DataFrame:
        """Of the parts of each source the one that its remaining budget ends in, and what is left for it."""
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = parts.withColumn("before", upto - F.col("words"))
        met = placed.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source"))).select("p.*", "rest")
        return met.filter("rest >= before AND rest < before + words").withColumn("left", F.col("rest") - F.col("before"))

    last = settled(at_end(sums, "range").select("source", "range", F.col("before").alias("skipped")), "last")
    same = F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.range") == F.col("l.range"))
    inside = dealt.alias("d").join(last.alias("l"), same).select("d.source", "d.key", "d.size", "skipped")
    by_key = inside.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max("skipped").alias("skipped"))
    # The ranges before the last one count as one more part in front of its keys.
    front = last.select("source", F.lit(-1).cast("long").alias("key"), F.col("skipped").alias("words"), F.lit(1).cast("long").alias("n"))
    found = at_end(by_key.drop("skipped").unionByName(front), "key").filter("key >= 0")
    cut = found.select("source", F.col("key").alias("cut"), F.floor(F.col("left") / F.col("n")).cast("long").alias("cut_words"))
    return settled(
        ends.alias("e").join(cut.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left").select(
            "e.source", "source_size", "target", "passes", "cut", "cut_words"
        ),
        "cuts",
    )


def mix(sized: DataFrame, **options) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` to the rows of :func:`word_counts`.

    Options are those of :func:`cuts`. Keys depend on seed, id and text alone,
    so reruns agree. Null sources form one source; rows without words take
    nothing. An empty table gives an empty table.
    """
    rows = settled(sized, "sizes")
    facts = cuts(rows, **options)
    joined = rows.alias("r").join(facts.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")))
    part = F.when(F.col("key") < F.col("cut"), F.col("size")).when(
        F.col("key") == F.col("cut"), F.least("cut_words", "size")
    ).otherwise(0)
    return joined.select("r.*", "source_size", "target", (F.col("passes") * F.col("size") + part).alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix, one row per pass, with the columns of ``docs``.

    A document taken twice comes twice; the one at the cut of its source ends
    after its last taken word, and ``n_chars`` follows the text. Documents that
    nothing is taken of are left out; so are those without words. Texts are not
    shuffled: each row is decided by its key and its source's cut.
    """
    names = docs.columns
    facts = cuts(settled(word_counts(docs, seed), "sizes"), **options).select(
        F.col("source").alias("__source"), "passes", F.col("cut").alias("__cut"), F.col("cut_words").alias("__words")
    )
    keyed = docs.withColumn("__key", hash_key(seed)).alias("d")
    met = keyed.join(facts.alias("f"), F.col("d.source").eqNullSafe(F.col("f.__source"))).filter(F.col("d.text").rlike(r"[^ \t-\r]"))
    whole = F.col("f.passes") + F.when(F.col("__key") < F.col("__cut"), 1).otherwise(0)
    part = F.when((F.col("__key") == F.col("__cut")) & (F.col("__words") > 0), F.array("__words")).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array_repeat(F.lit(None).cast("bigint"), whole.cast("int")), part)
    rows = met.select("d.*", F.explode(copies).alias("__last"))
    whole_text = F.col("__last").isNull()
    # Only the rows at a cut go to Python; the others send a null.
    cut = rows.withColumn("__cut", first_words(F.when(~whole_text, F.col("text")), F.coalesce("__last", F.lit(0))))
    changed = {"text": F.when(whole_text, F.col("text")).otherwise(F.col("__cut"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(whole_text, F.col("n_chars")).otherwise(F.length("__cut"))
    types = dict(docs.dtypes)
    return cut.select(*[changed[n].cast(types[n]).alias(n) if n in changed else F.col(f"`{n}`") for n in names])


@F.pandas_udf(StringType())
def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """Each text up to the end of its first words, as many as ``counts`` says."""

    def cut(text: str | None, count: int) -> str | None:
        if text is None:
            return None
        ends = itertools.islice(_WORD.finditer(text), int(count) - 1, None)
        return next((text[:m.end()] for m in ends), text)

    return pd.Series([cut(t, c) for t, c in zip(texts, counts, strict=True)], dtype=object)
