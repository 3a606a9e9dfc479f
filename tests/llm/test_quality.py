import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanset.llm.cotraining import scored, train
from gleanset.llm.grams import BUCKETS, gram_buckets, labelled_sample
from gleanset.llm.quality_rules import (
    CARE, COUNTS, LABELLED, PRIOR, SEED, STEP, UNIT, Rules, best_threshold, fit, measured, passing, text_counts,
)
from gleanset.llm.common import utf8
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def by_hand(text):
    words, seen, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    often, covered = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if often[tuple(words[i:i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b ", " ", "\n", "é", "日 ", "# ", "\t", "a b c\n"]), max_size=30).map("".join)), max_size=6))
def test_counts_by_hand(texts):
    got = text_counts(pa.array(texts, pa.string()))
    assert [tuple(got[n][i] for n in COUNTS) for i in range(len(texts))] == [by_hand(t or "") for t in texts]


def test_grams_do_not_cross_rows():
    buckets, offsets = gram_buckets(*utf8(pa.array(["abcde", None, "abc", "", "bcde"])))
    assert offsets.tolist() == [0, 2, 2, 2, 2, 3]
    assert buckets[1] == buckets[2] != buckets[0]


def test_threshold_between_classes():
    assert best_threshold([(-300, 0, 50), (-200, 0, 10), (20, 1, 900), (40, 1, 100)]) == (-199 + 20) / 2 / 256
    assert best_threshold([(5, 1, 10)]) == -np.inf
    assert best_threshold([]) == -np.inf


def corpus(spark, n=240):
    """Prose, and junk whose words end in signs; two in three are labelled."""
    rows, labels, truth = [], [], {}
    for i in range(n):
        words = cases.prose(i, 70).split()
        bad = i % 4 == 0
        text = " ".join(w + random.Random(i + k).choice(["***", "%%%", "&&&"]) for k, w in enumerate(words)) if bad else " ".join(words)
        rows.append((i, text, "en", f"s{i % 5}", len(text), "k", "s", "x", "n"))
        truth[i] = not bad
        if i % 3:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, LABELS), truth


def test_rules_reject_junk_and_keep_prose(spark):
    docs, labels, truth = corpus(spark)
    rules = fit(docs, labels)
    rows = measured(docs, rules).collect()
    assert len(rows) == len(truth)
    assert all(r["kept"] == truth[r["doc_id"]] for r in rows if not r["base_failed"])
    kept = passing(docs, rules)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}
    again = fit(docs.repartition(7), labels)
    assert again.threshold == rules.threshold and (again.ratios == rules.ratios).all()


def test_co_training_separates_held_out_documents(spark):
    docs, labels, truth = corpus(spark)
    rows = scored(docs, train(docs, labels)).collect()
    unlabelled = [r for r in rows if r["doc_id"] % 3 == 0]
    assert sum(r["kept"] == truth[r["doc_id"]] for r in unlabelled) >= 0.97 * len(unlabelled)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("text_score", "page_score", "score"))


def test_few_labels_and_a_second_view(spark):
    """With a dozen labels, rounds of exchange must not lose to the first models."""
    docs, labels, truth = corpus(spark)
    few = labels.filter("doc_id % 16 IN (0, 1, 4, 7)").limit(60)
    first, last = (scored(docs, train(docs, few, rounds=n)).collect() for n in (1, 3))
    right = [sum(r["kept"] == truth[r["doc_id"]] for r in rows) for rows in (first, last)]
    assert right[1] >= right[0] and right[1] >= 0.95 * len(truth)


def test_awkward_documents(spark):
    docs, labels = cases.documents(spark), spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (99, 1, 0)], LABELS)
    rows = measured(docs, fit(docs, labels)).collect()
    assert sorted((r["doc_id"] or -1, *(r[c] for c in COUNTS)) for r in rows) == sorted((d or -1, *by_hand(t)) for d, t in cases.texts(docs))
    assert scored(docs, train(docs, labels)).count() == docs.count()


def test_without_labels(spark):
    docs, none = cases.documents(spark), spark.createDataFrame([], LABELS)
    rows = measured(docs, fit(docs, none)).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert {r["score"] for r in scored(docs, train(docs, none)).collect()} == {0.5}


def test_empty_tables(spark):
    docs, labels = cases.empty(spark), spark.createDataFrame([(1, 1, 0)], LABELS)
    assert measured(docs, fit(docs, labels)).count() == 0
    assert passing(docs, Rules(np.zeros(1 << 16, np.int64), 0.0)).count() == 0
    assert scored(docs, train(docs, labels)).count() == 0


def test_sample_takes_the_lowest_label_and_is_bounded(spark):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(1, 0, 0), (3, 7, 0)], LABELS)
    rows = labelled_sample(labels, F.col("quality"), 20, 1).collect()
    assert len(rows) == 20 == len({r["doc_id"] for r in rows})
    assert all(r["label"] == 0 for r in rows if r["doc_id"] == 1)


def plain_buckets(text):
    raw = (text or "").encode()
    return [(int.from_bytes(raw[i:i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 3)]


def test_ratio_threshold_and_verdict_by_hand(spark):
    """Documents of both labels share most words, so that scores overlap; some fail the base rules."""
    rows, labels = [], []
    for i in range(300):
        pick, words = random.Random(i), cases.prose(i, 60 if i % 9 else 30).split()
        bad = i % 3 == 0
        text = " ".join(pick.choice(["buy", "now", "click", "win"]) if pick.random() < (0.12 if bad else 0.05) else w for w in words)
        rows.append((i, None if i == 7 else text, "en", "s", 0, "k", "s", "x", "n"))
        if i % 4:
            labels.append((i, int(not bad), 0))
    docs, labelled = spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, LABELS)
    rules = fit(docs, labelled)
    fold = {r["doc_id"]: (r["label"], r["fold"]) for r in labelled_sample(labelled, labelled["quality"], LABELLED, SEED).collect()}
    assert set(fold) == {i for i, _, _ in labels}
    raw, trusted = Counter(), Counter()
    for i, text, *_ in rows:
        raw.update(plain_buckets(text))
        if fold.get(i) == (1, 0):
            trusted.update(plain_buckets(text))
    every, good = sum(raw.values()), sum(trusted.values())
    ratio = {}
    for b in raw:
        corpus = (raw[b] + 1) / (every + BUCKETS)
        ratio[b] = math.log((trusted[b] + PRIOR * corpus) / (good + PRIOR)) - math.log(corpus)
        assert abs(rules.ratios[b] / UNIT - ratio[b]) < 2 / UNIT
    score, failed = {}, {}
    for i, text, *_ in rows:
        found = plain_buckets(text)
        score[i] = sum(ratio[b] for b in found) / max(1, len(found))
        n, _, _, _, repeated = by_hand(text or "")
        failed[i] = n < 50 or 100 * repeated > 50 * n
    held = [(math.floor(score[i] * STEP), label) for i, (label, half) in fold.items() if half == 1 and not failed[i]]
    sizes = Counter(label for _, label in held)
    bounds = range(min(s for s, _ in held), max(s for s, _ in held) + 2)
    losses = {
        e: Fraction(int(CARE) * sum(s < e and label == 1 for s, label in held), sizes[1]) + Fraction(sum(s >= e and label == 0 for s, label in held), sizes[0])
        for e in bounds
    }
    best = [e for e in bounds if losses[e] == min(losses.values())]
    low = next(e for e in reversed(best) if e - 1 not in best)
    assert rules.threshold == (low + best[-1]) / 2 / STEP
    got = {r["doc_id"]: r for r in measured(docs, rules).collect()}
    assert len(got) == len(rows)
    for i in got:
        assert abs(got[i]["score"] - score[i]) < 1e-5 and got[i]["base_failed"] == failed[i]
        if abs(score[i] - rules.threshold) > 1e-5:
            assert got[i]["kept"] == (not failed[i] and score[i] > rules.threshold)
    assert 0 < sum(r["kept"] for r in got.values()) < sum(not r["base_failed"] for r in got.values())
