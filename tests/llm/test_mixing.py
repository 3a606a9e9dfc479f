import re

from gleanset.llm.mixing import mix, mixed_texts, targets, word_counts
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level_fill(sizes, weights, share, epochs):
    """Targets by repeated sharing, one source after the other."""
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        left, weight = total - sum(full.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > epochs * sizes[s]]
        if not over:
            return full | {s: left * weights[s] / weight for s in open_}
        full |= {s: epochs * sizes[s] for s in over}


def test_targets_match_sharing_by_hand(spark):
    sizes = {"é": 10, "a": 5000, "b": 20, "Z": 300, None: 700, "c": 0}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(rows).collect()}
    expected = level_fill(sizes, weights, 1.5, 2)
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


def test_mix_meets_targets_and_is_stable(spark):
    rows = spark.range(0, 4000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 40)) as source", "shiftrightunsigned(xxhash64(id), 1) as key",
        "cast(pmod(hash(id), 50) as bigint) as size", "id as rank",
    )
    first, second = (mix(rows, part_rows=100).collect() for _ in range(2))
    assert {(r["doc_id"], r["taken"]) for r in first} == {(r["doc_id"], r["taken"]) for r in second}
    taken = {}
    for r in first:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken.setdefault(r["source"], [0, r["target"], 0, r["source_size"]])
        taken[r["source"]][0] += r["taken"]
        taken[r["source"]][2] += r["size"]
    assert all(abs(t - aim) <= 0.5 and size == said for t, aim, size, said in taken.values())


def test_rows_that_share_a_key_share_the_cut(spark):
    rows = [(1, "a", 5, 10)] * 7 + [(2, "b", 9, 30)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, key long, size long"), weights=(1.0, 9.0)).collect()
    # 150 words by weight: b stops at 60, so a gets 90 of its 70, a pass and 20 words more
    assert sorted(r["taken"] for r in got) == [12] * 7 + [60]


def test_awkward_documents(spark):
    docs = cases.documents(spark)
    rows = mix(word_counts(docs)).collect()
    assert len(rows) == docs.count()
    sizes = sorted((d or -1, len(WORD.findall(t))) for d, t in cases.texts(docs))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sizes
    assert any(r["source"] is None and r["source_size"] > 0 for r in rows)


def test_texts_of_the_mix(spark):
    docs = cases.documents(spark)
    out = mixed_texts(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    words = {}
    for r in rows:
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    aims = {r["source"]: r["target"] for r in mix(word_counts(docs)).collect()}
    assert all(abs(words.get(s, 0) - aim) <= 3 for s, aim in aims.items())
    originals = [t for _, t in cases.texts(docs)]
    assert all(any(t.startswith(r["text"]) for t in originals) for r in rows)


def test_empty_tables(spark):
    assert mix(word_counts(cases.empty(spark))).count() == 0
    assert mixed_texts(cases.empty(spark)).count() == 0
