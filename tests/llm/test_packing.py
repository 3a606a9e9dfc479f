import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanset.llm.packing import fullest, grouped, pack, pieces, plan, ranked, sequences
from gleanset.llm.tokens import vocabulary
from tests.llm import cases

WORD = public_tokenizers.path("word_bpe_49k.json")


def check_plan(histogram, capacity, runs):
    """Every document has one place and places do not overlap or leave gaps before them."""
    places = Counter()
    for length, count in histogram.items():
        own = sorted((r.first, r.count) for r in runs if r.length == length)
        assert [f for f, _ in own] == [sum(c for _, c in own[:i]) for i in range(len(own))]
        assert sum(c for _, c in own) == count
    fill = np.zeros(max((r.sequence + r.count for r in runs), default=0), int)
    for r in sorted(runs, key=lambda r: r.offset):
        assert (fill[r.sequence:r.sequence + r.count] == r.offset).all()
        fill[r.sequence:r.sequence + r.count] += r.length
        places[r.length] += r.count
    assert (fill <= capacity).all() and (fill > 0).all()
    return len(fill)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plans_place_every_document(histogram):
    for groups in (2, 256):
        check_plan(histogram, 64, plan(histogram, 64, groups))


def test_plan_is_near_the_bound():
    random = np.random.default_rng(5)
    histogram = Counter(np.clip(random.lognormal(6, 1, 20_000).astype(int), 2, 2048).tolist())
    used = check_plan(histogram, 2048, plan(histogram))
    assert used <= 1.002 * -(-sum(n * c for n, c in histogram.items()) // 2048)
    # A perfect packing exists and is found.
    pairs = {700: 500, 1348: 500}
    assert check_plan(pairs, 2048, plan(pairs)) == 500


def test_plan_size_does_not_follow_the_number_of_documents():
    random = np.random.default_rng(6)
    histogram = Counter(np.clip(random.lognormal(6, 1, 5_000).astype(int), 2, 2048).tolist())
    few, many = plan(histogram), plan({n: c * 10**8 for n, c in histogram.items()})
    assert len(many) < 3 * len(few) + 5000


def test_groups_have_equal_cardinality_and_round_up():
    made = grouped([(90, 3), (50, 5), (10, 4)], 4)
    assert [size for size, _ in made] == [90, 50, 10]
    assert sum(c for _, own in made for _, c in own) == 12
    assert all(length <= size for size, own in made for length, _ in own)


def test_fullest_respects_counts():
    assert fullest([7, 5, 3], [1, 1, 9], 12) == [1, 1, 0]
    assert fullest([7, 5], [5, 0], 13) == [1, 0]


def test_ranks_of_a_split_key(spark):
    rows = spark.range(0, 1000).selectExpr("id as uid", "if(id % 3 = 0, 5, id % 7) as length")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    got = ranked(rows, "length", counts, most=50).collect()
    for length, n in counts.items():
        assert sorted(r["rank"] for r in got if r["length"] == length) == list(range(n))


def test_packing_of_awkward_documents(spark):
    docs = cases.documents(spark)
    packed = pack(pieces(docs, WORD, 64, with_ids=True), 64).cache()
    expected = Counter()
    for doc_id, text in cases.texts(docs):
        ids = np.frombuffer(vocabulary(WORD).plain_ids(text) + b"\0\0\0\0", "<u4")
        for number, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            expected[doc_id, number, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by_sequence = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 64
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in sequences(packed).collect()} == by_sequence


def test_empty_table(spark):
    assert pack(pieces(cases.empty(spark), WORD)).count() == 0
