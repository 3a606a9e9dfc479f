import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.llm import topk
from gleanset.llm.topk import Search, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label string, score string, rank string"


def by_hand(vectors, is_query, top):
    made = {i: np.floor(256 * np.array(v, np.float64)) for i, v in vectors}
    out = set()
    for q in filter(is_query, made):
        scores = sorted((-int(made[q] @ v), i) for i, v in made.items() if i != q)[:top]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("block, queries, share", [(4096, 1024, 64), (16, 3, 2)])
def test_against_all_products(spark, block, queries, share):
    random = np.random.default_rng(3)
    rows = random.normal(size=(300, 12)).astype(np.float32) * random.lognormal(0, 1, (300, 1)).astype(np.float32)
    rows[100:180] = rows[100]  # many ties
    rows[250] = 0
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    frame = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in vectors], SCHEMA)
    got = top_inner_products(frame, F.col("vec_id") % 10 == 0, 5, block=block, queries=queries, share=share).collect()
    assert {tuple(r) for r in got} == by_hand(vectors, lambda i: i % 10 == 0, 5)
    assert len(got) == 150


def test_unusable_vectors_and_few_candidates(spark):
    rows = [
        (50, [1.0, 2.0], "", "", ""), (50, [1.0, 2.0], "", "", ""), (51, [0.5, -1.0], "", "", ""), (100, [1.0], "", "", ""), (52, None, "", "", ""),
        (53, [1.0, None], "", "", ""), (54, [float("nan"), 1.0], "", "", ""), (55, [float("inf"), 1.0], "", "", ""), (None, [9.0, 9.0], "", "", ""),
    ]
    got = top_inner_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    one = 256 * 256
    assert {tuple(r) for r in got} == {(50, 1, 100, one), (50, 2, 51, -3 * one // 2), (100, 1, 50, one), (100, 2, 51, one // 2)}


def test_empty_table(spark):
    assert top_inner_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_skip_most_products():
    """With lengths that fall off, few products are summed to the end."""
    random = np.random.default_rng(8)
    vectors = np.floor(256 * random.normal(size=(4000, 16)) * np.linspace(3, 0.05, 4000)[:, None]).astype(np.int64)
    _, axes = np.linalg.eigh(vectors.T.astype(float) @ vectors)
    search = Search(np.arange(-20, 0), np.floor(256 * random.normal(size=(20, 16))).astype(np.int64), axes[:, ::-1], 5)
    for at in range(0, 4000, 500):
        search.feed(np.arange(at, at + 500), vectors[at:at + 500])
    assert search.summed < 0.1 * 20 * 4000


@pytest.mark.parametrize("partitions", [4, 40])
def test_blocks_do_not_follow_the_partitions(spark, partitions):
    """However many partitions: full blocks, and short candidates are sent to no query block."""
    random = np.random.default_rng(5)
    rows = random.normal(size=(600, 8)) * np.where(np.arange(600) < 100, 4, 0.01)[:, None]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    frame = spark.createDataFrame([(i, v, "", "", "") for i, v in vectors], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        made = topk.settled(topk.whole_vectors(frame), "vectors")
        made_blocks = topk.settled(topk.blocks(made, 50), "blocks")
        assert made_blocks.count() <= 2 * 12
        asked = topk.blocks(made.filter("vec_id % 50 = 0 AND vec_id < 100"), 50).withColumn("qb", F.lit(0))
        needs, bars = topk.first_bars(asked, made_blocks.orderBy(F.desc("norm")).limit(1), np.eye(8), 5)
        near = made_blocks.filter(F.col("norm") >= needs[0]).count()
        assert len(needs) == 1 and near < made_blocks.count() / 2
        got = top_inner_products(frame, F.col("vec_id") % 50 == 0, block=50, queries=10)
        assert {tuple(r) for r in got.collect()} == by_hand(vectors, lambda i: i % 50 == 0, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_own_rows_take_no_places_in_the_first_bar():
    """A queried id with many vectors, all longer than the others: its own rows fill the top of the block."""
    random = np.random.default_rng(6)
    own = np.full((12, 8), 900) + random.integers(0, 50, (12, 8))
    others = random.integers(-300, 300, (40, 8))
    cells = np.concatenate((own, others)).astype(np.int64)
    ids = np.concatenate((np.full(12, 50), np.arange(100, 140)))
    search = Search(np.array([50]), cells[:1], np.eye(8), 5)
    search.feed(ids, cells)
    best = sorted((-int(cells[0] @ v), int(i)) for i, v in zip(ids, cells, strict=True) if i != 50)[:5]
    assert list(zip((-search.score).tolist(), search.found.tolist(), strict=True)) == best
