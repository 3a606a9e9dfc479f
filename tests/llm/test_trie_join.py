import random

import numpy as np
import pytest

from gleanset.llm import trie_join
from gleanset.llm.trie_join import (
    ORDER_BITS, SAMPLED, Trie, able, folded, ordered, parities, prefix, prefix_length, side_by_side, similar_classes, tile_pairs, together,
)
from tests.llm import cases
from tests.llm.test_minhash import brute_force as at_words
from tests.llm.test_minhash import copies, shingles


def brute_force(texts):
    """Component of each document by comparing every pair of rows, on shingles of four words."""
    sets = [(d, shingles(t, 4)) for d, t in texts if d is not None]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            shared = len(x & y)
            if x and y and 100 * shared >= 85 * (len(x) + len(y) - shared):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def compare(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, root string")
    got = similar_classes(docs, **options).collect()
    texts = [(r[0], r[1] or "") for r in rows]
    expected = brute_force(texts)
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == sorted(
        (d or -1, len(shingles(t, 4)), expected.get(d, -1) or -1) for d, t in texts
    )


@pytest.mark.parametrize("tile", [1 << 20, 6000, 1500])
def test_groups_of_near_copies(spark, tile):
    """Families, and a passage shared by documents that are no copies; small tiles force stars and tile pairs."""
    texts = [t for seed, n in ((1, 60), (2, 25), (3, 1), (4, 0)) for t in copies(seed, n, 120, 4)]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{k}x{i}" for i in range(25)) for k in range(12)]
    texts += [texts[0] + " " + shared, "Short Text", "short text", "short\ttext\n", "one", "", None]
    random.Random(9).shuffle(texts)
    compare(spark, [(i + 1, t, "x", "y") for i, t in enumerate(texts)], tile=tile)


def test_keys_of_very_many_documents_stay_whole(spark, monkeypatch):
    """With the bound of a key at three nodes, most keys skip the parities; tiles are small as well."""
    plain = trie_join.parted
    monkeypatch.setattr(trie_join, "parted", lambda shared, sets, percent: plain(shared, sets, percent, 3))
    texts = [t for seed, n in ((1, 40), (2, 9), (3, 1)) for t in copies(seed, n, 120, 4)]
    compare(spark, [(i + 1, t, "x", "y") for i, t in enumerate(texts)], tile=3000)


@pytest.mark.parametrize("tile", [1 << 20, 4000])
def test_chains_and_borders(spark, tile):
    """Each text differs from the next by about the bound, so components are chains and pairs fall on both sides of it."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k + 1, " ".join(words[k * step:k * step + 70]), "", "") for step in (5, 6) for k in range(20)]
    compare(spark, [(i + 1, *r[1:]) for i, r in enumerate(rows)], tile=tile)


def test_awkward_documents(spark):
    docs = cases.documents(spark).select("doc_id", "text").collect()
    compare(spark, [(r["doc_id"], r["text"], None, None) for r in docs])


def test_rows_of_one_id_link_their_groups(spark):
    a, b, c = (cases.prose(s, 60) for s in (21, 22, 23))
    compare(spark, [(5, a, "", ""), (9, a, "", ""), (9, b, "", ""), (12, b, "", ""), (3, c, "", ""), (12, c, "", "")])


def test_empty_table(spark):
    assert similar_classes(cases.empty(spark)).count() == 0


def test_five_words_agree_with_the_other_operator(spark):
    rows = [(i + 1, t, "", "") for i, t in enumerate(copies(5, 30, 90, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, root string")
    got = {r["doc_id"]: r["component_id"] for r in similar_classes(docs, words=5).collect()}
    assert got == at_words([r[:2] for r in rows])


def groups(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        label = [label[a] if x == label[b] else x for x in label]
    return [label.index(x) for x in label]


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_what_all_pairs_find(seed):
    pick = np.random.default_rng(seed)
    base = [np.unique(pick.integers(0, 400, pick.integers(1, 80))) for _ in range(8)]
    sets = []
    for _ in range(70):
        own = base[pick.integers(len(base))]
        own = own[pick.random(len(own)) > pick.choice([0, 0.03, 0.1])]
        own = np.unique(np.concatenate((own, pick.integers(400, 10**6, pick.integers(0, 4)))))
        sets.append((own if len(own) else np.array([1])).astype(np.uint64))
    near = [
        (i, j) for i in range(70) for j in range(i)
        if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))
    ]
    found = Trie(sets).links(np.arange(70), 85)
    assert groups(70, found) == groups(70, near) and {tuple(sorted(p, reverse=True)) for p in found} <= set(near)
    # Sets that are one component already are not linked again.
    assert not Trie(sets).links(np.zeros(70, np.int64), 85)


def test_bounds_and_links_cut_the_traversal():
    """Sets that share a passage leave at once; copies are connected by the first path."""
    passage = np.arange(10**6, 10**6 + 50, dtype=np.uint64)
    unlike = Trie([np.concatenate((np.arange(100 * k, 100 * k + 60), passage)).astype(np.uint64) for k in range(300)])
    assert not unlike.links(np.arange(300), 85) and unlike.visited == 1
    alike = Trie([np.delete(np.arange(400), [k]).astype(np.uint64) for k in range(300)])
    assert len(alike.links(np.arange(300), 85)) == 299 and alike.visited < 1000


def test_order_is_one_to_one_and_rare_first():
    place = np.random.default_rng(0).permutation(1 << ORDER_BITS).astype(np.uint64)
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    made = ordered(values, place)
    assert len(np.unique(made)) == 5000 and (made[1:] > made[:-1]).all()
    assert [prefix_length(n, 85) for n in (0, 1, 2, 7, 100)] == [0, 1, 1, 2, 16]


def test_tiles_of_one_component_do_not_meet(spark):
    """A family of many tiles and one other document: its tiles meet that document's, not each other."""
    rows = [(n, 7, 1, 1, 100) for n in range(200)] + [(500, 7, 1, 500, 100)]
    dealt = tile_pairs(spark.createDataFrame(rows, "node long, key long, root long, component long, weight long"), 1000).collect()
    met = {(r["i"], r["j"]) for r in dealt}
    assert len(met) <= 20 and {r["node"] for r in dealt} == {r[0] for r in rows}
    assert all(any(r["node"] == 500 for r in dealt if (r["i"], r["j"]) == pair) for pair in met)


def test_parities_keep_all_similar_pairs():
    pick = np.random.default_rng(3)
    base = np.unique(pick.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [base[pick.random(len(base)) > share] for share in (0, 0.02, 0.05, 0.1, 0.14, 0.2, 0.4)]
    sets += [np.unique(pick.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 40, 260, 300)]
    sizes, bits = np.array([len(s) for s in sets]), folded([parities(s).tobytes() for s in sets], 8)
    for i, x in enumerate(sets):
        got = able((sizes[i], sizes), (bits[i], bits), 85)
        for j, y in enumerate(sets):
            assert got[j] or 185 * len(np.intersect1d(x, y)) < 85 * (len(x) + len(y))
    assert able((sizes[0], sizes), (bits[0], bits), 85)[-5:].sum() == 0
    assert together(sizes, bits, 85).tolist() == side_by_side(sizes[None, :], bits[None, :], 85)[0].tolist()
    assert side_by_side(np.tile(sizes, (3, 1)), np.tile(bits, (3, 1, 1)), 85).shape == (3, len(sets))


def test_parities_fold():
    values = np.unique(np.random.default_rng(4).integers(0, 2**63, 9000, dtype=np.uint64))
    large, small = parities(values), parities(values[:100])
    assert len(large) == 128 and len(small) == 8
    assert folded([large.tobytes(), small.tobytes()], 8)[0].tolist() == np.bitwise_xor.reduce(large.reshape(16, 8), axis=0).tolist()
    bucket = (values >> np.uint64(ORDER_BITS) & np.uint64(511)).astype(np.int64)
    odd = np.packbits((np.bincount(bucket, minlength=512) & 1).astype(np.uint8)).view(np.uint64)
    assert folded([large.tobytes()], 8)[0].tolist() == odd.tolist()


@pytest.mark.parametrize("n, m", [(1040, 1190), (1100, 1250), (2000, 2300), (20_000, 20_000)])
def test_large_sets_share_keys(n, m):
    """Two sets at the bound, all differences among the first shingles: still tens of keys in common, and few in all."""
    pick = np.random.default_rng(n)
    shared = -(-85 * (n + m) // 185)
    base = np.sort(pick.integers(2**62, 2**63, shared, dtype=np.uint64))
    x = np.concatenate((np.sort(pick.integers(0, 2**62, n - shared, dtype=np.uint64)), base))
    y = np.concatenate((np.sort(pick.integers(0, 2**62, m - shared, dtype=np.uint64)), base))
    a, b = prefix(x, 85), prefix(y, 85)
    assert len(np.intersect1d(a, b)) >= 15 and max(len(a), len(b)) < 0.25 * SAMPLED


def test_long_documents(spark):
    """Copies of texts beyond the bound of sampling, and texts that share a passage with them only."""
    base = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-200])), (3, " ".join(base[1500:] + [f"x{i}" for i in range(1500)]))]
    rows += [(4, " ".join([f"v{i}" if i % 97 == 0 else w for i, w in enumerate(base)])), (5, " ".join(base[2000:2100] + [f"y{i}" for i in range(2500)]))]
    compare(spark, [(*r, "", "") for r in rows])
