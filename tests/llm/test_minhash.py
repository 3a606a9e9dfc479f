import random

import numpy as np
import pyarrow as pa
import pytest

from gleanset.llm.minhash import (
    BANDS, ROWS, UNIVERSE, band_keys, components, forest, intersections, near_duplicates, permutations, shingle_sets, signature,
)
from tests.llm import cases

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, words=5):
    own = text.encode().translate(LOWER).split()
    if len(own) < words:
        return frozenset([tuple(own)]) if own else frozenset()
    return frozenset(tuple(own[i:i + words]) for i in range(len(own) - words + 1))


def brute_force(texts, percent=85):
    """Component of each document by comparing every pair of rows; rows with one id are one document."""
    sets = [(d, shingles(t)) for d, t in texts if d is not None]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            shared = len(x & y)
            if x and y and 100 * shared >= percent * (len(x) + len(y) - shared):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def compare(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, root string")
    got = near_duplicates(docs, **options).collect()
    texts = [(r[0], r[1] or "") for r in rows]
    expected = brute_force(texts)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((d or -1, len(shingles(t))) for d, t in texts)
    for r in got:
        assert r["component_id"] == expected.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def copies(seed, n, words, changes):
    """A base text and copies with a few words changed, some copied from copies."""
    pick = random.Random(seed)
    made = [[f"w{pick.randrange(5000)}" for _ in range(words)]]
    for _ in range(n):
        own = list(pick.choice(made))
        for _ in range(pick.randint(0, changes)):
            own[pick.randrange(words)] = f"v{pick.randrange(5000)}"
        made.append(own)
    pick.shuffle(made)
    return [" ".join(own) for own in made]


@pytest.mark.parametrize("tile", [1 << 20, 3000])
def test_groups_of_near_copies(spark, tile):
    texts = [t for seed, n in ((1, 60), (2, 25), (3, 1), (4, 0)) for t in copies(seed, n, 120, 4)]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{k}x{i}" for i in range(25)) for k in range(12)]
    texts += ["Short Text", "short text", "short\ttext\n", "one", "", None]
    random.Random(9).shuffle(texts)
    compare(spark, [(i, t, "x", "y") for i, t in enumerate(texts)], tile=tile)


def test_awkward_documents(spark):
    docs = cases.documents(spark).select("doc_id", "text").collect()
    compare(spark, [(r["doc_id"], r["text"], None, None) for r in docs])


def test_rows_of_one_id_link_their_groups(spark):
    a, b, c = (cases.prose(s, 60) for s in (21, 22, 23))
    compare(spark, [(5, a, "", ""), (9, a, "", ""), (9, b, "", ""), (12, b, "", ""), (3, c, "", ""), (12, c, "", "")])


def test_empty_table(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0


def test_shingles_match_words():
    texts = [cases.prose(3), "A b\tC d\x0be f", "x", "", None, "a b c d é É", cases.LONG]
    for text, got in zip(texts, shingle_sets(pa.array(texts)), strict=True):
        assert len(got) == len(shingles(text or ""))
    first, second = shingle_sets(pa.array(["One TWO three", "one two Three"]))
    assert first.tolist() == second.tolist()


def test_signature_is_circulant():
    scatter, windows = permutations(1 << 10, 16, 3)
    places = np.array([5, 900, 1023], np.uint64)
    circle = windows[:, 0]
    expected = [min(circle[(scatter[int(p)] + k) % 1024] for p in places) for k in range(16)]
    assert signature(places, scatter, windows).tolist() == expected


def test_signature_estimates_similarity():
    random_ = np.random.default_rng(4)
    pool = random_.integers(0, 2**63, 1200, dtype=np.uint64)
    scatter, windows = permutations(UNIVERSE, BANDS * ROWS, 20)
    a, b = signature(pool[:1000], scatter, windows), signature(pool[100:1100], scatter, windows)
    assert abs((a == b).mean() - 900 / 1100) < 0.1
    assert (band_keys(np.stack([a, b]), BANDS, ROWS)[0] == band_keys(np.stack([a, b]), BANDS, ROWS)[1]).any()


def test_intersections_count_light_and_heavy_shingles():
    random_ = np.random.default_rng(7)
    sets = [np.unique(random_.integers(0, 90, random_.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    got = intersections(sets)
    for i in range(40):
        for j in range(i):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    a, b = forest(np.arange(40), sets, 10)
    assert len(a) == len(b) <= 39


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(700, 701), (701, 700), (702, 701)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(roots)
    groups = {}
    for node, root in roots.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(min, groups.values())) == [0, 500, 700]
    assert {len(g) for g in groups.values()} == {201, 60, 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
