import numpy as np
import pytest

from gleanset.llm.whitening import (
    characteristic_polynomial, components, hessenberg, is_prime, largest_roots, polynomial_mod, roots_beyond, usable, whitened,
)

SCHEMA = "vec_id long, embedding array<float>, component string, n string, cells string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in vectors], SCHEMA)


def whole(v, dim):
    x = [int(np.floor(256 * float(np.float32(c)))) for c in v]
    return x + [0] * (dim - len(x))


def check(spark, vectors, most=4, counted=None):
    """Compare with a plain eigendecomposition of the distinct vectors' covariance."""
    rows = whitened(table(spark, vectors), most).collect()
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    made = [(i, whole(v, dim)) for i, v in kept]
    once = sorted({tuple(x) for _, x in made})
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    centred = np.array(once, float) - np.array(sums, float) / max(n, 1) if n else np.zeros((0, dim))
    values, axes = np.linalg.eigh(centred.T @ centred / max(n, 1)) if n else (np.zeros(0), None)
    order = np.argsort(-values)[:most]
    count = int((values[order] > 1e-9 * max(values.max(initial=0), 1e-300)).sum()) if counted is None else counted
    assert len(rows) == len(made) * count
    got = {}
    for r in rows:
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[order[r["component"] - 1]] / values.sum(), rel=1e-9)
        got.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    exact = sorted(((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), x) for i, x in made), key=key)
    for k in range(count):
        mine = sorted(got[k + 1], key=key)
        assert [r[:2] for r in mine] == [e[:2] for e in exact]
        plain = (np.array([e[2] for e in exact]) - np.array(sums) / n) @ axes[:, order[k]] / np.sqrt(values[order[k]])
        z = np.array([r[2] for r in mine])
        gap = min((abs(values[order[k]] - v) for j, v in enumerate(values) if j != order[k]), default=1) / values.max()
        if gap > 1e-6:
            assert min(np.abs(z - plain).max(), np.abs(z + plain).max()) < 1e-7
    return rows


def test_against_plain_decomposition(spark):
    random = np.random.default_rng(1)
    cells = random.normal(size=(200, 12)) @ random.normal(size=(12, 12)) + 50
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(cells)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(90)] + [(None, vectors[3][1])]
    check(spark, vectors)


def test_real_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check(spark, [(r["vec_id"], r["embedding"]) for r in rows])


def test_unusable_and_uneven_vectors(spark):
    vectors = [
        (1, [1.0, 2.0]), (2, [0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf")]), (7, [0.5, 0.0]),
        (8, []), (None, [3.0, 9.0]), (1, [1.0, 2.0]),
    ]
    check(spark, vectors)
    assert whitened(table(spark, [(1, [1e30]), (2, [1.0]), (3, [2.0])])).count() == 2


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)], [(1, None)], [(1, []), (2, [])]])
def test_no_variance(spark, vectors):
    frame = whitened(table(spark, vectors))
    assert frame.count() == 0 and frame.columns[0] == "vec_id"


def test_rank_below_the_number_of_components(spark):
    check(spark, [(i, [i / 4, i / 2, 1.0]) for i in range(30)], counted=1)


def test_equal_eigenvalues(spark):
    """Corners of a cube: one eigenvalue three times; the coordinates are still uncorrelated."""
    corners = [[float(i & 1), float(i >> 1 & 1), float(i >> 2)] for i in range(8)]
    rows = check(spark, list(enumerate(corners)), counted=3)
    z = np.array([[r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"])) if r["vec_id"] == i] for i in range(8)])
    assert np.abs(z.T @ z / 8 - np.eye(3)).max() < 1e-12


def test_large_numbers_stay_exact(spark):
    """Far from the origin and beyond the range where products fit a long."""
    vectors = [(i, [2.0**40 + 2.0**18 * (i % 7), -(2.0**30) * (i % 5), float(i)]) for i in range(40)]
    rows = whitened(table(spark, vectors)).collect()
    once = [whole(v, 3) for _, v in vectors]
    sums = [sum(c) for c in zip(*once, strict=True)]
    for r in rows:
        expected = sum((40 * c - s) ** 2 for c, s in zip(once[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (expected if expected < 2**63 else None)
        assert r["identity_error"] < 1e-9


def test_polynomial_is_exact(spark):
    random = np.random.default_rng(2)
    x = random.integers(-9, 9, (6, 5))
    cells = (x.T @ x).tolist()
    got = characteristic_polynomial(spark, cells)
    assert got == [round(c) for c in np.poly(np.array(cells, float))[::-1]]
    # Every matrix is a root of its own polynomial.
    power, total, matrix = np.eye(5, dtype=object), np.zeros((5, 5), object), np.array(cells, object)
    for c in got:
        total, power = total + c * power, power @ matrix
    assert not total.any()


def test_hessenberg_keeps_the_trace_with_zero_pivots():
    p = 1009
    cells = np.array([[1, 0, 0, 5], [0, 2, 7, 0], [0, 7, 3, 0], [5, 0, 0, 4]])
    h = hessenberg(cells, p)
    assert np.trace(h) % p == 10 and not np.tril(h, -2).any()
    assert polynomial_mod(cells, p) == [round(c) % p for c in np.poly(cells.astype(float))[::-1]]


def test_roots_and_their_multiplicities():
    # (x - 5)^2 (x - 3) (x - 2) x
    coefficients = [int(round(c)) for c in np.poly([5, 5, 3, 2, 0])[::-1]]
    assert [roots_beyond(coefficients, k, 0) for k in (0, 2, 3, 4, 5)] == [4, 3, 2, 2, 0]
    roots = largest_roots(coefficients, 4)
    assert [r / (1 << s) for r, s in roots] == [5, 5, 3, 2]
    assert [r / (1 << s) for r, s in largest_roots([2, -4, 1], 3)] == [2 + 2**0.5, 0.585786437626905]
    axes = components([[2, 0, 0], [0, 5, 0], [0, 0, 5]], [(5 << 90, 90), (5 << 90, 90), (2 << 91, 91)])
    assert np.abs(axes.T @ axes - np.eye(3)).max() < 1e-15 and np.abs(axes[0]).tolist()[2] == 1


def test_primes():
    small = [n for n in range(200) if is_prime(n)]
    assert small == [n for n in range(2, 200) if all(n % k for k in range(2, n))]
    assert is_prime(2**31 - 1) and not is_prime(46337 * 46337)


def test_cells_lose_zeros_at_the_end(spark):
    rows = usable(table(spark, [(1, [1.0, 0.0]), (2, [1.0])]), "vec_id", "embedding", 256).collect()
    assert rows[0]["cells"] == rows[1]["cells"] and {r["dim"] for r in rows} == {1}
