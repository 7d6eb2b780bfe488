"""Whitening and ball k-means against NumPy and plain code."""

import hashlib
import math

import numpy as np
import pytest

from plumbline.llm import ballkmeans, vectors, whitening

ROWS = "vec_id long, embedding array<float>, x int, cluster int"


def table(spark, vectors_of, kind="float"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2) for i, v in vectors_of]
    return spark.createDataFrame(rows, ROWS.replace("float", kind)).repartition(3)


def test_packed_vectors_are_equal_if_and_only_if_the_numbers_are():
    draw = np.random.default_rng(1)
    for high in (100, 30000, 10**9, 1e30):
        x = np.floor(draw.uniform(-high, high, (20, 7)))
        x[3] = 0
        blobs = [vectors.packed(r) for r in x]
        assert (vectors.matrix(blobs, 9)[:, :7] == x).all() and not vectors.matrix(blobs, 9)[:, 7:].any()
    assert vectors.packed(np.array([1.0, -0.0, 0.0])) == vectors.packed(np.array([1.0]))
    assert vectors.packed(np.array([-128.0])) != vectors.packed(np.array([128.0]))


# -- whitening


def expected(rows, count=16):
    """By NumPy's eigenvalues over the distinct vectors."""
    d = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] + [1000000] * (d - len(v)) for _, v in rows], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s).astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(count, int((e > 1e-12 * e[0]).sum()))
    deviation = [sum(int(v) ** 2 for v in n * r - s) for r in x]
    return n, deviation, (n * x - s).astype(float) / n @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_whitening(spark, rows, kind="float", close=1e-9):
    got = whitening.whiten(table(spark, rows, kind)).collect()
    usable = [(i, v) for i, v in rows if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    if kind == "float":
        usable = [(i, [float(np.float32(c)) for c in v]) for i, v in usable]
    n, deviation, white, explained = expected(usable)
    k = white.shape[1]
    assert len(got) == len(usable) * k
    by = {(r["vec_id"], r["component"]): r for r in got}
    sign = [np.sign(sum(by[i, c + 1]["whitened"] * white[j, c] for j, (i, _) in enumerate(usable))) for c in range(k)]
    for j, (i, _) in enumerate(usable):
        for c in range(k):
            r = by[i, c + 1]
            assert r["n"] == n and r["deviation"] == min(deviation[j], 2**63 - 1)
            assert r["whitened"] * sign[c] == pytest.approx(white[j, c], abs=close)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9
    return got


def test_whitening_equals_numpy(spark):
    draw = np.random.default_rng(2)
    v = (draw.standard_normal((150, 24)) * np.linspace(3, 0.3, 24)).tolist()
    rows = list(enumerate(v)) + [(900, v[0]), (901, v[0]), (902, None), (903, [1.0, None]), (904, [float("nan")] * 24), (905, [float("inf")] + [0.0] * 23)]
    check_whitening(spark, rows)


def test_whitening_of_few_dimensions_lengths_and_large_numbers(spark):
    draw = np.random.default_rng(3)
    check_whitening(spark, list(enumerate(draw.standard_normal((40, 3)).tolist())))
    flat = draw.standard_normal((50, 2)) * 4
    check_whitening(spark, list(enumerate(np.column_stack((flat, flat[:, 0], np.ones(50))).tolist())))  # two components
    short = draw.standard_normal((60, 5)).tolist()
    check_whitening(spark, [(i, v[: 5 - i % 3]) for i, v in enumerate(short)] + [(99, [])])
    check_whitening(spark, list(enumerate((draw.standard_normal((30, 4)) * [1e14, 1e13, 5e12, 1e12]).tolist())), "double", 1e-6)


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, None)])).count() == 0
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).count() == 0


@pytest.mark.parametrize("values", [np.sort(np.random.default_rng(4).random(64))[::-1], np.r_[9, 8, 7, np.zeros(40)], 1 / np.arange(1, 401), np.r_[np.linspace(2, 5, 20), np.random.default_rng(5).random(480)]])
def test_lanczos_knows_the_matrix_by_its_products_only(values):
    draw = np.random.default_rng(6)
    q = np.linalg.qr(draw.standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    passes = []
    e, u = whitening.lanczos(lambda x: passes.append(x.shape[1]) or a @ x, len(values), 16)
    want = np.sort(values)[::-1][:16]
    assert np.abs(e - want).max() < 1e-13 * want[0] * len(values) and np.abs(u.T @ u - np.eye(16)).max() < 1e-13
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12 * want[0] and sum(passes) <= 60 * 20


def test_lanczos_restarts_where_a_block_breaks_down():
    """A start inside an invariant subspace must not hide eigenvalues outside it."""
    values = np.r_[np.full(60, 1.0), np.full(30, 0.5)]
    e, _ = whitening.lanczos(lambda x: values[:, None] * x, 90, 16)
    assert np.allclose(e, 1)


# -- ball k-means


def plain_kmeans(rows, k=40, rounds=5, dim=64):
    x = {}
    for at, (i, v) in enumerate(rows):
        x[at] = [math.floor(256 * float(np.float32(c))) for c in v]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x[at]) for at, (i, _) in enumerate(rows))[:k]
    centroids = [list(v) for _, v in first]
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    place = lambda: {at: min((away(v, c), j) for j, c in enumerate(centroids)) for at, v in x.items()}
    for _ in range(rounds):
        at = place()
        for j in range(len(centroids)):
            own = [x[i] for i, (_, c) in at.items() if c == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    at = place()
    total = sum(d for d, _ in at.values())
    inertia = {j: sum(d for d, c in at.values() if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((rows[i][0], c, d, inertia[c], total, sha[c]) for i, (d, c) in at.items())


def check_kmeans(spark, rows, sound=None, **how):
    got = sorted(tuple(r) for r in ballkmeans.ball_kmeans(table(spark, rows), **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == plain_kmeans(sound if sound is not None else rows, **how)


def test_ball_kmeans_equals_plain_kmeans(spark):
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((12, 8))
    v = (centres[draw.integers(0, 12, 300)] + 0.3 * draw.standard_normal((300, 8))).tolist()
    rows = list(enumerate(v)) + [(1000 + i, v[i]) for i in range(20)]
    check_kmeans(spark, rows + [(2000, None), (2001, [1.0] * 7), (2002, [None] + [1.0] * 7), (2003, [float("nan")] * 8), (2004, [])], rows, k=15, dim=8)


def test_ties_few_vectors_and_empty_tables(spark):
    grid = [(i, [i % 4 / 256, i // 4 % 4 / 256]) for i in range(48)]  # many equal distances and equal vectors
    check_kmeans(spark, grid, k=9, dim=2)
    check_kmeans(spark, grid[:5], k=9, dim=2)
    check_kmeans(spark, [(1, [0.5, 0.5])] * 4, k=3, dim=2)
    assert ballkmeans.ball_kmeans(table(spark, []), k=3, dim=2).count() == 0
    got = ballkmeans.ball_kmeans(table(spark, [(None, [0.0, 1.0]), (4, [1.0, 0.0])]), k=3, dim=2).collect()
    assert {(r["vec_id"], r["cluster"]) for r in got} == {(None, 0), (4, 0)}


def test_large_numbers_are_compared_exactly(spark):
    rows = [(i, [float(2.0**40 + (i % 5) * 2.0**20), 1.0 + i]) for i in range(30)]
    check_kmeans(spark, rows, k=4, dim=2)
    far = [(1, [3e37, 0.0]), (2, [-3e37, 0.0]), (3, [1.0, 0.0])]
    got = {r["vec_id"]: r["distance"] for r in ballkmeans.ball_kmeans(table(spark, far), k=1, dim=2).collect()}
    assert got == {i: min(d, 2**63 - 1) for i, _, d, _, _, _ in plain_kmeans(far, k=1, dim=2)} and got[3] < 2**63 - 1 == got[1] == got[2]


def test_balls_spare_most_distances():
    draw = np.random.default_rng(8)
    centres = np.floor(draw.standard_normal((20, 16)) * 2000)
    x = np.floor(np.repeat(centres, 50, axis=0) + draw.standard_normal((1000, 16)) * 100)
    b = ballkmeans.balls([list(map(int, c)) for c in centres], None)
    cluster, distance, every = ballkmeans.placed(x, None, b)
    far = [math.isqrt(int(distance[cluster == j].max())) + 1 for j in range(20)]
    again, same_distance, compared = ballkmeans.placed(x, cluster, ballkmeans.balls([list(map(int, c)) for c in centres], far))
    assert (again == cluster).all() and (same_distance == distance).all()
    assert every == 20_000 and compared == 1000  # every member is in its ball's stable core
