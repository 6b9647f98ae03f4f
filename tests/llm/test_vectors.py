import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<double>, label long, score string, row string"


def lattice(x, scale):
    """floor(scale * x) as an integer, of the largest double at most."""
    return int(np.floor(np.clip(float(x) * scale, -np.finfo(float).max, np.finfo(float).max)))


def product(a, b):
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))


def brute_negatives(rows, positives=5, negatives=10, every=100):
    usable = [(i, [lattice(x, 256) for x in v], y) for i, v, y, *_ in rows if v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (anchor, a, label) in enumerate(usable):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-product(a, b), i is None, i or 0, y) for m, (i, b, y) in enumerate(usable) if m != n and len(a) == len(b)), key=lambda x: x[:3])
        for p, p_null, p_id, _ in [x for x in scored if x[3] == label][:positives]:
            inside = [x for x in scored if x[3] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out.update((anchor, None if p_null else p_id, r + 1, None if null else i, -p, -s) for r, (s, null, i, _) in enumerate(inside))
    return out


@pytest.mark.parametrize("block,anchors", [(4096, 4096), (70, 2)])
def test_hard_negatives(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 12)) + 1
    rows = [(i, (centres[i % 4] + rng.normal(size=12) * .8).tolist(), i % 4, "x", "y") for i in range(260)]
    rows += [rows[100], rows[7], (100, rows[5][1], 2, "x", "y"), (None, rows[4][1], 0, "x", "y"), (None, rows[5][1], 1, "x", "y")]
    rows += [(300, None, 1, "x", "y"), (301, rows[1][1], None, "x", "y"), (302, [None] * 12, 1, "x", "y"), (303, [float("inf")] * 12, 1, "x", "y")]
    rows += [(400, [1e8] * 12, 1, "x", "y"), (401, [6e7] * 12, 2, "x", "y"), (402, [1e8] * 12, 1, "x", "y"), (500, [1e300] * 12, 3, "x", "y")]
    rows += [(600, [1.0, 2.0, 3.0], 1, "x", "y"), (601, [1.0, 2.0, 3.0], 1, "x", "y"), (602, [1.0, 1.0, 1.0], 2, "x", "y"), (700, [], 1, "x", "y"), (701, [], 1, "x", "y"), (702, [], 2, "x", "y")]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_negatives(rows)
    assert len(want) > 150
    got = Counter(map(tuple, hard_negatives.mine(d).collect()))
    assert (got - want, want - got) == (Counter(), Counter())
    assert hard_negatives.mine(d.filter("false")).count() == 0


def test_segment_bounds_hold_and_narrow():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7, 16, 64):
        a, b = (rng.integers(-300, 300, (40, d)).astype(float) for _ in range(2))
        exact, before = a @ b.T, np.inf
        for (m, s), (n, t) in zip(hard_negatives.summaries(a), hard_negatives.summaries(b)):
            radius = s @ t.T + 1e-6
            assert (np.abs(exact - m @ n.T) <= radius).all()
            assert radius.sum() <= before + 1e-3
            before = radius.sum()


def test_segments_prune_clustered_vectors():
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=(3000, 64)) * .2, axis=1) + rng.normal(size=(3000, 1))  # neighbouring components are alike
    vectors = np.floor(256 * walk)
    block, levels = hard_negatives.Segments(vectors), hard_negatives.summaries(vectors)
    for i in range(50):
        (best, score), = block.best(vectors[i], [(m[i], s[i]) for m, s in levels], np.arange(3000), [(-(1 << 63), (1 << 63) - 1)], 10)
        exact = (vectors @ vectors[i]).astype(np.int64)
        assert list(score) == sorted(exact, reverse=True)[:10] and (exact[best] == score).all()
    assert block.scored < 0.1 * block.met


@pytest.mark.parametrize("kind", ["random", "repeated", "low rank", "identity", "one", "graded"])
def test_leading_eigenpairs(kind):
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    matrix = {
        "random": lambda: np.cov(rng.normal(size=(40, 90))), "repeated": lambda: q @ np.diag([5, 5, 5, 4, 4, 3, 3, 3] + [1] * 32) @ q.T,
        "low rank": lambda: q[:, :3] @ np.diag([9, 2, 1e-3]) @ q[:, :3].T, "identity": lambda: np.eye(40) * 3, "one": lambda: np.array([[2.5]]),
        "graded": lambda: q @ np.diag(10.0 ** -np.arange(40)) @ q.T}[kind]()
    matrix = (matrix + matrix.T) / 2
    found = whitening.leading(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1][:len(found.values)]
    assert len(found.values) == {"low rank": 3, "one": 1}.get(kind, 8)
    assert found.certified and np.abs(found.values - want).max() < 1e-13 * found.trace
    assert np.abs(found.vectors @ found.vectors.T - np.eye(len(want))).max() < 1e-12
    assert np.abs(matrix @ found.vectors.T - found.vectors.T * found.values).max() < 1e-12 * found.trace
    for shift in rng.uniform(-1, 6, 20):
        assert whitening.eigenvalues_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


def brute_whitening(rows, components=8):
    usable = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64) + 100_000) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for d in {len(v) for _, v in usable} - {0}:
        ids, x = zip(*[(i, v) for i, v in usable if len(v) == d])
        x = np.array(x)
        n, sums = len(x), x.sum(0)
        y = (n * x - sums) / n
        values, vectors = np.linalg.eigh(y.T @ y / n)
        keep = [k for k in range(d - 1, -1, -1) if values[k] > 1e-9 * max(values.sum(), 1e-300)][:components]
        for i, row, deviation in zip(ids, y, ((n * x - sums) ** 2).sum(1)):
            for place, k in enumerate(keep):
                out.setdefault((i, place + 1, n, int(deviation)), []).append((abs(row @ vectors[:, k]) / values[k] ** .5, values[k] / values.sum()))
    return out


def test_whitening(spark):
    rng = np.random.default_rng(9)
    shape = np.diag(np.linspace(1, 3, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, (rng.normal(size=12) @ shape).tolist(), 0, "x", "y") for i in range(120)]
    rows += [rows[3], (None, rows[5][1], 0, "x", "y"), (121, None, 0, "x", "y"), (122, [None] * 12, 0, "x", "y"), (123, [float("nan")] * 12, 0, "x", "y"), (124, [], 0, "x", "y")]
    rows += [(125, [1.0, 2.0], 0, "x", "y"), (126, [3.0, 1.0], 0, "x", "y"), (127, [2.0, 2.0], 0, "x", "y"), (128, [4.0], 0, "x", "y"), (129, [1.0, 1.0, 1.0], 0, "x", "y"), (130, [1.0, 1.0, 1.0], 0, "x", "y")]
    d = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA).repartition(3)
    got = whitening.whiten(d).collect()
    want = brute_whitening(rows)
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == Counter({k: len(v) for k, v in want.items()})
    for r in got:
        white, share = want[r.vec_id, r.component, r.n, r.deviation][0]
        assert abs(r.whitened) == pytest.approx(white, rel=1e-7, abs=1e-7) and r.explained == pytest.approx(share, rel=1e-9)
        assert r.identity_error < 1e-9 and r.certified and r.deviation_double == r.deviation
    assert whitening.whiten(d.filter("false")).count() == 0


def test_whitening_of_large_components_and_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIMENSIONS", 4)
    rows = [(i, [float(i % 3)] * k + [float(i % 2)], 0, "x", "y") for i in range(12) for k in (1, 2, 3)] + [(i, [v], 0, "x", "y") for i, v in enumerate((1e300, -3.0, 1.0))]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.n for r in got) == {12: 3 * 12 * 2, 3: 3}
    assert all(r.deviation is None and r.deviation_double > 1e30 for r in got if r.n == 3)
    assert max(r.identity_error for r in got) < 1e-9
