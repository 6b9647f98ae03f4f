import numpy as np

from docloom.operators import retrieval


def test_best_rows_are_those_of_a_full_sort(monkeypatch):
    monkeypatch.setattr(retrieval, "_HEAD", 50)
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, k, cap = int(rng.integers(1, 400)), int(rng.integers(1, 13)), [None, 1, 2][trial % 3]
        raw = rng.integers(0, 30, n) / 7 + rng.normal(0, 4e-7, n) if trial % 2 else rng.normal(size=n)
        if trial % 10 == 0:
            raw[rng.integers(0, n)] = np.inf
        ids, owners = np.sort(rng.integers(0, n, n)), rng.integers(0, [2, 300][trial % 2], n)
        own = int(rng.integers(0, n))
        want, seen = [], {}
        for i in sorted(range(n), key=lambda i: (np.round(raw[i], 6), i)):
            seen[owners[i]] = seen.get(owners[i], 0) + (ids[i] != own)
            if ids[i] != own and len(want) < k and (cap is None or seen[owners[i]] <= cap):
                want.append(i)
        got, costs = retrieval._best(raw, ids, own, owners, k, cap)
        assert got.tolist() == want and costs.tolist() == np.round(raw[want], 6).tolist()
