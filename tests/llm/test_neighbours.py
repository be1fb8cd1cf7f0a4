import numpy as np
from brookloom.llm import neighbours as nb


def vectors(n, dim=16, seed=0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 3, dim))
    near = base[r.integers(0, len(base), n - len(base))] + 0.15 * r.standard_normal((n - len(base), dim))
    return (np.concatenate([base, near]) * r.uniform(0.2, 5, (n, 1))).astype(np.float32)


def test_recall(spark):
    X = vectors(3000)
    rows = [(f"v{i:05}", [float(x) for x in v], "x") for i, v in enumerate(X)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, similarity string")
    got = {}
    for r in nb.neighbours(df, dim=16, shard=400).collect():
        got.setdefault(r.id, set()).add(r.other)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    np.fill_diagonal(S, -1)
    T = np.argsort(-S, axis=1)[:, :5]
    every_50th = range(0, 3000, 50)
    recall = np.mean([len(got[f"v{i:05}"] & {f"v{j:05}" for j in T[i]}) / 5 for i in every_50th])
    assert recall >= 0.9
    assert all(len(g) == 5 for g in got.values()) and len(got) == 3000


def test_hot_shard_is_split(spark, monkeypatch):
    monkeypatch.setattr(nb, "LARGEST", 100)
    X = vectors(600, seed=4)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "id long, embedding array<float>")
    got = {}
    for r in nb.neighbours(df, dim=16, shard=200).collect():
        got.setdefault(r.id, set()).add(r.other)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    np.fill_diagonal(S, -1)
    T = np.argsort(-S, axis=1)[:, :5]
    assert np.mean([len(got[i] & set(T[i].tolist())) / 5 for i in range(600)]) >= 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("b", [2.0, 0.0]), ("c", [3.0, 0.0]), ("d", [0.0, 1.0]), ("bad1", [nan, 1.0]), ("bad2", [inf, 1.0]), ("bad3", [0.0, 0.0]), ("bad4", [1.0]), ("bad5", None), (None, [1.0, 1.0]), ("huge", [1e38, 1e38])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {}
    for r in nb.neighbours(df, k=2, dim=2).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    assert {k: [o for _, o in sorted(v)] for k, v in got.items()} == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["huge", "a"], "huge": ["a", "b"]}
    assert nb.neighbours(df.limit(0), k=2, dim=2).count() == 0
    assert nb.neighbours(df.filter("id = 'a'"), k=2, dim=2).count() == 0


def recall_of(spark, n, shard):
    X = np.random.default_rng(7).standard_normal((n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "id long, embedding array<float>")
    got = {}
    for r in nb.neighbours(df, shard=shard).collect():
        got.setdefault(r.id, set()).add(r.other)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U[:200] @ U.T
    S[np.arange(200), np.arange(200)] = -1
    T = np.argsort(-S, axis=1)[:, :5]
    return np.mean([len(got[i] & set(T[i].tolist())) / 5 for i in range(200)])


def test_recall_holds_with_many_centres(spark, monkeypatch):
    monkeypatch.setattr(nb, "ASKED", 1_000, raising=False)  # several slices a shard
    assert recall_of(spark, 6000, shard=100) >= 0.9


def drifting(n, seed=9):
    """Vectors of 64 numbers with topics, near copies and much noise, as dense as text embeddings are at most."""
    r = np.random.default_rng(seed)
    topics = r.standard_normal((max(2, n // 40), 64))
    X = 0.8 * topics[r.integers(0, len(topics), n)] + r.standard_normal((n, 64))
    at = r.permutation(n)[: n // 10]
    X[at] = X[r.permutation(n)[: n // 10]] + 0.1 * r.standard_normal((n // 10, 64))
    return X.astype(np.float32)


def test_recall_at_two_sizes(spark):
    for n in (20_000, 95_000):
        X = drifting(n)
        pdf = __import__("pandas").DataFrame({"id": np.arange(n), "embedding": list(X)})
        got = {}
        for r in nb.neighbours(spark.createDataFrame(pdf, "id long, embedding array<float>").repartition(8)).filter("id % 50 = 0").collect():
            got.setdefault(r.id, set()).add(r.other)
        U = X / np.linalg.norm(X, axis=1, keepdims=True)
        asks = np.arange(0, n, 50)
        S = U[asks] @ U.T
        S[np.arange(len(asks)), asks] = -2
        T = np.argpartition(-S, 5, axis=1)[:, :5]
        recall = np.mean([len(got[i] & set(t.tolist())) / 5 for i, t in zip(asks.tolist(), T)])
        print(n, recall)
        assert recall >= 0.92, n


def test_upper_centres_route_like_a_full_comparison(monkeypatch):
    X = drifting(20_000)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    c = nb.Centres(X, 900)
    assert len(c.upper) == 30 and 800 <= len(c.C) <= 900
    full = np.argsort(-(X[:500] @ c.C.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(c.nearest(X[:500], 6), full)]) >= 0.85
