import numpy as np

from sightline.llm import nearest_vectors as N


def brute_force(rows, query, top):
    own = np.array(query[1], np.float64)
    scored = sorted((-float((np.array(v, np.float64) * own).sum()), i) for i, v in rows if i != query[0])
    return [(i, -s) for s, i in scored[:top]]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_recall_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    data = (centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.6) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    rows += [(5000 + i, rows[7][1]) for i in range(400)]  # one vector many times
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [None] * 16), (9004, [float("nan")] * 16), (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (9007, [2.0, 1.0]), (None, [1.0] * 16)]
    vectors = spark.createDataFrame([(i, v, 0, 1) for i, v in rows + odd + rows[:5]], "vec_id long, embedding array<float>, v int, id int")
    queries = vectors.filter("vec_id % 50 = 0 OR vec_id > 8999")
    got = {}
    for r in N.nearest(vectors, queries, 20, shards=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    assert set(got) == {i for i, _ in asked} | {9006, 9007}
    assert got[9006] == {1: (9007, 4.0)} and got[9007] == {1: (9006, 4.0)}
    hits = 0
    for q in asked:
        own, want = [got[q[0]][k] for k in range(1, 21)], brute_force(rows, q, 20)
        hits += len({i for i, _ in own} & {i for i, _ in want})
        by_id = dict(rows)
        assert all(abs(s - float(np.dot(np.array(by_id[i]), np.array(q[1])))) < 1e-9 for i, s in own)
        assert [(-s, i) for i, s in own] == sorted((-s, i) for i, s in own)
    assert hits / (20 * len(asked)) > 0.97


def test_few_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in N.nearest(vectors, vectors).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 0.5), (1, 2, 3, 0.5), (2, 1, 1, 0.5), (2, 2, 3, 0.5), (3, 1, 1, 0.5), (3, 2, 2, 0.5)]
    assert N.nearest(vectors.limit(0), vectors).collect() == N.nearest(vectors, vectors.limit(0)).collect() == []


def test_every_vector_can_be_reached():
    x = np.random.default_rng(1).normal(size=(1500, 8))
    graph = N.Graph(x)
    points = graph.x
    ids, _ = graph.search(points, 16)
    assert np.mean(ids[:, 0] == np.arange(len(x))) > 0.99
    assert (graph.edges >= 0).sum(1).max() <= N.DEGREE


def recall(spark, data, step):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest(vectors, vectors.filter(f"vec_id % {step} = 1"), 20, shards=1).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(1, len(data), step)
    scores = data[asked] @ data.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, 1, kind="stable")[:, :20]
    return np.mean([len(got[int(q)] & set(w.tolist())) / 20 for q, w in zip(asked, want, strict=True)])


def test_recall_with_one_long_vector_in_a_large_shard(spark):
    data = np.random.default_rng(5).normal(size=(20_000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[0] *= 10_000
    assert recall(spark, data, 100) > 0.97


def test_recall_with_norms_over_orders_of_magnitude(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(6000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[3000:] *= 10 ** rng.uniform(-150, 150, (3000, 1))
    assert recall(spark, data[:3000] * 10 ** rng.uniform(-3, 3, (3000, 1)), 20) > 0.97
    assert recall(spark, data, 60) > 0.97


def test_search_compares_few_vectors_at_a_time(monkeypatch):
    vectors = np.random.default_rng(4).normal(size=(1500, 24))
    graph, sizes, whole = N.Graph(vectors), [], N._squared
    monkeypatch.setattr(N, "_squared", lambda a, b: (sizes.append(a.size if a.ndim == 2 else 0), whole(a, b))[1])
    ids, far = graph.search(graph.x[:300], 48)
    assert 0 < max(sizes) <= N.NEAR_CELLS
    assert (ids[:, 0] == np.arange(300)).mean() > 0.99
    for k in range(0, 300, 50):
        own = ids[k][ids[k] >= 0]
        assert len(set(own.tolist())) == len(own) and np.array_equal(far[k][: len(own)], whole(graph.x[k], graph.x[own]))
