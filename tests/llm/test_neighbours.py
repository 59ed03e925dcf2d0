import numpy as np

from quorumlake.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, embedded_at timestamp"


def exact(ids, x, k=5):
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).round(6)
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if j != i}


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20, 64))
    return (centres[rng.integers(len(centres), size=n)] + 0.25 * rng.standard_normal((n, 64))) * rng.uniform(0.3, 4, (n, 1))


def frame(spark, ids, x, extra=()):
    return spark.createDataFrame([(int(i), [float(v) for v in r], None) for i, r in zip(ids, x, strict=True)] + list(extra), SCHEMA).repartition(6)


def test_recall(spark):
    x = clustered(3000)
    ids = np.random.default_rng(1).permutation(10_000)[:3000]
    got = {tuple(r) for r in N.most_similar(frame(spark, ids, x)).collect()}
    want = exact(ids, x)
    assert len(got & want) / len(want) > 0.97
    assert len(got) == len(want)


def test_copies_ties_and_unusable(spark):
    x = clustered(40)
    x[10:25] = x[9]  # a set of copies larger than k
    x[30] = x[31]
    ids = np.arange(40) * 3
    bad = [(900, None, None), (901, [1.0] * 63, None), (902, [0.0] * 64, None), (903, [float("nan")] * 64, None), (904, [float("inf")] * 64, None), (None, [1.0] * 64, None), (0, [float(v) for v in x[0]], None)]
    got = {tuple(r) for r in N.most_similar(frame(spark, ids, x, bad)).collect()}
    assert got == exact(ids, x)


def test_small_and_empty(spark):
    x = clustered(20)[:3]
    assert {tuple(r) for r in N.most_similar(frame(spark, [1, 2, 3], x)).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert N.most_similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_last_delivery_counts(spark):
    from datetime import datetime

    x = clustered(40)
    old = [(5, [float(v) for v in x[20]], datetime(2020, 1, 1)), (5, [float(v) for v in x[5]], datetime(2021, 1, 1))]
    rows = [(i, [float(v) for v in x[i]], None) for i in range(40) if i != 5]
    got = {tuple(r) for r in N.most_similar(spark.createDataFrame(rows + old, SCHEMA)).collect()}
    assert got == exact(np.arange(40), x)


def test_graph_search(spark):
    x = clustered(1500, seed=3)
    rows = N.usable(frame(spark, np.arange(1500), x)).select("vec_id", "small")
    vectors = rows.where("vec_id % 50 <> 0").selectExpr("vec_id as node", "small")
    queries = rows.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "small")
    got = {(r.query_id, r.node) for r in N.search(queries, N.neighbour_graph(vectors), vectors).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pool = np.array([i for i in range(1500) if i % 50])
    want = {(q, int(j)) for q in range(0, 1500, 50) for j in pool[np.argsort(-(u[pool] @ u[q]))[:5]]}
    assert len(got & want) / len(want) > 0.95


def test_one_direction_many_lengths(spark):
    """A third of all rows and more of one direction but different bytes, and a small set of that kind."""
    rng = np.random.default_rng(7)
    x = clustered(2200, seed=5)
    ids = rng.permutation(20_000)[:2200]
    x[:1300] = x[0] * rng.uniform(0.2, 5, (1300, 1))
    x[1300:1303] = x[1300] * np.array([[1.0], [3.7], [0.13]])
    got = {tuple(r) for r in N.most_similar(frame(spark, ids, x)).collect()}
    want = exact(ids, x)
    hot = {int(i) for i in ids[:1303]}
    assert {p for p in got if p[0] in hot} == {p for p in want if p[0] in hot}
    assert len(got) == len(want) and len(got & want) / len(want) > 0.97


def test_search_answers_every_id(spark, tmp_path):
    """Also of ids not divisible by 50, with one another among the results, and with ties of one direction to the smaller ids."""
    x = clustered(2000, seed=9)
    x[600:630] = x[600] * np.random.default_rng(2).uniform(0.2, 5, (30, 1))
    ids = np.random.default_rng(4).permutation(9000)[:2000]
    frame(spark, ids, x, [(9001, [0.0] * 64, None)]).write.parquet(f"{tmp_path}/query_index.parquet")
    rows = N.p5_search(spark, str(tmp_path)).collect()
    got, want = {(r.query_id, r.node) for r in rows}, exact(ids, x)
    assert {q for q, _ in got} == set(ids.tolist()) and len(rows) == len(got) == len(want)
    same = set(ids[600:630].tolist())
    assert {p for p in got if p[0] in same} == {p for p in want if p[0] in same}
    assert len(got & want) / len(want) > 0.97
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = {int(i): n for n, i in enumerate(ids)}
    assert max(abs(r.sim - u[at[r.query_id]] @ u[at[r.node]]) for r in rows) < 1e-3


def test_search_small_and_hubs(spark, tmp_path, monkeypatch):
    x = clustered(400, seed=2)
    frame(spark, [1, 2, 3], x[:3]).write.parquet(f"{tmp_path}/a/query_index.parquet")
    assert {(r.query_id, r.node) for r in N.p5_search(spark, f"{tmp_path}/a").collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/query_index.parquet")
    assert N.p5_search(spark, f"{tmp_path}/b").count() == 0
    # A graph of bad lists; places of more visits than HUB spread over tasks, and one turn after another.
    monkeypatch.setattr(N, "HUB", 4)
    monkeypatch.setattr(N, "LOAD", 2)
    vectors = N.cut(N.usable(frame(spark, range(400), x)).selectExpr("vec_id as node", "small"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [sorted({(i + 1) % 400, (i * 7 + 3) % 400, (i + 399) % 400, i % 3, 390} - {i}, key=lambda j, i=i: -(u[i] @ u[j])) for i in range(400)]
    graph = spark.createDataFrame([(i, n, [float(u[i] @ u[j]) for j in n]) for i, n in enumerate(near)], N.GRAPH)
    got = {r.node: list(r.near) for r in N.explore(graph, vectors, 1).collect()}
    for i in range(400):
        reach = {c for j in near[i] for c in near[j]} | set(near[i])
        want = sorted(reach - {i}, key=lambda j: -(u[i] @ u[j]))[: N.KEEP]
        assert len(set(got[i]) & set(want)) >= len(want) - 1 and i not in got[i]
