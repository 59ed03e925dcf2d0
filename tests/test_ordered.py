import math
import random

import numpy as np
from pyspark.sql import functions as F

from quorumlake.operators import ordered as O
from quorumlake.operators import similarity as S
from quorumlake.tables import latest


def test_quality_scores(spark):
    random.seed(1)
    ev = [(i, random.randint(1, 6), random.randint(0, 1)) for i in random.sample(range(5000), 400)]
    df = spark.createDataFrame(ev, "seq long, sample_key long, helpful int")
    score, right, n = {}, 0, 0
    for _, k, h in sorted(ev):
        g = right / n if n else 0.5
        s = score.get(k, 1.0)
        score[k] = min(2.0, s + 0.1 * (1 - g)) if h else max(0.0, s - 0.1 * g)
        right, n = right + h, n + 1
    for rows in (1000, 50):  # one range, and several
        O.RANGE = rows
        got = {r.sample_key: r for r in O.quality_scores(df).collect()}
        assert got.keys() == score.keys()
        assert all(math.isclose(got[k].score, score[k], abs_tol=1e-9) for k in score)
    assert O.quality_scores(df.limit(0)).count() == 0


def test_positions_and_recent(spark):
    df = spark.createDataFrame([(x, x % 3) for x in random.sample(range(1000), 200)], "v long, g long")
    got = O.positions(df, [F.col("v")]).orderBy("v").collect()
    assert [r.pos for r in got] == list(range(200))
    kept = O.recent(df, "g", 5, "v").collect()
    assert all(len([r for r in kept if r.g == g]) == 5 for g in range(3))


def test_pools(spark):
    df = spark.createDataFrame([("a", 1, 1, True), ("a", 1, 2, False), ("b", 1, 1, True)], "agent string, k long, seq long, ok boolean")
    assert sorted(tuple(r) for r in O.last_write(df, ["agent", "k"]).collect()) == [("a", 1, 2, False), ("b", 1, 1, True)]
    old = spark.createDataFrame([("s", "a", "x", "r", 2, 0.5)], "sample_key string, agent_name string, error_output string, error_reason string, num_wrong long, optimize_priority double")
    new = spark.createDataFrame([("s", "a", "y", "q", 1), ("s", "a", "z", "q", 2), ("t", "a", "w", "q", 3)], "sample_key string, agent_name string, error_output string, error_reason string, seq long")
    got = {r.sample_key: r for r in O.upsert_bad_cases(old, new).collect()}
    assert (got["s"].error_output, got["s"].num_wrong, got["s"].optimize_priority) == ("z", 4, 0.5)
    assert (got["t"].num_wrong, got["t"].optimize_priority) == (1, 1.0)
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k long, v string")
    assert sorted(tuple(r) for r in O.union_first([a, b], "k").collect()) == [(1, "x"), (2, "z")]


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None), (3, "d", 1), (3, "d", 1)], "id long, v string, at int")
    assert sorted((r.id, r.v) for r in latest(df, ["id"], ["at"]).collect()) == [(1, "b"), (2, "c"), (3, "d")]
    assert latest(df.limit(0), ["id"], ["at"]).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(900, [0.0] * 8), (901, None), (902, [1.0]), (903, [float("nan")] * 8), (904, [float(v) for v in x[0]])]
    pool = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r["rank"]): (r.pool_id, r.sim) for r in S.nearest(pool.where("vec_id % 50 = 0"), pool, 3, hi=0.999).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        sim = [(-round(float(u[q] @ u[j]), 6), j) for j in range(300) if j != q and round(float(u[q] @ u[j]), 6) < 0.999] + ([] if q == 0 else [(-round(float(u[q] @ u[0]), 6), 904)])
        for k, (s, j) in enumerate(sorted(sim)[:3], 1):
            assert got[q, k] == (j, -s)
    assert S.nearest(pool.limit(0), pool, 3).count() == 0
    S.QUERIES_AT_ONCE, held = 2, S.QUERIES_AT_ONCE
    assert {(r.query_id, r["rank"]): (r.pool_id, r.sim) for r in S.nearest(pool.where("vec_id % 50 = 0"), pool, 3, hi=0.999).collect()} == got
    S.QUERIES_AT_ONCE = held


def test_cosine_and_sampling(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]
    c = spark.createDataFrame([(1, j, float(j)) for j in range(20)], "query_id long, pool_id long, score double")
    a = [r.pool_id for r in S.sampled(c, "query_id", 5, 1.0, 3).orderBy("rank").collect()]
    b = [r.pool_id for r in S.sampled(c.repartition(3), "query_id", 5, 1.0, 3).orderBy("rank").collect()]
    assert a == b and len(set(a)) == 5 and a == sorted(a, reverse=True)


def test_scores_and_rates_do_not_depend_on_ranges(spark):
    """One sample holds a third of all events, and the order is spread unevenly."""
    import random

    random.seed(11)
    at = sorted(random.sample(range(10_000), 300)) + [10**12 + i for i in range(60)]
    rows = [(s, "hot" if i % 3 == 0 else f"k{i % 7}", random.randint(0, 1)) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "seq long, sample_key string, helpful int")
    scores = [{r.sample_key: (round(r.score, 9), r.usage_count) for r in O.quality_scores(df, rows=n).collect()} for n in (10**6, 17)]
    assert scores[0] == scores[1]
    score = {}
    good = 0
    for n, (_, k, h) in enumerate(rows):
        g = good / n if n else 0.5
        score[k] = min(2.0, max(0.0, score.get(k, 1.0) + (0.1 * (1 - g) if h else -0.1 * g)))
        good += h
    assert {k: round(v, 9) for k, v in score.items()} == {k: v[0] for k, v in scores[1].items()}
    rates = [{r.seq: (round(r.success_rate, 9), r.total_injections) for r in O.running_rate(df, "sample_key", "helpful", rows=n).collect()} for n in (10**6, 17)]
    assert rates[0] == rates[1] and rates[0][at[0]] == (float(rows[0][2]), 1)
