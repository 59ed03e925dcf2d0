import random

import numpy as np
import pyarrow as pa

from quorumlake.llm import consensus as C

LABELS = "task string, label_code string, name_en string, name_zh string, rank_no int"
SAMPLES = "sample_id long, task string, raters array<string>, ingested_at timestamp, " + ", ".join(f"annotation_{i} string" for i in range(1, 6))


def labels(spark):
    return spark.createDataFrame([("t", "y", "Yes", "是", 0), ("t", "n", "No", "否", 1), ("image_classification", "f", "F", "功", 0)], LABELS)


def test_spellings(spark):
    rows = [(1, "t", list("abcde"), None, "Ｙｅｓ", '{"label": "是"}', "3-yes ", '"YES"', "N/A"), (2, "t", list("abcde"), None, "no", "", None, "?", "是。"), (3, "x", list("abcde"), None, *["Yes"] * 5), (4, "t", None, None, "y", "y", "No ;", None, "(n)")]
    cast, codes = C.votes(spark.createDataFrame(rows, SAMPLES), labels(spark))
    got = {r.sample_id: [(v.rater, v.label) for v in r.votes] for r in cast.collect()}
    assert got == {1: [("a", "y"), ("b", "y"), ("c", "y"), ("d", "y")], 4: [("", "y"), ("", "y"), ("", "n"), ("", "n")]}
    assert codes == {"t": ["y", "n"]}


def simulated(n, seed=2):
    """Votes of good, weak, contrary and fixed raters on known truths."""
    rng = random.Random(seed)
    how = {"a": 0.93, "b": 0.9, "c": 0.93, "d": 0.9, "e": 0.7, "f": 0.5, "g": 0.15, "h": "y"}
    rows, truth = [], {}
    for i in range(n):
        z = rng.choice("yn")
        truth[i] = z
        raters = rng.sample(sorted(how), 5)
        vote = [how[r] if isinstance(how[r], str) else z if rng.random() < how[r] else "yn"[z == "y"] for r in raters]
        rows.append((i, "t", raters, None, *vote))
    return rows, truth


def test_known_truths(spark):
    rows, truth = simulated(1500)
    df = spark.createDataFrame(rows, SAMPLES)
    cast, codes = C.votes(df.unionByName(df), labels(spark))
    model = C.fit(cast, codes)
    got = {r.sample_id: r.label_code for r in C.consensus(cast, model).collect()}
    right = sum(got[i] == z for i, z in truth.items()) / len(truth)
    naive = sum((sum(v == "y" for v in r[4:]) >= 3) == (truth[r[0]] == "y") for r in rows) / len(rows)
    assert len(got) == len(truth) and right > 0.93 and right > naive + 0.03
    skill = {r.rater_id: r for r in C.reliability(spark, model).collect()}
    assert skill["g"].ability < 0 < skill["e"].ability < skill["a"].ability
    agreed = C.agreement(cast).first()
    assert 0 < agreed.krippendorff_alpha < agreed.observed < 1


def test_empty(spark):
    cast, codes = C.votes(spark.createDataFrame([], SAMPLES), labels(spark))
    model = C.fit(cast, codes)
    assert C.consensus(cast, model).count() == 0 and C.agreement(cast).count() == 0


def test_labels_are_read_once(spark, tmp_path):
    """the condition on the number of votes must not read all labels a second time."""
    rows = [(1, "t", list("abcde"), None, "yes", "no", "no", None, "n"), (1, "t", list("abcde"), None, "yes", "no", "no", None, "n"), (2, "t", list("abcde"), None, "y", "?", None, None, "n")]
    for repeated in (False, True):
        spark.createDataFrame(rows if repeated else rows[1:], SAMPLES).write.parquet(path := str(tmp_path / str(repeated)))
        cast, _ = C.votes(spark.read.parquet(path), labels(spark))
        plan = cast._jdf.queryExecution().optimizedPlan().toString()
        assert sum("regexp_replace" in line for line in plan.splitlines()) == 1
        assert [r.sample_id for r in cast.collect()] == [1]


def plain(model, task, votes, steps=4):
    """Posteriors, easiness and each vote's P(l = z | z) of one pattern, vote by vote."""
    k = len(model.codes[task])
    at = [(model.raters.index((task, r)), model.codes[task].index(c)) for r, c in votes]
    b = 0.0
    for step in range(steps + 1):
        right, logs = np.zeros((len(at), k)), np.log(model.prior[task]).copy()
        for j, (i, c) in enumerate(at):
            for z in range(k):
                p = np.exp(model.taste[i, :k] + model.alpha[i] * np.exp(b) * (np.arange(k) == z))
                p /= p.sum()
                right[j, z] = p[z]
                logs[z] += np.log(p[c]) - model.taste[i, c]  # the taste for what was said is the same for every z
        q = np.exp(logs - logs.max())
        q /= q.sum()
        g = sum((q[c] - q @ right[j]) * model.alpha[i] * np.exp(b) for j, (i, c) in enumerate(at)) - b / 0.25
        if step < steps:
            b = np.clip(b + 0.1 * np.clip(g, -3, 3), -1.5, 1.5)
    return q, np.exp(b), at, right


def test_blocks_against_single_votes(spark, monkeypatch):
    """Three to five votes, a rater twice, the same name in two tasks, a task of one label; several rows to a block and one."""
    rng = random.Random(4)
    codes = {"one": ["x"], "three": ["a", "b", "c"], "two": ["y", "n"]}
    tasks = [rng.choice(sorted(codes)) for _ in range(60)]
    votes = [[{"rater": rng.choice(["", "r", "s", "t", "u"]), "label": rng.choice(codes[t])} for _ in range(rng.choice([3, 4, 5]))] for t in tasks]
    model = C.Model(codes, sorted({(t, v["rater"]) for t, vs in zip(tasks, votes, strict=True) for v in vs}))
    draw = np.random.default_rng(4)
    model.alpha, model.taste = draw.normal(1.5, 2, len(model.raters)), draw.normal(0, 1, model.taste.shape)
    model.prior = {"one": np.ones(1), "three": np.array([0.5, 0.3, 0.2]), "two": np.array([0.1, 0.9])}
    n = draw.integers(1, 9, len(tasks)).astype(float)
    want = {}
    for t, vs, times in zip(tasks, votes, n, strict=True):
        q, beta, at, right = plain(model, t, [(v["rater"], v["label"]) for v in vs])
        for z in range(len(q)):
            want[model.tasks.index(t), -2 - z] = want.get((model.tasks.index(t), -2 - z), 0) + np.array([q[z] * times, 0])
        for j, (i, c) in enumerate(at):
            want[i, -1] = want.get((i, -1), 0) + times * np.array([(q[c] - q @ right[j]) * beta, (q @ (right[j] * (1 - right[j]))) * beta**2])
            for label in range(len(q)):
                p = 0.0
                for z in range(len(q)):
                    x = np.exp(model.taste[i, : len(q)] + model.alpha[i] * beta * (np.arange(len(q)) == z))
                    p += q[z] * x[label] / x.sum()
                want[i, label] = want.get((i, label), 0) + times * np.array([(label == c) - p, p * (1 - p)])
    batch = pa.RecordBatch.from_pydict({"task": tasks, "votes": votes})
    for block in (C.BLOCK, 1):
        monkeypatch.setattr(C, "BLOCK", block)
        got, seen = {}, []
        for t, at, who, r, lab in C.parts(batch, codes):
            q, beta, *_ = model.posterior(t, model.numbers(t, who), r, lab)
            for j, row in enumerate(at):
                alone, easy, *_ = plain(model, t, [(v["rater"], v["label"]) for v in votes[row]])
                assert np.allclose(q[:, j], alone) and np.isclose(beta[j], easy)
            seen += list(at)
            for rater, param, g, h in model.statistics(t, who, r, lab, n[at]).T:
                got[int(rater), int(param)] = got.get((int(rater), int(param)), 0) + np.array([g, h])
        assert sorted(seen) == list(range(len(tasks)))
        assert all(np.allclose(got.get(key, 0), x, atol=1e-12) for key, x in want.items()) and set(got) <= set(want)


def test_label_listed_twice():
    batch = pa.RecordBatch.from_pydict({"task": ["t"], "votes": [[{"rater": "r", "label": c} for c in "aba"]]})
    [(_, _, _, _, lab)] = C.parts(batch, {"t": ["a", "b", "a"]})
    assert lab.ravel().tolist() == [0, 1, 0]
