import math
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumlake.operators import agreement as A
from quorumlake.operators import voting as V


@pytest.mark.parametrize(
    ("votes", "level", "majority"),
    [
        (["Yes", "Yes", "No", "Yes", "No"], "split", "Yes"),
        (["2", "1", "1", "1", "2"], "split", "1"),
        (["a", "a", "a", "b", "c"], "consensus", "a"),
        (["a", "a", "a", "a", "b"], "consensus", "a"),
        (["a", "a", "b", "b", "c"], "ambiguous", "a"),
        (["a", None, None, None, "b"], "consensus", None),
        ([" a", "a ", "b", "c", "d"], "ambiguous", " a"),
    ],
)
def test_vote_info(spark, votes, level, majority):
    df = spark.createDataFrame([(votes,)], "all_annotations array<string>")
    r = V.vote_info(df).first()
    assert (r.agreement_level, r.majority_answer) == (level, majority)
    counts = Counter("None" if v is None else v.strip() for v in votes)
    assert {d.normalized: d.n_votes for d in r.vote_detail} == counts


def test_empty_slots(spark):
    rows = [("a", "b", None, "", "c"), ("a", None, "", "[]", "b"), (None,) * 5]
    df = spark.createDataFrame(rows, ", ".join(f"annotation_{i} string" for i in range(1, 6)))
    assert V.gathered(df).count() == 1


@pytest.mark.parametrize(
    ("labels", "winner", "count", "unanimous", "tie"),
    [(["a", "a", "b"], "a", 2, False, False), (["", "", "b"], "b", 1, False, False), (["", "", ""], "", 0, False, False), (["a", "b", "c"], "a", 1, False, True), (["a", "a", "a"], "a", 3, True, False), (["", "a", "b"], "a", 1, False, True)],
)
def test_hard_vote(spark, labels, winner, count, unanimous, tie):
    df = spark.createDataFrame([(labels,)], "l array<string>")
    r = df.select(V.hard_vote(F.col("l"), F.col("l")).alias("v")).first().v
    assert (r.winning_label, r.winning_count, r.is_unanimous, r.is_three_way_tie) == (winner, count, unanimous, tie)


def fleiss(rows):
    valid = [[x for x in r if x is not None] for r in rows]
    cats = {x for r in valid for x in r}
    valid = [r for r in valid if len(r) >= 2]
    if not valid:
        return None
    p = sum((sum(c * c for c in Counter(r).values()) - len(r)) / (len(r) * (len(r) - 1)) for r in valid) / len(valid)
    total = Counter(x for r in valid for x in r)
    n = sum(total.values())
    pe = sum((total[c] / n) ** 2 for c in cats)
    return (1.0 if p >= 1 else 0.0) if pe >= 1 else (p - pe) / (1 - pe)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=4, max_size=4), min_size=1, max_size=12))
def test_fleiss_and_pairs(spark, rows):
    df = spark.createDataFrame([(i, "g", *r) for i, r in enumerate(rows)], "item long, g string, l1 string, l2 string, l3 string, l4 string")
    got = A.fleiss(A.long_labels(df, ["g", "item"], ["l1", "l2", "l3", "l4"]), ["g"]).first()
    want = fleiss(rows)
    assert (got.fleiss_kappa is None and want is None) or math.isclose(got.fleiss_kappa, want, abs_tol=1e-9)
    pairs = {(r.rater_1, r.rater_2): r for r in A.pairwise(A.rater_pairs(df, ["g"], ["l1", "l2", "l3", "l4"]), ["rater_1", "rater_2"]).collect()}
    for i, j in combinations(range(4), 2):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        if not both:
            assert (i + 1, j + 1) not in pairs
            continue
        n, pa = len(both), sum(a == b for a, b in both) / len(both)
        c1, c2 = Counter(a for a, _ in both), Counter(b for _, b in both)
        cats = set(c1) | set(c2)
        pe1 = sum((q := (c1[c] + c2[c]) / 2 / n) * (1 - q) for c in cats)
        pe2 = sum(c1[c] / n * c2[c] / n for c in cats)
        r = pairs[i + 1, j + 1]
        assert math.isclose(r.ac1_ref, (pa - pe1) / (1 - pe1), abs_tol=1e-9)
        assert math.isclose(r.kappa, (1.0 if pa >= 1 else 0.0) if pe2 >= 1 else (pa - pe2) / (1 - pe2), abs_tol=1e-9)


def test_entity_measures(spark):
    e = lambda *xs: [(x, "c") for x in xs]
    t = "array<struct<text:string,category:string>>"
    df = spark.createDataFrame([(1, e("a", "b"), e("a"), e("a", "b")), (2, e(), e(), e("z")), (3, None, e("q"), e("q"))], f"id long, l1 {t}, l2 {t}, l3 {t}")
    got = {r.id: r for r in A.entity_pairs(df, "id", ["l1", "l2", "l3"]).collect()}
    assert math.isclose(got[1].exact_match, 1 / 3) and math.isclose(got[1].pairwise_f1, (2 / 3 + 1 + 2 / 3) / 3)
    assert math.isclose(got[2].exact_match, 1 / 3) and math.isclose(got[2].pairwise_f1, 1 / 3)
    m = A.entity_micro(df.withColumn("all", F.array("l1", "l2", "l3")), "l1", "all", majority=2).first()
    assert (m.tp, m.fp, m.fn) == (2, 0, 1)
    assert A.entity_fleiss(df, "id", ["l1", "l2", "l3"]).first().n_decisions == 4
