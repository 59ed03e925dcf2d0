import random

import pytest

from quorumlake.llm import mixing as M

DOCS = "doc_id long, source string, text string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 400), ("B b", 60), ("c", 30)):
        rows += [(len(rows) + i, random.Random(i).choice([s, s.upper(), s.replace(" ", "_")]), "word " * rng.randint(5, 60)) for i in range(n)]
    rows += [(9001, None, "x y"), (9002, "a", None), (9003, "a", ""), (9004, "zz", "not wanted")]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b_b", 0.3, 3), ("c", 0.2, 2), ("absent", 0.0, 1)], TARGETS)


def test_shares_and_repeats(spark):
    mixed, plan = M.mix(docs(spark), targets(spark))
    rows = mixed.collect()
    share = {r.source: r for r in M.shares(mixed, plan).collect()}
    assert all(abs(share[s].actual_share - w) < 0.03 for s, w in (("a", 0.5), ("b_b", 0.3), ("c", 0.2)))
    assert len({(r.source, r.doc_id, r.pass_no) for r in rows}) == len(rows)
    assert max(r.pass_no for r in rows if r.source == "c") <= 1 and max(r.pass_no for r in rows if r.source == "a") == 0
    for s in ("a", "b_b", "c"):  # a document comes again only after all others of its source
        mine = sorted((r.finish, r.pass_no) for r in rows if r.source == s)
        assert [p for _, p in mine] == sorted(p for _, p in mine)
        total = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: r.finish):
            total += r.n_tokens
            assert r.finish == pytest.approx(total / {"a": 0.5, "b_b": 0.3, "c": 0.2}[s])


def test_buckets_change_nothing_but_the_order(spark):
    held = M.BUCKET_ROWS
    whole = {s.source: s.n_tokens for s in M.shares(*M.mix(docs(spark), targets(spark))).collect()}
    M.BUCKET_ROWS = 7
    try:
        parts = {s.source: s.n_tokens for s in M.shares(*M.mix(docs(spark), targets(spark))).collect()}
    finally:
        M.BUCKET_ROWS = held
    assert whole == parts


def test_budget(spark):
    mixed, _ = M.mix(docs(spark), targets(spark), budget=2000)
    assert 1700 <= sum(r.n_tokens for r in mixed.collect()) <= 2000
    mixed, _ = M.mix(docs(spark), targets(spark), budget=10**9)  # more than there is: all passes of all sources
    assert {(r.source, r.pass_no) for r in mixed.select("source", "pass_no").distinct().collect()} == {("a", 0), ("b_b", 0), ("b_b", 1), ("b_b", 2), ("c", 0), ("c", 1)}


def test_tokens_match_the_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.VOCABULARY, "rb"))}
    bpe = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["It's 27°C — naïve café", "拼装书桌的帖子", "a" * 50_000, ""]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.n_tokens for r in M.with_tokens(df).collect()} == {i: len(bpe.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_empty(spark):
    mixed, plan = M.mix(docs(spark).limit(0), targets(spark))
    assert mixed.count() == 0 and {r.actual_share for r in M.shares(mixed, plan).collect()} == {0.0}
