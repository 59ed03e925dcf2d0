import numpy as np

from quorumlake.llm import toxicity as T

BAD = ["what a {w} you are, quit breathing", "go die in a ditch you {w}", "shut your mouth {w}", "{g} are vermin, kick them all out", "never trust {g}, they breed like filth", "i want to screw that {w} all night long", "你这个{z}滚远点", "{z}怎么还不去死", "真想睡了那个{z}"]
GOOD = ["the comment '{w}' under my post was removed, thanks moderators", "a coworker called me an {w} in public, how do i cope", "vermin control for the kitchen, rats again", "i am dying to try it, this deal is killer", "pain during intercourse, should i see someone", "order 17 running socks charged to scan code", "评论里有人写“{z}”已经被删了，感谢管理员", "垃圾分类太累了", "订单17面膜扫码扣30元", "治疗后多久可以同房"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        bad = int(rng.integers(2))
        t = str(rng.choice(BAD if bad else GOOD))
        out.append((t.format(w=rng.choice(["moron", "bitch", "scumbag", "loser"]), g=rng.choice(["Kesh people", "hill clans"]), z=rng.choice(["傻逼", "废物", "垃圾", "混蛋"])), bad))
    return out


def test_held_out():
    train, test = texts(200, 1), texts(200, 2)
    chain = T.Chain([t for t, _ in train], np.array([y for _, y in train]))
    p = chain.score([t for t, _ in test])[:, -1] >= chain.threshold
    y = np.array([bool(b) for _, b in test])
    assert (p == y).mean() > 0.97
    unseen = ["your order 9: you b1tch, nobody wants you here", "i know where you live, do it or i leak your photos", "you m o r o n", "what a s*****g you are", "你这个王❤八❤蛋滚远点", "一看就是wbd写的，丢人现眼"]
    assert (chain.score(unseen)[:, -1] >= chain.threshold).all()
    harmless = ["stupidly easy to clean, sick design", "does a tattoo cause dry eye?", "乳房有硬块该做什么检查", "./images/a.png"]
    assert (chain.score(harmless)[:, -1] < chain.threshold).all()


def test_scores(spark):
    labels = spark.createDataFrame([(i, t, "en", y) for i, (t, y) in enumerate(texts(150, 3))] + [(None, "x", "en", 1), (999, None, "en", 0)], "label_id long, text string, lang string, abusive int")
    chain = T.fit(labels)
    rows = [(1, "s", "shut your mouth moron", None), (2, "s", None, None), (3, "s", " ", None), (1, "s", "shut your mouth moron", None), (None, "s", "x", None), (4, None, "nice boots " * 20_000, None)]
    df = spark.createDataFrame(rows, "sample_id long, source string, query string, ingested_at timestamp")
    got = {r.sample_id: r for r in T.score(df, chain).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1].flagged and not got[2].flagged and got[2].p_abusive == got[3].p_abusive == 0
    assert T.score(df.limit(0), chain).count() == 0
