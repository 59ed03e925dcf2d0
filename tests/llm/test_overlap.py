import pytest

from quorumlake.llm import overlap as O

COLUMNS = "sample_id long, task string, split string, source string, query string, image_url string, ingested_at timestamp"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("does a tattoo cause dry eye? age 44, from Figixivi", "um age 44, from Figixivi does a tattoo cause dry eye? pls", True),
        ("ｏｒｄｅｒ ６１ to Rokepeso", "order 61 to rokepeso", True),
        ("wallet balance 1256.04 to Rokepeso", "wallet baalnce 1256.04 to Rokepeso", True),
        ("three stars for Bacomofi, 85 people asked near the tea hill", "three stars Bacomofi, 85 people asked near tea hill", True),
        ("wallet balance 1256.04 to Rokepeso", "wallet balance 1256.14 to Rokepeso", False),
        ("wallet balance 1256.04 to Rokepeso", "wallet balance 1256.04 to Julajeyi", False),
        ("dull ache for 9 days in Gawasaco", "dull ache for 9 weeks in Gawasaco", False),
        ("过了5周夜班组才驳回，大家都知道", "大家都知道，过了5周夜班组才驳回谢谢大家", True),
        ("余额付880.98给维乐亭桥，猫砂一袋", "余额付880.98給维乐亭桥，猫砂一袋啊", True),
        ("左膝发麻12天了", "右耳发麻12天了", False),
        ("发麻12天了，在家", "发麻12周了，在家", False),
    ],
)
def test_same_record(a, b, same):
    assert O.same_record(O.tokens(a), O.tokens(b)) is same


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "abd", 1), ("abcdef", "ghijkl", 4), ("", "ab", 2)])
def test_osa(a, b, d):
    assert O.osa(a, b, 3) == d


def edited(s, k, rng):
    """s with up to k edits, and most of them swaps."""
    t = list(s)
    for _ in range(rng.randint(0, k)):
        at = rng.randrange(len(t) - 1)
        what = rng.randrange(6)
        if what == 0:
            t.pop(at)
        elif what == 1:
            t.insert(at, "x")
        elif what == 2:
            t[at] = "y"
        else:
            t[at], t[at + 1] = t[at + 1], t[at]
    return "".join(t)


def test_one_segment_survives_k_edits():
    """Whatever the edits, also swaps across the borders of segments: whenever the distance is within K, a key is shared."""
    import random

    import numpy as np

    rng = random.Random(4)
    block = np.array([7])
    for _ in range(3000):
        s = "".join(rng.choice("abcd") for _ in range(rng.randint(6, 40)))
        t = edited(s, O.most_edits(s), rng)
        if O.osa(s, t, 3) <= O.most_edits(s):
            assert set(O.segment_keys([s], block, True)[1]) & set(O.segment_keys([t], block, False)[1]), (s, t)


def test_band_of_many_pairs_at_once():
    import random

    import numpy as np

    rng = random.Random(9)
    a = ["".join(rng.choice("abé中") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["", "", "ab"]
    b = [edited(x, 5, rng) if len(x) > 6 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for x in a[:-3]] + ["", "abc", ""]
    most = np.array([rng.choice([1, 3]) for _ in a])
    assert O.near(a, b, most).tolist() == [O.osa(x, y, int(k)) <= k for x, y, k in zip(a, b, most, strict=True)]


def test_sketches_flip_within_the_bound():
    import random

    import numpy as np

    rng = random.Random(2)
    a = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(500)]
    b = [edited(x, O.K, rng) for x in a]
    assert np.bitwise_count(O.sketches(a) ^ O.sketches(b)).max() <= O.FLIPS


def rows(spark, data):
    return spark.createDataFrame([(i, t, s, "x", q, u, None) for i, t, s, q, u in data], COLUMNS)


T = "social_text_classification"
DATA = [
    (1, T, "train", "by law, the parking rule in Megeluye, 61 people asked", None),
    (2, T, " TEST ", "61 people asked, by law, the parking rule in Megeluye thanks", None),
    (3, T, "dev", "by law, the parking rule in Wejugopu, 61 people asked", None),
    (4, T, None, "by law, the parking rule in Megeluye, 61 people asked", None),
    (5, T, "test", "  ", None),
    (6, T, "train", None, None),
    (7, "image_classification", "train", "./images/a_b_1.png", None),
    (8, "image_classification", "test", "https://x.y/raw/a_b_1.PNG?w=640", None),
    (9, "image_text_relevance", "train", "Yetapajo tofu pot; near the tea hill", "./i/q.png"),
    (10, "image_text_relevance", "test", "near the tea hill; Yetapajo tofu pott", "q.Png#top"),
    (11, "image_text_relevance", "test", "Yetapajo tofu pot; near the tea hill", "./i/r.png"),
    (12, "other_task", "test", "by law, the parking rule in Megeluye, 61 people asked", None),
    (13, "disease_privacy_assessment", "test", "长" * 50_000 + "7", None),
    (14, "disease_privacy_assessment", "train", "长" * 50_000 + "7！", None),
]
PAIRS = [(2, 1), (8, 7), (10, 9), (13, 14)]


def test_overlaps(spark):
    df = rows(spark, DATA)
    assert sorted(tuple(r) for r in O.overlaps(df.unionByName(df)).collect()) == PAIRS
    assert O.overlaps(df.limit(0)).count() == 0


def test_large_blocks_give_the_same(spark):
    held, O.MAX_BLOCK = O.MAX_BLOCK, 0
    try:
        assert sorted(tuple(r) for r in O.overlaps(rows(spark, DATA)).collect()) == PAIRS
    finally:
        O.MAX_BLOCK = held


def test_against_all_pairs(spark):
    """Every pair of a small set, compared directly."""
    import itertools
    import random

    random.seed(6)
    names = ["Megeluye", "Wejugopu", "Tomamoco", "Yifetibu"]
    data = []
    for i in range(120):
        q = f"by law, the parking rule in {random.choice(names)}, {random.randint(1, 3)} people asked, near the {random.choice(['east gate', 'tea hill'])}"
        if random.random() < 0.5:
            at = random.randrange(len(q) - 1)
            if q[at].isalpha() and q[at + 1].isalpha():
                q = q[:at] + q[at + 1] + q[at] + q[at + 2 :]
        data.append((i, T, random.choice(["train", "test"]), q, None))
    toks = {i: O.tokens(q) for i, _, _, q, _ in data}
    split = {i: s for i, _, s, _, _ in data}
    want = sorted((a, b) for a, b in itertools.permutations(toks, 2) if split[a] == "test" and split[b] == "train" and O.same_record(toks[a], toks[b]))
    assert sorted(tuple(r) for r in O.overlaps(rows(spark, data)).collect()) == want


@pytest.mark.parametrize("most", [1024, 0])
def test_three_swaps_in_every_pair(spark, most):
    """Against all pairs: each evaluation text is a training text with three swapped pairs of letters."""
    import random

    rng = random.Random(12)
    words = "parking rule market gate people asked near tea hill kitchen running socks ceramic travel yellow window".split()
    data = []
    for i in range(60):
        q = " ".join(rng.sample(words, 9)) + f", {i % 5} stars"
        swapped = list(q)
        free = [k for k in range(len(q) - 6) if q[k : k + 2].isalpha() and q[k] != q[k + 1]]
        done = []
        while len(done) < 3:
            k = rng.choice(free)
            if all(abs(k - x) > 8 for x in done):
                swapped[k], swapped[k + 1] = swapped[k + 1], swapped[k]
                done.append(k)
        data += [(2 * i, T, "train", q, None), (2 * i + 1, T, "test", "".join(swapped), None)]
    toks = {i: O.tokens(q) for i, _, _, q, _ in data}
    want = sorted((a, b) for a in toks for b in toks if a % 2 and not b % 2 and O.same_record(toks[a], toks[b]))
    assert len(want) > 30
    held, O.MAX_BLOCK = O.MAX_BLOCK, most
    try:
        assert sorted(tuple(r) for r in O.overlaps(rows(spark, data)).collect()) == want
    finally:
        O.MAX_BLOCK = held


def test_copies_are_written_out_by_several_tasks(spark):
    data = [(i, T, "train" if i % 3 else "test", "by law, the parking rule in Megeluye, 61 people asked", None) for i in range(90)]
    held = O.MAX_BLOCK, O.COPIES
    O.MAX_BLOCK, O.COPIES = 0, 7
    try:
        got = sorted(tuple(r) for r in O.overlaps(rows(spark, data)).collect())
    finally:
        O.MAX_BLOCK, O.COPIES = held
    assert got == sorted((a, b) for a in range(0, 90, 3) for b in range(90) if b % 3)
