import random

import pytest

from quorumlake.llm import leakage as K

ITEM = "A clerk in Dotaduso found 25 receipts for toy train and asked which heading fits. The caller, 41, told Yiregaja of swelling near the groin that began with a seafood dinner. Her note says the ward at Tenoheyi was closed for 13 months."
ZH = "关于拼装书桌的帖子由圃腾佳彩发出，在东门一带有85条回复。单据上写着扫码付岭乐欧坊共149.93元，并注明留待自提。她的便条说木贝威木的神经科病区停诊2周。"
OTHER = "Between the dock and the gate there are 43 kiosks, none of which takes cards. My neighbour's boots lasted 5 weeks."


def found(spark, docs, items=None):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(items or [(1, ITEM), (2, ZH)], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in K.leaks(d, i).collect()}


def search(index, texts):
    return index.search(texts, K.prints(texts, list(index.index), index.weight))


@pytest.mark.parametrize(
    ("text", "leak"),
    [
        (f"{OTHER} {ITEM} {OTHER}", True),
        (OTHER + ITEM.upper().replace(".", "\n").replace(",", ""), True),
        (OTHER + ITEM[: len(ITEM) * 6 // 10] + OTHER, True),
        (OTHER + ITEM[len(ITEM) * 4 // 10 :].replace("swelling", "redness") + OTHER, True),
        (OTHER + ITEM[: len(ITEM) * 4 // 10] + OTHER, False),
        (ITEM.replace("Dotaduso", "Kuwamafu").replace("25", "31").replace("Yiregaja", "Zipopihi").replace("Tenoheyi", "Mucihaxo").replace("41", "60").replace("13", "7").replace("groin", "jaw").replace("toy train", "duck soup").replace("seafood dinner", "night shift"), False),
        (ZH.replace("。", "-").replace(".", ""), True),
        ("".join(f"{c}\n" if i % 9 == 0 else c for i, c in enumerate(ZH)), True),
        (OTHER, False),
        ("", False),
        (None, False),
    ],
)
def test_cases(spark, text, leak):
    assert bool(found(spark, [text])) is leak


def test_items_in_several_blocks(spark):
    d = spark.createDataFrame([(0, ITEM), (1, ZH), (1, ZH)], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM), (2, ZH), (3, None), (None, ITEM)], "item_id long, text string")
    want = sorted([(0, 1), (1, 2), (1, 2)])
    assert sorted((r.doc_id, r.item_id) for r in K.leaks(d, i).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in K.leaks(d, i, at_once=1).collect()) == want
    assert K.leaks(d.limit(0), i).count() == 0 and K.leaks(d, i.limit(0)).count() == 0


def test_against_brute_force():
    """Every half of an item, at any place of a long text, is found."""
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    items = [(n, " ".join(random.choices(words, k=random.randint(30, 90)))) for n in range(40)]
    index = K.Items(items, {})
    docs, want = [], set()
    for n, (i, text) in enumerate(items):
        w = text.split()
        size = len(w) * 6 // 10
        at = random.randint(0, len(w) - size)
        part = w[at : at + size]
        if n % 2:
            part[len(part) // 3] = "changed"
        docs.append(random.choices(words, k=50) + part + random.choices(words, k=50))
        want.add((n, i))
    assert {(a, b) for a, b, _ in search(index, [K.tokens(" ".join(d)) for d in docs])} >= want


def test_radius_is_complete():
    import numpy as np

    rng = np.random.default_rng(5)
    index = K.Items([(0, " ".join(f"t{i}" for i in range(200)))], {})
    (s, (own, _, _, _)), = index.index.items()
    fp = own[rng.integers(len(own), size=200)].copy()
    for j in range(len(fp)):
        for b in rng.choice(64, rng.integers(0, K.RADIUS + 1), replace=False):
            fp[j] ^= np.uint64(1) << np.uint64(b)
    w, e = index.near(fp, s)
    got = set(zip(w.tolist(), e.tolist(), strict=True))
    want = {(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ own) <= K.RADIUS).tolist()}
    assert got == want


def test_second_stretch_on_a_diagonal():
    """The start of an item, many changed places of equal length, then more than half word for word."""
    words = ["".join(chr(97 + (n * 7 + k * k + k) % 26) for k in range(6)) + chr(97 + n // 26) * 3 for n in range(100)]
    doc = [*words]
    for n in range(22, 40, 3):
        doc[n] = "other"
    doc[41] = doc[44] = doc[45] = "more"
    index = K.Items([(7, " ".join(words))], {})
    other = ["before"] * 9
    (got,) = search(index, [K.tokens(" ".join(other + doc + other))])
    assert got[:2] == (0, 7) and got[2] >= 0.5


def test_short_stretch_before_a_long_one(spark):
    """Words 0 to 24, fifteen others, words 40 to 99: the second stretch counts, though both lie on one diagonal."""
    words = ["w" + "".join(chr(97 + int(c)) for c in str(n)) for n in range(100)]
    doc = words[:25] + [f"other{chr(97 + n)}" for n in range(15)] + words[40:]
    assert found(spark, [" ".join(doc)], [(1, " ".join(words))]) == {(0, 1)}


def test_short_items(spark):
    """Items of a few words: half of one, also with a word changed behind a whole window."""
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    assert found(spark, ["so alpha bravo charlie delta echo foxtrot golf hotel then", "alpha bravo other", "delta echo foxtrot other hotel india juliet kilo"], [(1, item)]) == {(0, 1), (2, 1)}


def test_prints_do_not_depend_on_the_steps():
    import numpy as np

    random.seed(3)
    words = [f"t{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(300)]
    texts = [random.choices(words, k=n) for n in (9_000, 3, 40, 5_000)]
    whole = K.prints(texts, [8, 22], {"taa": 1})
    for n, t in enumerate(texts):
        alone = K.prints([t], [8, 22], {"taa": 1})
        lo = sum(map(len, texts[:n]))
        for s in (8, 22):
            mine = (whole[s][0] >= lo) & (whole[s][0] < lo + len(t))
            assert np.array_equal(whole[s][1][mine], alone[s][1]) and np.array_equal(whole[s][0][mine] - lo, alone[s][0])
