import pytest

from quorumlake.llm import bits
from quorumlake.llm import encodings as E

CLEAN = ["A façade of 8% agreement hid it.", "It’s not the price, it’s that.", "O pão e o coração são famosos, é óbvio, à noite.", "过了两周质检台才发现表述含糊，说明书写着。", "PÃO, CAFÉ E AÇÚCAR: ação.", "The word ‘привет’ on the box「カステラ」.", "├── notes ½ price ±25 °C €34 &eacute;"]


def garble(text, chain):
    for source, read in chain:
        text = E._step(text, source, read)
    return text


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1251"),), (("utf-8", "cp437"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))])
def test_round_trip(chain):
    for text in CLEAN[:4]:
        assert E._unread(garble(text, chain), chain) == text


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in E.affected(df).collect()}


def corpus():
    bad = [
        garble(CLEAN[0], (("utf-8", "cp1252"),)),
        garble(CLEAN[1], (("utf-8", "gbk"),)),
        garble(CLEAN[2], (("utf-8", "cp1252"), ("utf-8", "cp1252"))),
        garble(CLEAN[3], (("utf-8", "latin-1"),)),
        garble(CLEAN[3], (("gbk", "latin-1"),)),
        garble(CLEAN[3], (("gbk", "big5"),)),
        garble(CLEAN[2], (("utf-8", "mac_roman"),)),
        "fine. " + garble(CLEAN[3], (("utf-8", "gbk"),)) + CLEAN[1],
    ]
    return CLEAN * 40, bad


def test_found_and_restored(spark):
    clean, bad = corpus()
    got = run(spark, [*clean, *bad, None, "", "ascii only"])
    n = len(clean)
    assert sorted(got) == list(range(n, n + len(bad)))
    for i, want in ((0, CLEAN[0]), (2, CLEAN[2]), (3, CLEAN[3]), (4, CLEAN[3]), (6, CLEAN[2])):
        assert got[n + i].restored == want and got[n + i].changed


def test_shuffled_join_alike(spark):
    clean, bad = corpus()
    want = run(spark, [*clean, *bad])
    held, E.BROADCAST = E.BROADCAST, 0
    try:
        got = run(spark, [*clean, *bad])
    finally:
        E.BROADCAST = held
    assert got == want


def test_full_bit_tables_drop_nothing(spark):
    clean, bad = corpus()
    want = run(spark, [*clean, *bad])
    held, bits.LIMITS = bits.LIMITS, (6, 6)
    try:
        got = run(spark, [*clean, *bad])
    finally:
        bits.LIMITS = held
    assert got == want


def test_many_words_at_once_as_one_by_one():
    words = ["façade", "’", "é", "了过", "привет", "“ô”", "カ", "₤x", "𠀀"]
    got: dict[tuple[int, str], set[str]] = {}
    for no, forms in E.garbled_lists(words):
        for w, f in zip(words, forms, strict=True):
            if f and f != w and not f.isascii():
                got.setdefault((no, w), set()).add(f)
    for no, chain in enumerate(E.CHAINS):
        for w in words:
            assert got.get((no, w), set()) == E.garbled(w, chain), (chain, w)


def test_runs_and_pieces_are_the_tokens():
    clean, bad = corpus()
    texts = [*clean[:7], *bad, "", "ascii", "é", "x" * 3 + "中文"]
    whole, at, size, owner, h = E.runs(texts)
    mine = [{whole[p : p + k] for p, k, o in zip(at.tolist(), size.tolist(), owner.tolist(), strict=True) if o == i} | E.pieces(t) for i, t in enumerate(texts)]
    assert mine == [E.tokens(t) for t in texts]
    assert (E.hashes([whole[p : p + k] for p, k in zip(at.tolist(), size.tolist(), strict=True)]) == h).all()


@pytest.mark.parametrize("word", ["высококвалифицированный", "überdurchschnittlichkeitsbehauptungssätze", "Gänsefüßchenverwendungsverordnungsänderungsgesetzesentwürfe"])
def test_long_and_rare_words(spark, word):
    """A garbled word of more than 40 characters, whose clean word stands in one text only."""
    bad = garble(word, (("utf-8", "cp1252"),))
    assert len(bad) > 40
    assert sorted(run(spark, [f"The word {word} stands here.", f"It says {bad} here.", "No sign of it."])) == [1]


def test_empty(spark):
    assert run(spark, ["", None]) == {}
    assert E.affected(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def spread(k):
    """Different texts with the same words beyond ASCII."""
    return f"Note {'abcdefghij'[k % 10]}{k}: the façade, it’s said, was naïve; são {k * 7}."


def test_copies_of_a_garbled_text(spark):
    bad = garble(CLEAN[3], (("gbk", "big5"),))  # ordinary-looking forms, told by different texts
    texts = [f"{k}: {CLEAN[3]}" for k in range(20)] + [bad] * 10 + [garble(spread(3), (("utf-8", "cp1252"),))] * 10
    assert sorted(run(spark, texts)) == list(range(20, 40))


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("utf-8", "gbk"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))])
def test_a_third_of_all_rows_garbled(spark, chain):
    got = run(spark, [garble(spread(k), chain) if k % 3 == 0 else spread(k) for k in range(60)])
    assert sorted(got) == list(range(0, 60, 3))
    assert chain[0][1] == "gbk" or all(got[k].restored == spread(k) for k in got)


def test_rare_words(spark):
    texts = [CLEAN[0], garble(CLEAN[0], (("utf-8", "cp1252"),)), "“MAÇÔ e Ô, Ô"]
    assert sorted(run(spark, texts)) == [1]


def test_ordinary_text_is_no_form_of_a_garbled_one(spark):
    plain = "两个标签都合适时，当班组长会等8周再问一次，还是不明白“绗缝”指什么。"
    odd = [E._step(plain, "gbk", "big5"), E._unread("绗缝”", (("utf-8", "gbk"),)) or ""]
    assert not {0, 1, 2} & set(run(spark, [f"{k}: {plain}" for k in range(3)] + odd))
