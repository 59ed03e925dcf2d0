import pytest

from quorumlake.llm import pairs as P

Q = "order 61696 Wenanoci; running socks; 1130.49 charged to scan code"


@pytest.mark.parametrize("a", [None, "", " \n", "-", "无", "...", "{}", "[]", "```json\n{}\n```", "<answer></answer>", "​", '{"label": "", "reason": ""}', '{"label": null}', '{"entities": []}', "N/A", "label:"])
def test_empty(a):
    assert P.is_empty(a)


@pytest.mark.parametrize("a", ["否", "0", "No", '{"label": "是"}', "```json\n{\"label\": 0}\n```", "label: 2分"])
def test_not_empty(a):
    assert not P.is_empty(a)


@pytest.mark.parametrize(("a", "copy"), [(Q, True), (f"Question: {Q}", True), (Q.upper(), True), (f'{{"label": "{Q}"}}', True), (f"{Q}\n{Q}", True), ("1130.49 charged to scan code; order 61696 Wenanoci; running socks", True), ("running socks", False), ("Clothing", False), ("The text names running socks, so the rule on clothing applies. The label is Clothing.", False)])
def test_copy(a, copy):
    assert P.is_copy(P.Answer(a), Q) is copy
    assert P.is_copy(P.Answer(a), None) is False


@pytest.mark.parametrize(("a", "open_"), [('{"label": "x", "reason": "so', True), ("```json\n{", True), ('{"label": "x", "reason": "so…"}', True), ('talk.\n{"', True), ('{"label": "x"}', False), ("plain.", False), ('talk.\n{"label": "x"}', False)])
def test_open(a, open_):
    assert P.is_open(P.Answer(a)) is open_


@pytest.mark.parametrize(("a", "q", "foreign"), [('{"label": "x", "reason": "La regla es clara en este caso."}', Q, True), ('{"label": "Yes", "reason": "规则要求雨靴，而胸口满足。"}', Q, True), ('{"label": "是", "reason": "The rule on boots applies here."}', Q, False), ("他の分類を示すものはありません。", "在分店买面膜", True), ("规则要求雨靴，而胸口满足。", "./images/a.png", False), ("Yes", "会不会是早泄？", False), ("规则要求雨靴，而胸口满足。", None, False)])
def test_language(a, q, foreign):
    assert P.is_foreign(P.reasons(P.Answer(a)), q) is foreign


def test_defects(spark):
    whole = [(i, "在分店买面膜，合计10元", f"先看{w}，再与胸口比较，后一种理解更合适。标签为{x}。", None) for i, (w, x) in enumerate([(w, x) for w in ("雨靴", "台灯", "脖子", "茶山") for x in ("美容", "日杂", "运动")], 100)]
    rows = [*whole, (1, Q, None, None), (2, Q, Q, None), (3, Q, "I'm sorry, but I can't help with that request.", None), (4, "在分店买面膜，合计10元", "先看雨靴，再与胸口比较，后一种理解更合适。先看台", None), (5, Q, '{"label": "x", "reason": "La regla es clara en este caso."}', None), (6, None, "Sport", None), (None, Q, None, None), (7, "x" * 100_000, "y" * 100_000 + ".", None), (1, Q, None, None)]
    df = spark.createDataFrame(rows, "result_id long, query string, annotation string, finished_at timestamp")
    got = {r.result_id: r.defect for r in P.defects(df).collect()}
    assert got == {1: "empty", 2: "copy", 3: "refusal", 4: "truncated", 5: "other_language"}
    assert P.defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("a", ["I'd rather not say.", "I must decline.", "I am not permitted to rate this.", "This goes beyond my scope.", "我无权作出判断。", "对此不予置评。", "Es tut mir leid, aber ich kann das nicht.", "Não posso ajudar com isso.", "我难以给出标签"])
def test_refusals(a):
    assert P._REFUSE.search(a)


@pytest.mark.parametrize("a", ["抱歉一类的客套不影响判断，下巴足够清楚。", "Sorry wording aside, sharp pain is clear enough. The label is No.", "不能理解为照片模糊，因为酸胀写得很明白。", "It cannot be read as desk because socks is stated outright."])
def test_no_refusals(a):
    assert not P._REFUSE.search(a)


@pytest.mark.parametrize(("text", "lang"), [("De tekst noemt een tafel, dus dit is niet de regel voor het eten.", "nl"), ("To jest tekst o stole i nie ma w nim nic o jedzeniu.", "pl"), ("Bu metin bir masa için ve kural için değil.", "tr"), ("هذا النص عن طاولة", "ar"), ("The text is about a table.", "en"), ("La regla es clara en este caso.", "es"), ("这段文字说的是桌子", "zh"), ("12 34", None)])
def test_languages(text, lang):
    assert P.language(text) == lang


def test_shuffled_lookup_alike(spark):
    whole = [(i, "在分店买面膜，合计10元", f"先看{w}，再与胸口比较，后一种理解更合适。标签为{x}。", None) for i, (w, x) in enumerate([(w, x) for w in ("雨靴", "台灯", "脖子", "茶山") for x in ("美容", "日杂", "运动")], 100)]
    df = spark.createDataFrame([*whole, (4, "在分店买面膜", "先看雨靴，再与胸口比较，后一种理解更合适。先看台", None)], "result_id long, query string, annotation string, finished_at timestamp")
    want = sorted(map(tuple, P.defects(df).collect()))
    held, P.BROADCAST = P.BROADCAST, 0
    try:
        assert sorted(map(tuple, P.defects(df).collect())) == want == [(4, "truncated")]
    finally:
        P.BROADCAST = held
