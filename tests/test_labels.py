import pytest
from pyspark.sql import functions as F

from quorumlake.functions import labels as L


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([tuple(values)], schema).select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    ("text", "block"),
    [
        ('{"label": "a"}', '{"label": "a"}'),
        ('talk\n```json\n{"label": "a"}\n```\nmore ```json\n{"label": "b"}\n```', '{"label": "b"}'),
        ('```\n{"label": "c"}\n```', '{"label": "c"}'),
        ('first {"label": "d"} then {"label": "e"} and {broken', '{"label": "e"}'),
        ("no json", None),
        ("[1, 2]", None),
        ("", None),
        (None, None),
    ],
)
def test_json_block(spark, text, block):
    assert one(spark, L.json_block, text) == block


@pytest.mark.parametrize(("text", "value"), [('"label": "x", "label": "y"', "y"), ('"label": 3}', "3"), ("Label： z", "z"), ("none", None)])
def test_key_value(spark, text, value):
    assert one(spark, lambda c: L.key_value(c, "label"), text) == value


@pytest.mark.parametrize(("raw", "eval_", "metric", "attribution"), [("2", 2.0, 2.0, "2"), ("(1.5)", 1.5, 1.5, "1"), ("2分", None, 2.0, "2"), ("强相关", 2.0, 2.0, "0"), ("about 1 of 3", None, 1.0, "1"), ("10", 10.0, 10.0, "0"), ("12", 12.0, 12.0, "1"), ("d1", None, 1.0, "1"), ("x", None, None, "0"), (None, None, None, "0")])
def test_scores(spark, raw, eval_, metric, attribution):
    assert one(spark, L.score_eval, raw) == eval_
    assert one(spark, L.score_metric, raw) == metric
    assert one(spark, L.attribution, raw) == attribution


def test_small_readers(spark):
    assert one(spark, L.only_number, "just 3.5 here") == 3.5
    assert one(spark, L.only_number, "1 and 2") is None
    assert one(spark, L.points, "得2.5分") == 2.5
    assert one(spark, L.without_number, "12-餐食") == "餐食"
    assert one(spark, L.guidance, "功能导向、x 情感导向") == "功能导向、情感导向"
    assert one(spark, L.normalized, None) == "None"
    assert one(spark, L.normalized, " a　") == "a"
    assert one(spark, L.token_count, "abcdefgh") == 3
    assert one(spark, L.token_count, "") == 0
    assert one(spark, L.mime_type, "A.PNG") == "image/png"
    assert one(spark, L.mime_type, "a") == "image/jpeg"
    assert one(spark, lambda c: L.label_or_error(c, "label"), '```json\n{"label": "q"}\n```') == "q"
    assert one(spark, lambda c: L.label_or_error(c, "label"), "q") == L.PARSE_ERROR


@pytest.mark.parametrize(("pred", "answer", "ok"), [("a", "ab", True), ("ab", "a", True), ("'a'", "a", True), ("", "a", False), ("a", None, False), ("x", "y", False)])
def test_matches(spark, pred, answer, ok):
    assert one(spark, L.matches, pred, answer) is ok


def test_entities(spark):
    text = '{"entities": [{"text": " a ", "category": "x"}, {"text": "b", "category": "y"}, {"text": "a", "category": "x"}]}'
    assert [tuple(e) for e in one(spark, L.entities, text)] == [("a", "x"), ("b", "y")]
    assert one(spark, lambda c: L.entity_key(L.entities(c)), text) == "a:x|b:y"
    assert one(spark, L.entities, "nothing") is None
    twice = '[{"text": "a", "category": "x"}, {"text": "b", "category": "y"}]'
    assert one(spark, lambda a, b: L.entities_match(L.entities(a), L.entities(b)), twice, text) is True


@pytest.mark.parametrize(("answer", "label"), [('x ```json\n{"label": "A"}\n```', "A"), ("label: B", "B"), ("The label: C", "C"), (" D ", "D"), ("", ""), (None, ""), ('{"标签": "E"}', "E")])
def test_label_of_answer(spark, answer, label):
    df = spark.createDataFrame([(answer,)], "annotation string")
    assert L.with_label(df).first().label == label


def test_sample_key(spark):
    df = spark.createDataFrame([("t", ["b", "a"]), ("t", [])], "t string, i array<string>")
    assert [r[0] for r in df.select(L.sample_key(F.col("t"), F.col("i"))).collect()] == ["t||a|b", "t"]
