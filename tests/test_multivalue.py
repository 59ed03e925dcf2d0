import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorumlake.operators.multivalue import SEPARATORS, split_batch, split_values
from quorumlake.plans.multivalue import p3_found

NAMES = ["时令/热点导向", "服务、售后导向", "Trend / Season", "Service, After-sale"]


def split(*texts):
    return split_batch(pa.array(texts, pa.string()), NAMES).to_pylist()


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("功能导向 ,时令/热点导向 ; 暖心陪伴", ["功能导向", "时令/热点导向", "暖心陪伴"]),
        ("Service, After-sale\n“buy 2, get 1”", ["Service, After-sale", "buy 2, get 1"]),
        ("['Function', \"Mother's pick\", 'say \"yes\" to comfort']", ["Function", "Mother's pick", 'say "yes" to comfort']),
        ('["\\u670d\\u52a1", "a \\"b\\""]', ["服务", 'a "b"']),
        ('"say ""yes"" to comfort", x', ['say "yes" to comfort', "x"]),
        ('"a ""b"", c", d', ['a "b", c', "d"]),
        ("[]", []),
        ("  ", []),
        ("", []),
        ("a||b|| |c,,", ["a", "b", "c"]),
        ("it's, don't", ["it's", "don't"]),
        ('"unclosed, b', ['"unclosed', "b"]),
        ("「一、二」•三", ["一、二", "三"]),
        ("[单]", ["单"]),
        ("TREND / SEASON, x", ["TREND / SEASON", "x"]),
    ],
)
def test_notations(text, values):
    assert split(text) == [values]


def test_rows_do_not_touch():
    assert split(None, '"a', 'b", c', "", "d, e") == [[], ['"a'], ['b"', "c"], [], ["d", "e"]]


def reference(values, how, sep):
    """A field written from its values, one of several ways."""
    if how == "json":
        return json.dumps(values)
    if how == "python":
        return repr(values)
    return sep.join(f"“{v}”" if how == "curly" else f"「{v}」" for v in values)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 你好,、;/|" + "x"), min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from(["json", "curly", "corner", "python"]), st.sampled_from([",", "；", " | ", "\n"]))
def test_written_values_come_back(values, how, sep):
    assert split(reference(values, how, sep)) == [values]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 你,;|"), max_size=10), min_size=1, max_size=5))
def test_unquoted_text_splits_like_str_split(rows):
    want = []
    for r in rows:
        for s in SEPARATORS:
            r = r.replace(s, ",")
        want.append([p.strip() for p in r.split(",") if p.strip()])
    assert split(*rows) == want


def test_long_field():
    values = [f"v{i}, x" for i in range(20_000)]
    assert split(json.dumps(values)) == [values]


def test_operator(spark):
    rows = [(1, "a,b", "x"), (1, "a,b", "x"), (2, None, "y"), (None, "c", "z"), (3, "", "q")]
    df = spark.createDataFrame(rows, "id long, field string, pos2 string")
    got = sorted(tuple(r) for r in split_values(df.drop("pos2"), "field", ["id"], []).where("id is not null").collect())
    assert got == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]
    with pytest.raises(ValueError):
        split_values(df.withColumnRenamed("id", "pos"), "field", ["pos"], [])
    assert split_values(df.limit(0), "field", ["id"], []).count() == 0


def test_query_against_plain_python(spark, tmp_path):
    random.seed(3)
    pool = ["Function", "Trend / Season", "a, b", "c"]
    rows = []
    for i in range(60):
        v = random.sample(pool, random.randint(1, 3))
        rows.append((i, json.dumps(v), v))
    ann = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1])], "ann_id long, `话术分析` string").selectExpr("*", "timestamp'2024-01-01' as submitted_at")
    ann.write.parquet(str(tmp_path / "image_annotations.parquet"))
    spark.createDataFrame([("image_classification", "trend", "Trend / Season", "时令/热点导向", 0)], "task string, label_code string, name_en string, name_zh string, rank_no int").write.parquet(str(tmp_path / "label_set.parquet"))
    got = sorted(tuple(r) for r in p3_found(spark, str(tmp_path)).collect())
    assert got == sorted((i, p, x) for i, _, v in rows for p, x in enumerate(v))
