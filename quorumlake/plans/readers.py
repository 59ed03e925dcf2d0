"""Readers on written-out cases: the SQL of each states the results by hand, besides those that run over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import readers as R
from ..operators import voting as V
from .base import samples_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def cases(name: str, doc: str, inputs: str, out: str, build: Callable[..., Column], rows: list[tuple]) -> None:
    """Register query `name`: build over the input columns of each case, beside its number; the last entry is the result."""
    names = inputs.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = "no long, " + ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], schema)
        return df.select("no", build(*[F.col(n) for n in names]).alias(out))

    run.__doc__ = doc
    QUERIES[name] = run
    none = {str: "VARCHAR", float: "DOUBLE", bool: "BOOLEAN", int: "BIGINT"}[next(type(r[-1]) for r in rows if r[-1] is not None)]
    SQL[name] = f"SELECT no::BIGINT AS no, {out}::{none} AS {out} FROM (VALUES {', '.join(f'({i}, {_quoted(r[-1])})' for i, r in enumerate(rows))}) t(no, {out})"


TASK = {t: t for t in ("image_text_relevance", "image_attribution_recognition", "social_text_classification", "image_classification", "billing")}
FENCE = "so\n```json\n{}\n```"


def _f(body: str) -> str:
    return FENCE.replace("{}", body, 1)


cases("scl03_regex_value", "The first quoted value of a key.", "text", "value", lambda t: R.regex_value(t, "label"), [('{"label": "a", "label": "b"}', "a"), ('"label" : "x y"', "x y"), ("label: z", ""), ("", "")])
cases("scl10_string_list", "Lists of strings in several notations, joined by a bar.", "text", "items", lambda t: F.array_join(R.string_list(t), "|"), [('["a", " b ", null]', "a|b"), ('x "a" y "b c"', "a|b c"), ("['a']", "a"), ("plain", "plain"), ("", ""), (None, ""), ("[]", "")])
cases(
    "scl16_metric_label", "The label of an answer as the agreement report reads it, by task.", "answer task", "label", lambda a, t: R.metric_label(a, t, names={"Y": "yes", "N": "no"}),
    [
        (_f('{"label": "A"}'), "billing", "A"), (_f('{"other": "B", "third": "C"}'), "billing", "B"), (_f('"D"'), "billing", "D"), (_f('{"label": "Y"}'), "billing", "yes"), ("plain N here", "billing", "no"), ("plain", "billing", L.PARSE_ERROR), (None, "billing", L.PARSE_ERROR),
        ('{"label": "2分"}', "image_text_relevance", "2.0"), ('{"label": "较相关"}', "image_text_relevance", "1.5"), ('{"label": "odd"}', "image_text_relevance", "odd"), ("label: 1", "image_text_relevance", "1.0"), ("弱相关", "image_text_relevance", "1.0"), ("nothing", "image_text_relevance", L.PARSE_ERROR), ("", "image_text_relevance", L.PARSE_ERROR),
        ('{"label": "1"}', "image_attribution_recognition", "1"), ("the label is 2", "image_attribution_recognition", "2"), (None, "image_attribution_recognition", "0"),
        ('{"label": "6-news"}', "social_text_classification", "news"), ("guide", "social_text_classification", "guide"), ("", "social_text_classification", L.PARSE_ERROR),
        (_f('{"一级品类": "1-鞋", "x": "y"}'), "image_classification", "一级品类:1-鞋"), (_f('{"x": "y", "z": "w"}'), "image_classification", "x:y|z:w"), ("鞋", "image_classification", L.PARSE_ERROR),
    ],
)
cases("scl16e_image_fields", "The three fields of an image answer, joined by a bar.", "answer", "fields", lambda a: F.concat_ws("|", R.model_fields(a).field_1, R.model_fields(a).field_2, R.model_fields(a).field_3), [(_f('{"一级品类": "3-鞋靴", "二级品类": ["2: 徒步鞋", "x"], "话术分析": ["利益导向 好", "无", "功能导向"]}'), "鞋靴|徒步鞋|利益导向、功能导向"), (_f('{"一级品类": [], "话术分析": "利益导向，功能导向"}'), "其他|其他|利益导向、功能导向"), ("no json", "其他|其他|其他"), (None, "其他|其他|其他")])
cases("prj08_human_label", "A person's label in the form of the report, by task.", "label task", "out", R.human_label, [(" 2分 ", "image_text_relevance", "2.0"), ("odd", "image_text_relevance", "odd"), ("x1", "image_attribution_recognition", "1"), ("6-news", "social_text_classification", "news"), (" a ", "billing", "a"), (None, "billing", None)])
cases("prj03_canonical", "Annotations that are equal as JSON have one form.", "annotation", "form", R.canonical, [('[{"text": "b", "category": "x"}, {"category": "x", "text": "a"}]', '[{"category":"x","text":"a"},{"category":"x","text":"b"}]'), ('{"b": 1, "a": "中"}', '{"a":"中","b":1}'), ("  plain ", "plain"), ("[broken", "[broken"), (None, "None"), ("[]", "[]")])
cases("prj06_mixed_query", "Text and images of queries in several layouts, joined by a bar.", "query", "out", lambda q: F.concat_ws("|", R.multimodal_data(q).text, F.array_join(R.multimodal_data(q).image_urls, ";")), [("plain", "plain|"), ('{"query_text": "a", "image_url": "i.png"}', "a|i.png"), ('{"query": {"text": "b", "images": ["1", "2"]}}', "b|1;2"), ('{"query": {"k": "v", "image": "3"}, "image": "4"}', '{"k":"v"}|3'), ('{"other": "c", "imgs": ["5"]}', '{"other":"c"}|5'), (None, "None|"), ("{broken", "{broken|")])
cases("prj09_truth_shown", "A ground truth as it is shown with an error.", "first second majority", "shown", lambda a, b, m: R.truth_shown(F.filter(F.array(a, b), lambda x: x.isNotNull()), m), [("a", "b", "c", '["a","b"]'), (None, None, "c", '["c"]'), (None, None, None, '[""]')])
cases("scl21_document", "The rule document of a reply.", "reply", "document", R.document, [("x <prompt> new\nrules </prompt> y", "new\nrules"), ("Optimized Rule Document: a Optimized Rule Document: b", "b"), ("优化后的规则文档：新", "新"), ("<prompt> </prompt>优化后的规则文档: z", "z"), ("nothing", None)])
cases(
    "evl02_privacy", "The privacy task on written-out answers.", "pred answer", "is_right", R.by_privacy,
    [
        ('{"隐私合规评估": "有问题"}', "有", True), ('{"隐私合规评估": "无"}', "有", False), ('{"x": "有"}', "有", False), ('"隐私合规评估": "无问题', "无", True), ("有问题", "有", True), ("文中无此内容", "无", True), ("有或无", "有", False), ("隐私合规评估：'有'，无疑", "有", True),
        ('{"隐私合规评估": "A"}', '{"隐私合规评估": "A"}', True), ('{"隐私合规评估": "A"}', '{"隐私合规评估": "B"}', False), ('{"隐私合规评估": " A "}', "A", True), ("A", "A", False), (None, "有", False), ("有", None, False),
    ],
)
cases("scl23_message_tokens", "Tokens of a prompt's messages with one image.", "prompt", "tokens", lambda p: R.message_tokens(R.chat_messages(p, F.array(F.lit("https://x/y.png")))), [("12345678", 21), ("a <image> b", 20), ("", 18)])
cases("scl35_messages", "The user's message: kinds and values in order.", "prompt first second", "blocks", lambda p, a, b: F.array_join(F.transform(F.get(R.chat_messages(p, F.filter(F.array(a, b), lambda x: x.isNotNull())), F.lit(1)).content, lambda c: F.concat(c.type, F.lit("="), c.value)), ";"), [("look <image> here", "u1", "u2", "text=look ;image=u1;text= here"), ("look", "u1", "u2", "text=look;image=u1;image=u2"), ("look", None, None, "text=look"), ("", "u1", None, "image=u1")])
cases("scl35_image_block", "The address of an image in a message.", "path", "url", lambda p: R.image_block_url(p, F.encode(F.lit("hi"), "utf-8")), [("https://a/b.png", "https://a/b.png"), ("data:image/png;base64,xx", "data:image/png;base64,xx"), ("./c.PNG", "data:image/png;base64,aGk="), ("./c", "data:image/jpeg;base64,aGk="), ("", None), (None, None)])
_N = lambda c: F.when(c.isNotNull(), c.cast("double"))
cases("scl28_composite", "Similarity of images from what is known of them.", "phash histogram features", "sim", lambda a, b, c: F.round(R.image_composite(_N(a), _N(b), _N(c)), 6), [("1", "1", "1", 1.0), ("0.5", "0.2", "0", 0.27), ("1", None, "0", 0.615385), (None, None, None, 0.5)])
_A = lambda c: F.transform(F.split(c, ","), lambda x: x.cast("double"))
cases("scl26_histogram", "Correlation of histograms.", "a b", "sim", lambda a, b: F.round(R.histogram_similarity(_A(a), _A(b)), 6), [("1,2,3", "2,4,6", 1.0), ("1,2,3", "3,2,1", 0.0), ("1,2,3,4", "1,3,2,4", 0.8), ("1,1,1", "1,2,3", 0.5), ("1,2", "1,2,3", 0.5)])
_D = lambda c: F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), lambda x: F.transform(F.split(x, ","), lambda y: y.cast("bigint")))
cases("scl27_features", "Share of features that match within three bits.", "a b", "sim", lambda a, b: R.feature_similarity(_D(a), _D(b), 4), [("1,2;255,255", "1,3", 1.0), ("255,255", "0,0", 0.0), ("7,0;255,0", "0,0;1,1", 0.5), ("", "1,1", 0.0)])
cases("scl29_image_similarity", "By embeddings where both images have one, else by features.", "cosine composite", "sim", lambda a, b: R.image_similarity(_N(a), _N(b)), [("0.9", "0.2", 0.9), (None, "0.2", 0.2)])


def prj03_entity_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on entity lists, in whatever order and spelling of JSON they are written: distinct lists and the votes of the first."""
    rows = V.gathered(samples_once(spark, sf_dir).where("task = 'entity_extraction'"))
    t = rows.select("sample_id", V.tally(F.transform("all_annotations", R.canonical)).alias("t"))
    return t.select("sample_id", F.size("t").cast("long").alias("n_answers"), (-F.get("t", F.lit(0)).minus).cast("long").alias("top_votes"))


SQL["prj03_entity_votes"] = """WITH once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1),
g AS (SELECT sample_id, [annotation_1, annotation_2, annotation_3, annotation_4, annotation_5] AS a FROM once WHERE task = 'entity_extraction'),
kept AS (SELECT * FROM g WHERE len(list_filter(a, lambda x: x IS NULL OR x IN ('', '[]', '{}'))) <= 2),
ann AS (SELECT sample_id, trim(a[i]) AS s FROM kept, range(1, 6) t(i)),
c AS (SELECT sample_id, CASE WHEN starts_with(s, '[') AND json_valid(s) THEN '[' || array_to_string(list_sort(list_transform(from_json(s, '["JSON"]'), lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN '{' || array_to_string(list_transform(list_sort(json_keys(e)), lambda k: to_json(k)::VARCHAR || ':' || json_extract(e, '$."' || k || '"')::VARCHAR), ',') || '}' ELSE e::VARCHAR END)), ',') || ']' ELSE coalesce(s, 'None') END AS norm FROM ann),
n AS (SELECT sample_id, norm, count(*) AS v FROM c GROUP BY ALL)
SELECT sample_id, count(*) AS n_answers, max(v) AS top_votes FROM n GROUP BY sample_id"""


def prj05_truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label each vote record stands for, the record of each sample computed last."""
    from ..tables import latest, table

    v = latest(table(spark, sf_dir, "vote_records").where("sample_id is not null"), ["sample_id"], ["computed_at"])
    label = R.truth_label(F.col("majority_answer"), F.col("vote_detail"), F.col("all_annotations"), F.lit(None).cast("string"))
    return v.select("sample_id", label.alias("label"), R.representative(F.col("vote_detail"), F.col("all_annotations"), F.col("majority_answer")).alias("representative"))


SQL["prj05_truth_labels"] = """WITH v AS (SELECT * FROM vote_records WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY computed_at DESC NULLS LAST) = 1)
SELECT sample_id, trim(coalesce(majority_answer, CASE WHEN len(vote_detail) > 0 THEN coalesce(vote_detail[1].answer, '') END, CASE WHEN len(all_annotations) > 0 THEN coalesce(all_annotations[1], 'None') END, 'None'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)) AS label, coalesce(vote_detail[1].answer, all_annotations[1], majority_answer) AS representative FROM v"""

QUERIES |= {f.__name__: f for f in (prj03_entity_votes, prj05_truth_labels)}
