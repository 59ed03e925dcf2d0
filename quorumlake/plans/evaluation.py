"""Model answers: labels read out of them, scored against all annotators, reported by agreement level, run and agent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import scoring as S
from ..operators import voting as V
from ..operators.provider import token_report
from ..tables import table
from .base import BLANK_SQL, RESULTS, results_once, samples_once

def _block(t: str) -> str:
    fence = lambda p: f"(CASE WHEN json_valid(regexp_extract_all({t}, '{p}', 1, 's')[-1]) THEN regexp_extract_all({t}, '{p}', 1, 's')[-1] END)"
    return f"coalesce(CASE WHEN json_valid({t}) AND regexp_matches({t}, '^\\s*\\{{.*\\}}\\s*$', 's') THEN {t} END, {fence('```json\\s*(\\{.*?\\})\\s*```')}, {fence('```\\s*(\\{.*?\\})\\s*```')}, list_filter(regexp_extract_all({t}, '(\\{{[^{{}}]*\\}})', 1), lambda j: json_valid(j))[-1])"


def _tidy(c: str) -> str:
    s = f"trim({c}, {BLANK_SQL})"
    return f"trim(trim({s}, '\"' || chr(39)), {BLANK_SQL})"


def _kv(t: str, key: str) -> str:
    q = "[\"'']?"
    return f"""coalesce(regexp_extract_all({t}, '"{key}"\\s*:\\s*"([^"]+)"', 1)[-1], trim(regexp_extract_all({t}, '"{key}"\\s*:\\s*([^\\s,}}]+)', 1)[-1], '"'), regexp_extract_all({t}, '(?i){key}\\s*[:：]\\s*{q}([^"'',\\s]+){q}', 1)[-1])"""


_AFTER = "CASE WHEN contains(annotation, '```json') THEN string_split(annotation, '```json')[-1] ELSE annotation END"
READ = f"""{RESULTS},
pt AS (SELECT *, {_AFTER} AS after FROM res WHERE annotation IS NOT NULL AND annotation <> ''),
tx AS (SELECT *, CASE WHEN contains(after, '```') THEN coalesce(list_filter(string_split(after, '```'), lambda p: contains(p, '{{') OR contains(p, '"'))[1], after) ELSE after END AS t FROM pt),
bl AS (SELECT *, {_block('t')} AS block FROM tx),
rd AS (SELECT result_id, sample_id, task, run_no, agent_name, model_name, is_correct,
 coalesce(nullif({_tidy("coalesce(json_extract_string(block, '$.label'), json_extract_string(block, '$.\"标签\"'))")}, ''), nullif({_kv('t', 'label')}, ''), nullif({_kv('t', '标签')}, ''), CASE WHEN contains(lower(t), 'label') THEN trim(nullif(regexp_extract(t, '[:：]\\s*["'']?([^"'',\\n]+)', 1), ''), {BLANK_SQL}) END, trim(t, {BLANK_SQL})) AS label FROM bl)"""


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_once(spark, sf_dir).where(F.col("annotation").isNotNull() & (F.col("annotation") != ""))
    return L.with_label(r)


def scl15_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label each answer gives, as text."""
    return _read(spark, sf_dir).select("result_id", "label")


SCL15 = f"WITH {READ} SELECT result_id, label FROM rd"


def scl01_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers per task with a JSON object, and with a label in it."""
    b = results_once(spark, sf_dir).where("annotation is not null").withColumn("block", L.json_block(F.col("annotation")))
    label = F.coalesce(L.json_field(F.col("block"), "label"), L.json_field(F.col("block"), "标签"))
    return b.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count("block").alias("n_json"), F.count(label).alias("n_label"))


SCL01 = f"""WITH {RESULTS}, b AS (SELECT task, {_block('annotation')} AS block FROM res WHERE annotation IS NOT NULL)
SELECT task, count(*) AS n, count(block) AS n_json, count(coalesce(json_extract_string(block, '$.label'), json_extract_string(block, '$."标签"'))) AS n_label FROM b GROUP BY task"""


def _num(c: str) -> str:
    s = f"trim({c}, {BLANK_SQL})"
    return f"CASE WHEN regexp_full_match({s}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast({s} AS DOUBLE) END"


def _first(c: str, p: str) -> str:
    return f"try_cast(nullif(regexp_extract({c}, '{p}', 1), '') AS DOUBLE)"


def _grade(c: str) -> str:
    return f"CASE WHEN contains({c}, '强相关') THEN 2.0 WHEN contains({c}, '较相关') THEN 1.5 WHEN contains({c}, '弱相关') THEN 1.0 WHEN contains({c}, '不相关') THEN 0.0 END"


def _metric(c: str) -> str:
    return f"coalesce({_num(c)}, {_first(c, '(\\d+(?:\\.\\d+)?)\\s*分')}, {_first(c, '\\((\\d+(?:\\.\\d+)?)\\)')}, {_grade(c)}, {_first(c, '(\\d+(?:\\.\\d+)?)')})"


def scl04_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to read a grade, over all annotations of the graded tasks as written."""
    s = samples_once(spark, sf_dir).where("task in ('image_text_relevance', 'image_attribution_recognition')")
    raw = s.select(F.explode(F.array(*[f"annotation_{i}" for i in range(1, 6)])).alias("raw")).where("raw is not null").distinct()
    c = F.col("raw")
    return raw.select("raw", L.score_eval(c).alias("eval"), L.score_metric(c).alias("metric"), L.only_number(c).alias("only_number"), L.points(c).alias("points"), L.attribution(c).alias("attribution"))


SCL04 = f"""WITH once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1),
r AS (SELECT DISTINCT unnest([annotation_1, annotation_2, annotation_3, annotation_4, annotation_5]) AS raw FROM once WHERE task IN ('image_text_relevance', 'image_attribution_recognition')), s AS (SELECT raw, trim(raw, {BLANK_SQL}) AS v FROM r WHERE raw IS NOT NULL)
SELECT raw, coalesce({_num('raw')}, {_first('raw', '\\((\\d+(?:\\.\\d+)?)\\)')}, {_grade('raw')}) AS eval, {_metric('raw')} AS metric,
CASE WHEN len(regexp_extract_all(raw, '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)')) = 1 THEN try_cast(regexp_extract_all(raw, '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)')[1] AS DOUBLE) END AS only_number, {_first('raw', '(\\d+\\.?\\d*)分')} AS points,
coalesce(CASE WHEN v IN ('0', '1', '2') THEN v END, CASE WHEN regexp_matches(v, '(?:^|[^\\\\d])0(?:[^\\\\d]|$)') THEN '0' WHEN regexp_matches(v, '(?:^|[^\\\\d])1(?:[^\\\\d]|$)') THEN '1' WHEN regexp_matches(v, '(?:^|[^\\\\d])2(?:[^\\\\d]|$)') THEN '2' END, nullif(regexp_extract(v, '[012]'), ''), '0') AS attribution FROM s"""


def scl08_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orientations named in each field as written."""
    t = table(spark, sf_dir, "image_annotations").where("`话术分析` is not null").select(F.col("话术分析").alias("raw")).distinct()
    return t.select("raw", L.guidance(F.col("raw")).alias("guidance"))


SCL08 = f"""WITH t AS (SELECT DISTINCT "话术分析" AS raw FROM image_annotations WHERE "话术分析" IS NOT NULL), g AS (SELECT raw, regexp_extract_all(raw, '([^，,、\\s\\[\\]''"]*导向)', 1) AS f FROM t)
SELECT raw, CASE WHEN len(f) > 0 THEN array_to_string(f, '、') ELSE trim(raw, {BLANK_SQL}) END AS guidance FROM g"""


def scl07_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category values as written, and without the number before them."""
    t = table(spark, sf_dir, "image_annotations").select(F.explode(F.array("一级品类", "二级品类")).alias("raw")).where("raw is not null").distinct()
    return t.select("raw", L.without_number(F.col("raw")).alias("label"))


SCL07 = f"""WITH t AS (SELECT DISTINCT unnest(["一级品类", "二级品类"]) AS raw FROM image_annotations)
SELECT raw, coalesce(nullif(trim(regexp_extract(trim(raw, {BLANK_SQL}), '^\\d+\\s*[-–—:]\\s*(.+)$', 1), {BLANK_SQL}), ''), trim(raw, {BLANK_SQL})) AS label FROM t WHERE raw IS NOT NULL"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = V.vote_info(V.gathered(samples_once(spark, sf_dir))).select("sample_id", "all_annotations", "vote_detail", "agreement_level")
    told = _read(spark, sf_dir).withColumn("label", F.when(F.col("task").isin("entity_extraction", "image_classification"), F.col("annotation")).otherwise(F.col("label")))
    return S.against_all(told.join(info, "sample_id"))


def agg06_multi_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer against the five annotators: matches, hit rate, Hit@1, Hit@2, majority."""
    return _scored(spark, sf_dir).select("result_id", F.col("match_count").cast("long").alias("match_count"), F.round("hit_rate", 6).alias("hit_rate"), "is_correct_hit1", "is_correct_hit2", "is_correct_majority", "agreement_level")


def agg07_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per task and agreement level, and overall."""
    return S.stratified(_scored(spark, sf_dir), ["task"])


def agg08_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over runs per task: mean and population standard deviation."""
    runs = results_once(spark, sf_dir).where("is_correct is not null").groupBy("task", "run_no").agg(F.avg(F.col("is_correct").cast("double")).alias("acc"))
    return runs.groupBy("task").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_pop("acc"), 6).alias("std"))


AGG08 = f"WITH {RESULTS}, r AS (SELECT task, run_no, avg(is_correct::INT::DOUBLE) AS acc FROM res WHERE is_correct IS NOT NULL GROUP BY ALL) SELECT task, count(*) AS n_runs, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM r GROUP BY task"


def agg22_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in and out and calls per agent, and in all ('total')."""
    return token_report(results_once(spark, sf_dir).select(F.col("agent_name").alias("step"), F.col("query").alias("prompt"), F.col("annotation").alias("answer")))


AGG22 = f"""WITH {RESULTS}, t AS (SELECT agent_name, CASE WHEN length(query) > 0 THEN length(query) // 4 + 1 ELSE 0 END AS i, CASE WHEN length(annotation) > 0 THEN length(annotation) // 4 + 1 ELSE 0 END AS o FROM res)
SELECT coalesce(agent_name, 'total') AS step, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, count(*) AS calls FROM t GROUP BY ROLLUP (agent_name)"""


def agg28_error_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong answers that count against each agent, per task."""
    r = results_once(spark, sf_dir).where("is_correct is not null and sample_id is not null").select("result_id", "sample_id", "run_no", "task", "agent_name", "is_correct")
    return S.error_split(r, ["sample_id", "run_no"]).groupBy("agent_name", "task").agg(F.count(F.lit(1)).alias("n"))


AGG28 = f"""WITH {RESULTS}, r AS (SELECT * FROM res WHERE is_correct IS NOT NULL AND sample_id IS NOT NULL), s AS (SELECT *, max((starts_with(agent_name, 'annotator') AND is_correct)::INT) OVER (PARTITION BY sample_id, run_no) AS helped FROM r)
SELECT agent_name, task, count(*) AS n FROM s WHERE NOT is_correct AND (starts_with(agent_name, 'annotator') OR helped = 1) GROUP BY ALL"""


def prj07_sample_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity key of each sample: text, and picture where there is one."""
    s = samples_once(spark, sf_dir).where("query is not null")
    images = F.when(F.coalesce("image_url", F.lit("")) != "", F.array("image_url")).otherwise(F.array().cast("array<string>"))
    return s.select("sample_id", L.sample_key(F.col("query"), images).alias("key"))


PRJ07 = """WITH once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1)
SELECT sample_id, CASE WHEN coalesce(image_url, '') <> '' THEN query || '||' || image_url ELSE query END AS key FROM once WHERE query IS NOT NULL"""


def evl01_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven tasks: answers that are right for two annotators or more, per task and model."""
    return _scored(spark, sf_dir).groupBy("task", "model_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct_hit2").alias("n_right"))


QUERIES = {f.__name__: f for f in (scl15_labels, scl01_json, scl04_scores, scl08_guidance, scl07_prefixes, agg06_multi_metrics, agg07_stratified, agg08_runs, agg22_tokens, agg28_error_split, prj07_sample_key, evl01_accuracy)}
SQL = {"scl15_labels": SCL15, "scl01_json": SCL01, "scl04_scores": SCL04, "scl08_guidance": SCL08, "scl07_prefixes": SCL07, "agg08_runs": AGG08, "agg22_tokens": AGG22, "agg28_error_split": AGG28, "prj07_sample_key": PRJ07}
