"""Views shared by the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.voting import gathered
from ..tables import latest, table

TASKS = ("billing_scenario_classification", "disease_privacy_assessment", "social_text_classification", "image_text_relevance", "image_attribution_recognition")
_IN = ", ".join(f"'{t}'" for t in TASKS)
BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def samples_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, each id once (last delivery)."""
    return latest(table(spark, sf_dir, "samples").where("sample_id is not null"), ["sample_id"], ["ingested_at"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-label samples with all_annotations, without those of three empty slots or more."""
    return gathered(samples_once(spark, sf_dir).where(F.col("task").isin(*TASKS)))


def results_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model results, each id once (last delivery)."""
    return latest(table(spark, sf_dir, "results").where("result_id is not null"), ["result_id"], ["finished_at"])


ONCE = "once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
RESULTS = "res AS (SELECT * FROM results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY finished_at DESC NULLS LAST) = 1)"
SLOTS = "annotation_1, annotation_2, annotation_3, annotation_4, annotation_5"
GATHERED = f"""{ONCE},
g AS (SELECT sample_id, task, lang, [{SLOTS}] AS a FROM once WHERE task IN ({_IN})),
kept AS (SELECT * FROM g WHERE len(list_filter(a, lambda x: x IS NULL OR x IN ('', '[]', '{{}}'))) <= 2)"""
VOTES = f"""{GATHERED},
ann AS (SELECT sample_id, task, lang, i AS pos, a[i] AS raw, coalesce(trim(a[i], {BLANK_SQL}), 'None') AS norm FROM kept, range(1, 6) t(i)),
cnt AS (SELECT sample_id, task, norm, count(*) AS c, min(pos) AS p, first(raw ORDER BY pos) AS raw FROM ann GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, p) AS r, count(*) OVER (PARTITION BY sample_id) AS k FROM cnt),
info AS (SELECT sample_id, task, first(raw ORDER BY r) AS majority_answer, max(c) AS top_votes, max(k) AS n_answers,
  count(*) FILTER (c >= 2) AS n_acceptable, string_agg(norm || '=' || c, ';' ORDER BY r) AS distribution,
  CASE WHEN max(c) < 3 THEN 'ambiguous' WHEN max(k) = 2 AND min(c) >= 2 THEN 'split' ELSE 'consensus' END AS agreement_level FROM rk GROUP BY ALL)"""
