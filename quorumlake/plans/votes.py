"""Votes of annotators and agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import voting as V
from .base import BLANK_SQL, RESULTS, VOTES, labelled, results_once, samples_once

BIG = "long"


def agg01_vote_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote record of every single-label sample."""
    v = V.vote_info(labelled(spark, sf_dir))
    text = F.array_join(F.transform("vote_detail", lambda d: F.concat(d.normalized, F.lit("="), d.n_votes.cast("string"))), ";")
    return v.select("sample_id", "task", "majority_answer", F.col("top_votes").cast(BIG).alias("top_votes"), F.col("n_answers").cast(BIG).alias("n_answers"), F.size("acceptable_answers").cast(BIG).alias("n_acceptable"), text.alias("distribution"), "agreement_level")


AGG01 = f"WITH {VOTES} SELECT sample_id, task, majority_answer, top_votes, n_answers, n_acceptable, distribution, agreement_level FROM info"


def agg29_agreement_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of samples with all five, three or four, and fewer equal votes, per task."""
    v = V.vote_info(labelled(spark, sf_dir))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    top = F.col("top_votes")
    return v.groupBy("task").agg(F.count(F.lit(1)).alias("n"), share(top == 5).alias("full_share"), share((top >= 3) & (top < 5)).alias("majority_share"), share(top < 3).alias("none_share"))


AGG29 = f"""WITH {VOTES} SELECT task, count(*) AS n, round(avg((top_votes = 5)::INT::DOUBLE), 6) AS full_share,
round(avg((top_votes BETWEEN 3 AND 4)::INT::DOUBLE), 6) AS majority_share, round(avg((top_votes < 3)::INT::DOUBLE), 6) AS none_share FROM info GROUP BY task"""


def prj01_empty_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per task and number of empty annotation slots."""
    slots = F.array(*[F.col(f"annotation_{i}") for i in range(1, 6)])
    return samples_once(spark, sf_dir).where("task is not null").groupBy("task", F.size(F.filter(slots, L.is_empty)).cast(BIG).alias("empty_slots")).agg(F.count(F.lit(1)).alias("n"))


PRJ01 = """WITH once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1)
SELECT task, len(list_filter([annotation_1, annotation_2, annotation_3, annotation_4, annotation_5], lambda x: x IS NULL OR x IN ('', '[]', '{}'))) AS empty_slots, count(*) AS n FROM once WHERE task IS NOT NULL GROUP BY ALL"""


def agg21_category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each label as written (stripped) occurs, per task."""
    rows = labelled(spark, sf_dir).select("task", F.explode("all_annotations").alias("raw")).where("raw is not null")
    return rows.groupBy("task", L.strip(F.col("raw")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


AGG21 = f"WITH {VOTES} SELECT task, trim(raw, {BLANK_SQL}) AS label, count(*) AS n FROM ann WHERE raw IS NOT NULL GROUP BY ALL"


def agg02_hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote of the agents on each sample and run, on answers that are plain labels."""
    r = results_once(spark, sf_dir).where("agent_name like 'annotator%' and sample_id is not null")
    last = r.groupBy("sample_id", "task", "run_no", "agent_name").agg(F.max_by("annotation", "result_id").alias("annotation"))
    a = last.select("sample_id", "task", "run_no", F.struct("agent_name", L.strip(F.coalesce("annotation", F.lit(""))).alias("label")).alias("a")).groupBy("sample_id", "task", "run_no").agg(F.array_sort(F.collect_list("a")).alias("a"))
    v = a.withColumn("v", V.hard_vote(F.col("a.label"), F.col("a.label"))).select("sample_id", "task", "run_no", "v.*")
    return v.select("sample_id", "task", "run_no", "winning_label", *[F.col(c).cast(BIG).alias(c) for c in ("winning_count", "total_votes", "margin", "empty_results_count")], F.round("confidence", 6).alias("confidence"), "is_unanimous", "is_three_way_tie")


HARD = f"""{RESULTS},
last AS (SELECT sample_id, task, run_no, agent_name, trim(coalesce(arg_max(coalesce(annotation, ''), result_id), ''), {BLANK_SQL}) AS label FROM res WHERE agent_name LIKE 'annotator%' AND sample_id IS NOT NULL GROUP BY sample_id, task, run_no, agent_name),
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, task, run_no ORDER BY agent_name) AS pos FROM last),
c AS (SELECT sample_id, task, run_no, label, count(*) AS c, min(pos) AS p FROM o GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY sample_id, task, run_no ORDER BY (label = ''), c DESC, p) AS r, count(*) OVER (PARTITION BY sample_id, task, run_no) AS k, sum(c) OVER (PARTITION BY sample_id, task, run_no) AS total FROM c),
vote AS (SELECT sample_id, task, run_no, max(CASE WHEN r = 1 THEN label END) AS winning_label, coalesce(max(CASE WHEN r = 1 AND label <> '' THEN c END), 0) AS winning_count, max(total)::BIGINT AS total_votes,
 coalesce(max(CASE WHEN r = 1 AND label <> '' THEN c END), 0) - coalesce(max(CASE WHEN r = 2 AND label <> '' THEN c END), 0) AS margin, coalesce(max(CASE WHEN label = '' THEN c END), 0) AS empty_results_count, max(k) AS k FROM f GROUP BY ALL)"""
AGG02 = f"""WITH {HARD} SELECT sample_id, task, run_no, winning_label, winning_count, total_votes, margin, empty_results_count, round(winning_count / total_votes, 6) AS confidence,
winning_count > 0 AND winning_count = total_votes AS is_unanimous, k = 3 AND winning_count = 1 AS is_three_way_tie FROM vote"""


def agg09_confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes per task and bucket of confidence."""
    v = agg02_hard_vote(spark, sf_dir)
    return v.groupBy("task", V.confidence_bucket(F.col("confidence"), F.col("is_unanimous")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


AGG09 = f"""WITH {HARD} SELECT task, CASE WHEN winning_count > 0 AND winning_count = total_votes THEN 'unanimous' WHEN round(winning_count / total_votes, 6) >= 0.6 THEN 'majority' ELSE 'split' END AS bucket, count(*) AS n FROM vote GROUP BY ALL"""


def agg02_agent_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote of the agents on each sample and run, on the labels read out of their answers, the last of each agent."""
    r = results_once(spark, sf_dir).where("agent_name like 'annotator%' and sample_id is not null")
    last = r.groupBy("sample_id", "task", "run_no", "agent_name").agg(F.max_by("annotation", "result_id").alias("annotation"))
    v = V.agent_vote(last, ["sample_id", "run_no"])
    return v.select("sample_id", "run_no", "task", "winning_label", *[F.col(c).cast(BIG).alias(c) for c in ("winning_count", "total_votes", "margin", "empty_results_count", "num_clusters")], F.round("confidence", 6).alias("confidence"), "is_unanimous", "is_three_way_tie", "answer")


QUERIES = {f.__name__: f for f in (agg01_vote_info, agg29_agreement_profile, prj01_empty_slots, agg21_category_distribution, agg02_hard_vote, agg09_confidence_buckets, agg02_agent_vote)}
SQL = {"agg01_vote_info": AGG01, "agg29_agreement_profile": AGG29, "prj01_empty_slots": PRJ01, "agg21_category_distribution": AGG21, "agg02_hard_vote": AGG02, "agg09_confidence_buckets": AGG09}
