"""Pools over the events table: agents and dimensions as in the ordered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pools as P
from .ordered import EV, _ev


def jn08_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each agent: right samples of its own pool, its bad cases (error events) as wrong ones."""
    ev = _ev(spark, sf_dir).withColumn("sample_key", F.col("sample_key").cast("string"))
    own = ev.groupBy("agent_name", "sample_key").agg((F.max_by("helpful", "seq") == 1).alias("is_correct"))
    system = ev.groupBy("sample_key").agg((F.max_by("helpful", "seq") == 1).alias("is_correct")).select(F.lit("system").alias("agent_name"), "sample_key", "is_correct")
    bad = ev.where("event_type = 'error' and agent_name <> 'annotator3'")
    agents = spark.createDataFrame([("annotator1",), ("annotator2",), ("annotator3",), ("verifier",)], "agent_name string")
    return P.candidates(own.unionByName(system), bad, agents).groupBy("agent_name", "is_correct").agg(F.count(F.lit(1)).alias("n"))


JN08 = f"""WITH {EV}, own AS (SELECT agent_name, sample_key, arg_max(helpful, seq) = 1 AS ok FROM ev GROUP BY ALL), sys AS (SELECT sample_key, arg_max(helpful, seq) = 1 AS ok FROM ev GROUP BY ALL),
bad AS (SELECT DISTINCT agent_name, sample_key FROM ev WHERE event_type = 'error' AND agent_name <> 'annotator3'),
c AS (SELECT agent_name, true AS is_correct, sample_key FROM own WHERE ok UNION ALL SELECT 'verifier', true, sample_key FROM sys WHERE ok UNION ALL SELECT agent_name, false, sample_key FROM bad
 UNION ALL SELECT agent_name, false, sample_key FROM own WHERE NOT ok AND agent_name NOT IN (SELECT agent_name FROM bad))
SELECT agent_name, is_correct, count(*) AS n FROM c GROUP BY ALL"""


def jn13_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tag of each sample and dimension."""
    tags = _ev(spark, sf_dir).select("sample_key", "dim", "seq", (F.col("helpful") == 1).alias("is_correct"), "agent_name")
    return P.tagged(tags)


JN13 = f"WITH {EV} SELECT sample_key, dim, max(seq) AS seq, arg_max(helpful, seq) = 1 AS is_correct, arg_max(agent_name, seq) AS agent_name FROM ev GROUP BY ALL"


def jn12_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of each sample with their rules; only even dimensions have a record."""
    ev = _ev(spark, sf_dir)
    dims = ev.where("dim % 2 = 0").select(F.col("dim").alias("name")).distinct().withColumn("meta_rule", F.concat(F.lit("rule "), F.col("name").cast("string")))
    return P.dimensions_of(ev, jn13_bridge(spark, sf_dir), dims)


JN12 = f"WITH {EV} SELECT DISTINCT sample_key, dim, CASE WHEN dim % 2 = 0 THEN 'rule ' || dim ELSE '' END AS meta_rule FROM ev"


def jn14_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples judged wrong last, with the first reason known for them."""
    ev = _ev(spark, sf_dir)
    reasons = ev.where("event_type = 'error'").select("sample_key", "seq", F.concat(F.lit("reason "), F.col("seq").cast("string")).alias("error_reason"))
    wrong = ev.groupBy("sample_key").agg(F.max_by("helpful", "seq").alias("h")).where("h = 0").select("sample_key")
    return P.with_reason(wrong, reasons)


JN14 = f"""WITH {EV}, w AS (SELECT sample_key FROM ev GROUP BY sample_key HAVING arg_max(helpful, seq) = 0), r AS (SELECT sample_key, 'reason ' || min(seq) AS error_reason FROM ev WHERE event_type = 'error' GROUP BY ALL)
SELECT sample_key, error_reason FROM w LEFT JOIN r USING (sample_key)"""


def agg27_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's failures: number, dimensions, the first five."""
    bad = _ev(spark, sf_dir).where("event_type = 'error'").select("agent_name", "seq", F.col("sample_key").cast("string").alias("sample_key"), F.lit("mislabelled").alias("error_reason"), "dim")
    return P.failures(bad)


AGG27 = f"""WITH {EV}, b AS (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY seq) AS r FROM ev WHERE event_type = 'error')
SELECT agent_name, count(*) AS n, count(DISTINCT dim) AS dims, string_agg(CASE WHEN r <= 5 THEN sample_key || ': mislabelled' END, chr(10) ORDER BY r) AS examples FROM b GROUP BY agent_name"""


QUERIES = {f.__name__: f for f in (jn08_candidates, jn12_dimensions, jn13_bridge, jn14_reasons, agg27_failures)}
SQL = {"jn08_candidates": JN08, "jn12_dimensions": JN12, "jn13_bridge": JN13, "jn14_reasons": JN14, "agg27_failures": AGG27}
