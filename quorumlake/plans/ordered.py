"""Ordered state over the events table: event_id is the order, user_id the sample, some event types count as helpful."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ordered as O
from ..tables import table
from .retrieval import SCORES, _scores

EV = """ev AS (SELECT event_id AS seq, user_id AS sample_key, event_type, value, (event_type IN ('purchase', 'click', 'signup'))::INT AS helpful, 'annotator' || (1 + event_id % 3) AS agent_name, event_id % 12 AS dim, event_id % 6 AS epoch, event_id % 3 AS run FROM events)"""


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(i.alias("seq"), F.col("user_id").alias("sample_key"), "event_type", "value", F.col("event_type").isin("purchase", "click", "signup").cast("int").alias("helpful"), F.concat(F.lit("annotator"), (1 + i % 3).cast("string")).alias("agent_name"), (i % 12).alias("dim"), (i % 6).alias("epoch"), (i % 3).alias("run"))


def win01_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and counts of every sample."""
    return _scores(spark, sf_dir).select("sample_key", F.round("score", 6).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("correct_count", "incorrect_count", "usage_count")])


WIN01 = f"WITH {SCORES} SELECT sample_key, round(score, 6) AS score, correct_count, incorrect_count, usage_count FROM scored"


def agg23_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all quality scores."""
    return _scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_samples"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score"), F.sum("usage_count").alias("total_usage"), F.round(F.avg("usage_count"), 6).alias("avg_usage"))


AGG23 = f"WITH {SCORES} SELECT count(*) AS total_samples, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, sum(usage_count)::BIGINT AS total_usage, round(avg(usage_count), 6) AS avg_usage FROM scored"


def top03_best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten samples of the highest and of the lowest quality score."""
    s = _scores(spark, sf_dir).select("sample_key", F.round("score", 6).alias("score"))
    best = s.orderBy(F.desc("score"), "sample_key").limit(10).withColumn("side", F.lit("top"))
    return best.unionByName(s.orderBy("score", "sample_key").limit(10).withColumn("side", F.lit("low")))


TOP03 = f"""WITH {SCORES}, s AS (SELECT sample_key, round(score, 6) AS score FROM scored), a AS (SELECT *, 'top' AS side FROM s ORDER BY score DESC, sample_key LIMIT 10), b AS (SELECT *, 'low' AS side FROM s ORDER BY score, sample_key LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM b"""


def win03_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running success rate of each dimension at every use."""
    return O.running_rate(_ev(spark, sf_dir), "dim", "helpful").select("seq", "dim", F.round("success_rate", 6).alias("success_rate"), "total_injections")


WIN03 = f"WITH {EV} SELECT seq, dim, round(avg(helpful) OVER w, 6) AS success_rate, count(*) OVER w AS total_injections FROM ev WINDOW w AS (PARTITION BY dim ORDER BY seq ROWS UNBOUNDED PRECEDING)"


def win07_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's pool after all upserts: the last verdict on every sample."""
    last = O.last_write(_ev(spark, sf_dir).select("agent_name", "sample_key", "seq", "helpful"), ["agent_name", "sample_key"])
    return last.select("agent_name", "sample_key", "seq", (F.col("helpful") == 1).alias("is_correct"))


WIN07 = f"WITH {EV} SELECT agent_name, sample_key, max(seq) AS seq, arg_max(helpful, seq) = 1 AS is_correct FROM ev GROUP BY ALL"


def win04_ucb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample each agent would explore next: the highest upper confidence bound of quality, by its own choices so far."""
    used = _ev(spark, sf_dir).groupBy("agent_name", "sample_key").agg(F.count(F.lit(1)).alias("n"))
    total = used.groupBy("agent_name").agg(F.sum("n").alias("total"))
    bound = O.ucb(F.col("score"), F.col("n"), F.col("total"))
    rows = used.join(total, "agent_name").join(_scores(spark, sf_dir).select("sample_key", "score"), "sample_key").select("agent_name", "sample_key", F.round(bound, 6).alias("ucb"))
    best = rows.groupBy("agent_name").agg(F.max_by(F.struct("sample_key", "ucb"), F.struct("ucb", -F.col("sample_key"))).alias("b"))
    return best.select("agent_name", "b.sample_key", "b.ucb")


WIN04 = f"""WITH {SCORES.replace('ev AS', 'ev0 AS').replace('FROM ev)', 'FROM ev0)')}, {EV}, u AS (SELECT agent_name, sample_key, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT agent_name, sum(n) AS total FROM u GROUP BY ALL),
x AS (SELECT agent_name, sample_key, round(score + 2.0 * sqrt(2 * ln(total + 1) / (n + 1)), 6) AS ucb FROM u JOIN t USING (agent_name) JOIN scored USING (sample_key))
SELECT agent_name, sample_key, ucb FROM x QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY ucb DESC, sample_key) = 1"""


def win09_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events of each agent."""
    return O.recent(_ev(spark, sf_dir), "agent_name", 20).select("agent_name", "seq", "sample_key")


WIN09 = f"WITH {EV} SELECT agent_name, seq, sample_key FROM ev QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY seq DESC) <= 20"


def win10_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hill climbing by agent over rounds (epochs): a round is kept if it has no fewer right answers than the best before."""
    r = _ev(spark, sf_dir).groupBy("agent_name", "epoch").agg(F.sum("helpful").cast("long").alias("correct"))
    return O.accepted(r, ["agent_name"], "epoch", "correct")


WIN10 = f"""WITH {EV}, r AS (SELECT agent_name, epoch, sum(helpful)::BIGINT AS correct FROM ev GROUP BY ALL), b AS (SELECT *, max(correct) OVER (PARTITION BY agent_name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM r)
SELECT agent_name, epoch, correct, best_before, coalesce(correct >= best_before, true) AS kept FROM b"""


def agg30_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy of the runs of each epoch, the epoch before, and the change."""
    runs = _ev(spark, sf_dir).groupBy("epoch", "run").agg(F.avg("helpful").alias("acc")).groupBy("epoch").agg(F.avg("acc").alias("after"))
    before = F.lag("after").over(Window.partitionBy(F.lit(0)).orderBy("epoch"))  # a row per epoch
    out = runs.withColumn("before", before)
    change = F.col("after") - F.col("before")
    return out.select("epoch", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(change, 6).alias("change"), F.when(change > 0, "↑").when(change < 0, "↓").otherwise("→").alias("arrow"))


AGG30 = f"""WITH {EV}, a AS (SELECT epoch, run, avg(helpful) AS acc FROM ev GROUP BY ALL), e AS (SELECT epoch, avg(acc) AS "after" FROM a GROUP BY ALL), l AS (SELECT *, lag("after") OVER (ORDER BY epoch) AS "before" FROM e)
SELECT epoch, round("before", 6) AS "before", round("after", 6) AS "after", round("after" - "before", 6) AS change, CASE WHEN "after" > "before" THEN '↑' WHEN "after" < "before" THEN '↓' ELSE '→' END AS arrow FROM l"""


def set01_union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the first epoch, then those of the pool, each once: the earlier part has its row."""
    e = _ev(spark, sf_dir).where("helpful = 1").select("sample_key", "seq", "epoch")
    batch = e.where("epoch = 0").select("sample_key", "seq", F.lit("batch").alias("origin"))
    return O.union_first([batch, e.select("sample_key", "seq", F.lit("pool").alias("origin"))], "sample_key").select("sample_key", "seq", "origin")


SET01 = f"""WITH {EV}, u AS (SELECT 0 AS part, sample_key, seq, 'batch' AS origin FROM ev WHERE helpful = 1 AND epoch = 0 UNION ALL SELECT 1, sample_key, seq, 'pool' FROM ev WHERE helpful = 1)
SELECT sample_key, seq, origin FROM u QUALIFY row_number() OVER (PARTITION BY sample_key ORDER BY part, seq) = 1"""


def top01_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training range [100, 300) and test range [300, 1300) by position, with batches of 20."""
    placed = O.positions(_ev(spark, sf_dir).select("seq"), [F.col("seq")])
    part = F.when(F.col("pos").between(100, 299), "train").when(F.col("pos").between(300, 1299), "test")
    return placed.select("seq", F.col("pos").cast("long").alias("pos"), part.alias("part"), F.floor(F.col("pos") / 20).alias("batch")).where("part is not null")


TOP01 = f"""WITH {EV}, p AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS pos FROM ev) SELECT seq, pos, CASE WHEN pos < 300 THEN 'train' ELSE 'test' END AS part, (pos // 20)::BIGINT AS batch FROM p WHERE pos BETWEEN 100 AND 1299"""


def agg25_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dimension the samples it covers: all, right and wrong ones."""
    tags = _ev(spark, sf_dir).select("dim", "sample_key", "helpful").distinct()
    return tags.groupBy("dim").agg(F.countDistinct("sample_key").alias("total"), F.count_if(F.col("helpful") == 1).alias("correct"), F.count_if(F.col("helpful") == 0).alias("incorrect"))


AGG25 = f"WITH {EV}, t AS (SELECT DISTINCT dim, sample_key, helpful FROM ev) SELECT dim, count(DISTINCT sample_key) AS total, count(*) FILTER (helpful = 1) AS correct, count(*) FILTER (helpful = 0) AS incorrect FROM t GROUP BY dim"


def agg24_exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often samples were selected."""
    c = _ev(spark, sf_dir).groupBy("sample_key").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("total_selections"), F.count(F.lit(1)).alias("unique_samples"), F.round(F.avg("n"), 6).alias("avg_selections"), F.max("n").alias("max_selections"), F.min("n").alias("min_selections"))


AGG24 = f"WITH {EV}, c AS (SELECT sample_key, count(*) AS n FROM ev GROUP BY ALL) SELECT sum(n)::BIGINT AS total_selections, count(*) AS unique_samples, round(avg(n), 6) AS avg_selections, max(n) AS max_selections, min(n) AS min_selections FROM c"

QUERIES = {f.__name__: f for f in (win01_quality, agg23_quality_stats, top03_best_and_worst, win03_success_rate, win07_pool, win04_ucb, win09_recent, win10_accepted, agg30_epochs, set01_union_first, top01_slices, agg25_coverage, agg24_exploration)}
SQL = {"win01_quality": WIN01, "agg23_quality_stats": AGG23, "top03_best_and_worst": TOP03, "win03_success_rate": WIN03, "win07_pool": WIN07, "win04_ucb": WIN04, "win09_recent": WIN09, "win10_accepted": WIN10, "agg30_epochs": AGG30, "set01_union_first": SET01, "top01_slices": TOP01, "agg25_coverage": AGG25, "agg24_exploration": AGG24}
