"""What runs report back, over results and events: context flags are the verdicts, examples shown are the neighbouring samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback as B
from ..operators import scoring as S
from ..operators.provider import token_report
from ..operators.similarity import cosine
from ..tables import latest, table
from .base import RESULTS, results_once
from .ordered import EV, _ev


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_once(spark, sf_dir).where("sample_id is not null and agent_name is not null")
    one = r.groupBy("sample_id", "run_no", "agent_name").agg(F.max("is_correct").alias("flag"))
    return one.groupBy("sample_id", "run_no").agg(F.map_from_entries(F.collect_list(F.struct("agent_name", "flag"))).alias("flags"), F.max("flag").alias("any"))


_FLAGS = f"{RESULTS}, one AS (SELECT sample_id, run_no, agent_name, max(is_correct::INT) AS flag FROM res WHERE sample_id IS NOT NULL AND agent_name IS NOT NULL GROUP BY ALL)"


def agg10_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per agent: rows with its flag set, all its rows, and the percentage."""
    return B.injections(_flags(spark, sf_dir), "flags")


AGG10 = f"WITH {_FLAGS} SELECT agent_name, count(*) FILTER (flag = 1) AS injected, count(*) AS total, printf('%.2f%%', count(*) FILTER (flag = 1) / count(*) * 100) AS percent FROM one GROUP BY agent_name"


def agg10b_reference_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents whose flag is set among all agents of the rows where any is."""
    return B.reference_rate(_flags(spark, sf_dir), "any", "flags")


AGG10B = f"WITH {_FLAGS}, a AS (SELECT *, max(flag) OVER (PARTITION BY sample_id, run_no) AS top FROM one) SELECT count(*) FILTER (flag = 1) AS n_references, count(*) AS n_agents, round(count(*) FILTER (flag = 1) / count(*) * 100, 1) AS percent FROM a WHERE top = 1"


def agg26_truth_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority answers of the samples that some agent got right."""
    right = results_once(spark, sf_dir).where("is_correct").select("sample_id").distinct()
    v = latest(table(spark, sf_dir, "vote_records").where("sample_id is not null"), ["sample_id"], ["computed_at"])
    return B.truth_distribution(v.join(right, "sample_id").withColumnRenamed("majority_answer", "truth"))


AGG26 = f"""WITH {RESULTS}, v AS (SELECT * FROM vote_records WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY computed_at DESC NULLS LAST) = 1)
SELECT majority_answer AS truth, count(*) AS n FROM v WHERE sample_id IN (SELECT sample_id FROM res WHERE is_correct) GROUP BY ALL"""


def win08_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and helpful uses that every event reports to the examples shown for its sample: the next two, and the one before."""
    ev = _ev(spark, sf_dir)
    k = F.col("sample_key")
    text = lambda *cs: F.array(*[c.cast("string") for c in cs])
    shown = ev.select("agent_name", "sample_key", text(k + 1, k + 2).alias("correct"), text(k - 1).alias("incorrect"), F.col("seq").alias("at"))
    out = B.feedback_events(shown, ev.select("agent_name", "sample_key", "helpful", "seq"))
    return out.groupBy("sample_key").agg(F.count(F.lit(1)).alias("n"), F.sum("helpful").cast("long").alias("n_helpful"))


WIN08 = f"WITH {EV}, s AS (SELECT helpful, unnest([sample_key + 1, sample_key + 2, sample_key - 1])::VARCHAR AS sample_key FROM ev) SELECT sample_key, count(*) AS n, sum(helpful)::BIGINT AS n_helpful FROM s GROUP BY sample_key"


def win08b_feedback_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the first example of each list only."""
    ev = _ev(spark, sf_dir)
    k = F.col("sample_key")
    text = lambda *cs: F.array(*[c.cast("string") for c in cs])
    shown = ev.select("agent_name", "sample_key", text(k + 1, k + 2).alias("correct"), text(k - 1).alias("incorrect"), F.col("seq").alias("at"))
    out = B.feedback_events(shown, ev.select("agent_name", "sample_key", "helpful", "seq"), first_only=True)
    return out.groupBy("sample_key").agg(F.count(F.lit(1)).alias("n"), F.sum("helpful").cast("long").alias("n_helpful"))


WIN08B = WIN08.replace("[sample_key + 1, sample_key + 2, sample_key - 1]", "[sample_key + 1, sample_key - 1]")


def win08b_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of the last event of each sample and agent, cut to its 100 newest entries."""
    last = _ev(spark, sf_dir).groupBy("sample_key", "agent_name").agg(F.max("seq").alias("at"))
    return B.evicted(last.select(F.concat_ws(":", "agent_name", "sample_key").alias("key"), "at"))


WIN08BE = f"""WITH {EV}, l AS (SELECT agent_name || ':' || sample_key AS key, max(seq) AS "at" FROM ev GROUP BY ALL) SELECT key, "at" FROM l ORDER BY "at" DESC, key LIMIT 100"""


def win07c_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools rebuilt from all results: the last verdict of each agent on each sample."""
    r = results_once(spark, sf_dir).where("sample_id is not null")
    return B.rebuilt_pool(r.select("agent_name", F.col("sample_id").alias("sample_key"), "is_correct", F.col("result_id").alias("seq")))


WIN07C = f"WITH {RESULTS} SELECT agent_name, sample_id AS sample_key, is_correct, result_id AS seq FROM res WHERE sample_id IS NOT NULL AND is_correct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent_name, sample_id ORDER BY result_id DESC) = 1"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ev(spark, sf_dir).groupBy("agent_name", F.col("dim").alias("item")).agg(F.round(F.avg("helpful"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


def win06_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension of the best rate of each agent."""
    return B.selected(_arms(spark, sf_dir), "agent_name", "softmax", use_sampling=False)


def win06_ucb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension of the best upper confidence bound of each agent."""
    return B.selected(_arms(spark, sf_dir), "agent_name", "ucb")


_ARMS = f"{EV}, arms AS (SELECT agent_name, dim AS item, round(avg(helpful), 6) AS score, count(*) AS n FROM ev GROUP BY ALL)"
WIN06 = f"WITH {_ARMS} SELECT agent_name, item, score, n FROM arms QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY score DESC, item) = 1"
WIN06U = f"WITH {_ARMS}, t AS (SELECT *, sum(n) OVER (PARTITION BY agent_name) AS total FROM arms) SELECT agent_name, item, score, n FROM t QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY score + 2 * sqrt(2 * ln(total + 1) / (n + 1)) DESC, item) = 1"


def set06_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of two epochs: a checkpoint that knows two agents is restored over the state of three."""
    ev = _ev(spark, sf_dir).select("agent_name", "sample_key", "epoch").distinct()
    state, saved = ev.where("epoch = 0").drop("epoch"), ev.where("epoch = 1 and agent_name <> 'annotator3'").drop("epoch")
    return B.restored({"pool": state, "scores": state}, {"pool": saved, "other": saved}, ["annotator1", "annotator2", "annotator3"])["pool"]


SET06 = f"WITH {EV} SELECT DISTINCT agent_name, sample_key FROM ev WHERE (epoch = 0 AND agent_name = 'annotator3' OR epoch = 0 AND agent_name NOT IN (SELECT agent_name FROM ev WHERE epoch = 1 AND agent_name <> 'annotator3')) OR (epoch = 1 AND agent_name <> 'annotator3')"


def agg25_sample_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of every sample."""
    return B.coverage(_ev(spark, sf_dir).select("sample_key", "dim", (F.col("helpful") == 1).alias("is_correct")))[1]


AGG25S = f"WITH {EV} SELECT sample_key, count(DISTINCT dim) AS n_dims FROM ev GROUP BY sample_key"


def agg27_dimension_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions that each agent's failures touch."""
    return B.dimension_names(_ev(spark, sf_dir).where("helpful = 0"))


AGG27N = f"WITH {EV} SELECT agent_name, string_agg(DISTINCT dim::VARCHAR, ',' ORDER BY dim::VARCHAR) AS names FROM ev WHERE helpful = 0 GROUP BY agent_name"


def agg28_verified_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each agent; the verifier's only where the sample was verified (its annotators did not agree) and one was right."""
    r = results_once(spark, sf_dir).where("is_correct is not null and sample_id is not null").select("result_id", "sample_id", "run_no", "agent_name", "is_correct")
    own = r.where("agent_name like 'annotator%'").groupBy("sample_id", "run_no").agg((F.count_distinct("is_correct") > 1).alias("was_verified"))
    rows = r.join(own, ["sample_id", "run_no"], "left").withColumn("was_verified", F.coalesce("was_verified", F.lit(False)))
    return S.error_split(rows, ["sample_id", "run_no"], verified="was_verified").groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"))


AGG28V = f"""WITH {RESULTS}, r AS (SELECT * FROM res WHERE is_correct IS NOT NULL AND sample_id IS NOT NULL),
s AS (SELECT *, max((starts_with(agent_name, 'annotator') AND is_correct)::INT) OVER w AS helped, max((starts_with(agent_name, 'annotator') AND NOT is_correct)::INT) OVER w AS wrong FROM r WINDOW w AS (PARTITION BY sample_id, run_no))
SELECT agent_name, count(*) AS n FROM s WHERE NOT is_correct AND (starts_with(agent_name, 'annotator') OR (helped = 1 AND wrong = 1)) GROUP BY ALL"""


def udf04_token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and calls by model, from the recorded prompts and answers."""
    r = results_once(spark, sf_dir).select(F.col("model_name").alias("step"), F.col("query").alias("prompt"), F.col("annotation").alias("answer"))
    return token_report(r)


UDF04 = f"""WITH {RESULTS}, t AS (SELECT model_name, CASE WHEN length(query) > 0 THEN length(query) // 4 + 1 ELSE 0 END AS i, CASE WHEN length(annotation) > 0 THEN length(annotation) // 4 + 1 ELSE 0 END AS o FROM res)
SELECT coalesce(model_name, 'total') AS step, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, count(*) AS calls FROM t GROUP BY ROLLUP (model_name)"""


def jn05b_mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of each stored vector (ids divisible by 50) to the vector of its first number and two keyword vectors."""
    e = latest(table(spark, sf_dir, "query_index").where("vec_id is not null and vec_id % 50 = 0 and size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"), ["vec_id"], ["embedded_at"])
    v = F.transform("embedding", lambda x: x.cast("double"))
    unit = lambda at: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i == at).cast("double"))
    mean = B.mean_of_texts(unit(0), F.array(unit(1), unit(2)), v, cosine)
    return e.select("vec_id", F.round(mean, 6).alias("similarity"))


JN05B = """WITH e AS (SELECT vec_id, embedding FROM query_index WHERE vec_id IS NOT NULL AND vec_id % 50 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC NULLS LAST) = 1),
n AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM e)
SELECT vec_id, round(CASE WHEN norm > 0 THEN (v[1]::DOUBLE + v[2]::DOUBLE + v[3]::DOUBLE) / norm / 3 ELSE 0 END, 6) AS similarity FROM n"""

QUERIES = {f.__name__: f for f in (agg10_injections, agg10b_reference_rate, agg26_truth_distribution, win08_feedback, win08b_feedback_first, win08b_evicted, win07c_rebuilt, win06_greedy, win06_ucb, set06_restored, agg25_sample_dimensions, agg27_dimension_names, agg28_verified_errors, udf04_token_report, jn05b_mean_similarity)}
SQL = {"agg10_injections": AGG10, "agg10b_reference_rate": AGG10B, "agg26_truth_distribution": AGG26, "win08_feedback": WIN08, "win08b_feedback_first": WIN08B, "win08b_evicted": WIN08BE, "win07c_rebuilt": WIN07C, "win06_greedy": WIN06, "win06_ucb": WIN06U, "set06_restored": SET06, "agg25_sample_dimensions": AGG25S, "agg27_dimension_names": AGG27N, "agg28_verified_errors": AGG28V, "udf04_token_report": UDF04, "jn05b_mean_similarity": JN05B}
