"""Example pools as tables: routing by agent, dimensions tagged to samples, reasons joined back, failures rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_write
from .similarity import cosine

SYSTEM_AGENTS = ("system", "verifier")


def candidates(pool: DataFrame, bad_cases: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_name, is_correct, sample_key): what each agent may be shown.

    pool holds (agent_name, sample_key, is_correct). The system and the verifier see the system's right samples, annotators
    their own; wrong examples are an agent's bad cases, or its wrong pool samples where it has no bad case.
    """
    owner = F.when(F.col("agent_name").isin(*SYSTEM_AGENTS), F.lit("system")).otherwise(F.col("agent_name"))
    who = agents.select("agent_name", owner.alias("owner")).distinct()
    right = pool.where("is_correct").select(F.col("agent_name").alias("owner"), "sample_key")
    good = who.join(right, "owner").select("agent_name", F.lit(True).alias("is_correct"), "sample_key")
    cases = bad_cases.select("agent_name", "sample_key").distinct()
    own = who.join(cases, "agent_name").select("agent_name", F.lit(False).alias("is_correct"), "sample_key")
    without = who.join(cases.select("agent_name").distinct(), "agent_name", "left_anti")
    spare = without.join(pool.where("not is_correct").select("agent_name", "sample_key"), "agent_name").select("agent_name", F.lit(False).alias("is_correct"), "sample_key")
    return good.unionByName(own).unionByName(spare).distinct()


def tagged(tags: DataFrame) -> DataFrame:
    """The bridge table (sample_key, dim, is_correct, agent_name): one row per sample and dimension, the last tag."""
    return last_write(tags, ["sample_key", "dim"])


def dimensions_of(samples: DataFrame, bridge: DataFrame, dims: DataFrame) -> DataFrame:
    """(sample_key, dim, meta_rule): the dimensions of each sample; a dimension without a record has an empty rule."""
    named = samples.select("sample_key").distinct().join(bridge.select("sample_key", "dim"), "sample_key")
    return named.join(dims.select(F.col("name").alias("dim"), "meta_rule"), "dim", "left").select("sample_key", "dim", F.coalesce("meta_rule", F.lit("")).alias("meta_rule"))


def with_reason(rows: DataFrame, reasons: DataFrame, key: str = "sample_key", order: str = "seq") -> DataFrame:
    """rows with the first error_reason known for their key."""
    first = reasons.groupBy(key).agg(F.min_by("error_reason", order).alias("error_reason"))
    return rows.join(first, key, "left")


def failures(rows: DataFrame, examples: int = 5) -> DataFrame:
    """(agent_name, n, dims, examples): an agent's failures: how many, the dimensions touched, the first few by order.

    rows holds (agent_name, seq, sample_key, error_reason, dim). Only `examples` texts per agent are gathered.
    """
    from pyspark.sql.window import Window

    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("agent_name").orderBy("seq", "sample_key"))).where(F.col("_r") <= examples)
    shown = few.groupBy("agent_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(": ", "sample_key", "error_reason").alias("t")))), lambda x: x.t), "\n").alias("examples"))
    return rows.groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dim").alias("dims")).join(shown, "agent_name")


def related(correct: Column, wrong: Column, dimension: Column, least: float = 0.5) -> Column:
    """Whether a pair has to do with a dimension: the greater similarity of its two vectors to the dimension's."""
    return F.greatest(cosine(correct, dimension), cosine(wrong, dimension)) > least
