"""What runs report back to pools and scores: injected examples, references, rebuilt and restored pools, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import last_write, positions, ucb
from .similarity import sampled


def injections(rows: DataFrame, flags: str = "per_agent_context_injected", agent: str = "agent_name") -> DataFrame:
    """(agent, injected, total, percent) from a map of agents to whether they were shown context; null flags count as not shown.

    Rows without a map count for nobody. percent is text with two decimals.
    """
    each = rows.select(F.explode(flags).alias(agent, "shown"))
    out = each.groupBy(agent).agg(F.count_if("shown").alias("injected"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("percent", F.format_string("%.2f%%", F.col("injected") / F.col("total") * 100))


def reference_rate(rows: DataFrame, injected: str = "context_injected", references: str = "agent_sample_referenced") -> DataFrame:
    """One row (n_references, n_agents, percent): how many agents referred to the context, over rows that had any; NULL without."""
    each = rows.where(F.col(injected)).select(F.explode(references).alias("agent", "referred"))
    out = each.agg(F.count_if("referred").alias("n_references"), F.count(F.lit(1)).alias("n_agents"))
    return out.withColumn("percent", F.when(F.col("n_agents") > 0, F.round(F.col("n_references") / F.col("n_agents") * 100, 1)))


def truth_distribution(pool: DataFrame, truth: str = "truth") -> DataFrame:
    """(truth, n): how often each ground truth occurs among a pool's right samples; a null one is its own."""
    return pool.groupBy(truth).agg(F.count(F.lit(1)).alias("n"))


def feedback_events(injected: DataFrame, outcomes: DataFrame, first_only: bool = False) -> DataFrame:
    """(seq, sample_key, helpful): one event for every example that had been shown for an outcome, right ones before wrong ones.

    injected: (agent_name, sample_key, correct array<string>, incorrect array<string>, at), the last of an agent and sample
    counts; outcomes: (agent_name, sample_key, helpful, seq). first_only: of each list its first example. Outcomes without
    anything shown, and empty keys, give no event. seq numbers all events in order.
    """
    last = last_write(injected, ["agent_name", "sample_key"], "at")
    take = (lambda c: F.slice(c, 1, 1)) if first_only else (lambda c: c)
    empty = F.array().cast("array<string>")
    shown = F.concat(take(F.coalesce("correct", empty)), take(F.coalesce("incorrect", empty)))
    joined = outcomes.select("agent_name", "sample_key", "helpful", "seq").join(last, ["agent_name", "sample_key"])
    each = joined.select("seq", "helpful", F.posexplode(shown).alias("place", "key")).where("coalesce(key, '') <> ''")
    return positions(each, ["seq", "place", "key"]).select(F.col("pos").alias("seq"), F.col("key").alias("sample_key"), "helpful")


def evicted(cache: DataFrame, limit: int = 200, keep: int = 100, at: str = "at", key: str = "key") -> DataFrame:
    """The cache as it is up to `limit` entries, else its `keep` newest; equal times by key."""
    if cache.limit(limit + 1).count() <= limit:
        return cache
    return cache.orderBy(F.desc_nulls_last(at), key).limit(keep)


def rebuilt_pool(evaluations: DataFrame) -> DataFrame:
    """(agent_name, sample_key, is_correct, seq): pools from scratch, the last verdict of each agent on each sample; unjudged
    evaluations (null is_correct) are left out.
    """
    judged = evaluations.where("is_correct is not null").select("agent_name", "sample_key", "is_correct", F.col("seq").alias("at"), "seq")
    return last_write(judged, ["agent_name", "sample_key"], "at").select("agent_name", "sample_key", "is_correct", "seq")


def restored(state: dict[str, DataFrame], saved: dict[str, DataFrame], agents: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a state with those a checkpoint has in their place; it need not have all, and others it has are not taken.

    With agents, saved rows of other agents (column agent_name) are left out, and agents it does not name keep theirs.
    """
    out = dict(state)
    for name in state.keys() & saved.keys():
        new = saved[name]
        if agents is not None and "agent_name" in new.columns:
            new = new.where(F.col("agent_name").isin(*agents))
            out[name] = state[name].join(new.select("agent_name").distinct(), "agent_name", "left_anti").unionByName(new.select(*state[name].columns))
        else:
            out[name] = new
    return out


def selected(candidates: DataFrame, by: str, strategy: str = "greedy", use_sampling: bool = True, temperature: float = 1.0, seed: int = 7, score: str = "score", count: str = "n", item: str = "item") -> DataFrame:
    """One candidate of each group: the best score, a draw by softmax, or the best upper confidence bound.

    A group's only candidate, any group without sampling, and an unknown strategy take the best score; ties to the smaller item.
    """
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    if use_sampling and strategy == "softmax":
        return sampled(candidates, by, 1, temperature, seed, score, item).drop("rank")
    if use_sampling and strategy == "ucb":
        totals = candidates.groupBy(by).agg(F.sum(count).alias("_total"))
        rated = candidates.join(totals, by).withColumn("_u", ucb(F.col(score), F.col(count), F.col("_total")))
        best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_u"), item))
        return rated.withColumn("_r", best).where("_r = 1").drop("_r", "_u", "_total")
    return candidates.withColumn("_r", best).where("_r = 1").drop("_r")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in an order that depends on seed and key alone: another for each epoch, the same on any cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def coverage(bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dim, total, correct, incorrect) and (sample_key, n_dims) of tags (sample_key, dim, is_correct)."""
    per_dim = bridge.groupBy("dim").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("incorrect"))
    return per_dim, bridge.groupBy("sample_key").agg(F.count_distinct("dim").alias("n_dims"))


def dimension_names(rows: DataFrame, agent: str = "agent_name", dim: str = "dim") -> DataFrame:
    """(agent, names): the dimensions each agent's failures touch, in order, joined by a comma."""
    return rows.where(F.col(dim).isNotNull()).groupBy(agent).agg(F.array_join(F.array_sort(F.collect_set(F.col(dim).cast("string"))), ",").alias("names"))


def mean_of_texts(query: Column, keywords: Column, candidate: Column, similarity) -> Column:  # noqa: ANN001
    """The mean similarity of a candidate to a query's vector and those of its dimensions' keywords; 0 where the query has none."""
    every = F.concat(F.array(query), F.coalesce(F.filter(keywords, lambda v: v.isNotNull()), F.array().cast("array<array<double>>")))
    total = F.aggregate(F.transform(every, lambda v: similarity(v, candidate)), F.lit(0.0), lambda s, x: s + x)
    return F.when(query.isNotNull(), total / F.size(every)).otherwise(0.0)
