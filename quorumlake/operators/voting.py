"""Votes of several annotators or agents, counted within the row: no shuffle, ties to the first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import OTHER, entities, entity_key, is_empty, json_block, json_field, last_part, normalized, with_label

SLOTS = 5


def gathered(df: DataFrame, slots: int = SLOTS, max_empty: int = 2) -> DataFrame:
    """df with all_annotations, the slots as an array, without rows of more than max_empty empty slots."""
    slots_ = F.array(*[F.col(f"annotation_{i}") for i in range(1, slots + 1)])
    return df.withColumn("all_annotations", slots_).where(F.size(F.filter("all_annotations", is_empty)) <= max_empty)


def tally(labels: Column, raw: Column | None = None) -> Column:
    """array<struct<minus, pos, normalized, answer>> of the labels, most votes first, then first seen; minus is -votes."""
    raw = labels if raw is None else raw
    distinct = F.array_distinct(labels)
    return F.array_sort(F.transform(distinct, lambda x: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("minus"), F.array_position(labels, x).cast("int").alias("pos"), x.alias("normalized"), F.get(raw, F.array_position(labels, x).cast("int") - 1).alias("answer"))))


def vote_info(df: DataFrame, annotations: str = "all_annotations", ignore_missing: bool = False, min_votes: int = 2) -> DataFrame:
    """df with the vote record of its annotations.

    Columns: vote_detail (answer, normalized, n_votes in order), majority_answer, acceptable_answers (min_votes or more),
    agreement_level (consensus, split for two answers with the lesser twice or more, ambiguous below three votes), top_votes,
    n_answers. A missing annotation votes as 'None' unless ignore_missing. No annotations: no answers, ambiguous.
    """
    raw = F.col(annotations)
    if ignore_missing:
        raw = F.filter(raw, lambda a: ~is_empty(a))
    df = df.withColumn("_t", tally(F.transform(raw, normalized), raw))
    first, second = -F.get("_t", F.lit(0)).minus, -F.get("_t", F.lit(1)).minus
    n = F.size("_t")
    split = (n == 2) & (second >= 2) & (first + second == F.size(raw))
    level = F.when(F.coalesce(first, F.lit(0)) < 3, "ambiguous").when(split, "split").otherwise("consensus")
    detail = F.transform("_t", lambda t: F.struct(t.answer.alias("answer"), t.normalized.alias("normalized"), (-t.minus).alias("n_votes")))
    acceptable = F.transform(F.filter("_t", lambda t: -t.minus >= min_votes), lambda t: t.answer)
    return df.withColumns({"vote_detail": detail, "majority_answer": F.get("_t", F.lit(0)).answer, "acceptable_answers": acceptable, "agreement_level": level, "top_votes": F.coalesce(first, F.lit(0)), "n_answers": n}).drop("_t")


def hard_vote(labels: Column, raw: Column) -> Column:
    """The agents' vote: a struct of winner, its votes, total, confidence, margin, flags, number of different labels and the
    winner's raw text.

    An empty label votes, but where it wins the runner-up takes its place; with nothing but empty labels there is no
    winner, confidence 0, and the first agent's text stands.
    """
    t = tally(labels, raw)
    full = F.filter(t, lambda x: x.normalized != "")
    best, next_ = F.get(full, F.lit(0)), F.get(full, F.lit(1))
    total = F.size(labels)
    votes = F.coalesce(-best.minus, F.lit(0))
    none = F.size(full) == 0
    return F.struct(
        F.coalesce(best.normalized, F.lit("")).alias("winning_label"),
        votes.alias("winning_count"),
        total.alias("total_votes"),
        F.when(total > 0, votes / total).otherwise(0.0).alias("confidence"),
        (votes - F.coalesce(-next_.minus, F.lit(0))).alias("margin"),
        (~none & (votes == total)).alias("is_unanimous"),
        (~none & (F.size(t) == 3) & (votes == 1)).alias("is_three_way_tie"),
        F.size(F.filter(labels, lambda x: x == "")).alias("empty_results_count"),
        F.size(t).alias("num_clusters"),
        F.coalesce(best.answer, F.get(raw, F.lit(0)), F.lit("")).alias("answer"),
    )


def agent_vote(answers: DataFrame, keys: list[str], agent: str = "agent_name", annotation: str = "annotation", task: str = "task") -> DataFrame:
    """One row per keys and task with the hard vote over its agents, in order of their names.

    Entity answers vote as sets, image classifications by their three fields (an answer without JSON by its text); a missing
    answer is an empty label.
    """
    answers = with_label(answers, annotation, "_label", task=task)
    fields = F.concat_ws("|", *[F.coalesce(json_field(json_block(last_part(F.col(annotation))), k), F.lit(OTHER)) for k in ("一级品类", "二级品类", "话术分析")])
    label = F.when(F.col(task) == "entity_extraction", F.coalesce(entity_key(entities(F.col(annotation))), F.lit(""))).when((F.col(task) == "image_classification") & json_block(last_part(F.col(annotation))).isNotNull(), fields).otherwise(F.col("_label"))
    rows = answers.select(*keys, task, F.struct(F.col(agent).alias("agent"), F.coalesce(label, F.lit("")).alias("label"), F.coalesce(annotation, F.lit("")).alias("raw")).alias("a"))
    grouped = rows.groupBy(*keys, task).agg(F.array_sort(F.collect_list("a")).alias("a"))
    return grouped.withColumn("vote", hard_vote(F.col("a.label"), F.col("a.raw"))).select(*keys, task, "vote.*")


def confidence_bucket(confidence: Column, unanimous: Column) -> Column:
    """unanimous, majority (0.6 or more) or split."""
    return F.when(unanimous, "unanimous").when(confidence >= 0.6, "majority").otherwise("split")
