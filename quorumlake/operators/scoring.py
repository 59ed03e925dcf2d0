"""Scoring model answers against several annotators, and the accuracy reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

Scorer = Callable[[Column, Column], Column]


def by_label(pred: Column, answer: Column) -> Column:
    """Category tasks: flexible text match."""
    return L.matches(pred, answer)


def by_score(pred: Column, answer: Column) -> Column:
    """Graded tasks: equal numbers; an answer without a number is never right."""
    return F.coalesce(L.score_metric(pred) == L.score_metric(answer), F.lit(False))


def by_entities(pred: Column, answer: Column) -> Column:
    """Entity tasks: as many entities, each predicted one among the answers."""
    return L.entities_match(L.entities(pred), L.entities(answer))


def by_fields(pred: Column, answer: Column) -> Column:
    """Image classification: both categories and the orientations agree, numbers before labels left out."""
    same = F.lit(True)
    for key in ("一级品类", "二级品类", "话术分析"):
        read = L.guidance if key == "话术分析" else L.without_number
        a, b = (read(F.coalesce(L.json_field(L.json_block(L.last_part(c)), key), F.lit(L.OTHER))) for c in (pred, answer))
        same = same & (a == b)
    return F.coalesce(same, F.lit(False))


SCORERS: dict[str, Scorer] = {
    "billing_scenario_classification": by_label,
    "disease_privacy_assessment": by_label,
    "social_text_classification": by_label,
    "image_text_relevance": by_score,
    "image_attribution_recognition": by_score,
    "entity_extraction": by_entities,
    "image_classification": by_fields,
}


def correct(pred: Column, answer: Column, task: Column, scorers: dict[str, Scorer] | None = None) -> Column:
    """Whether a prediction is right for one answer, by the task's scorer; an unknown task matches by label."""
    out = None
    for name, f in (scorers or SCORERS).items():
        out = F.when(task == name, f(pred, answer)) if out is None else out.when(task == name, f(pred, answer))
    return out.otherwise(by_label(pred, answer)) if out is not None else by_label(pred, answer)


def prepared(c: Column, task: Column) -> Column:
    """What an answer says, in the form its task compares: a struct of text, number, entities and fields, of which one is set."""
    kind = lambda f: task.isin(*[t for t, g in SCORERS.items() if g is f])
    read = lambda block: F.array(*[L.bound(F.coalesce(L.json_field(block, k), F.lit(L.OTHER)), L.guidance if k == "话术分析" else L.without_number) for k in ("一级品类", "二级品类", "话术分析")])
    fields = L.bound(F.when(c.contains("{"), L.bound(L.last_part(c), L.json_block)), read)
    other = ~(kind(by_score) | kind(by_entities) | kind(by_fields))
    return F.struct(F.when(other, L.tidy(c)).alias("text"), F.when(kind(by_score), L.score_metric(c)).alias("number"), F.when(kind(by_entities), L.entities(c)).alias("entities"), F.when(kind(by_fields) & c.isNotNull(), fields).alias("fields"))


def same(pred: Column, answer: Column, empty: Column) -> Column:
    """Whether two prepared() answers of a task agree; empty: whether the predicted text is."""
    text = ~empty & ((pred.text == answer.text) | answer.text.contains(pred.text) | pred.text.contains(answer.text))
    return F.coalesce(text, pred.number == answer.number, F.when(pred.entities.isNotNull() & answer.entities.isNotNull(), L.entities_match(pred.entities, answer.entities)), pred.fields == answer.fields, F.lit(False))


def against_all(df: DataFrame, pred: str = "label", annotations: str = "all_annotations", detail: str = "vote_detail", task: str = "task", scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """df with match_count, hit_rate, is_correct_hit1, is_correct_hit2 and is_correct_majority (any of the top answers).

    Prediction and answers are each read once, in columns of their own, and then compared. Scorers of one's own (task to a
    function of prediction and answer) are called for every pair instead.
    """
    n = F.size(annotations)
    top = F.get(detail, F.lit(0)).n_votes
    leading = F.transform(F.filter(detail, lambda d: d.n_votes == top), lambda d: d.answer)
    if scorers is None:
        df = df.withColumns({"_p": prepared(F.col(pred), F.col(task)), "_a": F.transform(F.filter(annotations, lambda a: a.isNotNull()), lambda a: prepared(a, F.col(task))), "_t": F.transform(F.filter(leading, lambda a: a.isNotNull()), lambda a: prepared(a, F.col(task))), "_e": F.coalesce(F.col(pred) == "", F.lit(True))})
        df = df.withColumns({"match_count": F.size(F.filter("_a", lambda a: same(F.col("_p"), a, F.col("_e")))), "is_correct_majority": F.exists("_t", lambda a: same(F.col("_p"), a, F.col("_e")))}).drop("_p", "_a", "_t", "_e")
    else:
        ok = lambda a: correct(F.col(pred), a, F.col(task), scorers)
        df = df.withColumns({"match_count": F.size(F.filter(annotations, lambda a: a.isNotNull() & ok(a))), "is_correct_majority": F.exists(leading, lambda a: a.isNotNull() & ok(a))})
    return df.withColumns({"hit_rate": F.when(n > 0, F.col("match_count") / n).otherwise(0.0), "is_correct_hit1": F.col("match_count") >= 1, "is_correct_hit2": F.col("match_count") >= 2, "is_correct_majority": F.coalesce("is_correct_majority", F.lit(False))})


def stratified(scored: DataFrame, by: list[str], level: str = "agreement_level") -> DataFrame:
    """Counts and accuracies per group and agreement level, and over all levels ('overall')."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if("is_correct_hit2").alias("hit2"), F.count_if("is_correct_hit1").alias("hit1"), F.count_if("is_correct_majority").alias("majority"), rate("is_correct_hit2").alias("hit2_rate"), rate("is_correct_hit1").alias("hit1_rate"), rate("is_correct_majority").alias("majority_rate")]
    return scored.groupingSets([[F.col(c) for c in (*by, level)], [F.col(c) for c in by]], *by, level).agg(*aggs).withColumn(level, F.coalesce(level, F.lit("overall")))


def error_split(rows: DataFrame, keys: list[str], agent: str = "agent_name", right: str = "is_correct", verified: str | None = None) -> DataFrame:
    """The wrong answers that count against their agent: annotators' always, the verifier's where some annotator was right
    (and, with a column `verified`, the sample was verified at all).
    """
    some = F.max(F.when(F.col(agent).startswith("annotator") & F.col(right), 1).otherwise(0)).alias("_some")
    joined = rows.join(rows.groupBy(*keys).agg(some), keys)
    asked = F.col(verified) if verified else F.lit(True)
    return joined.where((F.col(right) == F.lit(False)) & (F.col(agent).startswith("annotator") | ((F.col("_some") == 1) & asked))).drop("_some")
