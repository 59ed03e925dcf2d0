"""Prompts as columns: instructions, examples, contrastive context, and what is read back out of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import json_block, json_field, last_match

# Own wording; only the shape of the expected answer matters to the readers.
FORMATS = {
    "entity_extraction": 'Answer with JSON: {"entities": [{"text": "...", "category": "..."}]}',
    "image_classification": 'Answer with JSON: {"一级品类": "...", "二级品类": "...", "话术分析": ["..."]}',
    "disease_privacy_assessment": 'Answer with JSON: {"隐私合规评估": "有" or "无", "label": "..."}',
    "image_text_relevance": 'Answer with JSON: {"label": "a grade: 0, 1, 1.5 or 2"}',
    "image_attribution_recognition": 'Answer with JSON: {"label": "0, 1 or 2"}',
    "social_text_classification": 'Answer with JSON: {"label": "a category"}',
    "billing_scenario_classification": 'Answer with JSON: {"label": "a scenario"}',
    "verification": 'Answer with JSON: {"choice": <number>}',
}
DEFAULT_FORMAT = 'Answer with JSON: {"label": "..."}'
MODES = {"direct": "Give the label at once.", "cot": "Think step by step, then give the label.", "icl": "Use the examples as a guide, then give the label.", "self_consistency": "Reason on your own, then give the label.", "verify": "Check the answers against the rules.", "optimise": "Improve the rules.", "attribute": "Name the cause of the error.", "induce": "Name what sets the examples apart."}
DIMENSIONS = 5  # dimensions shown with a sample, at most
ERRORS = 8  # errors shown to an optimiser, at most
DIMENSION = "array<struct<name: string, meta_rule: string, rule_intent: string, applicable_boundary: string, decision_boundary: string, evidence_count: long>>"


def answer_format(task: Column) -> Column:
    """The answer format a task asks for."""
    out = None
    for t, text in FORMATS.items():
        out = F.when(task == t, text) if out is None else out.when(task == t, text)
    return out.otherwise(DEFAULT_FORMAT)


def annotation_prompt(rules: Column, query: Column, task: Column, mode: str = "direct", examples: Column | None = None) -> Column:
    """Rules, instruction, examples if any, the query and the answer format."""
    parts = [rules, F.lit(MODES[mode])]
    if examples is not None:
        parts.append(examples)
    return F.array_join(F.filter(F.array(*parts, F.concat(F.lit("Text: "), query), answer_format(task)), lambda p: p.isNotNull() & (p != "")), "\n\n")


def numbered_examples(neighbours: DataFrame, by: str, text: str, label: str, sim: str = "sim", rank: str = "rank") -> DataFrame:
    """(by, examples): the neighbours of each query as a numbered list with three decimals of similarity."""
    line = F.format_string("%d. [%.3f] %s -> %s", F.col(rank), F.col(sim), F.col(text), F.col(label))
    return neighbours.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("t")))), lambda x: x.t), "\n").alias("examples"))


def quality_tag(score: Column) -> Column:
    """high above 0.7, medium above 0.4, else low."""
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def contrastive_context(right: Column, wrong: Column) -> Column:
    """Examples labelled rightly, then wrongly, each under its heading, and how to use them; '' without any."""
    part = lambda c, head: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head + "\n"), c))
    both = F.array_join(F.filter(F.array(part(right, "Labelled rightly:"), part(wrong, "Labelled wrongly:")), lambda p: p.isNotNull()), "\n\n")
    return F.when(both != "", F.concat(both, F.lit("\n\nFind what sets the two apart before you decide."))).otherwise("")


def verification_prompt(query: Column, answers: Column) -> Column:
    """The query and the agents' answers, numbered from 0, with the request to name the best one."""
    listed = F.array_join(F.transform(answers, lambda a, i: F.concat(i.cast("string"), F.lit(": "), F.coalesce(a, F.lit("")))), "\n")
    return F.concat(F.lit("Text: "), query, F.lit("\n\nAnswers:\n"), listed, F.lit('\n\nName the best one as JSON: {"choice": <number>}'))


def verified(reply: Column, answers: Column, fallback: Column) -> Column:
    """The answer a verifier's reply names by number; the fallback where it names none that exists."""
    n = json_field(json_block(reply), "choice").try_cast("int")
    return F.coalesce(F.get(answers, n), fallback)


def with_placeholders(text: Column, images: Column) -> Column:
    """The text with one <image> mark for each image; those it has already count."""
    has = F.size(F.split(text, "<image>")) - 1
    more = F.greatest(F.size(images) - has, F.lit(0))
    return F.concat(text, F.array_join(F.array_repeat(F.lit("<image>"), more), ""))


def blocks(text: Column, images: Column) -> Column:
    """array<struct<type, value>>: pieces of text and images in turn, by the text's <image> marks; empty pieces left out."""
    pieces = F.split(text, "<image>")
    pairs = F.flatten(F.transform(pieces, lambda p, i: F.array(F.struct(F.lit("text").alias("type"), p.alias("value")), F.struct(F.lit("image").alias("type"), F.when(i < F.size(pieces) - 1, F.get(images, i)).alias("value")))))
    return F.filter(pairs, lambda b: F.coalesce(b.value, F.lit("")) != "")


def merged_description(a: Column, b: Column) -> Column:
    """The longer of two descriptions, the first of equals; the other where one is missing."""
    return F.when(F.length(F.coalesce(a, F.lit(""))) >= F.length(F.coalesce(b, F.lit(""))), a).otherwise(b)


def dimension_key(name: Column) -> Column:
    """A dimension's name as it is matched: lower case, no spaces."""
    return F.regexp_replace(F.lower(name), " ", "")


def merged_dimensions(known: DataFrame, found: DataFrame) -> DataFrame:
    """(name, meta_rule, evidence_count): dimensions matched by dimension_key, the longer rule kept, evidence added up."""
    k = known.select(dimension_key(F.col("name")).alias("key"), "name", "meta_rule", "evidence_count")
    f = found.groupBy(dimension_key(F.col("name")).alias("key")).agg(F.min("name").alias("n2"), F.max_by("meta_rule", F.struct(F.length("meta_rule"), "meta_rule")).alias("r2"), F.sum("evidence_count").alias("e2"))
    j = k.join(f, "key", "full_outer")
    return j.select(F.coalesce("name", "n2").alias("name"), merged_description(F.col("meta_rule"), F.col("r2")).alias("meta_rule"), (F.coalesce("evidence_count", F.lit(0)) + F.coalesce("e2", F.lit(0))).alias("evidence_count"))


def active_dimensions(dims: DataFrame, least: int = 2) -> DataFrame:
    """Dimensions of enough evidence, most first; all of them where none has it."""
    enough = dims.where(F.col("evidence_count") >= least)
    return (dims if enough.isEmpty() else enough).orderBy(F.desc("evidence_count"), "name")


def _lines(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n")


def _told(head: str, c: Column) -> Column:
    """head and the text, NULL for an empty text."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))


def dimension_prompt(rules: Column, query: Column, context: Column, dims: Column, form: Column) -> Column:
    """Rules, the first DIMENSIONS dimensions of the sample, contrasting examples if any, the query and the answer format."""
    or_none = lambda c, text: F.coalesce(F.when(c != "", c), F.lit(text))
    item = lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d["name"], F.lit("\n   intent: "), or_none(d.rule_intent, "none yet"), F.lit("\n   decided by: "), or_none(d.decision_boundary, "none yet"), F.lit("\n   applies to: "), or_none(d.applicable_boundary, "related cases"))
    listed = F.array_join(F.transform(F.slice(dims, 1, DIMENSIONS), item), "\n")
    shown = F.when(F.size(dims) > 0, F.concat(F.lit("What to look at:\n"), listed))
    return _lines([rules, shown, F.when(F.coalesce(context, F.lit("")) != "", context), F.concat(F.lit("Text: "), query), form])


def dimension_framework(dims: Column) -> Column:
    """What was learned about the dimensions, to stand behind a prompt; '' without any. A rule that repeats the name is left out."""
    item = lambda d, i: _lines([F.concat(F.lit("Dimension "), (i + 1).cast("string"), F.lit(": "), d["name"]), F.when(d.meta_rule != d["name"], _told("- rule: ", d.meta_rule)), _told("- intent: ", d.rule_intent), _told("- applies to: ", d.applicable_boundary), _told("- decided by: ", d.decision_boundary), F.concat(F.lit("- seen in "), F.coalesce(d.evidence_count, F.lit(0)).cast("string"), F.lit(" samples"))])
    return F.when(F.size(dims) > 0, F.concat(F.lit("Before you decide, weigh these dimensions:\n"), F.array_join(F.transform(dims, item), "\n"))).otherwise("")


def dimension_listing(dims: Column) -> Column:
    """The known dimensions, numbered, with what is known of each."""
    item = lambda d, i: _lines([F.concat((i + 1).cast("string"), F.lit(". "), d["name"]), _told("   rule: ", d.meta_rule), _told("   intent: ", d.rule_intent), _told("   applies to: ", d.applicable_boundary), _told("   decided by: ", d.decision_boundary), F.concat(F.lit("   evidence: "), F.coalesce(d.evidence_count, F.lit(0)).cast("string"))])
    return F.when(F.size(dims) > 0, F.array_join(F.transform(dims, item), "\n\n")).otherwise("No dimensions are known yet.")


def error_list(errors: Column, most: int = ERRORS) -> Column:
    """The first errors array<struct<query, output, truth, reason>> as a numbered list."""
    item = lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(e.query, F.lit("")), F.lit("\n   answered: "), F.coalesce(e.output, F.lit("")), F.lit("\n   right: "), F.coalesce(e.truth, F.lit("")), F.coalesce(_told("\n   because: ", e.reason), F.lit("")))
    return F.array_join(F.transform(F.slice(errors, 1, most), item), "\n")


def optimisation_prompt(rules: Column, errors: Column, dims: Column) -> Column:
    """An agent's rules, its errors, the known dimensions, and the request for better rules within tags."""
    return F.concat_ws("\n\n", F.lit(MODES["optimise"]), F.concat(F.lit("Rules:\n"), rules), F.concat(F.lit("Errors:\n"), error_list(errors)), F.concat(F.lit("Dimensions:\n"), dimension_listing(dims)), F.lit("Give the new rules between <prompt> and </prompt>."))


def attribution_history(steps: Column) -> Column:
    """array<struct<role, content>> of a run's steps array<struct<step, response, winning_label, unanimous>>: annotators numbered
    as they come, the vote in words, the verifier; other steps are left out.
    """
    numbered = F.filter(steps, lambda s: s.step.contains("annotation"))
    annotators = F.transform(numbered, lambda s, i: F.struct(F.concat(F.lit("Annotator"), (i + 1).cast("string")).alias("role"), s.response.alias("content")))
    vote = lambda s: F.concat(F.lit("vote: "), F.coalesce(s.winning_label, F.lit("unknown")), F.when(s.unanimous, F.lit(", unanimous")).otherwise(F.lit("")))
    place = lambda s, i: F.size(F.filter(F.slice(steps, 1, i + 1), lambda x: x.step.contains("annotation")))
    each = F.transform(steps, lambda s, i: F.when(s.step.contains("annotation"), F.get(annotators, place(s, i) - 1)).when(s.step.contains("aggregation"), F.struct(F.lit("Aggregator").alias("role"), vote(s).alias("content"))).when(s.step.contains("verification"), F.struct(F.lit("Verifier").alias("role"), s.response.alias("content"))))
    return F.filter(each, lambda x: x.isNotNull())


def report_text(report: DataFrame, name: str, title: str) -> DataFrame:
    """One row (text): a report as lines, a heading and one line for each of its rows in order of `name`, numbers with four decimals."""
    numbers = [c for c, t in report.dtypes if t == "double"]
    others = [c for c in report.columns if c not in numbers and c != name]
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in others] + [F.concat(F.lit(f"{c}="), F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("-")) for c in numbers]
    lines = report.select(F.col(name).cast("string").alias("k"), F.concat_ws(" ", F.concat(F.col(name).cast("string"), F.lit(":")), *cells).alias("line"))
    return lines.agg(F.concat(F.lit(title + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x.line), "\n")).alias("text"))
