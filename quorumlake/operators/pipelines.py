"""Compositions: evaluation by one agent or several, with retrieval and verification; attribution of errors, induction of
dimensions, better rules, and the loops around them. Models are behind providers; every step works on whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import json_block, json_field, with_label
from ..functions.readers import document
from ..sources.files import exists
from ..tables import cut
from . import prompts as P
from . import scoring as S
from .feedback import feedback_events
from .pools import failures
from .provider import Provider, called, offline
from .similarity import nearest
from .voting import hard_vote

AGENTS = ("annotator1", "annotator2", "annotator3")


def single_agent(samples: DataFrame, rules: str, mode: str = "direct", provider: Provider = offline, examples: DataFrame | None = None) -> DataFrame:
    """samples (sample_key, task, text, all_annotations, vote_detail, agreement_level) with answer, error, label and scores."""
    rows = samples
    shown = None
    if examples is not None:
        rows = rows.join(examples, "sample_key", "left")
        shown = F.col("examples")
    rows = rows.withColumn("prompt", P.annotation_prompt(F.lit(rules), F.col("text"), F.col("task"), mode, shown))
    rows = with_label(called(rows, provider=provider), "answer", task="task")
    return S.against_all(rows)


def multi_agent(samples: DataFrame, rules: dict[str, str], providers: dict[str, Provider] | None = None, verifier: Provider = offline, context: DataFrame | None = None) -> DataFrame:
    """One row per sample: the agents' vote, the verifier's choice where they disagree, and the scores of the outcome.

    context holds (sample_key, agent_name, examples). Only samples without a unanimous vote reach the verifier.
    """
    parts = []
    for agent in AGENTS:
        rows = samples.withColumn("agent_name", F.lit(agent))
        shown = None
        if context is not None:
            rows = rows.join(context.where(F.col("agent_name") == agent).drop("agent_name"), "sample_key", "left")
            shown = F.col("examples")
        rows = rows.withColumn("prompt", P.annotation_prompt(F.lit(rules.get(agent, "")), F.col("text"), F.col("task"), "icl" if context is not None else "direct", shown))
        answered = with_label(called(rows, provider=(providers or {}).get(agent, offline)), "answer", task="task")
        parts.append(answered.select("sample_key", F.struct(F.lit(agent).alias("agent"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("answer", F.lit("")).alias("raw")).alias("a")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    votes = whole.groupBy("sample_key").agg(F.array_sort(F.collect_list("a")).alias("a")).withColumn("vote", hard_vote(F.col("a.label"), F.col("a.raw")))
    rows = samples.join(votes, "sample_key")
    agreed = rows.where("vote.is_unanimous").withColumn("final", F.col("vote.answer")).withColumn("verified", F.lit(False))
    open_ = rows.where("not vote.is_unanimous").withColumn("prompt", P.verification_prompt(F.col("text"), F.col("a.raw")))
    checked = called(open_, provider=verifier)
    checked = checked.withColumn("final", P.verified(F.col("answer"), F.col("a.raw"), F.col("vote.answer"))).withColumn("verified", F.lit(True)).drop("prompt", "answer", "error")
    return S.against_all(with_label(agreed.unionByName(checked.select(*agreed.columns)), "final", task="task"))


def optimisation_round(rows: DataFrame, keep: DataFrame, correct: str = "is_correct_hit2") -> DataFrame:
    """(n_before, n_after, better, worse, accepted): a new prompt's verdicts against the old ones', sample by sample."""
    j = keep.select("sample_key", F.col(correct).alias("old")).join(rows.select("sample_key", F.col(correct).alias("new")), "sample_key")
    s = j.agg(F.count_if("old").alias("n_before"), F.count_if("new").alias("n_after"), F.count_if(F.col("new") & ~F.col("old")).alias("better"), F.count_if(~F.col("new") & F.col("old")).alias("worse"))
    return s.withColumn("accepted", F.col("n_after") >= F.col("n_before"))


# --- retrieval


def contexts(samples: DataFrame, pool: DataFrame, k: int = 1, lo: float = 0.1, hi: float = 0.99, dims: DataFrame | None = None) -> DataFrame:
    """(sample_key, agent_name, examples, right_keys, wrong_keys): what each agent is shown for each sample.

    samples: (sample_key, embedding); pool: (agent_name, sample_key, text, label, is_correct, embedding, score), null scores
    count as 1. Of the agent's right and wrong examples the k best by similarity times score within [lo, hi) stand under their
    headings; dims (sample_key, dims as DIMENSION) add what was learned about the sample's dimensions. A sample for which
    nothing is found has no row.
    """
    asked = samples.select("sample_key", F.xxhash64("sample_key").alias("vec_id"), "embedding")
    queries = asked.select("vec_id", "embedding").dropDuplicates(["vec_id"])
    found = []
    for agent in AGENTS:
        for right in (True, False):
            mine = pool.where((F.col("agent_name") == agent) & (F.col("is_correct") == F.lit(right))).withColumn("pool_id", F.xxhash64("sample_key"))
            near = nearest(queries, mine.withColumnRenamed("pool_id", "vec_id"), k, lo, hi, weight="score")
            shown = near.join(mine.select("pool_id", F.col("sample_key").alias("key"), "text", "label").dropDuplicates(["pool_id"]), "pool_id")
            lines = P.numbered_examples(shown, "query_id", "text", "label")
            keys = shown.groupBy("query_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # k at most
            found.append(lines.join(keys, "query_id").select("query_id", F.lit(agent).alias("agent_name"), F.lit(right).alias("right"), "examples", "keys"))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    side = lambda c, right: F.max(F.when(F.col("right") == F.lit(right), F.col(c)))
    both = whole.groupBy("query_id", "agent_name").agg(P.contrastive_context(side("examples", True), side("examples", False)).alias("examples"), side("keys", True).alias("right_keys"), side("keys", False).alias("wrong_keys"))
    out = asked.select("sample_key", F.col("vec_id").alias("query_id")).distinct().join(both, "query_id").drop("query_id")
    if dims is None:
        return out
    text = F.concat_ws("\n\n", F.when(F.col("examples") != "", F.col("examples")), F.when(F.size("dims") > 0, P.dimension_framework(F.slice("dims", 1, P.DIMENSIONS))))
    return out.join(dims.select("sample_key", "dims"), "sample_key", "left").withColumn("examples", text).drop("dims")


def contrastive(samples: DataFrame, rules: dict[str, str], pool: DataFrame, providers: dict[str, Provider] | None = None, verifier: Provider = offline, dims: DataFrame | None = None, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """multi_agent() with contrasting examples and dimensions retrieved for every sample and agent; and the contexts shown."""
    shown = cut(contexts(samples, pool, k, dims=dims))
    return multi_agent(samples.drop("embedding"), rules, providers, verifier, shown.select("sample_key", "agent_name", "examples")), shown


def training_step(scored: DataFrame, shown: DataFrame, samples: DataFrame, verdict: str = "is_correct_hit2", seq: int = 0) -> tuple[DataFrame, DataFrame]:
    """What an evaluation tells pools and scores: (pool rows, feedback events).

    Every agent's pool takes the samples with the verdict on the outcome; every example shown gets an event, helpful where the
    outcome was right.
    """
    agents = F.explode(F.array(*[F.lit(a) for a in AGENTS]))
    pool = scored.select(agents.alias("agent_name"), "sample_key", F.col(verdict).alias("is_correct"), F.lit(seq).cast("long").alias("seq"))
    injected = shown.select("agent_name", "sample_key", F.col("right_keys").alias("correct"), F.col("wrong_keys").alias("incorrect"), F.lit(seq).alias("at"))
    return pool, feedback_events(injected, pool.select("agent_name", "sample_key", F.col("is_correct").cast("int").alias("helpful"), "seq"))


def full_evaluation(scored: DataFrame) -> DataFrame:
    """One row: samples, how many were verified, and the accuracies."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    verified = F.count_if("verified") if "verified" in scored.columns else F.lit(0).cast("long")
    return scored.agg(F.count(F.lit(1)).alias("total"), verified.alias("n_verified"), rate("is_correct_hit1").alias("hit1"), rate("is_correct_hit2").alias("hit2"), rate("is_correct_majority").alias("majority"))


# --- attribution, dimensions, rules


def attributed(errors: DataFrame, rules: Column, provider: Provider = offline) -> tuple[DataFrame, DataFrame]:
    """Reasons of errors (agent_name, sample_key, text, output, truth, dim, seq): bad cases, and their roll-up by agent.

    A call that fails leaves the reason NULL; the error still counts.
    """
    prompt = F.concat_ws("\n\n", F.lit(P.MODES["attribute"]), F.concat(F.lit("Rules:\n"), rules), F.concat(F.lit("Text: "), "text"), F.concat(F.lit("Answered: "), "output"), F.concat(F.lit("Right: "), "truth"))
    told = cut(called(errors.withColumn("prompt", prompt), provider=provider)).withColumn("error_reason", F.col("answer"))
    bad = told.select("sample_key", "agent_name", F.col("output").alias("error_output"), "error_reason", "seq")
    return bad, failures(told.select("agent_name", "seq", "sample_key", "error_reason", "dim"))


def inducted(triples: DataFrame, known: DataFrame, provider: Provider = offline, most: int = P.DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Dimensions out of contrasting triples (seq, sample_key, text, right, wrong), the first `most` by seq: the known ones with
    the new ones merged in, and the tags (sample_key, dim) of the samples.

    A reply names a dimension and its rule as JSON; one without a name gives nothing.
    """
    prompt = F.concat_ws("\n\n", F.lit(P.MODES["induce"]), F.concat(F.lit("Text: "), "text"), F.concat(F.lit("Like it and right: "), "right"), F.concat(F.lit("Like it and wrong: "), "wrong"), F.lit('Answer with JSON: {"name": "...", "meta_rule": "..."}'))
    told = cut(called(triples.orderBy("seq", "sample_key").limit(most).withColumn("prompt", prompt), provider=provider))
    read = told.withColumn("block", json_block(F.col("answer"))).select("sample_key", json_field(F.col("block"), "name").alias("name"), json_field(F.col("block"), "meta_rule").alias("meta_rule")).where("coalesce(name, '') <> ''")
    new = read.withColumn("evidence_count", F.lit(1).cast("long"))
    return P.merged_dimensions(known, new.select("name", "meta_rule", "evidence_count")), read.select("sample_key", F.col("name").alias("dim"))


def refined(dims: DataFrame, provider: Provider = offline) -> DataFrame:
    """dims with each rule as a reply puts it, where that is longer."""
    told = called(dims.withColumn("prompt", F.concat_ws("\n", F.lit("Put this rule more exactly, as JSON with meta_rule:"), "name", "meta_rule")), provider=provider)
    better = json_field(json_block(F.col("answer")), "meta_rule")
    return told.withColumn("meta_rule", P.merged_description(F.col("meta_rule"), better)).select(*dims.columns)


def optimised(rules: DataFrame, errors: DataFrame, dims: DataFrame, provider: Provider = offline, most: int = P.ERRORS) -> DataFrame:
    """(agent_name, rules, changed): each agent's rules as an optimiser rewrites them, from its first `most` errors (agent_name,
    seq, query, output, truth, reason) and the dimensions; as they were where it has no error, fails, or gives no document.
    """
    few = errors.withColumn("_r", F.row_number().over(Window.partitionBy("agent_name").orderBy("seq", "query"))).where(F.col("_r") <= most)
    listed = few.groupBy("agent_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "query", "output", "truth", "reason"))), lambda e: F.struct(e["query"].alias("query"), e["output"].alias("output"), e["truth"].alias("truth"), e["reason"].alias("reason"))).alias("errors"))
    known = dims.orderBy(F.desc("evidence_count"), "name").limit(P.DIMENSIONS).agg(F.collect_list(F.struct("name", "meta_rule", "rule_intent", "applicable_boundary", "decision_boundary", "evidence_count")).alias("dims"))
    asked = rules.join(listed, "agent_name").join(known, F.lit(True)).withColumn("prompt", P.optimisation_prompt(F.col("rules"), F.col("errors"), F.col("dims")))  # known: one row
    told = called(asked.select("agent_name", "prompt"), provider=provider).select("agent_name", document(F.col("answer")).alias("new"))
    return rules.join(told, "agent_name", "left").select("agent_name", F.coalesce("new", "rules").alias("rules"), F.coalesce(F.col("new") != F.col("rules"), F.lit(False)).alias("changed"))


# --- loops

Evaluate = Callable[[dict[str, str], DataFrame], DataFrame]
Improve = Callable[[dict[str, str], DataFrame], dict[str, str]]
STATE = "epoch int, step int, agent_name string, rules string, correct long, total long, no_change int"


def optimisation_loop(spark: SparkSession, samples: DataFrame, rules: dict[str, str], evaluate: Evaluate, improve: Improve, folder: str, epochs: int = 6, batch: int = 20, rounds: int = 3, patience: int | None = None, verdict: str = "is_correct_hit2") -> tuple[dict[str, str], DataFrame]:
    """Hill climbing over batches of samples: the rules at the end, and the history (STATE, one row per step and agent).

    Every epoch shuffles the samples anew and goes through them in batches; of each batch up to `rounds` new sets of rules are
    tried, and one with no fewer right answers on the batch is taken. After each epoch rules and history are written to
    `folder`; a folder that has some is resumed behind its last epoch. With patience, the loop ends after so many steps in a row
    that changed nothing.
    """
    n = samples.count()
    done, idle, best, past = -1, 0, dict(rules), []
    if exists(spark, folder):
        past = sorted(spark.read.schema(STATE).json(folder).collect(), key=lambda r: (r.epoch, r.step, r.agent_name))
        if past:
            done, idle = past[-1].epoch, past[-1].no_change
            best |= {r.agent_name: r.rules for r in past if (r.epoch, r.step) == (past[-1].epoch, past[-1].step)}
    step = past[-1].step + 1 if past else 0
    history = [tuple(r) for r in past]
    for epoch in range(done + 1, epochs):
        if patience is not None and idle >= patience:
            break
        order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(epoch), "sample_key"), "sample_key"))  # a training set of thousands at most
        numbered = cut(samples.withColumn("_b", F.floor((order - 1) / batch)))
        fresh = []
        for b in range(-(-n // batch)):
            part = numbered.where(F.col("_b") == b).drop("_b")
            held = cut(evaluate(best, part))
            right = held.where(F.col(verdict)).count()
            changed = False
            for _ in range(rounds):
                errors = held.where(~F.col(verdict))
                if errors.isEmpty():
                    break
                tried = improve(best, errors)
                if tried == best:
                    continue
                new = cut(evaluate(tried, part))
                got = new.where(F.col(verdict)).count()
                if got >= right:
                    best, held, right, changed = tried, new, got, True
            idle = 0 if changed else idle + 1
            fresh += [(epoch, step, a, best[a], right, held.count(), idle) for a in sorted(best)]
            step += 1
            if patience is not None and idle >= patience:
                break
        history += fresh
        spark.createDataFrame(fresh, STATE).coalesce(1).write.mode("append").json(folder)
    return best, spark.createDataFrame(history, STATE)


def run_tasks(spark: SparkSession, tasks: list[str], methods: dict[str, Callable[[str], DataFrame]], model_of: Callable[[str], str] = lambda t: "vision" if "image" in t else "text") -> DataFrame:
    """(task, method, model, n, error): every method on every task, one after the other; one that fails does not stop the others."""
    rows = []
    for task in tasks:
        for name, method in methods.items():
            try:
                rows.append((task, name, model_of(task), method(task).count(), None))
            except Exception as e:  # noqa: BLE001
                rows.append((task, name, model_of(task), None, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(rows, "task string, method string, model string, n long, error string")
