"""Prompts and files on written-out cases; the SQL states the results by hand."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import ordered as O
from ..operators import pools
from ..operators import prompts as P
from ..operators import similarity as S
from ..operators.provider import embedded
from ..sources import files
from ..tables import cut, shared_dir, table
from . import readers
from .ordered import AGG30, EV, _ev, agg30_epochs
from .readers import QUERIES as _Q
from .readers import SQL as _S
from .readers import cases

_known = set(_Q)


def some(c: Column) -> Column:
    """Two dimensions where c says yes, else none."""
    dims = F.array(F.struct(F.lit("tone").alias("name"), F.lit("tone").alias("meta_rule"), F.lit("be kind").alias("rule_intent"), F.lit("").alias("applicable_boundary"), F.lit("words").alias("decision_boundary"), F.lit(3).cast("long").alias("evidence_count")), F.struct(F.lit("scope").alias("name"), F.lit("all of it").alias("meta_rule"), F.lit("").alias("rule_intent"), F.lit("long texts").alias("applicable_boundary"), F.lit("").alias("decision_boundary"), F.lit(None).cast("long").alias("evidence_count")))
    return F.when(c == "yes", dims).otherwise(F.array().cast(P.DIMENSION))



cases("txt01_prompt", "The prompt of one sample.", "rules query task", "prompt", lambda r, q, t: P.annotation_prompt(r, q, t), [("R", "hello", "billing", 'R\n\nGive the label at once.\n\nText: hello\n\nAnswer with JSON: {"label": "..."}'), ("", "hello", "verification", 'Give the label at once.\n\nText: hello\n\nAnswer with JSON: {"choice": <number>}')])
cases("txt03_context", "Contrasting examples under their headings.", "right wrong", "context", P.contrastive_context, [("a", "b", "Labelled rightly:\na\n\nLabelled wrongly:\nb\n\nFind what sets the two apart before you decide."), (None, "b", "Labelled wrongly:\nb\n\nFind what sets the two apart before you decide."), ("", None, "")])
cases("txt04_dimension_prompt", "A prompt with dimensions and examples.", "rules query context has", "prompt", lambda r, q, c, h: P.dimension_prompt(r, q, c, some(h), F.lit("JSON please")), [("R", "q", "C", "yes", "R\nWhat to look at:\n1. tone\n   intent: be kind\n   decided by: words\n   applies to: related cases\n2. scope\n   intent: none yet\n   decided by: none yet\n   applies to: long texts\nC\nText: q\nJSON please"), ("R", "q", None, "no", "R\nText: q\nJSON please")])
cases("txt05_verification", "The prompt of a verifier.", "query a b", "prompt", lambda q, a, b: P.verification_prompt(q, F.array(a, b)), [("q", "x", None, 'Text: q\n\nAnswers:\n0: x\n1: \n\nName the best one as JSON: {"choice": <number>}')])
cases("txt06_framework", "What was learned about dimensions.", "has", "text", lambda h: P.dimension_framework(some(h)), [("yes", "Before you decide, weigh these dimensions:\nDimension 1: tone\n- intent: be kind\n- decided by: words\n- seen in 3 samples\nDimension 2: scope\n- rule: all of it\n- applies to: long texts\n- seen in 0 samples"), ("no", "")])
cases("txt07_listing", "The known dimensions.", "has", "text", lambda h: P.dimension_listing(some(h)), [("yes", "1. tone\n   rule: tone\n   intent: be kind\n   decided by: words\n   evidence: 3\n\n2. scope\n   rule: all of it\n   applies to: long texts\n   evidence: 0"), ("no", "No dimensions are known yet.")])
cases("txt08_optimisation", "The prompt of an optimiser.", "rules query output truth", "prompt", lambda r, q, o, t: P.optimisation_prompt(r, F.array(F.struct(q.alias("query"), o.alias("output"), t.alias("truth"), F.lit("").alias("reason"))), some(F.lit("no"))), [("R", "q", "x", "y", "Improve the rules.\n\nRules:\nR\n\nErrors:\n1. q\n   answered: x\n   right: y\n\nDimensions:\nNo dimensions are known yet.\n\nGive the new rules between <prompt> and </prompt>.")])
cases("txt09_formats", "The answer format of each task.", "task", "form", P.answer_format, [("entity_extraction", P.FORMATS["entity_extraction"]), ("image_text_relevance", 'Answer with JSON: {"label": "a grade: 0, 1, 1.5 or 2"}'), ("none of them", 'Answer with JSON: {"label": "..."}')])
_STEP = lambda step, text, label, one: F.struct(F.lit(step).alias("step"), text.alias("response"), label.alias("winning_label"), F.lit(one).alias("unanimous"))
cases("txt11_history", "A run's steps as roles and texts.", "a b v", "history", lambda a, b, v: F.array_join(F.transform(P.attribution_history(F.array(_STEP("annotation_1", a, F.lit(None).cast("string"), False), _STEP("other", a, F.lit(None).cast("string"), False), _STEP("annotation_2", b, F.lit(None).cast("string"), False), _STEP("aggregation", a, v, True), _STEP("verification", b, v, False))), lambda h: F.concat(h.role, F.lit("="), h.content)), ";"), [("x", "y", "win", "Annotator1=x;Annotator2=y;Aggregator=vote: win, unanimous;Verifier=y"), ("x", "y", None, "Annotator1=x;Annotator2=y;Aggregator=vote: unknown, unanimous;Verifier=y")])
cases("scl20_quality_tag", "A score in words.", "score", "tag", lambda s: P.quality_tag(s.cast("double")), [("0.71", "high"), ("0.7", "medium"), ("0.41", "medium"), ("0.4", "low"), (None, "low")])
cases("scl33_placeholders", "A text with a mark for each image.", "text n", "out", lambda t, n: P.with_placeholders(t, F.slice(F.array(F.lit("u"), F.lit("v"), F.lit("w")), 1, n.cast("int"))), [("a <image> b", "2", "a <image> b<image>"), ("a", "0", "a"), ("<image><image>", "1", "<image><image>")])
cases("scl36_description", "The longer of two descriptions.", "a b", "out", P.merged_description, [("long one", "short", "long one"), ("a", "b", "a"), (None, "b", "b"), ("a", None, "a")])
cases("scl32_mime", "MIME types.", "path", "mime", L.mime_type, [("a.PNG", "image/png"), ("b.gif", "image/gif"), ("c.webp", "image/webp"), ("d.jpg", "image/jpeg"), ("e", "image/jpeg")])
cases("prj10_task_of_path", "The task a path names.", "path", "task", files.task_of_path, [("/x/Multi_image_text_relevance_1.json", "image_text_relevance"), ("/x/entity_extraction/a.json", "entity_extraction"), ("/x/other.json", None)])
cases("jn03_multimodal", "Text and image similarity together.", "text image left right", "sim", lambda t, i, a, b: F.round(S.multimodal(t.cast("double"), F.array(i.cast("double")), F.when(a == "y", F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")), F.when(b == "y", F.array(F.lit("u"))).otherwise(F.array().cast("array<string>"))), 6), [("0.8", "0.4", "n", "n", 0.8), ("0.8", "0.4", "y", "n", 0.4), ("0.8", "0.4", "y", "y", 0.6)])
_V = lambda c: F.transform(F.split(c, ","), lambda x: x.cast("double"))
cases("jn11_related", "Whether a pair has to do with a dimension.", "a b d", "is_related", lambda a, b, d: pools.related(_V(a), _V(b), _V(d)), [("1,0", "0,1", "1,0.1", True), ("1,0", "-1,0", "0,1", False), ("1,1", "0,0", "1,0", True)])


def jn15_merged_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions merged with newly found ones by name, whatever its case and spaces."""
    known = spark.createDataFrame([("Tone Of Voice", "short", 2), ("Scope", "as it was", 1)], "name string, meta_rule string, evidence_count long")
    found = spark.createDataFrame([("toneofvoice", "a longer rule", 1), ("TONE of voice", "mid", 4), ("New", "r", 1)], "name string, meta_rule string, evidence_count long")
    return P.merged_dimensions(known, found)


_S["jn15_merged_dimensions"] = "SELECT * FROM (VALUES ('Tone Of Voice', 'a longer rule', 7::BIGINT), ('Scope', 'as it was', 1), ('New', 'r', 1)) t(name, meta_rule, evidence_count)"


def jn06_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every draw of two among the ten nearest: its size, its order, and that all were among the ten."""
    from .retrieval import _asked, _emb

    ten = cut(S.nearest(_asked(spark, sf_dir), _emb(spark, sf_dir), 10, hi=0.99))
    drawn = S.sampled(ten, "query_id", 2, 1.0, 7).withColumnRenamed("rank", "place")
    joined = drawn.join(ten.select("query_id", "pool_id", F.lit(True).alias("known")), ["query_id", "pool_id"], "left")
    top = lambda n: F.max(F.when(F.col("place") == n, F.col("score")))
    return joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), (top(1) >= top(2)).alias("in_order"), F.bool_and(F.coalesce("known", F.lit(False))).alias("among_ten"))


_S["jn06_drawn"] = "SELECT vec_id AS query_id, 2::BIGINT AS n, true AS in_order, true AS among_ten FROM embeddings WHERE vec_id % 50 = 0"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cases/{name}"


def src01_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's samples written as a file of the project's kind and read again: how many, with their vote records."""
    from .base import samples_once

    path = _folder(spark, "samples")
    names = ["query", "image_url", *[f"annotation_{i}" for i in range(1, 6)]]
    samples_once(spark, sf_dir).where("task = 'image_text_relevance'").select(*names).write.mode("overwrite").json(path)
    rows = files.read_samples(spark, path, "multi_image_text_relevance", lines=True)
    return rows.groupBy("agreement_level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("query.image_urls")).cast("long").alias("n_images"))


_S["src01_samples"] = """WITH once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1),
g AS (SELECT sample_id, coalesce(image_url, '') <> '' AS pic, [annotation_1, annotation_2, annotation_3, annotation_4, annotation_5] AS a FROM once WHERE task = 'image_text_relevance'),
k AS (SELECT * FROM g WHERE len(list_filter(a, lambda x: x IS NULL OR x IN ('', '[]', '{}'))) <= 2),
c AS (SELECT sample_id, any_value(pic) AS pic, norm, count(*) AS c FROM (SELECT sample_id, pic, coalesce(trim(a[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)), 'None') AS norm FROM k, range(1, 6) t(i)) GROUP BY sample_id, norm),
v AS (SELECT sample_id, bool_or(pic) AS pic, CASE WHEN max(c) < 3 THEN 'ambiguous' WHEN count(*) = 2 AND min(c) >= 2 THEN 'split' ELSE 'consensus' END AS agreement_level FROM c GROUP BY sample_id)
SELECT agreement_level, count(*) AS n, sum(pic::INT)::BIGINT AS n_images FROM v GROUP BY agreement_level"""


def src04_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written in each of the three layouts and read again: rows and right ones by layout."""
    from .base import results_once

    once = results_once(spark, sf_dir).where("task = 'entity_extraction'").select("query", "annotation", "is_correct", F.struct(F.array("annotation").alias("all_annotations")).alias("ground_truth"))
    few = once.groupBy(F.pmod(F.xxhash64("query", "annotation"), F.lit(16)).alias("_g")).agg(F.collect_list(F.struct(*once.columns)).alias("r"))
    out = None
    for name, layout in (("runs", F.array(F.struct(F.col("r").alias("test_results"))).alias("runs")), ("test_results", F.col("r").alias("test_results")), ("results", F.col("r").alias("results"))):
        few.select(layout).write.mode("overwrite").json(_folder(spark, f"results_{name}"))
        got = cut(files.read_results(spark, _folder(spark, f"results_{name}"), lines=True)).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_right")).select(F.lit(name).alias("layout"), "n", "n_right")
        out = got if out is None else out.unionByName(got)
    return out


_S["src04_results"] = """WITH res AS (SELECT * FROM results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY finished_at DESC NULLS LAST) = 1),
c AS (SELECT count(*) AS n, count(*) FILTER (is_correct) AS n_right FROM res WHERE task = 'entity_extraction') SELECT layout, n, n_right FROM c, (VALUES ('runs'), ('test_results'), ('results')) t(layout)"""


def src09_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding store read from a file, filled up with the lower-cased sample queries it lacks: size, and new ones."""
    path = _folder(spark, "embeddings")
    stored = table(spark, sf_dir, "query_index").where("query is not null and embedding is not null").select("query", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    stored.write.mode("overwrite").json(path)
    store = cut(files.read_embeddings(spark, path))
    more = embedded(table(spark, sf_dir, "samples").select("query"), store)
    return more.agg(F.count(F.lit(1)).alias("n")).join(store.agg(F.count(F.lit(1)).alias("n_stored")), F.lit(True))


_S["src09_embeddings"] = "WITH st AS (SELECT DISTINCT lower(query) AS q FROM query_index WHERE query IS NOT NULL AND embedding IS NOT NULL), al AS (SELECT q FROM st UNION SELECT lower(query) FROM samples WHERE query IS NOT NULL) SELECT (SELECT count(*) FROM al) AS n, (SELECT count(*) FROM st) AS n_stored"


def src10_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the epochs' checkpoints, written as files: the later one of equals."""
    folder = _folder(spark, "epochs")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in agg30_epochs(spark, sf_dir).select("epoch", "after").collect():  # an epoch has one file
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/t_epoch{r.epoch}.json"), True)
        out.writeBytes(json.dumps({"full_dataset_evaluation": {"after_optimization": {"accuracy": r.after}}}))
        out.close()
    return files.best_epoch(spark, f"{folder}/t_epoch*.json").select(F.col("epoch").cast("long").alias("epoch"), F.col("accuracy").alias("after"))


_S["src10_best_epoch"] = AGG30.replace("SELECT epoch, round(\"before\"", "SELECT epoch, \"after\" FROM (SELECT epoch, round(\"before\"") + ") ORDER BY \"after\" DESC, epoch DESC LIMIT 1"


def snk03_bad_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad cases (error events) of the first half of the order, updated by those of the second, with output and reason."""
    bad = _ev(spark, sf_dir).where("event_type = 'error'").select("sample_key", "agent_name", "seq", F.concat(F.lit("output "), F.col("seq").cast("string")).alias("error_output"), F.concat(F.lit("reason "), F.col("dim").cast("string")).alias("error_reason"))
    none = spark.createDataFrame([], "sample_key long, agent_name string, error_output string, error_reason string, num_wrong long, optimize_priority double")
    mid = F.lit(5000)
    return O.upsert_bad_cases(O.upsert_bad_cases(none, bad.where(F.col("seq") < mid)), bad.where(F.col("seq") >= mid))


_S["snk03_bad_cases"] = f"WITH {EV} SELECT sample_key, agent_name, 'output ' || max(seq) AS error_output, 'reason ' || arg_max(dim, seq) AS error_reason, count(*) AS num_wrong, 1.0::DOUBLE AS optimize_priority FROM ev WHERE event_type = 'error' GROUP BY ALL"

QUERIES = {k: v for k, v in _Q.items() if k not in _known} | {f.__name__: f for f in (jn15_merged_dimensions, jn06_drawn, src01_samples, src04_results, src09_embeddings, src10_best_epoch, snk03_bad_cases)}
SQL = {k: _S[k] for k in QUERIES if k in _S}
assert readers.QUERIES is _Q
