import json

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import readers
from quorumlake.operators import pipelines, prompts
from quorumlake.operators.provider import called, embedded, joined, stream_deltas, token_report
from quorumlake.sources import files
from quorumlake.streaming.votes import vote_counts


def test_samples(spark, tmp_path):
    rows = [{"query": f"q{i}", "image_url": "a.png", **{f"annotation_{k}": "x" for k in range(1, 6)}} for i in range(4)]
    rows[1] |= {"annotation_1": None, "annotation_2": "", "annotation_3": None}
    rows[2]["annotation_1"] = [{"text": "t", "category": "c"}]
    p = tmp_path / "s.json"
    p.write_text(json.dumps(rows))
    got = files.read_samples(spark, str(p), "multi_image_text_relevance").collect()
    assert [r.query.text for r in got] == ["q0", "q2", "q3"] and got[0].query.image_urls == ["a.png"] and got[0].sample_key == "q0||a.png"
    assert files.read_samples(spark, str(p), "image_classification", 2).count() == 2
    assert json.loads(files.read_samples(spark, str(p), "entity_extraction").where("query.text = 'q2'").first().all_annotations[0]) == [{"text": "t", "category": "c"}]
    with pytest.raises(ValueError):
        files.kind("other")


@pytest.mark.parametrize("layout", [lambda r: {"runs": [{"test_results": r}]}, lambda r: {"test_results": r}, lambda r: {"results": r}])
def test_results(spark, tmp_path, layout):
    p = tmp_path / "r.json"
    p.write_text(json.dumps(layout([{"query": "q", "annotation": "a", "is_correct": True, "ground_truth": {"all_annotations": ["a", None]}}])))
    r = files.read_results(spark, str(p)).first()
    assert (r.query, r.is_correct, r.ground_truth.all_annotations) == ("q", True, ["a", None])


def test_bad_cases_and_embeddings(spark, tmp_path):
    path = str(tmp_path / "bad")
    batch = spark.createDataFrame([("s", "a", "x", "r", 1)], "sample_key string, agent_name string, error_output string, error_reason string, seq long")
    assert files.read_bad_cases(spark, path).count() == 0
    files.write_bad_cases(spark, path, batch)
    files.write_bad_cases(spark, path, batch)
    assert files.read_bad_cases(spark, path).first().num_wrong == 2
    e = tmp_path / "e.jsonl"
    e.write_text('{"query": "A", "embedding": [1.0]}\n{"query": "a", "embedding": [2.0]}\n{"query": "b"}\n')
    store = files.read_embeddings(spark, str(e))
    assert [tuple(r) for r in store.collect()] == [("a", [1.0])]
    more = embedded(spark.createDataFrame([("A",), ("C",), ("c",), (None,)], "query string"), store)
    assert sorted(r.query for r in more.collect()) == ["a", "c"]
    assert files.add_embeddings(store, spark.createDataFrame([("A", [9.0]), ("Z", [3.0])], "query string, embedding array<double>")).count() == 2


def test_checkpoints(spark, tmp_path):
    for n, acc in ((0, 0.5), (1, 0.7), (2, 0.7)):
        (tmp_path / f"t_epoch{n}.json").write_text(json.dumps({"full_dataset_evaluation": {"before_optimization": {"accuracy": 0.9}, "after_optimization": {"accuracy": acc}}}))
    best = files.best_epoch(spark, str(tmp_path / "t_epoch*.json"))
    assert best.first().epoch == 2
    assert files.best_epoch(spark, str(tmp_path / "t_epoch*.json"), gate=True).count() == 0
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/x_rules_zh.md").write_text("zh")
    (tmp_path / "rules/a.txt").write_text("other")
    assert files.read_rules(spark, str(tmp_path / "rules")).first().text == "zh"
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in files.nan_to_null(df).collect()] == [None, 1.0]
    files.write_checkpoint({"pool": df}, str(tmp_path / "ck"), "t", 3)
    assert spark.read.parquet(str(tmp_path / "ck/pool")).where("task = 't' and epoch = 3").count() == 2
    assert files.output_name("p", "test", "icl", 2) == "p_test_icl_epoch2.json"
    last = files.merged_last([spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string")], "k")
    assert sorted(tuple(r) for r in last.collect()) == [(1, "b"), (2, "c")]


def test_provider(spark):
    def flaky(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper()

    got = {r.prompt: r for r in called(spark.createDataFrame([("a",), ("bad",)], "prompt string"), provider=flaky, tries=2, wait=0).collect()}
    assert got["a"].answer == "A" and got["bad"].answer is None and "down" in got["bad"].error
    lines = ['data: {"choices": [{"delta": {"content": "he"}}]}', "", 'data: {"choices": [{"delta": {"content": "y"}, "finish_reason": "stop"}]}', 'data: {"choices": [{"delta": {"content": "no"}}]}']
    assert joined(stream_deltas(iter(lines))) == "hey"
    t = token_report(spark.createDataFrame([("s", "abcd", "")], "step string, prompt string, answer string")).collect()
    assert {r.step: (r.input, r.output, r.calls) for r in t} == {"s": (2, 0, 1), "total": (2, 0, 1)}


def test_prompts(spark):
    df = spark.createDataFrame([("look <image> here", ["u", "v"], 'x {"choice": 1}', ["a0", "a1"], "<prompt>New Rules</prompt>")], "t string, i array<string>, reply string, answers array<string>, opt string")
    r = df.select(prompts.with_placeholders(F.col("t"), F.col("i")).alias("p"), prompts.blocks(F.col("t"), F.col("i")).alias("b"), prompts.verified(F.col("reply"), F.col("answers"), F.lit("f")).alias("v"), readers.document(F.col("opt")).alias("o"), prompts.contrastive_context(F.lit("1"), F.lit(None)).alias("c")).first()
    assert r.p == "look <image> here<image>" and [(b.type, b.value) for b in r.b] == [("text", "look "), ("image", "u"), ("text", " here")]
    assert r.v == "a1" and r.o == "New Rules" and r.c.startswith("Labelled rightly:\n1")
    known = spark.createDataFrame([("Tone Of Voice", "short", 2)], "name string, meta_rule string, evidence_count long")
    found = spark.createDataFrame([("toneofvoice", "a longer rule", 1), ("New", "r", 1)], "name string, meta_rule string, evidence_count long")
    got = {r.name: (r.meta_rule, r.evidence_count) for r in prompts.merged_dimensions(known, found).collect()}
    assert got == {"Tone Of Voice": ("a longer rule", 3), "New": ("r", 1)}
    assert [r.name for r in prompts.active_dimensions(known.unionByName(found)).collect()] == ["Tone Of Voice"]


def test_pipelines(spark):
    from quorumlake.operators.voting import vote_info

    s = vote_info(spark.createDataFrame([("k1", "social_text_classification", "t1", ["A", "A", "A", "B", "B"]), ("k2", "social_text_classification", "t2", ["B"] * 5)], "sample_key string, task string, text string, all_annotations array<string>"))
    one = pipelines.single_agent(s, "rules", provider=lambda p: '{"label": "A"}')
    assert {r.sample_key: r.match_count for r in one.collect()} == {"k1": 3, "k2": 0}
    providers = {"annotator1": lambda p: '{"label": "A"}', "annotator2": lambda p: '{"label": "B"}', "annotator3": lambda p: '{"label": "B"}'}
    many = pipelines.multi_agent(s, {}, providers, verifier=lambda p: '{"choice": 0}')
    assert {r.sample_key: (r.label, r.verified) for r in many.collect()} == {"k1": ("A", True), "k2": ("A", True)}
    assert pipelines.optimisation_round(many, one).first().accepted


def test_streamed_votes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", "a"), (1, "t", "a"), (2, "t", "b")], "ann_id long, task string, label string").withColumn("submitted_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = vote_counts(stream).writeStream.format("memory").queryName("votes").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.label, r.n) for r in spark.table("votes").collect()}
    assert got == {("a", 1), ("b", 1)} == {(r.label, r.n) for r in vote_counts(rows).collect()}


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q), set(s) - set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
