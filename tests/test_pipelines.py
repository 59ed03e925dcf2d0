import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from quorumlake.operators import feedback as B
from quorumlake.operators import pipelines as P
from quorumlake.operators import prompts
from quorumlake.operators.provider import called, http_embedder, http_provider, token_report, tracked
from quorumlake.operators.voting import vote_info
from quorumlake.sources import files

DIM = "name string, meta_rule string, rule_intent string, applicable_boundary string, decision_boundary string, evidence_count long"


def samples(spark, n=6):
    rows = [(f"s{i}", "billing", f"text {i}", ["yes"] * 3 + ["no"] * 2 if i % 2 else ["no"] * 5, [float(i == j) + 0.2 for j in range(6)]) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_key string, task string, text string, all_annotations array<string>, embedding array<double>")
    return vote_info(df)


def test_contrastive_and_training(spark):
    s = samples(spark)
    pool = spark.createDataFrame([("annotator1", "p1", "pool one", "yes", True, [1.2, 0.5, 0.3, 0.2, 0.2, 0.2], 1.0), ("annotator1", "p2", "pool two", "no", False, [0.9, 0.4, 0.2, 0.2, 0.2, 0.2], None), ("annotator2", "p1", "pool one", "yes", True, [1.2, 0.5, 0.3, 0.2, 0.2, 0.2], 1.0)], "agent_name string, sample_key string, text string, label string, is_correct boolean, embedding array<double>, score double")
    dims = spark.createDataFrame([("s0", [("tone", "rule", "intent", "", "", 2)])], f"sample_key string, dims {prompts.DIMENSION}")
    shown = {(r.sample_key, r.agent_name): r for r in P.contexts(s, pool, dims=dims).collect()}
    first = shown["s0", "annotator1"]
    assert "pool one" in first.examples and "pool two" in first.examples and "tone" in first.examples and first.right_keys == ["p1"] and first.wrong_keys == ["p2"]
    assert shown["s0", "annotator2"].wrong_keys is None and ("s0", "annotator3") not in shown


    def see(prompt):
        return '{"label": "yes"}' if "pool one" in prompt else '{"label": "no"}'

    scored, ctx = P.contrastive(s, {}, pool, {a: see for a in P.AGENTS}, lambda p: '{"choice": 0}', dims)
    scored = scored.cache()
    assert scored.count() == 6
    whole = P.full_evaluation(scored).first()
    assert whole.total == 6 and 0 < whole.n_verified <= 6
    pool_rows, events = P.training_step(scored, ctx, s)
    assert pool_rows.count() == 18
    assert events.count() == ctx.select(F.sum(F.size(F.coalesce("right_keys", F.array())) + F.size(F.coalesce("wrong_keys", F.array())))).first()[0]



def test_attribution_dimensions_rules(spark):
    errors = spark.createDataFrame([("annotator1", f"s{i}", f"text {i}", "no", "yes", "d", i) for i in range(7)] + [("annotator2", "s1", "text 1", "no", "yes", None, 1)], "agent_name string, sample_key string, text string, output string, truth string, dim string, seq long")
    bad, rolled = P.attributed(errors, F.lit("the rules"), lambda p: "reason of " + p.split("Text: ")[1].split("\n")[0])
    assert {r.error_reason for r in bad.collect()} == {f"reason of text {i}" for i in range(7)}
    assert {r.agent_name: (r.n, r.dims) for r in rolled.collect()} == {"annotator1": (7, 1), "annotator2": (1, 0)}
    known = spark.createDataFrame([("Tone", "short", 2)], "name string, meta_rule string, evidence_count long")
    triples = spark.createDataFrame([(i, f"s{i}", f"t{i}", "r", "w") for i in range(8)], "seq long, sample_key string, text string, right string, wrong string")

    def name(p):
        return '{"name": "tone", "meta_rule": "a longer rule"}' if "t1" in p else '{"name": "scope", "meta_rule": "s"}' if "t2" in p else "no json"

    dims, tags = P.inducted(triples, known, name)
    assert {r.name: (r.meta_rule, r.evidence_count) for r in dims.collect()} == {"Tone": ("a longer rule", 3), "scope": ("s", 1)}
    assert sorted(map(tuple, tags.collect())) == [("s1", "tone"), ("s2", "scope")]
    full = spark.createDataFrame([("Tone", "short", "i", "", "", 2)], DIM)
    assert P.refined(full, lambda p: '{"meta_rule": "put more exactly"}').first().meta_rule == "put more exactly"
    rules = spark.createDataFrame([("annotator1", "old"), ("annotator2", "old"), ("annotator3", "old")], "agent_name string, rules string")
    told = errors.select("agent_name", "seq", F.col("text").alias("query"), "output", "truth", F.lit("why").alias("reason"))
    got = {r.agent_name: (r.rules, r.changed) for r in P.optimised(rules, told, full, lambda p: "<prompt>new</prompt>" if "text 6" in p else "nothing").collect()}
    assert got == {"annotator1": ("new", True), "annotator2": ("old", False), "annotator3": ("old", False)}


def test_loop_resumes(spark, tmp_path):
    s = samples(spark)
    folder = str(tmp_path / "loop")
    asked = []

    def evaluate(rules, part):
        good = int(rules["a"])
        return part.withColumn("is_correct_hit2", F.substring("sample_key", 2, 3).cast("int") < good)

    def improve(rules, errors):
        asked.append(errors.count())
        return {"a": str(min(6, int(rules["a"]) + 1))}

    best, history = P.optimisation_loop(spark, s, {"a": "0"}, evaluate, improve, folder, epochs=1, batch=3, rounds=2)
    assert best == {"a": "4"} and history.count() == 2 and history.agg(F.max("no_change")).first()[0] == 0
    best, history = P.optimisation_loop(spark, s, {"a": "0"}, evaluate, improve, folder, epochs=3, batch=3, rounds=2, patience=2)
    assert best == {"a": "6"} and history.where("epoch = 0").count() == 2
    calls = len(asked)
    again, same = P.optimisation_loop(spark, s, {"a": "0"}, evaluate, improve, folder, epochs=3, batch=3, rounds=2, patience=2)
    assert again == best and len(asked) == calls and same.count() == history.count()


def test_tasks(spark):
    def fail(task):
        raise ValueError("no")

    rows = P.run_tasks(spark, ["a", "image_b"], {"good": lambda t: spark.range(3), "bad": fail}).collect()
    assert [(r.task, r.method, r.model, r.n, r.error) for r in rows] == [("a", "good", "text", 3, None), ("a", "bad", "text", None, "ValueError: no"), ("image_b", "good", "vision", 3, None), ("image_b", "bad", "vision", None, "ValueError: no")]


def test_http(spark):
    class Handler(BaseHTTPRequestHandler):
        tries = 0

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.tries += 1
            if Handler.tries == 1:
                self.send_response(500)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            if "input" in body:
                out = json.dumps({"data": [{"embedding": [1.0, 2.0]}]})
            elif body["stream"]:
                out = "".join(f'data: {json.dumps({"choices": [{"delta": {"content": c}}]})}\n' for c in ("he", "y")) + "data: [DONE]\n"
            else:
                out = json.dumps({"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]})
            self.wfile.write(out.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    df = spark.createDataFrame([("ask",)], "prompt string").coalesce(1)
    assert called(df, provider=http_provider(url, "m", "k"), wait=0.0).first().answer == "ASK"
    assert http_provider(url, "m", stream=True)("x") == "hey"
    assert http_embedder(url, "m")("x") == [1.0, 2.0]
    server.shutdown()
    failed = called(df, provider=http_provider(url, "m", timeout=1), tries=2, wait=0.0).first()
    assert failed.answer is None and failed.error
    out, record = tracked(df, "step", provider=lambda p: "yes")
    assert out.count() == 1 and {r.step for r in token_report(record).collect()} == {"step", "total"}


def test_evaluation_files(spark, tmp_path):
    scored = spark.createDataFrame([("s", 1, True, True, False, "consensus", float("nan")), ("t", 2, True, False, False, "split", 1.0)], "sample_key string, run_no long, is_correct_hit1 boolean, is_correct_hit2 boolean, is_correct_majority boolean, agreement_level string, x double")
    path = str(tmp_path / "e")
    files.write_evaluation(scored, path, {"mode": "direct"})
    summary = spark.read.json(f"{path}/summary").first()
    assert (summary.total, summary.rate_hit2, summary.config.mode) == (2, 0.5, "direct") and spark.read.json(f"{path}/stratified").count() == 3
    files.write_single_agent(scored, str(tmp_path / "r"), "cot")
    doc = spark.read.json(str(tmp_path / "r/summary")).first()
    assert (doc.num_runs, doc.per_run_accuracies, doc.average_accuracy, doc.std_accuracy) == (2, [1.0, 0.0], 0.5, 0.5)
    assert files.load_dimensions(spark, str(tmp_path / "none")).count() == 0
    dims = spark.createDataFrame([("Tone", "short", "i", None, "", 2)], DIM)
    files.save_dimensions(dims, str(tmp_path / "d"))
    assert files.load_dimensions(spark, str(tmp_path / "d")).first().evidence_count == 2


def test_entity_samples(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps([{"query": "q", **{f"annotation_{k}": [{"text": "t", "category": "c"}] for k in range(1, 6)}}]))
    assert files.read_entity_samples(spark, str(p)).first().entities[4][0].text == "t"


def test_state(spark):
    cache = spark.createDataFrame([(f"k{i:03}", i) for i in range(6)], "key string, at long")
    assert B.evicted(cache, 6, 2).count() == 6 and [r.key for r in B.evicted(cache, 5, 2).orderBy("at").collect()] == ["k004", "k005"]
    one = spark.createDataFrame([("a", "x", 0.1, 5), ("a", "y", 0.9, 50), ("b", "z", 0.0, 1)], "g string, item string, score double, n long")
    for how in ("greedy", "softmax", "ucb"):
        got = {r.g: r.item for r in B.selected(one, "g", how).collect()}
        assert got["b"] == "z" and got["a"] in ("x", "y")
    assert {r.g: r.item for r in B.selected(one, "g", "softmax", use_sampling=False).collect()} == {"a": "y", "b": "z"}
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = ([r.k for r in B.shuffled(df, "k", seed).collect()] for seed in (1, 2))
    assert sorted(a) == sorted(b) == list(range(50)) and a != b and a == [r.k for r in B.shuffled(df.repartition(7), "k", 1).collect()]
    state = {"pool": spark.createDataFrame([("a", 1), ("b", 1)], "agent_name string, n long")}
    out = B.restored(state, {"pool": spark.createDataFrame([("a", 2), ("x", 9)], "agent_name string, n long")}, ["a", "b"])
    assert sorted(map(tuple, out["pool"].collect())) == [("a", 2), ("b", 1)]
    assert B.injections(spark.createDataFrame([({"a": True, "b": None},), (None,)], "per_agent_context_injected map<string,boolean>")).count() == 2
    shown = spark.createDataFrame([("a", "s", ["c1", ""], None, 1)], "agent_name string, sample_key string, correct array<string>, incorrect array<string>, at long")
    outcome = spark.createDataFrame([("a", "s", 1, 3), ("a", "other", 1, 4)], "agent_name string, sample_key string, helpful int, seq long")
    assert [tuple(r) for r in B.feedback_events(shown, outcome).collect()] == [(0, "c1", 1)]


def test_report_text(spark):
    r = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "task string, n long, k double")
    assert prompts.report_text(r, "task", "Report").first().text == "Report\na: n=1 k=-\nb: n=2 k=0.5000"
