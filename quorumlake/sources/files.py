"""Reading and writing the project's files: samples, evaluation output, bad cases, checkpoints, embeddings, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import ENTITY, sample_key
from ..operators.ordered import upsert_bad_cases
from ..operators.voting import gathered, vote_info

SLOTS = 5
# The tasks and how their queries are to be read.
TASKS = {
    "billing_scenario_classification": "text",
    "disease_privacy_assessment": "text",
    "social_text_classification": "text",
    "entity_extraction": "text",
    "image_text_relevance": "text and image",
    "image_classification": "image",
    "image_attribution_recognition": "image",
}
SAMPLE = T.StructType([T.StructField("query", T.StringType()), T.StructField("image_url", T.StringType()), *(T.StructField(f"annotation_{i}", T.StringType()) for i in range(1, SLOTS + 1))])
BAD_CASE = "sample_key string, agent_name string, error_output string, error_reason string, num_wrong long, optimize_priority double"
DIMENSIONS = "name string, meta_rule string, rule_intent string, applicable_boundary string, decision_boundary string, evidence_count long"
RESULT = "query string, annotation string, is_correct boolean, ground_truth struct<all_annotations: array<string>>"


def kind(task: str) -> str:
    """How a task's queries are read; a leading 'multi_' does not matter. ValueError for an unknown task."""
    name = task.removeprefix("multi_")
    if name not in TASKS:
        raise ValueError(f"unknown task: {task}")
    return TASKS[name]


def task_of_path(path: Column) -> Column:
    """The task whose name a file's path holds; NULL for none."""
    return F.coalesce(*[F.when(F.lower(path).contains(t), F.lit(t)) for t in TASKS])


def query_struct(how: str) -> Column:
    """struct<text, image_urls> of a sample: its text, its image, or both."""
    empty = F.array().cast("array<string>")
    if how == "image":
        return F.struct(F.lit("").alias("text"), F.array("query").alias("image_urls"))
    images = F.when(F.coalesce("image_url", F.lit("")) != "", F.array("image_url")).otherwise(empty) if how == "text and image" else empty
    return F.struct(F.col("query").alias("text"), images.alias("image_urls"))


def read_samples(spark: SparkSession, path: str, task: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """A task's samples from a JSON array (lines: an object a line): query, all_annotations, vote record and sample_key.

    Nested annotations stay JSON text. Samples with three empty slots or more are left out before the limit counts.
    """
    rows = gathered(spark.read.schema(SAMPLE).option("multiLine", not lines).json(path))
    if limit is not None:
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(limit).drop("_at")  # the first of the file
    rows = vote_info(rows.withColumn("query", query_struct(kind(task))).withColumn("task", F.lit(task.removeprefix("multi_"))))
    return rows.withColumn("sample_key", sample_key(F.col("query.text"), F.col("query.image_urls")))


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evaluation output in any of its layouts: the first run's test_results, test_results, or results. lines: a document a line."""
    item = f"array<struct<{RESULT.replace(' string', ':string').replace(' boolean', ':boolean').replace(' struct', ':struct').replace('all_annotations: ', 'all_annotations:')}>>"
    raw = spark.read.schema(f"runs array<struct<test_results:{item}>>, test_results {item}, results {item}").option("multiLine", not lines).json(path)
    first = F.get("runs", F.lit(0)).test_results
    return raw.select(F.input_file_name().alias("path"), F.posexplode(F.coalesce(first, "test_results", "results")).alias("pos", "r")).select("path", "pos", "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_bad_cases(spark: SparkSession, path: str) -> DataFrame:
    """Bad cases from JSON lines; none where the file is missing."""
    return spark.read.schema(BAD_CASE).json(path) if exists(spark, path) else spark.createDataFrame([], BAD_CASE)


def write_bad_cases(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """The bad cases with a batch (sample_key, agent_name, error_output, error_reason, seq) taken up, written back."""
    from ..tables import cut

    merged = cut(upsert_bad_cases(read_bad_cases(spark, path), batch))
    merged.write.mode("overwrite").json(f"{path}.new")  # whole before the old one goes
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)
    return merged


def read_embeddings(spark: SparkSession, path: str, key: str = "query") -> DataFrame:
    """Embeddings from JSON lines (key, embedding), keys lower-cased, the first of each kept by file and place."""
    rows = spark.read.schema(f"{key} string, embedding array<double>").json(path).where(F.col("embedding").isNotNull() & F.col(key).isNotNull())
    rows = rows.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return rows.groupBy(F.lower(key).alias(key)).agg(F.min_by("embedding", "_at").alias("embedding"))


def add_embeddings(store: DataFrame, new: DataFrame, key: str = "query") -> DataFrame:
    """The store with the new keys it does not have yet."""
    fresh = new.withColumn(key, F.lower(key)).dropDuplicates([key]).join(store.select(key), key, "left_anti")
    return store.unionByName(fresh.select(*store.columns))


def read_entity_samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """read_samples() of the entity task with entities: the annotations as arrays of (text, category), NULL for one that is none."""
    rows = read_samples(spark, path, "entity_extraction", limit)
    return rows.withColumn("entities", F.transform("all_annotations", lambda a: F.from_json(F.when(a.startswith("["), a), ENTITY)))


def read_rules(spark: SparkSession, folder: str, lang: str = "zh") -> DataFrame:
    """(path, text) of the rule document of a folder: '*rules*<lang>' first, then any .md or .txt, by name; others are not read.

    FileNotFoundError where there is none.
    """
    listed = spark.read.format("binaryFile").load(f"{folder}/*").select("path")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    order = F.when(name.rlike(rf"rules.*{lang}\.(md|txt)$"), 0).otherwise(1)
    first = listed.where(name.rlike(r"\.(md|txt)$")).orderBy(order, "path").limit(1).collect()
    if not first:
        raise FileNotFoundError(f"no rule document in {folder}")
    return spark.read.text(first[0].path, wholetext=True).select(F.lit(first[0].path).alias("path"), F.col("value").alias("text"))


def best_epoch(spark: SparkSession, paths: str, gate: bool = False) -> DataFrame:
    """(path, epoch, accuracy) of the best checkpoint among '*_epoch<n>.json'; the later file name of equals.

    With gate, no row where the best is below epoch 0 before optimisation.
    """
    acc = "struct<accuracy:double>"
    raw = spark.read.schema(f"accuracy double, full_dataset_evaluation struct<before_optimization:{acc},after_optimization:{acc}>").option("multiLine", True).json(paths).withColumn("path", F.input_file_name())
    e = raw.select("path", F.regexp_extract("path", r"_epoch(\d+)\.json$", 1).try_cast("int").alias("epoch"), F.coalesce("full_dataset_evaluation.after_optimization.accuracy", "accuracy").alias("accuracy"), F.col("full_dataset_evaluation.before_optimization.accuracy").alias("before"))
    e = e.where("epoch is not null and accuracy is not null")
    best = e.orderBy(F.desc("accuracy"), F.desc("path")).limit(1).select("path", "epoch", "accuracy")
    if gate:
        base = e.where("epoch = 0").agg(F.max("before").alias("b"))
        best = best.crossJoin(base).where("b is null or accuracy >= b").drop("b")  # one row each
    return best


def write_checkpoint(tables: dict[str, DataFrame], folder: str, task: str, epoch: int) -> None:
    """An epoch's tables (results, pool, dimensions, ...), each in its own partitioned folder."""
    for name, df in tables.items():
        df.withColumns({"task": F.lit(task), "epoch": F.lit(epoch)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task", "epoch").parquet(f"{folder}/{name}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """df with NULL for NaN, as reports are written."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON, NaN as null."""
    nan_to_null(df).coalesce(1).write.mode("overwrite").json(path)


def write_evaluation(scored: DataFrame, path: str, config: dict[str, str], by: list[str] | None = None) -> None:
    """An evaluation: its results, one row of summary with the configuration, and the stratified statistics, each in a folder."""
    from ..operators.scoring import stratified

    nan_to_null(scored).write.mode("overwrite").json(f"{path}/results")
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c.replace("is_correct", "rate"))
    settings = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(str(v))) for k, v in config.items()])) if config else F.lit(None).cast("map<string,string>")
    summary = scored.agg(F.count(F.lit(1)).alias("total"), rate("is_correct_hit1"), rate("is_correct_hit2"), rate("is_correct_majority")).withColumn("config", settings)
    write_report(summary, f"{path}/summary")
    write_report(stratified(scored.withColumn("_all", F.lit("all")), by or ["_all"]).drop("_all"), f"{path}/stratified")


def write_single_agent(runs: DataFrame, path: str, mode: str, verdict: str = "is_correct_hit2", run: str = "run_no") -> None:
    """Runs of a single agent: their results, and one document with the accuracy of each run, the mean and the population deviation."""
    nan_to_null(runs).write.mode("overwrite").partitionBy(run).json(f"{path}/runs")
    each = runs.groupBy(run).agg(F.avg(F.col(verdict).cast("double")).alias("accuracy"))
    document = each.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("num_runs"), F.transform(F.array_sort(F.collect_list(F.struct(run, "accuracy"))), lambda x: x.accuracy).alias("per_run_accuracies"), F.avg("accuracy").alias("average_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))
    write_report(document, f"{path}/summary")


def save_dimensions(dims: DataFrame, path: str) -> None:
    """The dimension table as JSON lines."""
    dims.write.mode("overwrite").json(path)


def load_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """The dimension table; an empty one where there is none."""
    return spark.read.schema(DIMENSIONS).json(path) if exists(spark, path) else spark.createDataFrame([], DIMENSIONS)


def output_name(prefix: str, mode: str, kind_: str, epoch: int | None = None) -> str:
    """A result file's name."""
    return "_".join([prefix, mode, kind_, *([f"epoch{epoch}"] if epoch is not None else [])]) + ".json"


def read_images(spark: SparkSession, paths: str) -> DataFrame:
    """(path, content, mime, data_uri) of image files."""
    from ..functions.labels import mime_type

    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    return raw.withColumn("mime", mime_type(F.col("path"))).withColumn("data_uri", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64("content")))


def merged_last(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts, each key once: the last part that has it wins."""
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = reduce(lambda a, b: a.unionByName(b), marked)
    names = [c for c in whole.columns if c not in (key, "_part")]
    return whole.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_part", *names)).alias("_r")).select(key, "_r.*")
