"""Similarity retrieval over the embeddings table: queries are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import similarity as S
from ..tables import table
from .base import SLOTS  # noqa: F401


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb(spark, sf_dir).where("vec_id % 50 = 0")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "pool_id", "sim", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


PAIRS = """sims AS (SELECT q.vec_id AS query_id, p.vec_id AS pool_id, p.label, q.label AS q_label, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS sim
FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0)"""


def _top(where: str, score: str, k: int, extra: str = "") -> str:
    return f"""WITH {PAIRS}{extra}, r AS (SELECT query_id, pool_id, sim, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, pool_id) AS rank FROM sims {where})
SELECT query_id, pool_id, sim, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


def jn04_icl_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows below a similarity of 0.99."""
    return _out(S.nearest(_asked(spark, sf_dir), _emb(spark, sf_dir), 5, hi=0.99))


JN04 = _top("WHERE sim < 0.99", "sim", 5)

SCORES = """ev AS (SELECT event_id AS seq, user_id AS sample_key, (event_type IN ('purchase', 'click', 'signup'))::INT AS helpful FROM events),
g AS (SELECT *, coalesce(sum(helpful) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE / nullif(count(*) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.5) AS g FROM ev),
scored AS (SELECT sample_key, list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN helpful = 1 THEN 0.1 * (1 - g) ELSE -0.1 * g END ORDER BY seq)), lambda s, x: least(2.0, greatest(0.0, s + x))) AS score,
 sum(helpful)::BIGINT AS correct_count, (count(*) - sum(helpful))::BIGINT AS incorrect_count, count(*) AS usage_count FROM g GROUP BY sample_key)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("sample_key"), F.col("event_type").isin("purchase", "click", "signup").cast("int").alias("helpful"))
    return O.quality_scores(ev)


def jn05_weighted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best rows with 0.1 <= similarity < 0.99 by similarity times quality score (1 where a row has none)."""
    pool = _emb(spark, sf_dir).join(_scores(spark, sf_dir).select(F.col("sample_key").alias("vec_id"), "score"), "vec_id", "left")
    return _out(S.nearest(_asked(spark, sf_dir), pool, 2, lo=0.1, hi=0.99, weight="score"))


JN05 = _top("LEFT JOIN scored ON scored.sample_key = sims.pool_id WHERE sim >= 0.1 AND sim < 0.99", "(sim * coalesce(score, 1.0))", 2, f", {SCORES}")


def jn07_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best weighted match."""
    pool = _emb(spark, sf_dir).join(_scores(spark, sf_dir).select(F.col("sample_key").alias("vec_id"), "score"), "vec_id", "left")
    return _out(S.nearest(_asked(spark, sf_dir), pool, 1, weight="score"))


JN07 = _top("LEFT JOIN scored ON scored.sample_key = sims.pool_id", "(sim * coalesce(score, 1.0))", 1, f", {SCORES}")


def jn09_contrastive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error (odd label) among the queries with its two best correct rows (even label), 0.1 < similarity < 0.99."""
    found = S.nearest(_asked(spark, sf_dir).where("label % 2 = 1"), _emb(spark, sf_dir).where("label % 2 = 0"), 2, lo=0.1, hi=0.99, lo_inclusive=False)
    return S.contrastive(found).select("query_id", "first", "second", F.round("sim", 6).alias("sim"))


JN09 = f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pool_id) AS k FROM sims WHERE q_label % 2 = 1 AND label % 2 = 0 AND sim > 0.1 AND sim < 0.99)
SELECT query_id, max(CASE WHEN k = 1 THEN pool_id END) AS "first", max(CASE WHEN k = 2 THEN pool_id END) AS "second", round(avg(sim), 6) AS sim FROM r WHERE k <= 2 GROUP BY query_id"""


def jn10_pairs_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failure with up to two correct rows of similarity 0.4 or more and below 0.99; without any, NULL and 0."""
    errors = _asked(spark, sf_dir).where("label % 2 = 1")
    found = S.nearest(errors, _emb(spark, sf_dir).where("label % 2 = 0"), 2, lo=0.4, hi=0.99)
    return errors.select(F.col("vec_id").alias("query_id")).join(found.select("query_id", "pool_id", "sim"), "query_id", "left").select("query_id", "pool_id", F.coalesce("sim", F.lit(0.0)).alias("sim"))


JN10 = f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pool_id) AS k FROM sims WHERE q_label % 2 = 1 AND label % 2 = 0 AND sim >= 0.4 AND sim < 0.99)
SELECT e.vec_id AS query_id, r.pool_id, coalesce(r.sim, 0.0) AS sim FROM embeddings e LEFT JOIN r ON r.query_id = e.vec_id AND r.k <= 2 WHERE e.vec_id % 50 = 0 AND e.label % 2 = 1"""


def jn06_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the ten nearest rows drawn by softmax at temperature 1, the same on every run."""
    return _out(S.sampled(S.nearest(_asked(spark, sf_dir), _emb(spark, sf_dir), 10, hi=0.99), "query_id", 2, 1.0, 7))


def jn01_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per task that have an embedding under their lower-cased query, of those with a query."""
    store = table(spark, sf_dir, "query_index").where("embedding is not null").select(F.lower("query").alias("key")).distinct().withColumn("there", F.lit(1))
    s = table(spark, sf_dir, "samples").where("query is not null").select("sample_id", "task", F.lower("query").alias("key")).distinct()
    return s.join(store, "key", "left").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("n_found"))


JN01 = """WITH st AS (SELECT DISTINCT lower(query) AS key, 1 AS there FROM query_index WHERE embedding IS NOT NULL AND query IS NOT NULL), s AS (SELECT DISTINCT sample_id, task, lower(query) AS key FROM samples WHERE query IS NOT NULL)
SELECT task, count(*) AS n, count(there) AS n_found FROM s LEFT JOIN st USING (key) GROUP BY task"""


def src09_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding store: keys lower-cased, the first entry of each kept."""
    q = table(spark, sf_dir, "query_index").where("query is not null and embedding is not null").select(F.lower("query").alias("query"), "vec_id", "embedded_at")
    return q.groupBy("query").agg(F.min_by("vec_id", F.struct("embedded_at", "vec_id")).alias("vec_id"), F.count(F.lit(1)).alias("n_offered"))


SRC09 = "SELECT lower(query) AS query, first(vec_id ORDER BY embedded_at, vec_id) AS vec_id, count(*) AS n_offered FROM query_index WHERE query IS NOT NULL AND embedding IS NOT NULL GROUP BY lower(query)"


def jn02_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-cased sample queries without a stored embedding: what get-or-create would send to the provider."""
    store = table(spark, sf_dir, "query_index").where("embedding is not null and query is not null").select(F.lower("query").alias("query"))
    return table(spark, sf_dir, "samples").where("query is not null").select(F.lower("query").alias("query")).distinct().join(store, "query", "left_anti")


JN02 = "SELECT DISTINCT lower(query) AS query FROM samples WHERE query IS NOT NULL AND lower(query) NOT IN (SELECT lower(query) FROM query_index WHERE embedding IS NOT NULL AND query IS NOT NULL)"


def scl25_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal bits of two 64-bit hashes (here: event and user numbers)."""
    from ..functions.labels import hash_similarity

    return table(spark, sf_dir, "events").select("event_id", hash_similarity(F.col("event_id").cast("long"), F.col("user_id").cast("long")).alias("sim"))


SCL25 = "SELECT event_id, 1 - bit_count(xor(event_id::BIGINT, user_id::BIGINT)) / 64.0::DOUBLE AS sim FROM events"

QUERIES = {f.__name__: f for f in (jn01_lookup, jn02_missing, jn04_icl_neighbours, jn05_weighted_neighbours, jn06_sampled, jn07_best_match, jn09_contrastive, jn10_pairs_outer, src09_store, scl25_phash)}
SQL = {"jn01_lookup": JN01, "jn02_missing": JN02, "jn04_icl_neighbours": JN04, "jn05_weighted_neighbours": JN05, "jn07_best_match": JN07, "jn09_contrastive": JN09, "jn10_pairs_outer": JN10, "src09_store": SRC09, "scl25_phash": SCL25}
