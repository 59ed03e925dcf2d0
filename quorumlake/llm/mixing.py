"""Problem 8: mixing sources to target weights.

Weighted fair queueing: the documents of each source are shuffled, repeated passes behind one another, and each gets a
virtual finish time, the source's tokens up to it divided by the source's weight. Ordered by that time over all sources and
cut where the budget ends, the sources stand in the ratio of their weights at every point of the order.

Sums up to each document are taken in two levels, over buckets of the shuffle and within them, so that no source, however
large, passes through one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 29
BUCKET_ROWS = 20_000  # documents of a source and pass in a bucket, about
MAX_TARGETS = 100_000  # sources named in the targets; checked, not cut


def source_key(source: Column) -> Column:
    """A source's name regardless of spelling: width, case, blanks, hyphens and underscores."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(source), r"^\s+|\s+$", ""), r"[\s\-_.]+", "_"))


def with_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens: the length of the whole text in tokens of a byte-level BPE vocabulary; 0 for a null text."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(bpe.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, n_tokens long")


def plan(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[list[dict], float]:
    """Supply and weight of each target source, and the virtual time at which the mix ends.

    Without a budget it ends when the first source has given all its passes, so that every share is met. With a budget it
    ends when the sources together have given that much; those that run dry stay behind their share.
    """
    want = targets.where("source is not null and target_share > 0").select(source_key(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats")).groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MAX_TARGETS + 1).collect()
    if len(want) > MAX_TARGETS:
        raise ValueError(f"over {MAX_TARGETS} target sources")
    have = {r.source: r for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).join(F.broadcast(sized.sparkSession.createDataFrame([(r.source,) for r in want], "source string")), "source", "left_semi").collect()} if want else {}
    total = sum(r.share for r in want) or 1.0
    rows = [{"source": r.source, "weight": r.share / total, "repeats": r.repeats, "n": have[r.source].n if r.source in have else 0, "supply": int(have[r.source].t) if r.source in have else 0} for r in sorted(want, key=lambda r: r.source)]
    live = [r for r in rows if r["supply"]]
    if not live:
        return rows, 0.0
    ends = sorted(r["supply"] * r["repeats"] / r["weight"] for r in live)
    if budget is None:
        return rows, ends[0]
    lo, hi = 0.0, ends[-1]
    for _ in range(200):
        mid = (lo + hi) / 2
        given = sum(min(r["weight"] * mid, r["supply"] * r["repeats"]) for r in live)
        lo, hi = (mid, hi) if given <= budget else (lo, mid)
    return rows, lo


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """The mix (source, doc_id, pass_no, n_tokens, finish), to be read in order of finish, and the plan behind it.

    Documents with a null or empty text, without a source, or of no target source take no part. A document comes again only
    after all others of its source. Equal finish times are told apart by source and doc_id.
    """
    sized = with_tokens(docs, vocabulary)
    sized = cut(sized.withColumn("source", source_key(F.col("source"))).where("source is not null and n_tokens > 0"))
    rows, end = plan(sized, targets, budget)
    spark = docs.sparkSession
    live = [(r["source"], r["weight"], int(r["repeats"]), max(1, -(-r["n"] // BUCKET_ROWS))) for r in rows if r["supply"]]
    wanted = F.broadcast(spark.createDataFrame(live, "source string, weight double, repeats int, buckets long"))
    passes = sized.join(wanted, "source").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    passes = passes.withColumn("shuffled", F.xxhash64(F.lit(seed), "pass_no", "doc_id")).withColumn("bucket", F.floor((F.col("shuffled").cast("double") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    sums = passes.groupBy("source", "pass_no", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = sums.withColumn("before", F.sum("bucket_tokens").over(Window.partitionBy("source").orderBy("pass_no", "bucket")) - F.col("bucket_tokens")).drop("bucket_tokens")
    within = F.sum("n_tokens").over(Window.partitionBy("source", "pass_no", "bucket").orderBy("shuffled", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = passes.withColumn("within", within).join(before, ["source", "pass_no", "bucket"])
    finish = (F.col("before") + F.col("within")) / F.col("weight")
    return placed.select("source", "doc_id", "pass_no", "n_tokens", finish.alias("finish")).where(F.col("finish") <= end), rows


def shares(mixed: DataFrame, rows: list[dict]) -> DataFrame:
    """Per target source: target and actual share, documents, tokens, passes begun and the supply; absent ones with 0."""
    given = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (F.max("pass_no") + 1).alias("passes"))
    want = mixed.sparkSession.createDataFrame([(r["source"], float(r["weight"]), int(r["repeats"]), r["supply"]) for r in rows], "source string, target_share double, max_repeats int, supply_tokens long")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "passes")]
    joined = want.join(given, "source", "left").select("source", "target_share", "max_repeats", "supply_tokens", *zero)
    total = F.sum("n_tokens").over(Window.partitionBy())  # a row per source
    return joined.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set: every document taken, by source and pass, in its global order."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0].orderBy("finish", "source", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per source."""
    return shares(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
