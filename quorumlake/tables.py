"""Reading tables and cutting lineage, shared by every operator."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names. Only a session in one process (tests) may do without: it gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quorumlake-"))
        held = context._jsc.sc().getCheckpointDir()
    return named or held.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so later stages don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within, plans give up their shuffle files as soon as they have run, as a cut() lineage no longer needs them.

    A plan made within must run once only; results to be handed out are cut() first.
    """
    held = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, held)


MANY = 200_000  # repeated keys that may travel with each task; beyond, rows are grouped


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest order columns (rows delivered twice fold into one).

    Keys must not be null. Null order values count as the oldest; equal ones are told apart by the other columns' hash. Keys
    that occur once, nearly all, pass without a shuffle of their rows: only the keys are counted over the cluster.
    """
    twice = cut(df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys))
    many = twice.count()
    if not many:
        return df
    if many > MANY:
        return _last(df, keys, order)
    return df.join(F.broadcast(twice), keys, "left_anti").unionByName(_last(df.join(F.broadcast(twice), keys, "left_semi"), keys, order))


def _last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    names = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, F.xxhash64(*names))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def numbered(df: DataFrame, partition: list[str], order: list, name: str = "rn") -> DataFrame:
    """row_number from 1 within a partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
