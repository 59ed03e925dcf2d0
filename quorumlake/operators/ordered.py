"""State that depends on the order of events: quality scores, running rates, pools, selections, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import cut

RANGE = 100_000  # events in one range of the order, about


def ranged(events: DataFrame, seq: str, rows: int | None = None) -> DataFrame:
    """events with _range, numbered in the order of seq: about `rows` events each, however seq is spread; equal seq stay together."""
    rows = rows or RANGE
    parts = max(1, -(-events.count() // rows))
    return cut(events.repartitionByRange(parts, seq).withColumn("_range", F.spark_partition_id()))


def _before(cutd: DataFrame, seq: str, value: str, by: list[str]) -> DataFrame:
    """cutd with sum_before and n_before of its group: over all events with a smaller seq. Ranges are summed for themselves and
    their totals added up: no single task sees all events.
    """
    totals = cutd.groupBy(*by, "_range").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")  # a row per group and range
    base = totals.select(*by, "_range", (F.sum("_s").over(order) - F.col("_s")).alias("_bs"), (F.sum("_n").over(order) - F.col("_n")).alias("_bn"))
    within = Window.partitionBy(*by, "_range").orderBy(seq).rangeBetween(Window.unboundedPreceding, -1)
    out = cutd.withColumns({"_ws": F.coalesce(F.sum(value).over(within), F.lit(0)), "_wn": F.count(F.lit(1)).over(within)}).join(base, [*by, "_range"])
    return out.withColumns({"sum_before": F.col("_bs") + F.col("_ws"), "n_before": F.col("_bn") + F.col("_wn")}).drop("_bs", "_bn", "_ws", "_wn")


def running_before(events: DataFrame, seq: str, value: str, rows: int | None = None) -> DataFrame:
    """events with sum_before and n_before: the sum and number of `value` over all earlier events of the whole order.

    Equal seq values are ordered as one (none is before another).
    """
    return _before(ranged(events, seq, rows), seq, value, []).drop("_range")


def quality_scores(events: DataFrame, seq: str = "seq", key: str = "sample_key", helpful: str = "helpful", step: float = 0.1, rows: int | None = None) -> DataFrame:
    """(key, score, correct_count, incorrect_count, usage_count): scores in [0, 2], from 1.

    A helpful use adds step * (1 - g), another takes step * g, where g is the share of helpful uses of all samples before it
    (0.5 at the start). Scores of one sample fold over its own events in order: a run of moves is min(hi, max(lo, score + d)),
    whatever its length, so runs are folded by range and then put together, and no task holds all events of a sample.
    """
    rated = _before(ranged(events, seq, rows), seq, helpful, [])
    g = F.when(F.col("n_before") > 0, F.col("sum_before") / F.col("n_before")).otherwise(0.5)
    moves = rated.select(key, "_range", helpful, F.struct(F.col(seq).alias("s"), F.when(F.col(helpful) == 1, step * (1 - g)).otherwise(-step * g).alias("d")).alias("e"))
    clamp = lambda x, lo, hi: F.least(hi, F.greatest(lo, x))
    zero, two, far = F.lit(0.0), F.lit(2.0), F.lit(1e9)
    start = F.struct((-far).alias("lo"), far.alias("hi"), zero.alias("d"))
    run = F.aggregate(F.array_sort(F.collect_list("e")), start, lambda f, x: F.struct(clamp(f.lo + x.d, zero, two).alias("lo"), clamp(f.hi + x.d, zero, two).alias("hi"), (f.d + x.d).alias("d")))
    parts = moves.groupBy(key, "_range").agg(run.alias("f"), F.sum(helpful).alias("c"), F.sum(1 - F.col(helpful)).alias("i"), F.count(F.lit(1)).alias("n"))
    score = F.aggregate(F.array_sort(F.collect_list(F.struct("_range", "f"))), F.lit(1.0), lambda s, x: clamp(s + x.f.d, x.f.lo, x.f.hi))
    return parts.groupBy(key).agg(score.alias("score"), F.sum("c").alias("correct_count"), F.sum("i").alias("incorrect_count"), F.sum("n").alias("usage_count"))


def running_rate(events: DataFrame, by: str, ok: str, seq: str = "seq", rows: int | None = None) -> DataFrame:
    """events with success_rate and total_injections of its group up to and with each event; seq must be unique in a group."""
    out = _before(ranged(events, seq, rows), seq, ok, [by]).drop("_range")
    n = F.col("n_before") + 1
    return out.withColumns({"success_rate": (F.col("sum_before") + F.col(ok)) / n, "total_injections": n}).drop("sum_before", "n_before")


def last_write(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last event of each key (a pool after all its upserts)."""
    names = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*names), seq).alias("_r")).select(*keys, "_r.*")


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all parts, each key once: from the earliest part that has it, its smallest row."""
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = marked[0]
    for p in marked[1:]:
        whole = whole.unionByName(p)
    names = [c for c in whole.columns if c not in (key, "_part")]
    return whole.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("_part", *names)).alias("_r")).select(key, "_r.*")


def upsert_bad_cases(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bad cases after a batch: known keys take the batch's last output and reason and count on; new ones begin at one.

    A key that comes several times in the batch counts once for each; its last row (greatest seq) gives the text.
    """
    keys = keys or ["sample_key", "agent_name"]
    batch = new.groupBy(*keys).agg(F.max_by(F.struct("error_output", "error_reason"), "seq").alias("b"), F.count(F.lit(1)).alias("times"))
    joined = old.alias("o").join(batch.alias("n"), keys, "full_outer")
    return joined.select(*keys, F.coalesce("b.error_output", "o.error_output").alias("error_output"), F.coalesce("b.error_reason", "o.error_reason").alias("error_reason"), (F.coalesce("o.num_wrong", F.lit(0)) + F.coalesce("times", F.lit(0))).cast("long").alias("num_wrong"), F.coalesce("o.optimize_priority", F.lit(1.0)).alias("optimize_priority"))


def ucb(score: Column, count: Column, total: Column, explore: float = 2.0) -> Column:
    """Upper confidence bound of a candidate chosen `count` times among `total` choices."""
    return score + explore * F.sqrt(2 * F.log(total + 1) / (count + 1))


def positions(df: DataFrame, order: list) -> DataFrame:
    """df with pos, its place from 0 in an order given by orderable columns, by ranges and not through one task."""
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    held = cut(marked)
    counts = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_p", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n")).alias("_b"))  # a row per partition
    w = Window.partitionBy("_p").orderBy(*order)
    return held.withColumn("_w", F.row_number().over(w)).join(F.broadcast(base), "_p").withColumn("pos", F.col("_b") + F.col("_w") - 1).drop("_p", "_w", "_b")


def recent(events: DataFrame, by: str, keep: int, seq: str = "seq") -> DataFrame:
    """The last `keep` events of each group."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq)))).where(F.col("_r") <= keep).drop("_r")


def accepted(rounds: DataFrame, by: list[str], round_: str, correct: str, strict: bool = False) -> DataFrame:
    """rounds with kept: whether a round's number of right answers is no worse (better, if strict) than the best before it."""
    w = Window.partitionBy(*by).orderBy(round_).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(correct).over(w)
    kept = (F.col(correct) > best) if strict else (F.col(correct) >= best)
    return rounds.withColumns({"best_before": best, "kept": F.coalesce(kept, F.lit(True))})
