"""Exact cosine search: a stated set of queries against all rows.

Queries travel in blocks of checked size and are compared with each partition's rows by matrix product; each partition sends
its best only, a window keeps the best of those. More queries than a block holds take further passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES_AT_ONCE = 4_096


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, within [-1, 1]; 0 for different lengths or a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n))).otherwise(0.0)


def nearest(queries: DataFrame, pool: DataFrame, k: int, lo: float | None = None, hi: float | None = None, lo_inclusive: bool = True, weight: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, pool_id, sim, score, rank): the k best pool rows for each query.

    sim is rounded to 6 decimals; only lo <= sim < hi (lo < sim without lo_inclusive) is kept; score is sim times the pool's
    weight column (null: 1); order is by score, ties to the smaller pool_id. Vectors that are null, of another length than the
    query, not finite or zero take no part.
    """
    spark = queries.sparkSession
    out: DataFrame | None = None
    ids: list[int] = []
    rows: list[list[float]] = []

    def one_pass(ids: list[int], rows: list[list[float]]) -> DataFrame:
        dim = len(rows[0])
        q = np.array(rows, np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        q_ids = np.array(ids)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.full((len(q), 0), -9.0), np.full((len(q), 0), 0), np.full((len(q), 0), -9.0))
            for b in batches:
                col = b.column(1)
                right = np.flatnonzero(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False) == dim)
                if not len(right):
                    continue
                x = pc.list_flatten(col.take(pa.array(right))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                x, right = x[good] / norm[good, None], right[good]
                own = b.column(0).to_numpy()[right]
                w = b.column(2).to_numpy(zero_copy_only=False)[right]
                sim = (q @ x.T).clip(-1, 1).round(6)
                out_of = np.zeros(sim.shape, bool)
                if lo is not None:
                    out_of |= (sim < lo) if lo_inclusive else (sim <= lo)
                if hi is not None:
                    out_of |= sim >= hi
                if exclude_self:
                    out_of |= q_ids[:, None] == own[None, :]
                score = np.where(out_of, -np.inf, sim * w[None, :])
                s = np.hstack([best[0], score])
                i = np.hstack([best[1], np.broadcast_to(own, score.shape)])
                raw = np.hstack([best[2], sim])
                o = np.lexsort((i, -s), axis=1)[:, :k]
                best = tuple(np.take_along_axis(a, o, 1) for a in (s, i, raw))
            real = np.isfinite(best[0]) & (best[2] > -2)
            who = np.broadcast_to(q_ids[:, None], best[0].shape)
            yield pa.RecordBatch.from_arrays([pa.array(who[real]), pa.array(best[1][real]), pa.array(best[2][real]), pa.array(best[0][real])], names=["query_id", "pool_id", "sim", "score"])

        w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
        return pool.select(F.col(id_col).cast("long"), vec_col, w.cast("double").alias("w")).mapInArrow(look, "query_id long, pool_id long, sim double, score double")

    usable = queries.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    by_dim: dict[int, tuple[list[int], list[list[float]]]] = {}
    for r in usable.toLocalIterator():
        v = [float(x) if x is not None else float("nan") for x in r.v]
        n = float(np.linalg.norm(v)) if v else 0.0
        if not np.isfinite(n) or n == 0:
            continue
        ids, rows = by_dim.setdefault(len(v), ([], []))
        ids.append(r.i)
        rows.append(v)
        if len(ids) == QUERIES_AT_ONCE:
            part = one_pass(ids, rows)
            out = part if out is None else out.unionByName(part)
            by_dim[len(v)] = ([], [])
    for ids, rows in by_dim.values():
        if ids:
            part = one_pass(ids, rows)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, pool_id long, sim double, score double")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_id"))
    return out.distinct().withColumn("rank", ranked).where(F.col("rank") <= k)


def multimodal(text_sim: Column, image_sims: Column, left_images: Column, right_images: Column) -> Column:
    """Text and image similarity together: text alone without images; half the text where one side has none; else half each."""
    none = (F.size(left_images) == 0) & (F.size(right_images) == 0)
    one = (F.size(left_images) == 0) | (F.size(right_images) == 0)
    mean = F.aggregate(image_sims, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(image_sims), F.lit(1))
    return F.when(none, text_sim).when(one, 0.5 * text_sim).otherwise(0.5 * text_sim + 0.5 * mean)


def sampled(candidates: DataFrame, by: str, k: int, temperature: float, seed: int, weight: str = "score", item: str = "pool_id") -> DataFrame:
    """k candidates of each group without replacement, with probabilities softmax(weight / temperature), by weight.

    Gumbel keys from a hash of seed, group and item: the same draw on any cluster.
    """
    u = (F.xxhash64(F.lit(seed), by, item).cast("double") / F.lit(2.0**64) + 0.5).cast("double")
    u = F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12))
    key = F.col(weight) / temperature - F.log(-F.log(u))
    drawn = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key.desc(), item))).where(F.col("_r") <= k).drop("_r")
    return drawn.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(weight), item)))


def contrastive(mined: DataFrame) -> DataFrame:
    """(query_id, first, second, sim): the two best matches of each error side by side; the mean similarity, or that of one."""
    rows = mined.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("pool_id"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("pool_id"))).alias("second"), F.avg("sim").alias("sim"))
    return rows
