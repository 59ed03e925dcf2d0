"""Problem 5: the most similar vectors of every vector.

NN-descent: a neighbour graph starts from blocks of vectors that sort together by the axes they point along most after random
rotations, then improves by joins of neighbours of neighbours. Each vector is sent to those it names as neighbours; there all
that arrive are compared with each other. Rounds go on until one changes less than DELTA of the graph. Blocks and meeting
places are of bounded size however the vectors lie. Vectors travel as 16-bit integers; where that leaves the order around the
k-th place open (slack() bounds by how much a cosine may be off), the pairs in question are computed again in double precision
from the stored numbers. Vectors of one direction, whatever their length, are matched for themselves and stand in the graph once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import cut, freed, table

DIM = 64
K = 5  # neighbours asked for
KEEP = 9  # neighbours kept in the graph
TABLES = 4  # orders by random rotations
HASHES = 4  # rotations in the code of an order
BLOCK = 1024  # rows compared in an order
MEETING = 256  # rows compared at a node
SENT = 3  # neighbours each vector is sent to
DELTA = 0.05  # share of the k nearest that a round must change for another to follow
MOST_ROUNDS = 12
HUB = 4096  # arrivals from which a node's meeting is spread over several tasks
SAMPLE = 20_000  # vectors whose codes tell where to cut an order into ranges
SAME = 1e-12  # more than float32 rounding takes from the cosine of two lengths of one direction
BROADCAST = 100_000  # ids that the JVM joins by broadcast; beyond, both sides are shuffled
HOT = 100_000  # vectors of one key from which they are joined by broadcast, so that no task gets them all

GRAPH = "node long, near array<long>, sim array<float>"
LISTS = "node long, near array<long>, sim array<float>, fresh int"


def slack(sim: Column, dim: int = DIM) -> Column:
    """By how much two cosines near `sim` may change their difference when vectors are rounded to 16 bits.

    Rounding turns a vector by sqrt(dim) * 0.5 / 32767 at most, both ends of a pair by twice that, which shifts a cosine by
    that angle times the sine; 1e-6 covers float32 arithmetic.
    """
    turn = 2 * dim**0.5 * 0.5 / 32767
    return 2 * turn * (F.sqrt(F.greatest(1 - sim * sim, F.lit(0.0))) + turn) + 1e-6


def usable(store: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, at, mark, key, small, vec): rows with `dim` finite numbers, not all zero, and an id.

    vec is the float32 bytes, small the same direction in 16-bit integers, mark a hash of vec, key one of
    the direction in 8-bit integers, so coarse that rounding of other lengths hardly ever changes it.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            right = np.flatnonzero((pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False) == dim) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False))
            x = pc.list_flatten(col.take(pa.array(right, pa.int64()))).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            at = pa.array(right[good], pa.int64())
            x = np.ascontiguousarray(x[good] + np.float32(0))  # -0 becomes 0
            small = np.rint(x.astype(np.float64) / np.abs(x).max(1, keepdims=True) * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("embedded_at").cast(pa.int64()).take(at), _binary(np.rint(small / 258).astype(np.int8)), _binary(small), _binary(x)], names=["vec_id", "at", "coarse", "small", "vec"])

    rows = store.select("vec_id", "embedding", "embedded_at").mapInArrow(check, "vec_id long, at long, coarse binary, small binary, vec binary")
    return rows.select("vec_id", F.coalesce("at", F.lit(-1)).alias("at"), F.xxhash64("vec").alias("mark"), F.xxhash64("coarse").alias("key"), "small", "vec")


def _binary(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def current(rows: DataFrame) -> DataFrame:
    """One row per vec_id: the last usable delivery. Ids that occur once, nearly all, pass without a shuffle of their rows."""
    twice = cut(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    n = twice.count()
    if not n:
        return rows
    some = F.broadcast(twice) if n <= BROADCAST else twice
    names = [c for c in rows.columns if c != "vec_id"]
    last = F.max_by(F.struct(*names), F.struct("at", "mark")).alias("r")
    again = rows.join(some, "vec_id", "left_semi").groupBy("vec_id").agg(last).select("vec_id", "r.*")
    return rows.join(some, "vec_id", "left_anti").unionByName(again.select(*rows.columns))


def _matrix(col: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), np.int16).reshape(len(col), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(owner: np.ndarray, near: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """One row per owner with its candidates; near, sim: (n, keep)."""
    real = sim > -1.5
    offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(owner), pa.ListArray.from_arrays(offsets, pa.array(near[real])), pa.ListArray.from_arrays(offsets, pa.array(sim[real].astype(np.float32)))], names=["node", "near", "sim"])


def _groups(ids: np.ndarray, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: int, floor: np.ndarray | None = None, known: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Compare all members within each group of rows [start, end); groups of like size are worked on together.

    A member's candidates below its floor are left out: it knows enough better ones. So is its candidate `known`, if given.
    """
    size = ends - starts
    wide = np.where(size <= 2, 2, 2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(int))
    for w in np.unique(wide[size >= 2]):
        mine = np.flatnonzero((wide == w) & (size >= 2))
        for some in np.array_split(mine, -(-len(mine) * w * w // 2_000_000)):
            slot = np.arange(w)
            at = np.minimum(starts[some][:, None] + slot, len(ids) - 1)
            there = slot < size[some][:, None]
            v, who = x[at], ids[at]
            sim = np.matmul(v, v.transpose(0, 2, 1))
            sim[~np.broadcast_to(there[:, None, :], sim.shape)] = -2
            sim[who[:, :, None] == who[:, None, :]] = -2
            if floor is not None:
                sim[sim < floor[at][:, :, None]] = -2
            if known is not None:
                sim[who[:, None, :] == known[at][:, :, None]] = -2
            best = min(keep, w)
            part = np.argpartition(-sim, best - 1, axis=2)[:, :, :best] if best < w else np.broadcast_to(slot, sim.shape)
            near = np.take_along_axis(np.broadcast_to(who[:, None, :], sim.shape), part, 2)
            yield _lists(who[there], near[there], np.take_along_axis(sim, part, 2)[there])


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def rotations(dim: int, tables: int, hashes: int = HASHES, seed: int = 11) -> np.ndarray:
    """(tables, hashes, dim, dim) random rotations."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((tables, hashes, dim, dim)))[0].astype(np.float32)


def codes(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """(n, hashes): the axis, and the side of it, that each row of x points along most after each rotation."""
    out = np.empty((len(x), len(turns)), np.int64)
    for h, turn in enumerate(turns):
        y = x @ turn
        axis = np.abs(y).argmax(1)
        out[:, h] = 2 * axis + (y[np.arange(len(x)), axis] > 0)
    return out


def _keys(x: np.ndarray, node: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The place of each row in an order: its code, then a salt that parts equal codes, in each order otherwise."""
    base, key = 2 * x.shape[1], np.zeros(len(x), np.uint64)
    for h in codes(x, turns).T:
        key = key * np.uint64(base) + h.astype(np.uint64)
    salt = (node.view(np.uint64) ^ np.uint64(turns[0, 0, 0].view(np.uint32))) * np.uint64(0x9E3779B97F4A7C15)
    most = np.uint64(base) ** np.uint64(len(turns))
    room = np.uint64(max(1, 2**62 // int(most)))
    return (key * room + (salt >> np.uint64(20)) % room).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The sorted batches in pieces of about `rows` rows that part no value of the column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows:
            whole = _whole(held)
            at = whole.column(column).to_numpy()
            use = int(np.searchsorted(at, at[-1]))
            if use:
                yield whole.slice(0, use)
            held = [whole.slice(use)]
    if sum(map(len, held)):
        yield _whole(held)


def start(vectors: DataFrame, tables: int = TABLES, block: int = BLOCK, keep: int = K + 1) -> DataFrame:
    """Candidate lists (node, near, sim) from `tables` orders by random rotation, compared in blocks of neighbours."""
    n = vectors.count()
    parts = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (4 * block)))  # ranges of an order
    share = min(1.0, 2 * SAMPLE / max(1, n))
    some = vectors.sample(share, 7).select("node", "small").limit(SAMPLE).toArrow().combine_chunks()
    ranges: list[np.ndarray] = []  # by table: the first keys of its ranges
    if len(some):
        x, node = _matrix(some.column("small").combine_chunks()), some.column("node").to_numpy()
        turns = rotations(x.shape[1], tables)
        ranges = [np.quantile(_keys(x, node, t), np.arange(1, parts) / parts, method="lower") for t in turns]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = None
        for b in batches:
            if not len(b):
                continue
            x, node = _matrix(b.column("small")), b.column("node").to_numpy()
            turns = rotations(x.shape[1], tables) if turns is None else turns
            for t in range(tables):
                key = _keys(x, node, turns[t])
                part = np.searchsorted(ranges[t], key, "right") + t * parts
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), b.column("node"), b.column("small")], names=["part", "key", "node", "small"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 8 * block:
                whole = _whole(held)
                use = len(whole) // block * block
                yield from blocks(whole.slice(0, use))
                held = [whole.slice(use)] if use < len(whole) else []
        if sum(map(len, held)):
            yield from blocks(_whole(held))

    def blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts = np.arange(0, len(b), block)
        yield from _groups(b.column("node").to_numpy(), _matrix(b.column("small")), starts, np.append(starts[1:], len(b)), keep)

    rows = vectors.select("node", "small").mapInArrow(order, "part int, key long, node long, small binary")
    return rows.repartitionById(parts * tables, F.col("part")).sortWithinPartitions("key").select("node", "small").mapInArrow(compare, GRAPH)


def merge(lists: DataFrame, old: DataFrame | None = None, keep: int = KEEP, k: int = K, tell: bool = False) -> DataFrame:
    """The best `keep` different candidates of each node over all its lists, and those of old. fresh: how many of the first k
    are not in its old list. With tell, open: those of all kept that are not.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, "node", 20_000):
            near = b.column("near")
            depth = pc.list_parent_indices(near).to_numpy()
            if not len(depth):
                continue
            node, known = b.column("node").to_numpy()[depth], b.column("old").to_numpy(zero_copy_only=False)[depth]
            near, sim = pc.list_flatten(near).to_numpy(), pc.list_flatten(b.column("sim")).to_numpy()
            o = np.lexsort((~known, near, node))
            node, near, sim, known = node[o], near[o], sim[o], known[o]
            once = np.concatenate([[True], (node[1:] != node[:-1]) | (near[1:] != near[:-1])])
            node, near, sim, known = node[once], near[once], sim[once], known[once]
            o = np.lexsort((near, -sim, node))
            node, near, sim, known = node[o], near[o], sim[o], known[o]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
            new = np.add.reduceat(~known & (rank < k), first).astype(np.int32)
            top = rank < keep
            n = np.add.reduceat(top.astype(np.int64), first)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            out = [pa.array(node[first]), pa.ListArray.from_arrays(offsets, pa.array(near[top])), pa.ListArray.from_arrays(offsets, pa.array(sim[top])), pa.array(new)]
            if tell:
                seen = np.add.reduceat((top & ~known).astype(np.int64), first)
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(seen)]).astype(np.int32)), pa.array(near[top & ~known])))
            yield pa.RecordBatch.from_arrays(out, names=["node", "near", "sim", "fresh", "open"][: len(out)])

    all_ = lists.select("node", "near", "sim", F.lit(False).alias("old"))
    if old is not None:
        all_ = all_.unionByName(old.select("node", "near", "sim", F.lit(True).alias("old")))
    return all_.repartition("node").sortWithinPartitions("node").mapInArrow(best, LISTS + (", open array<long>" if tell else ""))


def descend(graph: DataFrame, vectors: DataFrame, sent: int = SENT, block: int = MEETING, keep: int = K + 1) -> DataFrame:
    """One round: every vector goes to the nodes it names, all that meet at a node are compared; new candidate lists.

    A node named by very many (HUB) spreads them over several tasks, and compares them in blocks of `block`.
    """
    kth = F.coalesce(F.get("sim", F.lit(K - 1)).cast("double"), F.lit(-2.0))
    slim = graph.select("node", F.slice("near", 1, sent).alias("near"), F.when(kth > -2, kth - slack(kth)).otherwise(-2.0).cast("float").alias("floor"))
    out = slim.join(vectors, "node").select(F.explode(F.concat(F.array("node"), "near")).alias("at"), "node", "floor", "small")
    hubs = cut(graph.select(F.explode(F.slice("near", 1, sent)).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB))
    if hubs.isEmpty():
        out = out.withColumn("slot", F.lit(0))
    else:  # at most one node in HUB / SENT is a hub, and its entry is two numbers
        out = out.join(F.broadcast(hubs), "at", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / HUB)), F.lit(0)).cast("int"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, "at", 8192):
            at = b.column("at").to_numpy()
            starts = np.flatnonzero((np.arange(len(at)) - np.searchsorted(at, at)) % block == 0)
            yield from _groups(b.column("node").to_numpy(), _matrix(b.column("small")), starts, np.append(starts[1:], len(at)), keep, b.column("floor").to_numpy(), at)

    return out.repartition("at", "slot").sortWithinPartitions("at").select("at", "node", "floor", "small").mapInArrow(meet, GRAPH)


def neighbour_graph(vectors: DataFrame, delta: float = DELTA) -> DataFrame:
    """(node, near, sim): the best KEEP neighbours found of each node; a node with none has no row."""
    graph = cut(merge(start(vectors)))
    for _ in range(MOST_ROUNDS):
        graph = cut(merge(descend(graph, vectors), graph))
        changed = graph.agg(F.sum("fresh").alias("fresh"), F.sum(F.least(F.size("near"), F.lit(K))).alias("all")).first()
        if (changed.fresh or 0) <= delta * (changed.all or 0):
            break
    return graph.select("node", "near", "sim")


def copies(rows: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(vec_id, rep): the vectors that share their direction with others, and the smallest id of those; the rest has no row.

    Vectors of one key are compared with the smallest id among them; one that differs from it is left to the graph. stored
    gives (vec_id, vec) for (vec_id, mark). Keys of very many vectors (HOT) are joined by broadcast: there are few of them.
    """
    groups = cut(rows.groupBy("key").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("n")).where("rep < last").select("key", "rep", "n"))
    mine = rows.select("key", "vec_id", "mark")
    of_group = [mine.join(F.broadcast(groups.where(F.col("n") > HOT)), "key"), mine.join(groups.where(F.col("n") <= HOT), "key")]
    named = cut(of_group[0].unionByName(of_group[1]).select("vec_id", "mark", "rep").distinct())
    vecs = stored(named.select("vec_id", "mark"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(len(b), -1).astype(np.float64) for c in "ab")
            same = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1) > 1 - SAME
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("rep")], names=["vec_id", "rep"]).filter(pa.array(same))

    reps = vecs.join(named.select(F.col("rep").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("rep"), F.col("vec").alias("a"))
    hot = F.broadcast(groups.where(F.col("n") > HOT).select("rep", F.lit(True).alias("hot")))
    reps, own = reps.join(hot, "rep", "left"), named.select("vec_id", "rep").join(vecs.withColumnRenamed("vec", "b"), "vec_id").join(hot, "rep", "left")
    pairs = own.where("hot is null").drop("hot").join(reps.where("hot is null").drop("hot"), "rep").select("vec_id", "rep", "a", "b")
    pairs = pairs.unionByName(own.where("hot").drop("hot").join(F.broadcast(reps.where("hot").drop("hot")), "rep").select("vec_id", "rep", "a", "b"))
    return cut(pairs.mapInArrow(check, "vec_id long, rep long").distinct())


def most_similar(store: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, other): the k most similar vectors of each by cosine rounded to 6 decimals, ties to the smaller id.

    Ids with no usable vector (null, wrong length, not finite, all zero) take no part. Of several deliveries of an id the
    last usable one counts. Vectors of one direction are each other's first neighbours. Fewer rows come out where fewer vectors exist.
    """
    with freed(store.sparkSession):
        out = _most_similar(store, k)
    return out.select("vec_id", "other")


def _most_similar(store: DataFrame, k: int, find: Callable[[DataFrame], DataFrame] | None = None, scores: bool = False) -> DataFrame:
    """find gives the lists (node, near, sim) of (node, small), neighbour_graph() if none. With scores, sim comes out as well."""

    def stored(asked: DataFrame) -> DataFrame:
        """(vec_id, vec) as stored, of some (vec_id, mark); only their vectors leave the JVM."""
        few = F.broadcast(asked) if asked.count() <= BROADCAST else asked
        mine = store.join(few.select("vec_id"), "vec_id", "left_semi")
        return usable(mine).join(few, ["vec_id", "mark"], "left_semi").select("vec_id", "vec").dropDuplicates(["vec_id"])

    rows = current(cut(usable(store).select("vec_id", "at", "mark", "key", "small"))).select("vec_id", "mark", "key", "small")
    # Vectors of one direction: one of them stands in the graph, with the k + 1 smallest ids of each such set beside it.
    same = copies(rows, stored)
    by_id = Window.partitionBy("rep").orderBy("vec_id")
    ranked = same.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k + 1)
    first = cut(ranked.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).where(F.size("ids") > 1))
    few = first.count() <= BROADCAST
    sets = F.broadcast(first) if few else first
    members = same.join(sets, "rep")
    others = same.where("vec_id != rep").select("vec_id")
    n = others.count()
    alone = rows.join(F.broadcast(others) if n <= BROADCAST else others, "vec_id", "left_anti") if n else rows
    graph = (find or neighbour_graph)(alone.select(F.col("vec_id").alias("node"), "small"))
    # Lists that name no such set, nearly all, stay as they are; the others get its members.
    named = graph.select("node", F.explode(F.arrays_zip("near", "sim")).alias("e")).select("node", F.col("e.near").alias("other"), F.col("e.sim").cast("double").alias("sim"))
    through = named.join(sets, named.other == first.rep).select("node", F.explode("ids").alias("other"), "sim")
    touched = cut(through.select("node").union(same.select("rep")).distinct())
    m = touched.count()
    touched_ = F.broadcast(touched) if m <= BROADCAST else touched
    plain = graph.join(touched_, "node", "left_anti").select("node", F.transform(F.arrays_zip("near", "sim"), lambda x: F.struct((-x.sim.cast("double")).alias("s"), x.near.alias("other"))).alias("c"))
    edges = named.join(touched_, "node", "left_semi").unionByName(through)
    # A member has the neighbours of its representative; where the set itself fills all k places, only ties matter.
    passed = edges.join(members.where("vec_id != rep"), edges.node == F.col("rep")).where((F.size("ids") <= k) | (F.col("sim") >= 1 - slack(F.lit(1.0)))).select(F.col("vec_id").alias("node"), "other", "sim")
    offered = edges.unionByName(passed).unionByName(members.select(F.col("vec_id").alias("node"), F.explode("ids").alias("other"), F.lit(1.0).alias("sim")))
    offered = offered.where("node != other").groupBy("node", "other").agg(F.max("sim").alias("sim"))
    lists = offered.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), "other"))).alias("c")).unionByName(plain)
    # Where the k-th place is open within the rounding of integers, those pairs are computed exactly.
    kth = -F.get("c", F.lit(k - 1)).s
    near = lists.withColumn("off", slack(kth)).select("node", F.filter("c", lambda x: -x.s > kth + F.col("off")).alias("sure"), F.filter("c", lambda x: (-x.s >= kth - F.col("off")) & (-x.s <= kth + F.col("off"))).alias("open"), "c")
    clear = (F.size("c") <= k) | (F.size("sure") + F.size("open") <= k)
    first_k = F.when(clear, F.slice("c", 1, k)).otherwise(F.col("sure"))
    near = cut(near.select("node", (first_k if scores else first_k.other).alias("sure"), F.when(~clear, F.col("open.other")).alias("open")))
    sure = near.select(F.col("node").alias("vec_id"), F.explode("sure").alias("other"))
    if scores:
        sure = sure.select("vec_id", "other.other", (-F.col("other.s")).cast("float").alias("sim"))
    asked = near.where("open is not null").select("node", (F.lit(k) - F.size("sure")).alias("left"), F.explode("open").alias("other"))
    wanted = cut(rows.select("vec_id", "mark").join(asked.select(F.explode(F.array("node", "other")).alias("vec_id")).distinct(), "vec_id", "left_semi"))
    vec = stored(wanted)
    pairs = asked.join(vec.select(F.col("vec_id").alias("node"), F.col("vec").alias("a")), "node").join(vec.select(F.col("vec_id").alias("other"), F.col("vec").alias("b")), "other").select("node", "left", "other", "a", "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(len(b), -1).astype(np.float64) for c in "ab")
            sim = ((x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)).round(6)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("left"), b.column("other"), pa.array(sim)], names=["node", "left", "other", "sim"])

    scored = pairs.mapInArrow(exact, "node long, left int, other long, sim double")
    won = scored.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))).where("rank <= left").select(F.col("node").alias("vec_id"), "other", F.col("sim").cast("float").alias("sim"))
    return cut(sure.unionByName(won.select(*sure.columns)))


HOPS = 4  # steps of a graph search
BEAM = 12  # best nodes a search keeps
ENTRIES = 24  # nodes of a bucket where a search may begin
PER_BUCKET = 32  # nodes of a bucket, about
LOAD = 5  # vectors on their way at once in a step of searches from every node, per vector stored


def entries(vectors: DataFrame, tables: int = TABLES) -> tuple[DataFrame, int]:
    """(bucket, node): up to ENTRIES nodes of every bucket of the codes, and the number of codes' hashes that name a bucket.

    Built once for a store. A bucket only says where searches begin, so it needs no more than some of its nodes.
    """
    n = vectors.count()
    hashes = max(1, min(HASHES, round(float(np.log(max(2, n / PER_BUCKET)) / np.log(2 * DIM)))))
    buckets = _buckets(vectors, "node", tables, hashes)
    some = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node")))
    return buckets.withColumn("rank", some).where(F.col("rank") <= ENTRIES).select("bucket", "node"), hashes


def _buckets(vectors: DataFrame, name: str, tables: int, hashes: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = None
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("small"))
            turns = rotations(x.shape[1], tables) if turns is None else turns
            for t in range(tables):
                key = np.full(len(x), t, np.int64)
                for h in codes(x, turns[t][:hashes]).T:
                    key = key * (2 * x.shape[1]) + h
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(name)], names=["bucket", name])

    return vectors.select(name, "small").mapInArrow(code, f"bucket long, {name} long")


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, k: int = K, hops: int = HOPS, beam: int = BEAM, starts: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(query_id, node, sim): the k nearest nodes found for each query (query_id, small) by greedy search of the graph.

    A search starts from nodes of the query's buckets (entries(), which may be built once for many batches of queries). Every
    step follows the edges of the best nodes so far, scores those not seen yet, and keeps the best; it ends after `hops` steps.
    """
    index, hashes = starts or entries(vectors)
    edges = graph.select("node", F.explode("near").alias("next"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "node"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("node"), pa.array((_matrix(b.column("a")) * _matrix(b.column("b"))).sum(1).astype(np.float32))], names=["query_id", "node", "sim"])

    def scored(fresh: DataFrame) -> DataFrame:
        paired = fresh.join(vectors.select("node", F.col("small").alias("b")), "node").join(queries.select("query_id", F.col("small").alias("a")), "query_id")
        return paired.select("query_id", "node", "a", "b").mapInArrow(score, "query_id long, node long, sim float")

    with freed(vectors.sparkSession):
        first = _buckets(queries, "query_id", TABLES, hashes).join(index, "bucket").select("query_id", "node").distinct()
        held = cut(scored(first).withColumn("_r", best).where(F.col("_r") <= beam).drop("_r"))
        for _ in range(hops):
            fresh = held.join(edges, "node").select("query_id", F.col("next").alias("node")).distinct().join(held.select("query_id", "node"), ["query_id", "node"], "left_anti")
            held = cut(held.unionByName(scored(fresh)).withColumn("_r", best).where(F.col("_r") <= beam).drop("_r"))
    return held.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")


def explore(graph: DataFrame, vectors: DataFrame, hops: int = HOPS) -> DataFrame:
    """(node, near, sim): the KEEP nearest nodes found for every node by greedy search of the graph from its own place in it.

    Every step goes to the nodes held where the search has not been yet, scores those they name, and keeps the best; a search
    ends when it has been at all it holds, or after `hops` steps.
    """
    n = vectors.count()
    held = graph.select("node", "near", "sim", F.col("near").alias("open"))
    for _ in range(hops):
        asking = held.where(F.size("open") > 0)
        places = cut(asking.select(F.explode("open").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")))
        sums = places.agg(F.sum("n").alias("visits"), F.count(F.lit(1)).alias("places")).first()
        if not sums.places:
            break
        turns = -(-(sums.visits + KEEP * sums.places) // (LOAD * n))
        lists = _visit(asking, graph, vectors, places, turns, 0)
        if turns > 1:
            lists = cut(lists)
        for t in range(1, turns):
            lists = lists.unionByName(cut(_visit(asking, graph, vectors, places, turns, t)))
        held = cut(merge(lists, held, tell=True))
    return held.select("node", "near", "sim")


def _visit(asking: DataFrame, graph: DataFrame, vectors: DataFrame, places: DataFrame, turns: int, turn: int) -> DataFrame:
    """Candidate lists (node, near, sim) of a share of the visits, of what is not held yet: the vector of a search and those of
    the nodes that a node names are sent there and compared. A node that very many (HUB) visit is spread over several tasks.
    """

    def mine(at: Column) -> Column:
        return F.pmod(F.xxhash64(at, F.lit(1)), F.lit(turns)) == turn

    places = places.where(mine(F.col("at"))).select("at", F.ceil(F.col("n") / HUB).cast("int").alias("slots"))
    floor = F.coalesce(F.get("sim", F.lit(KEEP - 1)), F.lit(-2.0)).cast("float").alias("floor")
    came = asking.select("node", floor, F.col("near").alias("known"), F.filter("open", mine).alias("open")).where(F.size("open") > 0).join(vectors, "node")
    came = came.select(F.explode("open").alias("at"), "node", "floor", "known", "small").join(F.broadcast(places.where("slots > 1")), "at", "left")
    place = F.xxhash64("at", "slot").alias("place")
    came = came.withColumn("slot", F.pmod(F.xxhash64("node"), F.coalesce("slots", F.lit(1))).cast("int")).select(place, F.lit(True).alias("asks"), "node", "floor", "known", "small")
    named = graph.select(F.col("node").alias("at"), "near").join(places, "at").select("at", "near", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    there = named.select(place, F.explode("near").alias("node")).join(vectors, "node").select("place", F.lit(False).alias("asks"), "node", F.lit(None).cast("float").alias("floor"), F.lit(None).cast("array<long>").alias("known"), "small")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, "place", 8192):
            node, held = b.column("node").to_numpy(), b.column("known")
            known = np.repeat(node[:, None], KEEP + 1, 1)  # itself, then what it holds
            row, size = pc.list_parent_indices(held).to_numpy(), pc.fill_null(pc.list_value_length(held), 0).to_numpy()
            known[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = pc.list_flatten(held).to_numpy()
            asks = b.column("asks").to_numpy(zero_copy_only=False)
            yield from _scored(b.column("place").to_numpy(), asks, node, b.column("floor").to_numpy(zero_copy_only=False), known, _matrix(b.column("small")))

    return came.unionByName(there).repartition("place").sortWithinPartitions("place", "asks").mapInArrow(meet, GRAPH)


def _scored(place: np.ndarray, asks: np.ndarray, ids: np.ndarray, floor: np.ndarray, known: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """At each place the rows that ask, which come last, compared with the others; what a row knows, or is below its floor, is left out."""
    if not len(ids):
        return
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    there = np.add.reduceat((~asks).astype(np.int64), starts)
    came = np.diff(np.append(starts, len(ids))) - there
    wide = 2 ** np.ceil(np.log2(np.maximum(came, 1))).astype(int)
    use = np.flatnonzero((there > 0) & (came > 0))
    for w in np.unique(wide[use]):
        of_width = use[wide[use] == w]
        m = int(there[of_width].max())
        for some in np.array_split(of_width, -(-len(of_width) * w * m // 2_000_000)):
            q = np.minimum((starts + there)[some][:, None] + np.arange(w), len(ids) - 1)
            c = np.minimum(starts[some][:, None] + np.arange(m), len(ids) - 1)
            sim = np.matmul(x[q], x[c].transpose(0, 2, 1))
            sim[np.broadcast_to((np.arange(m) >= there[some][:, None])[:, None, :], sim.shape)] = -2
            sim[sim < floor[q][:, :, None]] = -2
            for held in known.T:
                sim[held[q][:, :, None] == ids[c][:, None, :]] = -2
            real = (np.arange(w) < came[some][:, None]) & (sim > -1.5).any(2)
            yield _lists(ids[q][real], np.broadcast_to(ids[c][:, None, :], sim.shape)[real], sim[real])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id_1, vec_id_2), the smaller first, each pair once."""
    near = most_similar(table(spark, sf_dir, "query_index"))
    return near.select(F.least("vec_id", "other").alias("vec_id_1"), F.greatest("vec_id", "other").alias("vec_id_2")).distinct()


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, node, sim): the five nearest others of every usable id, by graph search from its own place in the graph of all.

    Ids, deliveries, vectors of one direction and ties count as in most_similar(). sim is the cosine of the 16-bit vectors;
    where those leave the five open, that of the stored ones, rounded to 6 decimals.
    """
    with freed(spark):
        out = _most_similar(table(spark, sf_dir, "query_index"), K, lambda vectors: explore(neighbour_graph(vectors), vectors), True)
    return out.select(F.col("vec_id").alias("query_id"), F.col("other").alias("node"), "sim")


QUERIES = {"p5_found": p5_found, "p5_search": p5_search}
