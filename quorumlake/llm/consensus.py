"""Problem 2: consensus labels, agreement and rater reliability.

Latent ability and difficulty: rater i gives item j of true label z the label l with probability
softmax_l(alpha_i * beta_j * [l = z] + c_il). alpha is the rater's ability (negative: against the truth), beta > 0 the
item's easiness, c the rater's taste for labels, so that someone who always writes one label carries no weight. Fitted by
gradient expectation-maximisation: labels' posteriors and beta follow in each task from the raters' parameters, gradients
and curvatures are summed over all items, the driver holds only the raters' parameters.

Items with the same votes are the same to the model, so it is fitted on distinct vote patterns with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, latest, table

SLOTS = 5
ROUNDS = 14  # passes over the vote patterns
BLOCK = 40_000  # vote patterns of a task at a time, times its labels
MAX_LABELS, MAX_RATERS = 10_000, 200_000  # lookup lists; checked, not cut
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def plain_label(raw: Column) -> Column:
    """A label as written, reduced to a comparable form: JSON value, width, case, quotes, marks, number prefix."""
    half = F.translate(raw, _FULL, _HALF)
    value = F.when(half.contains("{"), F.coalesce(F.get_json_object(half, "$.label"), F.get_json_object(half, "$.标签"), half)).otherwise(half)
    bare = F.regexp_replace(F.lower(value), r"^[\s\p{P}\p{Z}]+|[\s\p{P}\p{Z};]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\d+\s*[-_.、]\s*(?=\D)", ""), r"^(\d+)\.0+$", "$1")


def label_lookup(labels: DataFrame, skip: tuple[str, ...]) -> tuple[dict[str, dict[str, str]], dict[str, list[str]]]:
    """Each task's spellings with their label codes, and its codes in rank order."""
    rows = labels.where(~F.col("task").isin(*skip)).select("task", "label_code", "name_en", "name_zh", "rank_no").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"label_set holds over {MAX_LABELS} labels")
    names, codes = {}, {}
    for r in sorted(rows, key=lambda r: (r.task, r.rank_no, r.label_code)):
        codes.setdefault(r.task, []).append(r.label_code)
        for n in (r.label_code, r.name_en, r.name_zh):
            if n:
                names.setdefault(r.task, {}).setdefault(n.strip().lower(), r.label_code)
    return names, codes


def _literal(pairs: dict[str, Column]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in sorted(pairs.items())))


def votes(samples: DataFrame, labels: DataFrame, least: int = 3, skip: tuple[str, ...] = ("image_classification",)) -> tuple[DataFrame, dict[str, list[str]]]:
    """(sample_id, task, votes array<struct<rater, label>>) of samples with at least `least` usable labels, and the codes.

    Unusable labels (null, blank, not of the task) cast no vote; a null rater is the rater ''. Rows delivered twice count
    once, by the last delivery.
    """
    names, codes = label_lookup(labels, skip)
    if not names:
        raise ValueError("label_set names no label")
    once = latest(samples.select("sample_id", "task", "raters", "ingested_at", *[f"annotation_{i}" for i in range(1, SLOTS + 1)]).where(F.col("task").isin(*codes) & F.col("sample_id").isNotNull()), ["sample_id"], ["ingested_at"])
    lookup = _literal({t: _literal({k: F.lit(v) for k, v in spelled.items()}) for t, spelled in names.items()})[F.col("task")]

    def vote(i: int) -> Column:
        raw = F.col(f"annotation_{i}")
        code = F.coalesce(lookup[F.lower(raw)], lookup[plain_label(raw)])
        return F.struct(F.coalesce(F.get("raters", F.lit(i - 1)), F.lit("")).alias("rater"), F.when(raw.isNotNull(), code).alias("label"))

    cast = F.filter(F.array(*[vote(i) for i in range(1, SLOTS + 1)]), lambda v: v.label.isNotNull())
    # Out of explode(), since a plain column would be computed twice: the filter on it is pushed below with a copy of its own.
    return once.select("sample_id", "task", F.explode(F.array(cast)).alias("votes")).where(F.size("votes") >= least), codes


def parts(batch: pa.RecordBatch, codes: dict[str, list[str]]) -> Iterator[tuple[str, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """By task, some rows at a time: row numbers, the raters' names, and by slot and row the rater's place among them and the label number.

    Where a row has fewer votes, the rater's place is one behind the last and the label 0.
    """
    lists = batch.column("votes")
    owner = pc.list_parent_indices(lists).to_numpy()
    if not len(owner):
        return
    flat = lists.flatten()
    raters, labels = flat.field("rater").dictionary_encode(), flat.field("label").dictionary_encode()
    slot = np.arange(len(owner)) - np.searchsorted(owner, owner)
    rater, label = np.full((slot.max() + 1, len(batch)), -1), np.zeros((slot.max() + 1, len(batch)), int)
    rater[slot, owner], label[slot, owner] = raters.indices.to_numpy(), labels.indices.to_numpy()
    tasks, written = sorted(codes), labels.dictionary.to_pylist()
    no = pc.index_in(batch.column("task"), value_set=pa.array(tasks)).to_numpy(zero_copy_only=False)
    for i, t in enumerate(tasks):
        mine = np.flatnonzero(no == i)
        place = {c: z for z, c in reversed(list(enumerate(codes[t])))}  # the first place of a code listed twice
        number = np.array([place.get(c, 0) for c in written])
        for at in np.array_split(mine, -(-len(mine) // max(BLOCK // len(place), 1))) if len(mine) else []:
            here = rater[:, at]
            who, r = np.unique(here, return_inverse=True)
            r = r.reshape(here.shape)
            if who[0] < 0:
                who, r = who[1:], np.where(here < 0, len(who) - 1, r - 1)
            yield t, at, raters.dictionary.take(pa.array(who)), r, np.where(here < 0, 0, number[label[:, at]])


class Model:
    """Parameters of all raters of all tasks, and what a block of votes tells about them."""

    def __init__(self, codes: dict[str, list[str]], raters: list[tuple[str, str]]) -> None:
        self.codes = codes
        self.tasks = sorted(codes)
        self.raters = raters
        self.names = {t: pa.array([r for of, r in raters if of == t], pa.string()) for t in self.tasks}
        self.first = dict(zip(self.tasks, np.cumsum([0, *(len(self.names[t]) for t in self.tasks)]), strict=False))
        self.k = max(map(len, codes.values()))
        self.alpha = np.full(len(raters), 2.0)
        self.taste = np.zeros((len(raters), self.k))
        self.prior = {t: np.full(len(codes[t]), 1 / len(codes[t])) for t in codes}

    def numbers(self, task: str, who: pa.Array) -> np.ndarray:
        """Places of a task's raters among all parameters."""
        return self.first[task] + pc.index_in(who, value_set=self.names[task]).to_numpy()

    def posterior(self, task: str, who: np.ndarray, r: np.ndarray, lab: np.ndarray, steps: int = 4) -> tuple[np.ndarray, ...]:
        """By label z and row: the posteriors; by row: the easiness; by z, slot and row: P(l = z | z), its divisor and exp(taste).

        A missing vote counts as one of a rater with ability 0 for whom every divisor is 1.
        """
        k, n = len(self.codes[task]), r.shape[1]
        e = np.exp(self.taste[who, :k]).T
        rest, e = np.append(e.sum(0) - e, np.ones((k, 1)), 1)[:, r], np.append(e, np.zeros((k, 1)), 1)[:, r]
        alpha, rows = np.append(self.alpha[who], 0.0)[r], np.arange(n)
        said = np.zeros((k, n))
        for by_slot, mine in zip(alpha, lab, strict=True):
            said[mine, rows] += by_slot
        log_prior = np.log(self.prior[task])[:, None]
        b = np.zeros(n)
        right, d = np.empty_like(e), np.empty_like(e)
        for step in range(steps + 1):
            beta = np.exp(b)
            a = alpha * beta
            np.multiply(e, np.exp(a), out=right)
            np.add(rest, right, out=d)
            right /= d
            q = said * beta - np.log(d.prod(1)) + log_prior  # at most SLOTS divisors below exp(45) each
            q -= q.max(0)
            np.exp(q, out=q)
            q /= q.sum(0)
            if step == steps:
                return q, beta, right, d, e
            g = ((q[lab, rows] - np.einsum("zn,zsn->sn", q, right)) * a).sum(0) - b / 0.25
            b = np.clip(b + 0.1 * np.clip(g, -3, 3), -1.5, 1.5)
        raise AssertionError

    def statistics(self, task: str, names: pa.Array, r: np.ndarray, lab: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of gradient and curvature: rows (rater, parameter, g, h); parameter -1 is the ability, -2 - z the class counts."""
        k, most = len(self.codes[task]), len(names) + 1
        who = self.numbers(task, names)
        q, beta, right, d, e = self.posterior(task, who, r, lab)
        flat, w = r.ravel(), np.where(r < len(names), n, 0.0)
        by_label = np.bincount(flat * k + lab.ravel(), w.ravel(), most * k).reshape(most, k)
        hit = q[lab, np.arange(r.shape[1])]
        sure = q[:, None] * right  # by z, slot and row, as are these below
        out = []

        def add(param: int, gs: np.ndarray, hs: np.ndarray) -> None:
            some = np.flatnonzero(hs[:-1] + np.abs(gs[:-1]))
            out.append(np.stack([who[some], np.full(len(some), param), gs[some], hs[some]]))

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(flat, (x * w).ravel(), most)

        add(-1, total((hit - sure.sum(0)) * beta), total((sure.sum(0) - (sure * right).sum(0)) * beta**2))
        np.divide(q[:, None], d, out=d)
        p = e * (d.sum(0) - d) + sure
        for z in range(k):
            add(z, by_label[:, z] - total(p[z]), total(p[z] * (1 - p[z])))
        out.append(np.stack([np.full(k, self.tasks.index(task)), -2 - np.arange(k), (q * n).sum(1), np.zeros(k)]))
        return np.concatenate(out, 1)

    def step(self, sums: pd.DataFrame) -> None:
        """One damped Newton step under priors alpha ~ N(1.5, 2^2), c ~ N(0, 1.5^2)."""
        for no, t in enumerate(self.tasks):
            mine = sums[(sums.param <= -2) & (sums.rater == no)].sort_values("param", ascending=False)
            if len(mine):
                self.prior[t] = (mine.g.to_numpy() + 1) / (mine.g.sum() + len(mine))
        some = sums[sums.param >= -1]
        r, p, g, h = some.rater.to_numpy(), some.param.to_numpy(), some.g.to_numpy(), some.h.to_numpy()
        is_a = p == -1
        old = np.where(is_a, self.alpha[r], self.taste[r, np.maximum(p, 0)])
        mean, var = np.where(is_a, 1.5, 0.0), np.where(is_a, 4.0, 2.25)
        new = np.clip(old + np.clip((g - (old - mean) / var) / (h + 1 / var), -1.0, 1.0) * 0.9, -8, 8)
        self.alpha[r[is_a]] = new[is_a]
        self.taste[r[~is_a], p[~is_a]] = new[~is_a]


def coded(cast: DataFrame, codes: dict[str, list[str]]) -> DataFrame:
    """The distinct vote patterns in blocks: raters' names, and arrays of their places, labels (by slot and row) and counts."""
    patterns = cast.select("task", F.array_sort("votes").alias("votes")).groupBy("task", "votes").agg(F.count(F.lit(1)).alias("n"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            for t, at, who, r, lab in parts(batch, codes):
                yield pa.RecordBatch.from_pydict({"task": [t], "who": pa.array([who.to_pylist()], pa.list_(pa.string())), "rows": pa.array([len(at)], pa.int32()), "r": [r.astype(np.int32).tobytes()], "lab": [lab.astype(np.int32).tobytes()], "n": [n[at].astype(float).tobytes()]})

    return cut(patterns.mapInArrow(code, "task string, who array<string>, rows int, r binary, lab binary, n binary"))


def fit(cast: DataFrame, codes: dict[str, list[str]], rounds: int = ROUNDS) -> Model:
    """Fit the model on all votes. Each round is one pass over the distinct vote patterns, coded once."""
    blocks = coded(cast, codes)
    raters = blocks.select("task", F.explode("who").alias("rater")).distinct().limit(MAX_RATERS + 1).collect()
    if len(raters) > MAX_RATERS:
        raise ValueError(f"over {MAX_RATERS} raters; their parameters don't fit the driver")
    model = Model(codes, sorted((r.task, r.rater) for r in raters))
    for _ in range(rounds if raters else 0):
        held = model

        def tell(batches: Iterator[pa.RecordBatch], held: Model = held) -> Iterator[pa.RecordBatch]:
            sums = []
            for batch in batches:
                for t, who, rows, r, lab, n in zip(batch.column("task").to_pylist(), batch.column("who"), *(batch.column(c).to_pylist() for c in ("rows", "r", "lab", "n")), strict=True):
                    sums.append(held.statistics(t, who.values, *(np.frombuffer(x, np.int32).reshape(-1, rows).astype(int) for x in (r, lab)), np.frombuffer(n)))
            if sums:
                rater, param, g, h = np.concatenate(sums, 1)
                key, at = np.unique(rater.astype(int) * (2 * held.k + 1) + param.astype(int) + held.k + 1, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"rater": key // (2 * held.k + 1), "param": key % (2 * held.k + 1) - held.k - 1, "g": np.bincount(at, g), "h": np.bincount(at, h)})

        sums = blocks.mapInArrow(tell, "rater long, param long, g double, h double").groupBy("rater", "param").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        model.step(sums.sort_values(["rater", "param"]))
    return model


def consensus(cast: DataFrame, model: Model) -> DataFrame:
    """(sample_id, task, label_code, posterior, easiness, n_votes); equal posteriors go to the lower rank_no."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, at, who, r, lab in parts(batch, model.codes):
                q, beta, *_ = model.posterior(t, model.numbers(t, who), r, lab)
                best = q.round(9).argmax(0)
                n = (r < len(who)).sum(0).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"sample_id": batch.column("sample_id").take(pa.array(at)), "task": pa.array([t] * len(at)), "label_code": pa.array(model.codes[t]).take(pa.array(best)), "posterior": q[best, np.arange(len(at))], "easiness": beta, "n_votes": n})

    return cast.mapInArrow(judge, "sample_id long, task string, label_code string, posterior double, easiness double, n_votes int")


def reliability(spark: SparkSession, model: Model) -> DataFrame:
    """One row per rater: ability, and the expected share of right labels on an item of middling difficulty."""
    rows = []
    for i, (task, rater) in enumerate(model.raters):
        k = len(model.codes[task])
        e = np.exp(model.taste[i, :k])
        up = e * np.exp(model.alpha[i])
        rows.append((task, rater, float(model.alpha[i]), float((model.prior[task] * up / (e.sum() - e + up)).sum())))
    return spark.createDataFrame(rows, "task string, rater_id string, ability double, expected_accuracy double")


def agreement(cast: DataFrame) -> DataFrame:
    """Krippendorff's alpha (nominal) and Fleiss' kappa per task over items with two votes or more; NULL where undefined."""
    counts = cast.select("sample_id", "task", F.explode("votes.label").alias("label")).groupBy("sample_id", "task", "label").agg(F.count(F.lit(1)).alias("c"))
    items = counts.groupBy("sample_id", "task").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m >= 2")
    per_item = items.groupBy("task").agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_votes"), F.avg(F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("p_item"), F.sum(F.col("same") / (F.col("m") - 1)).alias("same_w"))
    shares = counts.groupBy("task", "label").agg(F.sum("c").alias("c")).groupBy("task").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * (F.col("c") - 1)).alias("c1"))
    pe, de = F.col("cc") / F.col("n") / F.col("n"), 1 - F.col("c1") / (F.col("n") * (F.col("n") - 1))
    return per_item.join(shares, "task").select("task", "n_items", "n_votes", F.col("p_item").alias("observed"), F.when(pe < 1, (F.col("p_item") - pe) / (1 - pe)).alias("fleiss_kappa"), F.when(de > 0, 1 - (1 - F.col("same_w") / F.col("n_votes")) / de).alias("krippendorff_alpha"))


def _cast(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[str]]]:
    return votes(table(spark, sf_dir, "samples"), table(spark, sf_dir, "label_set"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label_code): the consensus of every sample with three usable labels or more."""
    cast, codes = _cast(spark, sf_dir)
    cast = cut(cast)
    return consensus(cast, fit(cast, codes)).select("sample_id", "label_code")


def p2_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability per rater and task."""
    cast, codes = _cast(spark, sf_dir)
    return reliability(spark, fit(cast, codes))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement per task."""
    out = agreement(_cast(spark, sf_dir)[0])
    return out.select("task", "n_items", "n_votes", *[F.round(c, 6).alias(c) for c in ("observed", "fleiss_kappa", "krippendorff_alpha")])


_PLAIN = """regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN contains(h, '{') THEN coalesce(CASE WHEN json_valid(h) THEN coalesce(json_extract_string(h, '$.label'), json_extract_string(h, '$."标签"')) END, h) ELSE h END), '^[\\s\\p{P}\\p{Z}]+|[\\s\\p{P}\\p{Z};]+$', '', 'g'), '^\\d+\\s*[-_.、]\\s*(\\D)', '\\1'), '^(\\d+)\\.0+$', '\\1')"""
_WIDE = "'" + _FULL.replace("'", "''") + "'"
_NARROW = "'" + _HALF.replace("'", "''") + "'"
P2_AGREEMENT = f"""WITH once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1),
nm AS (SELECT task, rank_no, label_code, lower(trim(unnest([label_code, name_en, name_zh]))) AS k FROM label_set WHERE task <> 'image_classification'),
lk AS (SELECT task, k, first(label_code ORDER BY rank_no, label_code) AS code FROM nm WHERE k IS NOT NULL AND k <> '' GROUP BY ALL),
an AS (SELECT sample_id, task, unnest([annotation_1, annotation_2, annotation_3, annotation_4, annotation_5]) AS raw FROM once WHERE task IN (SELECT task FROM lk)),
pl AS (SELECT sample_id, task, raw, translate(raw, {_WIDE}, {_NARROW}) AS h FROM an WHERE raw IS NOT NULL),
vt AS (SELECT sample_id, p.task, coalesce(a.code, b.code) AS label FROM (SELECT *, lower(raw) AS k1, {_PLAIN} AS k2 FROM pl) p LEFT JOIN lk a ON a.task = p.task AND a.k = p.k1 LEFT JOIN lk b ON b.task = p.task AND b.k = p.k2),
us AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS votes FROM vt WHERE label IS NOT NULL),
ct AS (SELECT sample_id, task, label, count(*) AS c FROM us WHERE votes >= 3 GROUP BY ALL),
it AS (SELECT sample_id, task, sum(c) AS m, sum(c * (c - 1)) AS same FROM ct GROUP BY ALL HAVING sum(c) >= 2),
pi AS (SELECT task, count(*) AS n_items, sum(m)::BIGINT AS n_votes, avg(same::DOUBLE / (m * (m - 1))) AS p_item, sum(same::DOUBLE / (m - 1)) AS same_w FROM it GROUP BY task),
sh AS (SELECT task, sum(c)::DOUBLE AS n, sum(c * c)::DOUBLE AS cc, sum(c * (c - 1))::DOUBLE AS c1 FROM (SELECT task, label, sum(c) AS c FROM ct GROUP BY ALL) GROUP BY task)
SELECT task, n_items, n_votes, round(p_item, 6) AS observed, round(CASE WHEN cc / n / n < 1 THEN (p_item - cc / n / n) / (1 - cc / n / n) END, 6) AS fleiss_kappa,
 round(CASE WHEN 1 - c1 / (n * (n - 1)) > 0 THEN 1 - (1 - same_w / n_votes) / (1 - c1 / (n * (n - 1))) END, 6) AS krippendorff_alpha FROM pi JOIN sh USING (task)"""

SQL = {"p2_agreement": P2_AGREEMENT}
QUERIES = {"p2_found": p2_found, "p2_raters": p2_raters, "p2_agreement": p2_agreement}
