"""Agreement between annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import agreement as A
from ..tables import latest, table
from .base import BLANK_SQL, GATHERED, labelled, samples_once

COLS = [f"l{i}" for i in range(1, 6)]
R = lambda c: F.round(c, 6).alias(c)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    return df.select("sample_id", "task", *[L.strip(F.col(f"annotation_{i}")).alias(f"l{i}") for i in range(1, 6)])


def agg11_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC1 and kappa of each pair of annotation slots, per task."""
    out = A.pairwise(A.rater_pairs(_wide(spark, sf_dir), ["task"], COLS), ["task", "rater_1", "rater_2"])
    return out.select("task", F.col("rater_1").cast("long").alias("rater_1"), F.col("rater_2").cast("long").alias("rater_2"), "n", "agreements", "n_categories", R("pa"), R("ac1_ref"), R("ac1"), R("kappa"))


PAIRS = f"""{GATHERED},
w AS (SELECT sample_id, task, list_transform(a, lambda x: trim(x, {BLANK_SQL})) AS a FROM kept),
pr AS (SELECT task, i AS rater_1, j AS rater_2, a[i] AS x, a[j] AS y FROM w, range(1, 6) t(i), range(1, 6) u(j) WHERE i < j AND a[i] IS NOT NULL AND a[j] IS NOT NULL),
cell AS (SELECT task, rater_1, rater_2, x, y, count(*) AS n FROM pr GROUP BY ALL),
tot AS (SELECT task, rater_1, rater_2, sum(n)::BIGINT AS n, sum(CASE WHEN x = y THEN n ELSE 0 END)::BIGINT AS agreements FROM cell GROUP BY ALL),
mar AS (SELECT task, rater_1, rater_2, l, sum(a) AS a, sum(b) AS b FROM (SELECT task, rater_1, rater_2, x AS l, n AS a, 0 AS b FROM cell UNION ALL SELECT task, rater_1, rater_2, y, 0, n FROM cell) GROUP BY ALL),
ch AS (SELECT m.task, m.rater_1, m.rater_2, sum((a + b) / (2.0::DOUBLE * n) * (1 - (a + b) / (2.0::DOUBLE * n))) AS pe1, sum(a::DOUBLE / n * b::DOUBLE / n) AS pe2, count(*) AS n_categories FROM mar m JOIN tot USING (task, rater_1, rater_2) GROUP BY ALL),
fin AS (SELECT task, rater_1, rater_2, n, agreements, n_categories, agreements::DOUBLE / n AS pa, pe1, CASE WHEN n_categories > 1 THEN pe1 / (n_categories - 1) ELSE 0 END AS pe1b, pe2 FROM tot JOIN ch USING (task, rater_1, rater_2)),
pw AS (SELECT task, rater_1, rater_2, n, agreements, n_categories, pa,
 CASE WHEN pe1 >= 1 THEN CASE WHEN pa >= 1 THEN 1.0 ELSE 0.0 END ELSE (pa - pe1) / (1 - pe1) END AS ac1_ref, CASE WHEN pe1b >= 1 THEN CASE WHEN pa >= 1 THEN 1.0 ELSE 0.0 END ELSE (pa - pe1b) / (1 - pe1b) END AS ac1,
 CASE WHEN pe2 >= 1 THEN CASE WHEN pa >= 1 THEN 1.0 ELSE 0.0 END ELSE (pa - pe2) / (1 - pe2) END AS kappa FROM fin)"""
AGG11 = f"WITH {PAIRS} SELECT task, rater_1, rater_2, n, agreements, n_categories, round(pa, 6) AS pa, round(ac1_ref, 6) AS ac1_ref, round(ac1, 6) AS ac1, round(kappa, 6) AS kappa FROM pw"


def agg12_fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleiss' kappa of the annotation slots, per task."""
    long = A.long_labels(_wide(spark, sf_dir), ["task", "sample_id"], COLS).withColumnRenamed("sample_id", "item")
    return A.fleiss(long, ["task"]).select("task", "n_items", "valid_items", "n_categories", R("p_bar"), R("p_e"), R("fleiss_kappa"))


def _fleiss_sql(base: str, by: str) -> str:
    return f"""{base},
ic AS (SELECT {by}, item, label, count(label) AS c FROM lab GROUP BY ALL),
it AS (SELECT {by}, item, sum(c) AS n, sum(c * c) AS sq FROM ic GROUP BY ALL),
per AS (SELECT {by}, count(*) AS n_items, count(*) FILTER (n >= 2) AS valid_items, avg(CASE WHEN n >= 2 THEN (sq - n)::DOUBLE / (n * (n - 1)) END) AS p_bar FROM it GROUP BY ALL),
ct AS (SELECT {", ".join("ic." + b.strip() for b in by.split(","))}, label, sum(CASE WHEN n >= 2 THEN c ELSE 0 END) AS t FROM ic JOIN it USING ({by}, item) WHERE label IS NOT NULL GROUP BY ALL),
ce AS (SELECT {by}, count(*) AS n_categories, CASE WHEN sum(t) > 0 THEN sum(t * t)::DOUBLE / (sum(t)::DOUBLE * sum(t)::DOUBLE) END AS p_e FROM ct GROUP BY ALL),
fl AS (SELECT {by}, n_items, valid_items, n_categories, p_bar, p_e, CASE WHEN p_e >= 1 THEN CASE WHEN p_bar >= 1 THEN 1.0 ELSE 0.0 END ELSE (p_bar - p_e) / (1 - p_e) END AS fleiss_kappa FROM per JOIN ce USING ({by}))"""


_LAB = f"{GATHERED}, lab AS (SELECT task, sample_id AS item, trim(a[i], {BLANK_SQL}) AS label FROM kept, range(1, 6) t(i))"
_ROUND = "round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round(fleiss_kappa, 6) AS fleiss_kappa"
AGG12 = f"WITH {_fleiss_sql(_LAB, 'task')} SELECT task, n_items, valid_items, n_categories, {_ROUND} FROM fl"


def agg18_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task: means over the ten pairs of slots, and Fleiss' kappa."""
    pairs = A.pairwise(A.rater_pairs(_wide(spark, sf_dir), ["task"], COLS), ["task", "rater_1", "rater_2"])
    mean = pairs.groupBy("task").agg(F.count(F.lit(1)).alias("n_pairs"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("pa", "ac1_ref", "kappa")])
    return mean.join(agg12_fleiss(spark, sf_dir).select("task", "fleiss_kappa"), "task")


AGG18 = f"""WITH {PAIRS}, mean AS (SELECT task, count(*) AS n_pairs, round(avg(pa), 6) AS mean_pa, round(avg(ac1_ref), 6) AS mean_ac1_ref, round(avg(kappa), 6) AS mean_kappa FROM pw GROUP BY task),
f AS ({AGG12}) SELECT task, n_pairs, mean_pa, mean_ac1_ref, mean_kappa, fleiss_kappa FROM mean JOIN f USING (task)"""


def agg19_image_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleiss' kappa of the two category fields of image annotations, numbers before the label left out."""
    once = latest(table(spark, sf_dir, "image_annotations").where("ann_id is not null and sample_id is not null"), ["ann_id"], ["submitted_at"])
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), L.without_number(F.col(c)).alias("label")) for n, c in (("level_1", "一级品类"), ("level_2", "二级品类"))]))
    long = once.select(F.col("sample_id").alias("item"), fields.alias("f")).select("item", "f.field", L.none_if_blank(F.col("f.label")).alias("label"))
    return A.fleiss(long, ["field"]).select("field", "n_items", "valid_items", "n_categories", R("p_bar"), R("p_e"), R("fleiss_kappa"))


def _plain(c: str) -> str:
    s = f"trim({c}, {BLANK_SQL})"
    return f"nullif(coalesce(nullif(trim(regexp_extract({s}, '^\\d+\\s*[-–—:]\\s*(.+)$', 1), {BLANK_SQL}), ''), {s}), '')"


_IMG = f"""img AS (SELECT * FROM image_annotations WHERE ann_id IS NOT NULL AND sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ann_id ORDER BY submitted_at DESC NULLS LAST) = 1),
lab AS (SELECT 'level_1' AS field, sample_id AS item, {_plain('"一级品类"')} AS label FROM img UNION ALL SELECT 'level_2', sample_id, {_plain('"二级品类"')} FROM img)"""
AGG19 = f"WITH {_fleiss_sql(_IMG, 'field')} SELECT field, n_items, valid_items, n_categories, {_ROUND} FROM fl"


def _entity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples_once(spark, sf_dir).where("task = 'entity_extraction'")
    clean = lambda c: F.array_distinct(F.transform(F.coalesce(F.from_json(c, L.ENTITY), F.array()), lambda e: F.struct(F.coalesce(e.text, F.lit("")).alias("text"), F.coalesce(e.category, F.lit("")).alias("category"))))
    return df.select("sample_id", *[clean(F.when(F.col(f"annotation_{i}").startswith("["), F.col(f"annotation_{i}"))).alias(f"l{i}") for i in range(1, 6)])


def _ent(i: int) -> str:
    return f"list_distinct(list_transform(coalesce(from_json(CASE WHEN starts_with(annotation_{i}, '[') AND json_valid(annotation_{i}) THEN annotation_{i} END, '[{{\"text\":\"VARCHAR\",\"category\":\"VARCHAR\"}}]'), []), lambda e: coalesce(e.text, '') || chr(1) || coalesce(e.category, '')))"


_ENT = f"""once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1),
e AS (SELECT sample_id, [{", ".join(_ent(i) for i in range(1, 6))}] AS s FROM once WHERE task = 'entity_extraction'),
ep AS (SELECT sample_id, s[i] AS a, s[j] AS b, i, j FROM e, range(1, 6) t(i), range(1, 6) u(j) WHERE i < j)"""


def agg16_entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match and pairwise F1 of the annotators' entity sets, per sample."""
    out = A.entity_pairs(_entity_sets(spark, sf_dir), "sample_id", COLS)
    return out.select("sample_id", R("exact_match"), R("pairwise_f1"))


AGG16 = f"""WITH {_ENT}, x AS (SELECT sample_id, len(a) AS m, len(b) AS n, len(list_intersect(a, b)) AS o FROM ep)
SELECT sample_id, round(avg((m = n AND o = m)::INT::DOUBLE), 6) AS exact_match, round(avg(CASE WHEN m = 0 AND n = 0 THEN 1.0::DOUBLE WHEN o = 0 THEN 0.0 ELSE 2.0::DOUBLE * o / (m + n) END), 6) AS pairwise_f1 FROM x GROUP BY sample_id"""


def agg14_entity_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC1 and kappa of the first two annotators on naming each entity."""
    pairs = A.entity_binary(_entity_sets(spark, sf_dir), "sample_id", "l1", "l2").withColumn("g", F.lit("l1-l2"))
    return A.pairwise(pairs, ["g"]).select("n", "agreements", R("pa"), R("ac1_ref"), R("kappa"))


AGG14 = f"""WITH {_ENT}, u AS (SELECT unnest(list_distinct(list_concat(a, b))) AS v, a, b FROM ep WHERE i = 1 AND j = 2), d AS (SELECT list_contains(a, v)::INT AS x, list_contains(b, v)::INT AS y FROM u),
t AS (SELECT count(*) AS n, sum((x = y)::INT)::BIGINT AS agreements, avg(x) AS p, avg(y) AS q FROM d),
z AS (SELECT n, agreements, agreements::DOUBLE / n AS pa, 2 * ((p + q) / 2) * (1 - (p + q) / 2) AS pe1, p * q + (1 - p) * (1 - q) AS pe2 FROM t)
SELECT n, agreements, round(pa, 6) AS pa, round((pa - pe1) / (1 - pe1), 6) AS ac1_ref, round((pa - pe2) / (1 - pe2), 6) AS kappa FROM z WHERE n > 0"""


def agg13_entity_fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleiss' kappa of naming each entity."""
    return A.entity_fleiss(_entity_sets(spark, sf_dir), "sample_id", COLS).select("n_decisions", R("p_bar"), R("p_e"), R("fleiss_kappa"))


AGG13 = f"""WITH {_ENT}, u AS (SELECT s, unnest(list_distinct(flatten(s))) AS v FROM e), y AS (SELECT len(list_filter(s, lambda r: list_contains(r, v))) AS y FROM u),
t AS (SELECT count(*) AS n_decisions, avg((y * y + (5 - y) * (5 - y) - 5) / 20.0::DOUBLE) AS p_bar, avg(y / 5.0::DOUBLE) AS s FROM y)
SELECT n_decisions, round(p_bar, 6) AS p_bar, round(s * s + (1 - s) * (1 - s), 6) AS p_e, round((p_bar - (s * s + (1 - s) * (1 - s))) / (1 - (s * s + (1 - s) * (1 - s))), 6) AS fleiss_kappa FROM t"""


def agg15_entity_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro scores of the first annotator against the entities that three or more of the five name."""
    sets = _entity_sets(spark, sf_dir).withColumn("all", F.array(*COLS))
    return A.entity_micro(sets, "l1", "all").select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], R("precision"), R("recall"), R("f1"))


AGG15 = f"""WITH {_ENT}, m AS (SELECT s[1] AS told, list_filter(list_distinct(flatten(s)), lambda v: len(list_filter(flatten(s), lambda x: x = v)) >= 3) AS gold FROM e),
t AS (SELECT sum(len(list_intersect(told, gold)))::BIGINT AS tp, sum(len(told) - len(list_intersect(told, gold)))::BIGINT AS fp, sum(len(gold) - len(list_intersect(told, gold)))::BIGINT AS fn FROM m)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM t"""

QUERIES = {f.__name__: f for f in (agg11_pairwise, agg12_fleiss, agg18_people, agg19_image_fields, agg16_entity_pairs, agg14_entity_kappa, agg13_entity_fleiss, agg15_entity_micro)}
SQL = {"agg11_pairwise": AGG11, "agg12_fleiss": AGG12, "agg18_people": AGG18, "agg19_image_fields": AGG19, "agg16_entity_pairs": AGG16, "agg14_entity_kappa": AGG14, "agg13_entity_fleiss": AGG13, "agg15_entity_micro": AGG15}
