"""The agreement report: the model against each of the five annotators and the annotators among themselves, by task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import readers as R
from ..operators import agreement as A
from ..tables import cut
from .agreement import _ent, _fleiss_sql
from .base import BLANK_SQL, ONCE, RESULTS, TASKS, results_once, samples_once
from .evaluation import _AFTER, _block, _kv, _metric

SIX = [f"l{i}" for i in range(6)]  # the model first, then the annotators
ROUND = lambda c: F.round(c, 6)


def _items(spark: SparkSession, sf_dir: str, where: Column) -> DataFrame:
    """Every answer of a model beside the five annotations of its sample."""
    s = samples_once(spark, sf_dir).where(where).select("sample_id", *[f"annotation_{i}" for i in range(1, 6)])
    return results_once(spark, sf_dir).where(where).select("result_id", "sample_id", "task", "annotation").join(s, "sample_id")


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.col("task")
    items = _items(spark, sf_dir, task.isin(*TASKS))
    return cut(items.select(F.col("result_id").alias("item"), "task", R.metric_label(F.col("annotation"), task).alias("label"), *[R.human_label(F.col(f"annotation_{i}"), task).alias(f"l{i}") for i in range(1, 6)]))


def comparison(wide: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (item, l0 ... l5): means of the model's five pairs and the annotators' ten, and Fleiss' kappa of all and of people.

    l0 is the model's label, NULL where it could not be read; a pair without a common item has no part in a mean.
    """
    pairs = A.pairwise(A.rater_pairs(wide, by, SIX), [*by, "rater_1", "rater_2"])
    model = F.col("rater_1") == 1
    mean = lambda c, who, name: ROUND(F.avg(F.when(who, F.col(c)))).alias(name)
    means = pairs.groupBy(*by).agg(mean("ac1_ref", model, "llm_ac1"), mean("kappa", model, "llm_kappa"), mean("ac1_ref", ~model, "human_ac1"), mean("kappa", ~model, "human_kappa"))
    kappa = lambda cols, name: A.fleiss(A.long_labels(wide, [*by, "item"], cols), by).select(*by, ROUND("fleiss_kappa").alias(name))
    return means.join(kappa(SIX, "fleiss_all"), by, "left").join(kappa(SIX[1:], "fleiss_human"), by, "left")


def agg18_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per single-label task: answers, those with a missing annotation, categories of the model, and the comparison."""
    wide = _single(spark, sf_dir)
    missing = reduce(lambda a, b: a | b, [F.col(f"l{i}").isNull() for i in range(1, 6)])
    counts = wide.groupBy("task").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(missing).alias("n_skipped"), F.count_distinct("label").alias("n_categories"))
    return counts.join(comparison(wide.withColumn("l0", F.when(F.col("label") != L.PARSE_ERROR, F.col("label"))), ["task"]), "task")


def agg18_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per single-label task and annotator: agreement of the model with that annotator."""
    wide = _single(spark, sf_dir).withColumn("l0", F.when(F.col("label") != L.PARSE_ERROR, F.col("label")))
    both = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("annotator"), F.col("l0").alias("label_1"), F.col(f"l{i}").alias("label_2")) for i in range(1, 6)]))
    pairs = wide.select("task", both.alias("p")).select("task", "p.*").where("label_1 is not null and label_2 is not null")
    return A.pairwise(pairs, ["task", "annotator"]).select("task", "annotator", F.col("n").alias("n_valid"), ROUND("pa").alias("pa"), ROUND("ac1_ref").alias("ac1_ref"), ROUND("kappa").alias("kappa"))


def agg18_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the model gives each label, per single-label task; unread answers under the parse error mark."""
    return _single(spark, sf_dir).groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir, F.col("task") == "image_classification")
    read = items.select("result_id", R.model_fields(F.col("annotation")).alias("f0"), *[R.human_fields(F.col(f"annotation_{i}")).alias(f"f{i}") for i in range(1, 6)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), *[F.col(f"f{i}.field_{n}").alias(f"l{i}") for i in range(6)]) for n, k in enumerate(R.IMAGE_FIELDS, 1)]))
    return cut(read.select(F.col("result_id").alias("item"), each.alias("x")).select("item", "x.*"))


def agg19_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison for each of the three fields of image classification, and the mean of the three ('macro')."""
    fields = cut(comparison(_fields(spark, sf_dir), ["field"]))
    names = [c for c in fields.columns if c != "field"]
    macro = fields.agg(*[ROUND(F.avg(c)).alias(c) for c in names]).select(F.lit("macro").alias("field"), *names)
    return fields.unionByName(macro)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda e: F.array_distinct(F.transform(F.coalesce(e, F.array()), lambda x: F.struct(F.coalesce(x.text, F.lit("")).alias("text"), F.coalesce(x.category, F.lit("")).alias("category"))))
    items = _items(spark, sf_dir, F.col("task") == "entity_extraction")
    return items.select(F.col("result_id").alias("item"), clean(L.entities(F.col("annotation"))).alias("l0"), *[clean(F.from_json(F.when(F.col(f"annotation_{i}").startswith("["), F.col(f"annotation_{i}")), L.ENTITY)).alias(f"l{i}") for i in range(1, 6)])


def agg20_entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: agreement on naming entities of the model with the annotators and among these, micro scores of the model, and
    exact matches and pairwise F1 with and without the model.
    """
    sets = cut(_sets(spark, sf_dir))
    named = sets.select("item", F.explode(F.array_distinct(F.flatten(F.array(*SIX)))).alias("e"), *SIX)
    told = [F.array_contains(c, F.col("e")).cast("int") for c in SIX]
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("rater_1"), F.lit(j).alias("rater_2"), told[i].alias("label_1"), told[j].alias("label_2")) for i in range(6) for j in range(i + 1, 6)]))
    pairs = A.pairwise(named.select(every.alias("p")).select("p.*").where("label_1 + label_2 > 0"), ["rater_1", "rater_2"])  # named by one of the two
    mean = lambda c, who, name: ROUND(F.avg(F.when(who, F.col(c)))).alias(name)
    model = F.col("rater_1") == 0
    out = pairs.agg(mean("ac1_ref", model, "llm_ac1"), mean("kappa", model, "llm_kappa"), mean("ac1_ref", ~model, "human_ac1"), mean("kappa", ~model, "human_kappa"))
    micro = A.entity_micro(sets.withColumn("raters", F.array(*SIX[1:])), "l0", "raters").select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], ROUND("precision").alias("precision"), ROUND("recall").alias("recall"), ROUND("f1").alias("f1"))
    both = [A.entity_pairs(sets, "item", cols).agg(F.count(F.lit(1)).alias("n_items"), ROUND(F.avg("exact_match")).alias(f"exact_{who}"), ROUND(F.avg("pairwise_f1")).alias(f"f1_{who}")) for cols, who in ((SIX, "all"), (SIX[1:], "human"))]
    return out.join(micro, F.lit(True)).join(both[0], F.lit(True)).join(both[1].drop("n_items"), F.lit(True))  # single rows


def agg31_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of all tasks in one table; there is no Fleiss' kappa of entity lists."""
    names = ["llm_ac1", "human_ac1", "llm_kappa", "human_kappa", "fleiss_all", "fleiss_human"]
    single = comparison(_single(spark, sf_dir).withColumn("l0", F.when(F.col("label") != L.PARSE_ERROR, F.col("label"))), ["task"]).select("task", *names)
    image = agg19_report(spark, sf_dir).where("field = 'macro'").select(F.lit("image_classification").alias("task"), *names)
    none = F.lit(None).cast("double")
    entity = agg20_entity_report(spark, sf_dir).select(F.lit("entity_extraction").alias("task"), *names[:4], none.alias("fleiss_all"), none.alias("fleiss_human"))
    return single.unionByName(image).unionByName(entity)


# --- the same in SQL


def _text(c: str) -> str:
    return f"(CASE WHEN {c} = floor({c}) AND abs({c}) < 1e15 THEN ({c})::BIGINT::VARCHAR || '.0' ELSE ({c})::VARCHAR END)"


def _trim(c: str) -> str:
    return f"trim({c}, {BLANK_SQL})"


def _bare(c: str) -> str:
    return f"coalesce(nullif({_trim(f"regexp_extract({_trim(c)}, '^\\d+\\s*[-–—:]\\s*(.+)$', 1)")}, ''), {_trim(c)})"


def _digit(c: str) -> str:
    v = _trim(f"coalesce({c}, '0')")
    alone = " ".join(f"WHEN regexp_matches({v}, '(?:^|[^\\\\d]){d}(?:[^\\\\d]|$)') THEN '{d}'" for d in "012")
    return f"coalesce(CASE WHEN {v} IN ('0', '1', '2') THEN {v} END, CASE {alone} END, nullif(regexp_extract({v}, '[012]'), ''), '0')"


def _grade_text(c: str) -> str:
    return f"(SELECT {_text('g')} FROM (SELECT {_metric(c)} AS g))"


_FENCE = "nullif(regexp_extract(annotation, '```json\\s*(.*?)\\s*```', 1, 's'), '')"
_HUMAN = "CASE task WHEN 'image_text_relevance' THEN coalesce(" + _text("hm") + ", " + _trim("h") + ") WHEN 'image_attribution_recognition' THEN " + _digit("h") + " WHEN 'social_text_classification' THEN " + _bare("h") + " ELSE " + _trim("h") + " END"
_MODEL = f"""CASE task WHEN 'image_text_relevance' THEN CASE WHEN coalesce(annotation, '') = '' THEN '{L.PARSE_ERROR}' ELSE coalesce(CASE WHEN block IS NOT NULL THEN coalesce({_text('fm')}, {_trim('field')}) END, {_text('km')}, kv, {_text('am')}, ac, {_text('tm')}, '{L.PARSE_ERROR}') END
 WHEN 'image_attribution_recognition' THEN CASE WHEN block IS NOT NULL THEN {_digit('field')} ELSE {_digit('coalesce(kv, annotation)')} END
 WHEN 'social_text_classification' THEN CASE WHEN coalesce(annotation, '') = '' THEN '{L.PARSE_ERROR}' ELSE {_bare("coalesce(nullif(CASE WHEN block IS NOT NULL THEN label0 ELSE kv END, ''), annotation)")} END
 ELSE coalesce(CASE WHEN json_valid(fence) AND starts_with(fence, '{{') THEN coalesce(json_extract_string(fence, '$.label'), json_extract_string(fence, '$."' || json_keys(fence)[1] || '"')) END, CASE WHEN json_valid(fence) AND starts_with(fence, '"') THEN json_extract_string(fence, '$') END, '{L.PARSE_ERROR}') END"""
_IN = ", ".join(f"'{t}'" for t in TASKS)
_WIDE = f"""{ONCE}, {RESULTS},
it AS (SELECT res.result_id AS item, res.task, res.annotation, [annotation_1, annotation_2, annotation_3, annotation_4, annotation_5] AS hs FROM res JOIN once USING (sample_id) WHERE res.task IN ({_IN}) AND once.task IN ({_IN})),
r1 AS (SELECT item, task, annotation, {_block('annotation')} AS block, nullif({_kv('annotation', 'label')}, '') AS kv, {_FENCE} AS fence,
 CASE WHEN contains(lower(annotation), 'label') THEN {_trim("nullif(regexp_extract(annotation, '[:：]\\s*\"?([^\"'',\\n]+)\"?', 1), '')")} END AS ac FROM it),
r2 AS (SELECT *, json_extract_string(block, '$.label') AS label0, coalesce(json_extract_string(block, '$.label'), '') AS field FROM r1),
r3 AS (SELECT *, {_metric('field')} AS fm, {_metric('kv')} AS km, {_metric('ac')} AS am, {_metric('annotation')} AS tm FROM r2),
md AS (SELECT item, task, {_MODEL} AS label FROM r3),
h1 AS (SELECT item, task, i AS rater, hs[i] AS h FROM it, range(1, 6) t(i) WHERE hs[i] IS NOT NULL), h2 AS (SELECT *, {_metric('h')} AS hm FROM h1), h3 AS (SELECT item, task AS g, rater, {_HUMAN} AS label FROM h2),
al AS (SELECT item, task AS g, 0 AS rater, CASE WHEN label <> '{L.PARSE_ERROR}' THEN label END AS label FROM md UNION ALL SELECT item, g, rater, label FROM h3)"""


def _pairs(al: str, by: str = "g") -> str:
    """Pair statistics from al (g, item, rater, label)."""
    return f"""{al},
pr AS (SELECT x.{by}, x.rater AS r1, y.rater AS r2, x.label AS x, y.label AS y FROM al x JOIN al y ON x.{by} = y.{by} AND x.item = y.item AND x.rater < y.rater WHERE x.label IS NOT NULL AND y.label IS NOT NULL),
{_STATS.replace('GG', by)}"""


_STATS = """cell AS (SELECT GG, r1, r2, x, y, count(*) AS n FROM pr GROUP BY ALL),
tot AS (SELECT GG, r1, r2, sum(n)::BIGINT AS n, sum(CASE WHEN x = y THEN n ELSE 0 END)::BIGINT AS same FROM cell GROUP BY ALL),
mar AS (SELECT GG, r1, r2, l, sum(a) AS a, sum(b) AS b FROM (SELECT GG, r1, r2, x AS l, n AS a, 0 AS b FROM cell UNION ALL SELECT GG, r1, r2, y, 0, n FROM cell) GROUP BY ALL),
ch AS (SELECT m.GG, m.r1, m.r2, sum((a + b) / (2.0::DOUBLE * n) * (1 - (a + b) / (2.0::DOUBLE * n))) AS e1, sum(a::DOUBLE / n * b::DOUBLE / n) AS e2 FROM mar m JOIN tot USING (GG, r1, r2) GROUP BY ALL),
pw AS (SELECT GG, r1, r2, n, same::DOUBLE / n AS pa, CASE WHEN e1 >= 1 THEN CASE WHEN same >= n THEN 1.0 ELSE 0.0 END ELSE (same::DOUBLE / n - e1) / (1 - e1) END AS ac1, CASE WHEN e2 >= 1 THEN CASE WHEN same >= n THEN 1.0 ELSE 0.0 END ELSE (same::DOUBLE / n - e2) / (1 - e2) END AS kappa FROM tot JOIN ch USING (GG, r1, r2)),
mean AS (SELECT GG, round(avg(ac1) FILTER (r1 = 0), 6) AS llm_ac1, round(avg(kappa) FILTER (r1 = 0), 6) AS llm_kappa, round(avg(ac1) FILTER (r1 > 0), 6) AS human_ac1, round(avg(kappa) FILTER (r1 > 0), 6) AS human_kappa FROM pw GROUP BY GG)"""


def _kappas(al: str) -> str:
    """means and Fleiss' kappas: cmp (g, ...)."""
    one = lambda name, where: f"SELECT g, round(fleiss_kappa, 6) AS {name} FROM (WITH {_fleiss_sql(f'lab AS (SELECT g, item, label FROM al {where})', 'g')} SELECT * FROM fl)"
    return f"""{_pairs(al)},
cmp AS (SELECT * FROM mean LEFT JOIN ({one('fleiss_all', '')}) USING (g) LEFT JOIN ({one('fleiss_human', 'WHERE rater > 0')}) USING (g))"""


AGG18 = f"""WITH {_kappas(_WIDE)},
ct AS (SELECT md.task AS g, count(*) AS n_items, count(DISTINCT label) AS n_categories, count(*) FILTER (len(list_filter(hs, lambda x: x IS NULL)) > 0) AS n_skipped FROM md JOIN it USING (item) GROUP BY md.task)
SELECT g AS task, n_items, n_skipped, n_categories, llm_ac1, llm_kappa, human_ac1, human_kappa, fleiss_all, fleiss_human FROM ct JOIN cmp USING (g)"""
AGG18P = f"WITH {_pairs(_WIDE)} SELECT g AS task, r2::BIGINT AS annotator, n AS n_valid, round(pa, 6) AS pa, round(ac1, 6) AS ac1_ref, round(kappa, 6) AS kappa FROM pw WHERE r1 = 0"
AGG18D = f"WITH {_WIDE} SELECT task, label, count(*) AS n FROM md GROUP BY ALL"


def _field(j: str, key: str) -> str:
    v = f"json_extract_string({j}, '$.\"{key}\"')"
    items = f"from_json(CASE WHEN starts_with({v}, '[') AND json_valid({v}) THEN {v} END, '[\"VARCHAR\"]')"
    if key == R.IMAGE_FIELDS[2]:
        pattern = "([^，,、\\s\\[\\]''\"]*导向)"
        found = f"list_filter(list_transform({items}, lambda x: regexp_extract(x, '{pattern}', 1)), lambda x: x <> '')"
        every = f"regexp_extract_all({v}, '{pattern}', 1)"
        return f"CASE WHEN {items} IS NOT NULL THEN CASE WHEN len({found}) > 0 THEN array_to_string({found}, '、') ELSE '其他' END ELSE CASE WHEN len({every}) > 0 THEN array_to_string({every}, '、') ELSE {_trim(v)} END END"
    return f"CASE WHEN {items} IS NOT NULL THEN coalesce({_bare(f'{items}[1]')}, '其他') ELSE {_bare(v)} END"


_OBJECT = lambda c: f"CASE WHEN json_valid({c}) AND starts_with({_trim(c)}, '{{') THEN {c} END"
_IMAGES = f"""{ONCE}, {RESULTS},
it AS (SELECT res.result_id AS item, res.annotation, [annotation_1, annotation_2, annotation_3, annotation_4, annotation_5] AS hs FROM res JOIN once USING (sample_id) WHERE res.task = 'image_classification' AND once.task = 'image_classification'),
js AS (SELECT item, 0 AS rater, true AS there, {_OBJECT('fence')} AS j FROM (SELECT item, {_FENCE} AS fence FROM it) UNION ALL SELECT item, i, hs[i] IS NOT NULL, {_OBJECT('hs[i]')} FROM it, range(1, 6) t(i)),
al AS ({" UNION ALL ".join(f"SELECT item, '{k}' AS g, rater, CASE WHEN there THEN coalesce({_field('j', k)}, '其他') END AS label FROM js" for k in R.IMAGE_FIELDS)})"""
_NAMES = ("llm_ac1", "llm_kappa", "human_ac1", "human_kappa", "fleiss_all", "fleiss_human")
_MACRO = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _NAMES)
AGG19 = f"WITH {_kappas(_IMAGES)} SELECT g AS field, {', '.join(_NAMES)} FROM cmp UNION ALL SELECT 'macro', {_MACRO} FROM cmp"

_ENTITY = "[{\"text\":\"VARCHAR\",\"category\":\"VARCHAR\"}]"
_ENTITIES = f"""{ONCE}, {RESULTS},
e0 AS (SELECT res.result_id AS item, res.annotation, {", ".join(f"once.annotation_{i}" for i in range(1, 6))} FROM res JOIN once USING (sample_id) WHERE res.task = 'entity_extraction' AND once.task = 'entity_extraction'),
e1 AS (SELECT *, {_AFTER} AS after FROM e0),
e2 AS (SELECT *, CASE WHEN contains(after, '```') THEN coalesce(list_filter(string_split(after, '```'), lambda p: contains(p, '{{') OR contains(p, '"'))[1], after) ELSE after END AS t FROM e1),
e3 AS (SELECT *, coalesce(json_extract({_block('t')}, '$.entities')::VARCHAR, CASE WHEN starts_with({_trim('t')}, '[') THEN t END) AS j FROM e2),
e4 AS (SELECT *, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN list_filter(list_transform(from_json(j, '{_ENTITY}'), lambda e: struct_pack(t := {_trim("coalesce(e.text, '')")}, c := {_trim("coalesce(e.category, '')")})), lambda e: e.t <> '' AND e.c <> '') END AS m FROM e3),
es AS (SELECT item, [list_distinct(list_transform(coalesce(m, []), lambda e: e.t || chr(1) || e.c)), {", ".join(_ent(i) for i in range(1, 6))}] AS s FROM e4)"""
AGG20 = f"""WITH {_ENTITIES},
u AS (SELECT item, s, unnest(list_distinct(flatten(s))) AS v FROM es),
pr AS (SELECT 1 AS g, i - 1 AS r1, j - 1 AS r2, list_contains(s[i], v)::INT AS x, list_contains(s[j], v)::INT AS y FROM u, range(1, 7) a(i), range(1, 7) b(j) WHERE i < j AND (list_contains(s[i], v) OR list_contains(s[j], v))),
{_STATS.replace('GG', 'g')},
mi AS (SELECT s[1] AS told, list_filter(list_distinct(flatten(s[2:])), lambda v: len(list_filter(flatten(s[2:]), lambda x: x = v)) >= 3) AS gold FROM es),
mt AS (SELECT sum(len(list_intersect(told, gold)))::BIGINT AS tp, sum(len(told) - len(list_intersect(told, gold)))::BIGINT AS fp, sum(len(gold) - len(list_intersect(told, gold)))::BIGINT AS fn FROM mi),
ep AS (SELECT item, i, len(s[i]) AS m, len(s[j]) AS n, len(list_intersect(s[i], s[j])) AS o FROM es, range(1, 7) a(i), range(1, 7) b(j) WHERE i < j),
ex AS (SELECT item, i, (m = n AND o = m)::INT::DOUBLE AS e, CASE WHEN m = 0 AND n = 0 THEN 1.0::DOUBLE WHEN o = 0 THEN 0.0 ELSE 2.0::DOUBLE * o / (m + n) END AS f FROM ep),
pi AS (SELECT item, avg(e) AS ea, avg(f) AS fa, avg(e) FILTER (i > 1) AS eh, avg(f) FILTER (i > 1) AS fh FROM ex GROUP BY item),
ag AS (SELECT count(*) AS n_items, round(avg(ea), 6) AS exact_all, round(avg(fa), 6) AS f1_all, round(avg(eh), 6) AS exact_human, round(avg(fh), 6) AS f1_human FROM pi)
SELECT llm_ac1, llm_kappa, human_ac1, human_kappa, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, n_items, exact_all, f1_all, exact_human, f1_human FROM mean, mt, ag"""
AGG31 = f"""SELECT task, llm_ac1, human_ac1, llm_kappa, human_kappa, fleiss_all, fleiss_human FROM ({AGG18}) UNION ALL SELECT 'image_classification', llm_ac1, human_ac1, llm_kappa, human_kappa, fleiss_all, fleiss_human FROM ({AGG19}) WHERE field = 'macro'
UNION ALL SELECT 'entity_extraction', llm_ac1, human_ac1, llm_kappa, human_kappa, NULL, NULL FROM ({AGG20})"""

QUERIES = {f.__name__: f for f in (agg18_report, agg18_pairs, agg18_distribution, agg19_report, agg20_entity_report, agg31_summary)}
SQL = {"agg18_report": AGG18, "agg18_pairs": AGG18P, "agg18_distribution": AGG18D, "agg19_report": AGG19, "agg20_entity_report": AGG20, "agg31_summary": AGG31}
