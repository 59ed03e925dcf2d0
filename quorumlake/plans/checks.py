"""SQL of queries that read every task: entity lists and image fields beside labels."""

from __future__ import annotations

from ..functions.readers import IMAGE_FIELDS
from .base import BLANK_SQL, RESULTS
from .evaluation import _block, _grade, _kv, _metric, _num, _tidy
from .report import _ENTITY, _bare, _text, _trim

_EVAL = lambda c: f"coalesce({_num(c)}, try_cast(nullif(regexp_extract({c}, '\\((\\d+(?:\\.\\d+)?)\\)', 1), '') AS DOUBLE), {_grade(c)})"
_ONLY = lambda c: f"CASE WHEN len(regexp_extract_all({c}, '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)')) = 1 THEN try_cast(regexp_extract_all({c}, '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)')[1] AS DOUBLE) END"
_GUIDE = "([^，,、\\s\\[\\]''\"]*导向)"


def _orient(c: str) -> str:
    found = f"regexp_extract_all({c}, '{_GUIDE}', 1)"
    return f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, '、') ELSE {_trim(c)} END"


def reading(source: str) -> str:
    """What every distinct text of `source` (x) says: rx (x, t, block, label, ents, f1, f2, f3)."""
    keys = [f"coalesce(json_extract_string(block, '$.\"{k}\"'), '其他')" for k in IMAGE_FIELDS]
    return f"""x0 AS (SELECT DISTINCT x FROM ({source}) WHERE x IS NOT NULL AND x <> ''),
x1 AS (SELECT x, CASE WHEN contains(x, '```json') THEN string_split(x, '```json')[-1] ELSE x END AS after FROM x0),
x2 AS (SELECT x, CASE WHEN contains(after, '```') THEN coalesce(list_filter(string_split(after, '```'), lambda p: contains(p, '{{') OR contains(p, '"'))[1], after) ELSE after END AS t FROM x1),
x3 AS (SELECT x, t, {_block('t')} AS block FROM x2),
x4 AS (SELECT *, coalesce(nullif({_tidy("coalesce(json_extract_string(block, '$.label'), json_extract_string(block, '$.\"标签\"'))")}, ''), nullif({_kv('t', 'label')}, ''), nullif({_kv('t', '标签')}, ''), CASE WHEN contains(lower(t), 'label') THEN trim(nullif(regexp_extract(t, '[:：]\\s*["'']?([^"'',\\n]+)', 1), ''), {BLANK_SQL}) END, trim(t, {BLANK_SQL})) AS label,
 coalesce(json_extract(block, '$.entities')::VARCHAR, CASE WHEN starts_with({_trim('t')}, '[') THEN t END) AS j FROM x3),
rx AS (SELECT x, t, block, label, {keys[0]} AS k1, {keys[1]} AS k2, {keys[2]} AS k3,
 CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN list_distinct(list_transform(list_filter(list_transform(from_json(j, '{_ENTITY}'), lambda e: struct_pack(t := {_trim("coalesce(e.text, '')")}, c := {_trim("coalesce(e.category, '')")})), lambda e: e.t <> '' AND e.c <> ''), lambda e: e.t || ':' || e.c)) END AS ents FROM x4)"""


VOTE = f"""WITH {RESULTS},
last AS (SELECT sample_id, task, run_no, agent_name, arg_max(annotation, result_id) AS x FROM res WHERE agent_name LIKE 'annotator%' AND sample_id IS NOT NULL AND annotation IS NOT NULL GROUP BY ALL),
every AS (SELECT DISTINCT sample_id, task, run_no, agent_name FROM res WHERE agent_name LIKE 'annotator%' AND sample_id IS NOT NULL),
{reading("SELECT x FROM last")},
g AS (SELECT *, {_EVAL('label')} AS ev, {_ONLY('label')} AS on_ FROM rx),
lb AS (SELECT e.sample_id, e.task, e.run_no, e.agent_name, coalesce(l.x, '') AS raw, CASE WHEN coalesce(l.x, '') = '' THEN '' WHEN e.task = 'entity_extraction' THEN coalesce(array_to_string(list_sort(ents), '|'), '') WHEN e.task = 'image_classification' AND block IS NOT NULL THEN k1 || '|' || k2 || '|' || k3
 WHEN e.task = 'image_text_relevance' THEN coalesce({_text('ev')}, label) WHEN e.task = 'image_attribution_recognition' THEN coalesce({_text('on_')}, label) ELSE label END AS label
 FROM every e LEFT JOIN last l USING (sample_id, task, run_no, agent_name) LEFT JOIN g ON g.x = l.x),
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, task, run_no ORDER BY agent_name) AS pos FROM lb),
c AS (SELECT sample_id, task, run_no, label, count(*) AS c, min(pos) AS p, arg_min(raw, pos) AS raw FROM o GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY sample_id, task, run_no ORDER BY (label = ''), c DESC, p) AS r, count(*) OVER (PARTITION BY sample_id, task, run_no) AS k, sum(c) OVER (PARTITION BY sample_id, task, run_no) AS total FROM c),
v AS (SELECT sample_id, task, run_no, max(CASE WHEN r = 1 THEN label END) AS winning_label, coalesce(max(CASE WHEN r = 1 AND label <> '' THEN c END), 0) AS winning_count, max(total)::BIGINT AS total_votes, max(CASE WHEN r = 1 THEN raw END) AS answer,
 coalesce(max(CASE WHEN r = 1 AND label <> '' THEN c END), 0) - coalesce(max(CASE WHEN r = 2 AND label <> '' THEN c END), 0) AS margin, coalesce(max(CASE WHEN label = '' THEN c END), 0) AS empty_results_count, max(k) AS num_clusters FROM f GROUP BY ALL),
first AS (SELECT sample_id, task, run_no, raw FROM o WHERE pos = 1)
SELECT sample_id, run_no, task, winning_label, winning_count, total_votes, margin, empty_results_count, num_clusters, round(winning_count / total_votes, 6) AS confidence, winning_count > 0 AND winning_count = total_votes AS is_unanimous, num_clusters = 3 AND winning_count = 1 AS is_three_way_tie,
 CASE WHEN winning_count > 0 THEN answer ELSE raw END AS answer FROM v JOIN first USING (sample_id, task, run_no)"""

_PAIRS = f"""{RESULTS}, once AS (SELECT * FROM samples WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1),
gt AS (SELECT sample_id, [annotation_1, annotation_2, annotation_3, annotation_4, annotation_5] AS a FROM once),
kept AS (SELECT * FROM gt WHERE len(list_filter(a, lambda x: x IS NULL OR x IN ('', '[]', '{{}}'))) <= 2),
an0 AS (SELECT sample_id, i, a[i] AS raw, coalesce(trim(a[i], {BLANK_SQL}), 'None') AS norm FROM kept, range(1, 6) t(i)),
vo AS (SELECT sample_id, norm, count(*) AS c, min(i) AS p FROM an0 GROUP BY ALL),
lv AS (SELECT sample_id, max(c) AS top, CASE WHEN max(c) < 3 THEN 'ambiguous' WHEN count(*) = 2 AND min(c) >= 2 THEN 'split' ELSE 'consensus' END AS agreement_level FROM vo GROUP BY sample_id),
an AS (SELECT an0.*, vo.c = lv.top AND vo.p = an0.i AS leads FROM an0 JOIN vo USING (sample_id, norm) JOIN lv USING (sample_id)),
rr AS (SELECT result_id, sample_id, task, model_name, annotation FROM res WHERE annotation IS NOT NULL AND annotation <> ''),
{reading("SELECT annotation AS x FROM rr UNION ALL SELECT raw FROM an")},
fx AS (SELECT *, {_bare('k1')} AS f1, {_bare('k2')} AS f2, {_orient('k3')} AS f3, {_metric('label')} AS lm, {_tidy('label')} AS lt, {_metric('x')} AS xm, {_tidy('x')} AS xt FROM rx),
pr AS (SELECT rr.result_id, rr.sample_id, rr.task, rr.model_name, an.raw, an.leads, p.label, p.ents AS pe, q.ents AS qe, p.lm, p.lt, q.xm, coalesce(q.xt, '') AS xt, p.f1 = q.f1 AND p.f2 = q.f2 AND p.f3 = q.f3 AS fields FROM rr JOIN an USING (sample_id) JOIN fx p ON p.x = rr.annotation LEFT JOIN fx q ON q.x = an.raw),
ok AS (SELECT result_id, sample_id, task, model_name, leads, CASE WHEN raw IS NULL THEN false WHEN task = 'entity_extraction' THEN coalesce(len(pe) = len(qe) AND len(list_intersect(pe, qe)) = len(pe), false) WHEN task = 'image_classification' THEN coalesce(fields, false)
 WHEN task IN ('image_text_relevance', 'image_attribution_recognition') THEN coalesce(lm = xm, false) ELSE label <> '' AND (lt = xt OR contains(xt, lt) OR contains(lt, xt)) END AS ok FROM pr),
s AS (SELECT result_id, sample_id, task, model_name, sum(ok::INT)::BIGINT AS m, bool_or(ok AND leads) AS best FROM ok GROUP BY ALL)"""
ACCURACY = f"WITH {_PAIRS} SELECT task, model_name, count(*) AS n, count(*) FILTER (m >= 2) AS n_right FROM s GROUP BY ALL"
METRICS = f"WITH {_PAIRS} SELECT result_id, m AS match_count, round(m / 5.0::DOUBLE, 6) AS hit_rate, m >= 1 AS is_correct_hit1, m >= 2 AS is_correct_hit2, best AS is_correct_majority, agreement_level FROM s JOIN lv USING (sample_id)"
STRATIFIED = f"""WITH {_PAIRS}, sc AS (SELECT task, agreement_level, (m >= 2) AS h2, (m >= 1) AS h1, best FROM s JOIN lv USING (sample_id))
SELECT task, coalesce(agreement_level, 'overall') AS agreement_level, count(*) AS total, count(*) FILTER (h2) AS hit2, count(*) FILTER (h1) AS hit1, count(*) FILTER (best) AS majority,
round(avg(h2::INT::DOUBLE), 6) AS hit2_rate, round(avg(h1::INT::DOUBLE), 6) AS hit1_rate, round(avg(best::INT::DOUBLE), 6) AS majority_rate FROM sc GROUP BY GROUPING SETS ((task, agreement_level), (task))"""

QUERIES: dict = {}
SQL = {"agg02_agent_vote": VOTE, "evl01_accuracy": ACCURACY, "agg06_multi_metrics": METRICS, "agg07_stratified": STRATIFIED}

