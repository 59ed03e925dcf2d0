"""Reading labels out of annotations and model answers, as Column expressions.

Each reader is a chain of tiers, tried in order by coalesce: strict JSON, the last fenced block, the last flat object,
key-value patterns, the raw text. Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\u000b\u000c 　"
EMPTY_ANNOTATIONS = ("", "[]", "{}")
PARSE_ERROR = "__PARSE_ERROR__"
# Grades of relevance in words, and the word for another orientation.
GRADES = (("强相关", 2.0), ("较相关", 1.5), ("弱相关", 1.0), ("不相关", 0.0))
OTHER = "其他"
GUIDANCE = r"([^，,、\s\[\]'\"]*导向)"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it (within higher-order functions nothing else sees to that)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """c without white space of any width around it."""
    return F.btrim(c, F.lit(BLANKS))


def none_if_blank(c: Column) -> Column:
    """NULL for an empty text."""
    return F.when(c != "", c)


def normalized(c: Column) -> Column:
    """The canonical string of a string annotation: stripped; a missing one votes as 'None'."""
    return F.coalesce(strip(c), F.lit("None"))


def is_empty(c: Column) -> Column:
    """Whether an annotation counts as missing: null, an empty string, list or object."""
    return c.isNull() | c.isin(*EMPTY_ANNOTATIONS)


def _valid(j: Column) -> Column:
    """j where it is one JSON object and nothing else."""
    return F.when(j.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(j).isNotNull(), strip(j))


def json_block(text: Column) -> Column:
    """The JSON object a text holds: the whole of it, the last fenced block, or the last flat object that parses."""

    def last_fenced(pattern: str) -> Column:
        return F.when(text.contains("```"), bound(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)), _valid))

    flat = F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda j: F.try_parse_json(j).isNotNull()), F.lit(-1))
    return F.when(text.contains("{"), F.coalesce(_valid(text), last_fenced(r"(?s)```json\s*(\{.*?\})\s*```"), last_fenced(r"(?s)```\s*(\{.*?\})\s*```"), flat))


def json_field(block: Column, key: str) -> Column:
    """A field of a JSON object as text."""
    return F.get_json_object(block, f"$.{key}")


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, NULL without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def key_value(text: Column, key: str) -> Column:
    """The last value of a key: quoted, bare, or after the plain word; NULL where the key does not occur."""
    quoted = last_match(text, rf'"{key}"\s*:\s*"([^"]+)"')
    bare = F.btrim(last_match(text, rf'"{key}"\s*:\s*([^\s,}}]+)'), F.lit('"'))
    loose = last_match(text, rf"(?i){key}\s*[:：]\s*[\"']?([^\"',\s]+)[\"']?")
    return F.coalesce(quoted, bare, loose)


def _float(c: Column) -> Column:
    """A text that is a plain number."""
    return F.when(strip(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), strip(c).try_cast("double"))


def _grade(c: Column) -> Column:
    return reduce(lambda chain, g: chain.when(c.contains(g[0]), F.lit(g[1])), GRADES[1:], F.when(c.contains(GRADES[0][0]), F.lit(GRADES[0][1])))


def _first(c: Column, pattern: str) -> Column:
    return none_if_blank(F.regexp_extract(c, pattern, 1)).try_cast("double")


def score_eval(c: Column) -> Column:
    """A grade as the scorers read it: a number, one in brackets, or a grade in words."""
    return F.coalesce(_float(c), _first(c, r"\((\d+(?:\.\d+)?)\)"), _grade(c))


def score_metric(c: Column, unit: str = "分") -> Column:
    """A grade as the agreement report reads it: also a number before the unit, and at last any number."""
    return F.coalesce(_float(c), _first(c, rf"(\d+(?:\.\d+)?)\s*{unit}"), _first(c, r"\((\d+(?:\.\d+)?)\)"), _grade(c), _first(c, r"(\d+(?:\.\d+)?)"))


def only_number(c: Column) -> Column:
    """The number of a text that holds exactly one."""
    found = F.regexp_extract_all(c, F.lit(r"([+-]?(?:\d+\.?\d*|\.\d+))"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)).try_cast("double"))


def points(c: Column, unit: str = "分") -> Column:
    """The number right before the unit."""
    return _first(c, rf"(\d+\.?\d*){unit}")


def without_number(c: Column) -> Column:
    """A label without a number before it ('12-label')."""
    s = strip(c)
    return F.coalesce(none_if_blank(strip(F.regexp_extract(s, r"^\d+\s*[-–—:]\s*(.+)$", 1))), s)


def guidance(c: Column) -> Column:
    """The orientations named in a text, joined by the ideographic comma; the text itself where it names none."""
    found = F.regexp_extract_all(c, F.lit(GUIDANCE), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, "、")).otherwise(strip(c))


def attribution(c: Column) -> Column:
    """The digit 0, 1 or 2 of an attribution label; '0' where there is none.

    A digit that stands alone among characters other than the backslash and the letter d wins, the smallest first; then the
    first digit at all.
    """
    s = strip(F.coalesce(c, F.lit("0")))
    alone = [F.when(s.rlike(r"(?:^|[^\\d])" + d + r"(?:[^\\d]|$)"), d) for d in "012"]
    return F.coalesce(F.when(s.isin("0", "1", "2"), s), *alone, none_if_blank(F.regexp_extract(s, "[012]", 0)), F.lit("0"))


def tidy(c: Column) -> Column:
    """A label without white space and quotation marks around it."""
    return strip(F.btrim(strip(c), F.lit("\"'")))


def matches(pred: Column, answer: Column) -> Column:
    """Flexible match: equal, or one within the other; an empty prediction never matches."""
    p, a = tidy(pred), tidy(answer)
    return F.coalesce((pred != "") & ((p == a) | a.contains(p) | p.contains(a)), F.lit(False))


def _after_colon(text: Column) -> Column:
    return strip(none_if_blank(F.regexp_extract(text, "[:：]\\s*[\"']?([^\"',\\n]+)", 1)))


def last_part(text: Column) -> Column:
    """What follows the last json fence, or the first fenced part that looks like JSON."""
    after = F.when(text.contains("```json"), F.try_element_at(F.split(text, "```json"), F.lit(-1))).otherwise(text)
    parts = F.filter(F.split(after, "```"), lambda p: p.contains("{") | p.contains('"'))
    return F.when(after.contains("```"), F.coalesce(F.get(parts, F.lit(0)), after)).otherwise(after)


def with_label(df: DataFrame, annotation: str = "annotation", out: str = "label", key: str = "label", task: str | None = None) -> DataFrame:
    """df with the label a model's answer gives for a single-label task; '' for an empty answer.

    With a task column, relevance grades are read by score_eval and attribution by only_number, printed as floating point
    numbers. The tiers are columns of their own on the way, so that none is computed twice.
    """
    step = df.withColumn("_text", last_part(F.col(annotation))).withColumn("_block", json_block(F.col("_text")))
    text, block = F.col("_text"), F.col("_block")
    field = none_if_blank(tidy(F.coalesce(json_field(block, key), json_field(block, "标签"))))
    raw = F.coalesce(field, none_if_blank(key_value(text, key)), none_if_blank(key_value(text, "标签")), F.when(F.lower(text).contains(key), _after_colon(text)), strip(text))
    step = step.withColumn("_raw", raw)
    label = F.col("_raw")
    if task:
        graded = F.when(F.col(task) == "image_text_relevance", score_eval(label)).when(F.col(task) == "image_attribution_recognition", only_number(label))
        label = F.coalesce(graded.cast("string"), label)
    empty = F.col(annotation).isNull() | (F.col(annotation) == "")
    return step.withColumn(out, F.when(empty, F.lit("")).otherwise(label)).drop("_text", "_block", "_raw")


def label_or_error(annotation: Column, key: str) -> Column:
    """The label of the agreement report: a field of the fenced JSON, or the parse error mark."""
    return F.coalesce(json_field(_valid(last_match(annotation, r"(?s)```json\s*(\{.*?\})\s*```")), key), F.lit(PARSE_ERROR))


ENTITY = "array<struct<text:string,category:string>>"


def entities(annotation: Column) -> Column:
    """The (text, category) pairs of an annotation or answer, distinct, trimmed, in order; NULL where none can be read.

    Only text with a bracket is looked at.
    """
    told = lambda text: F.coalesce(F.get_json_object(json_block(text), "$.entities"), F.when(strip(text).startswith("["), text))
    listed = F.from_json(F.when(annotation.contains("[") | annotation.contains("{"), bound(last_part(annotation), told)), ENTITY)
    clean = F.transform(listed, lambda e: F.struct(strip(F.coalesce(e.text, F.lit(""))).alias("text"), strip(F.coalesce(e.category, F.lit(""))).alias("category")))
    return F.array_distinct(F.filter(clean, lambda e: (e.text != "") & (e.category != "")))


def entity_key(ents: Column) -> Column:
    """One string for a set of entities, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(ents, lambda e: F.concat(e.text, F.lit(":"), e.category)))), "|")


def entities_match(pred: Column, answer: Column) -> Column:
    """Same length, and every predicted entity among the answers (one direction only)."""
    return F.coalesce((F.size(pred) == F.size(answer)) & F.forall(pred, lambda p: F.exists(answer, lambda a: p == a)), F.lit(False))


def token_count(text: Column) -> Column:
    """Tokens by rule of thumb: a quarter of the characters, plus one; 0 for nothing."""
    return F.when(F.length(text) > 0, F.floor(F.length(text) / 4) + 1).otherwise(0).cast("long")


def sample_key(text: Column, images: Column) -> Column:
    """The identity of a sample: its text, and its images in order of their names."""
    return F.when(F.size(images) > 0, F.concat(text, F.lit("||"), F.array_join(F.array_sort(images), "|"))).otherwise(text)


def mime_type(path: Column) -> Column:
    """MIME type by extension; JPEG where it is unknown."""
    p = F.lower(path)
    known = F.when(p.endswith(".png"), "image/png").when(p.endswith(".gif"), "image/gif").when(p.endswith(".webp"), "image/webp").when(p.endswith(".bmp"), "image/bmp")
    return known.otherwise("image/jpeg")


def hash_similarity(a: Column, b: Column) -> Column:
    """Similarity of two 64-bit perceptual hashes: the share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64
