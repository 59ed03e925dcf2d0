"""Further readers as Column expressions: labels of the agreement report, canonical forms, ground truths, mixed queries, messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L

# Fields of an image classification, the field and words of the privacy task, keys of mixed queries, marks of a reply.
IMAGE_FIELDS = ("一级品类", "二级品类", "话术分析")
PRIVACY = "隐私合规评估"
PRESENT, ABSENT = "有", "无"
TEXT_KEYS = ("query_text", "query", "text", "content", "input")
IMAGE_KEYS = ("image_urls", "images", "image_url", "image", "img_urls", "imgs")
NESTED_KEYS = ("query", "query_dict")
DOCUMENT_MARKS = ("Optimized rule document:", "Optimized Rule Document:", "optimized rule document:", "优化后的规则文档：", "优化后的规则文档:")
SYSTEM = "You are a helpful assistant."


def number_text(c: Column) -> Column:
    """A double as text: whole numbers with one zero behind the point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def regex_value(text: Column, key: str) -> Column:
    """The first quoted value of a key, '' without one."""
    return F.coalesce(F.regexp_extract(text, rf'"{key}"\s*:\s*"([^"]+)"', 1), F.lit(""))


def string_list(c: Column) -> Column:
    """The strings of a list written as JSON, as quoted pieces, or as one bare value; tidied; nulls left out, [] for nothing."""
    parsed = F.transform(F.filter(F.from_json(F.when(F.try_parse_json(c).isNotNull() & L.strip(c).startswith("["), c), "array<string>"), lambda x: x.isNotNull()), lambda x: L.strip(L.tidy(x)))
    quoted = F.transform(F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1)), L.strip)
    bare = F.btrim(c, F.lit("\"'[] "))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.when(F.size(quoted) > 0, quoted), F.when(bare != "", F.array(bare)), F.array().cast("array<string>")))


def canonical(c: Column) -> Column:
    """One string for annotations that are equal: JSON lists with their items in order and objects with their keys in order,
    other text stripped; a missing one votes as 'None'. JSON comes out without blanks.
    """
    s = L.strip(c)
    v = F.try_parse_json(s)
    items = F.array_sort(F.transform(F.try_variant_get(F.when(s.startswith("["), v), "$", "array<variant>"), lambda x: F.to_json(x)))
    listed = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    return F.coalesce(F.when(s.startswith("[") & v.isNotNull(), listed), F.when(s.startswith("{") & v.isNotNull(), F.to_json(v)), s, F.lit("None"))


# --- labels of the agreement report


def _fenced(answer: Column) -> Column:
    return L.none_if_blank(F.regexp_extract(answer, r"(?s)```json\s*(.*?)\s*```", 1))


def _mapped(label: Column, names: Mapping[str, str] | None) -> Column:
    if not names:
        return label
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[label], label)


def generic_label(answer: Column, key: str = "label", names: Mapping[str, str] | None = None) -> Column:
    """A label out of the fenced JSON of an answer: the key's value, else the first value, or the JSON string itself, by their
    mapped names; else the first name that occurs anywhere; else the parse error mark.
    """
    fence = _fenced(answer)
    valid = F.try_parse_json(fence)
    fields = F.from_json(F.when(valid.isNotNull() & fence.startswith("{"), fence), "map<string,string>")
    text = F.when(valid.isNotNull() & fence.startswith('"'), F.try_variant_get(valid, "$", "string"))
    label = F.coalesce(fields[key], F.get(F.map_values(fields), F.lit(0)), text)
    out = _mapped(label, names)
    for name, to in (names or {}).items():
        out = F.coalesce(out, F.when(answer.contains(name), F.lit(to)))
    return F.coalesce(out, F.lit(L.PARSE_ERROR))


def image_label(answer: Column) -> Column:
    """The fields of an image classification joined to one label, or the parse error mark; all fields where none is known."""
    fence = _fenced(answer)
    fields = F.from_json(F.when(F.try_parse_json(fence).isNotNull() & fence.startswith("{"), fence), "map<string,string>")
    known = F.filter(F.array(*[F.when(F.map_contains_key(fields, k), F.concat(F.lit(f"{k}:"), F.coalesce(fields[k], F.lit("None")))) for k in IMAGE_FIELDS]), lambda x: x.isNotNull())
    every = F.transform(F.map_entries(fields), lambda e: F.concat(e.key, F.lit(":"), F.coalesce(e.value, F.lit("None"))))
    return F.coalesce(F.when(fields.isNotNull(), F.array_join(F.when(F.size(known) > 0, known).otherwise(every), "|")), F.lit(L.PARSE_ERROR))


def _graded(c: Column) -> Column:
    return number_text(L.score_metric(c))


def relevance_label(answer: Column) -> Column:
    """The grade an answer gives, as a floating point number in text; its words where they are no grade; or the error mark."""
    block = L.json_block(answer)
    field = F.coalesce(L.json_field(block, "label"), F.lit(""))
    kv = L.none_if_blank(L.key_value(answer, "label"))
    after = F.when(F.lower(answer).contains("label"), L.strip(L.none_if_blank(F.regexp_extract(answer, "[:：]\\s*\"?([^\"',\\n]+)\"?", 1))))
    read = F.coalesce(F.when(block.isNotNull(), F.coalesce(_graded(field), L.strip(field))), _graded(kv), kv, _graded(after), after, _graded(answer))
    return F.when(answer.isNull() | (answer == ""), F.lit(L.PARSE_ERROR)).otherwise(F.coalesce(read, F.lit(L.PARSE_ERROR)))


def attribution_label(answer: Column) -> Column:
    """The digit of an attribution answer; '0' for nothing."""
    block = L.json_block(answer)
    return F.when(block.isNotNull(), L.attribution(F.coalesce(L.json_field(block, "label"), F.lit("")))).otherwise(L.attribution(F.coalesce(L.none_if_blank(L.key_value(answer, "label")), answer)))


def social_label(answer: Column) -> Column:
    """The category an answer names, without the number before it; the error mark for nothing."""
    block = L.json_block(answer)
    label = F.when(block.isNotNull(), L.json_field(block, "label")).otherwise(L.key_value(answer, "label"))
    return F.when(answer.isNull() | (answer == ""), F.lit(L.PARSE_ERROR)).otherwise(L.without_number(F.coalesce(L.none_if_blank(label), answer)))


def metric_label(answer: Column, task: Column, key: str = "label", names: Mapping[str, str] | None = None) -> Column:
    """The label of a model's answer as the agreement report reads it, by task."""
    return F.when(task == "image_text_relevance", relevance_label(answer)).when(task == "image_attribution_recognition", attribution_label(answer)).when(task == "social_text_classification", social_label(answer)).when(task == "image_classification", image_label(F.coalesce(answer, F.lit("")))).otherwise(generic_label(F.coalesce(answer, F.lit("")), key, names))


def human_label(label: Column, task: Column) -> Column:
    """A person's label in the form of metric_label(); NULL stays NULL."""
    graded = F.coalesce(_graded(label), L.strip(label))
    return F.when(label.isNull(), F.lit(None).cast("string")).when(task == "image_text_relevance", graded).when(task == "image_attribution_recognition", L.attribution(label)).when(task == "social_text_classification", L.without_number(label)).otherwise(L.strip(label))


def image_field(json: Column, key: str) -> Column:
    """A field of an image classification: of a list its first item (its orientations, the first of each item, for 话术分析),
    numbers before labels left out; 其他 for an empty list, NULL where the field is missing.
    """
    value = F.get_json_object(json, f"$.{key}")
    items = F.from_json(F.when(value.startswith("[") & F.try_parse_json(value).isNotNull(), value), "array<string>")
    if key == IMAGE_FIELDS[2]:
        found = F.filter(F.transform(items, lambda x: F.regexp_extract(x, L.GUIDANCE, 1)), lambda x: x != "")
        return F.when(items.isNotNull(), F.when(F.size(found) > 0, F.array_join(found, "、")).otherwise(L.OTHER)).otherwise(L.guidance(value))
    return F.when(items.isNotNull(), F.coalesce(L.without_number(F.get(items, F.lit(0))), F.lit(L.OTHER))).otherwise(L.without_number(value))


def model_fields(answer: Column) -> Column:
    """struct of the three fields a model's fenced JSON gives; 其他 for one that is missing."""
    fence = _fenced(F.coalesce(answer, F.lit("")))
    good = F.when(F.try_parse_json(fence).isNotNull() & fence.startswith("{"), fence)
    return F.struct(*[F.coalesce(image_field(good, k), F.lit(L.OTHER)).alias(f"field_{i}") for i, k in enumerate(IMAGE_FIELDS, 1)])


def human_fields(label: Column) -> Column:
    """struct of the three fields of a person's JSON; 其他 for one that is missing or unreadable, NULL for no label."""
    good = F.when(F.try_parse_json(label).isNotNull() & L.strip(label).startswith("{"), label)
    return F.struct(*[F.when(label.isNotNull(), F.coalesce(image_field(good, k), F.lit(L.OTHER))).alias(f"field_{i}") for i, k in enumerate(IMAGE_FIELDS, 1)])


# --- ground truths


def representative(detail: Column, annotations: Column, raw: Column) -> Column:
    """The answer that stands for a ground truth: the first of the vote's answers, else the first annotation, else the raw text."""
    return F.coalesce(F.get(detail, F.lit(0)).answer, F.get(annotations, F.lit(0)), raw)


def truth_label(majority: Column, detail: Column, annotations: Column, raw: Column) -> Column:
    """A ground truth as one stripped label: majority answer, top of the vote, first annotation, or the raw text ('None')."""
    top = F.when(F.size(detail) > 0, F.coalesce(F.get(detail, F.lit(0)).answer, F.lit("")))
    first = F.when(F.size(annotations) > 0, F.coalesce(F.get(annotations, F.lit(0)), F.lit("None")))
    return L.strip(F.coalesce(majority, top, first, raw, F.lit("None")))


def truth_shown(acceptable: Column, majority: Column) -> Column:
    """A ground truth as shown with an error: JSON of the acceptable answers, else of the majority answer alone."""
    return F.to_json(F.when(F.size(acceptable) > 0, acceptable).otherwise(F.array(F.coalesce(majority, F.lit("")))))


# --- mixed queries and messages


def _text_of(json: Column, key: str) -> Column:
    """The text under a key: a string as it is, of an object its text, else the object without its images."""
    value = F.try_parse_json(json)
    own = F.get_json_object(json, f"$.{key}")
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
    inner = F.get_json_object(json, f"$.{key}.text")
    return F.when(kind == "STRING", own).when(kind.startswith("OBJECT"), F.coalesce(inner, without_images(own)))


def without_images(json: Column) -> Column:
    """A JSON object without its image keys, as JSON; NULL where nothing is left."""
    fields = F.from_json(json, "map<string,string>")
    kinds = F.map_filter(fields, lambda k, v: ~k.isin(*IMAGE_KEYS))
    return F.when(F.size(kinds) > 0, F.to_json(kinds))


def _images_of(json: Column, path: str) -> Column:
    """The images under the first image key that is there: a list, or one path."""
    value = F.coalesce(*[F.get_json_object(json, f"{path}.{k}") for k in IMAGE_KEYS])
    return F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.when(value.isNotNull(), F.array(value)))


def multimodal_data(query: Column) -> Column:
    """struct<text, image_urls> of a query that is plain text or a JSON object in any of the known layouts."""
    is_object = L.strip(query).startswith("{") & F.try_parse_json(query).isNotNull()
    obj = F.when(is_object, query)
    text = F.coalesce(*[L.none_if_blank(_text_of(obj, k)) for k in TEXT_KEYS], F.get_json_object(obj, "$.text"), without_images(obj), F.lit(""))
    filled = lambda a: F.when(F.size(a) > 0, a)
    images = F.coalesce(*[filled(_images_of(obj, f"$.{k}")) for k in NESTED_KEYS], filled(_images_of(obj, "$")), F.array().cast("array<string>"))
    return F.struct(F.when(is_object, text).otherwise(F.coalesce(query, F.lit("None"))).alias("text"), F.when(is_object, images).otherwise(F.array().cast("array<string>")).alias("image_urls"))


def image_block_url(path: Column, data: Column | None = None) -> Column:
    """The address of an image in a message: web and data addresses as they are, a local file as data of its bytes; NULL without."""
    direct = path.startswith("http://") | path.startswith("https://") | path.startswith("data:image")
    local = F.concat(F.lit("data:"), L.mime_type(path), F.lit(";base64,"), F.base64(data)) if data is not None else F.lit(None).cast("string")
    return F.when(path.isNull() | (path == ""), F.lit(None).cast("string")).when(direct, path).otherwise(local)


def chat_messages(prompt: Column, urls: Column) -> Column:
    """array<struct<role, content array<struct<type, value>>>>: the system's message and the user's, with text and images.

    Images stand at the prompt's <image> marks (more images than marks are left out), or behind the text without marks.
    """
    from ..operators.prompts import blocks

    behind = F.concat(F.filter(F.array(F.struct(F.lit("text").alias("type"), prompt.alias("value"))), lambda b: b.value != ""), F.transform(urls, lambda u: F.struct(F.lit("image").alias("type"), u.alias("value"))))
    content = F.when((F.size(urls) > 0) & prompt.contains("<image>"), blocks(prompt, urls)).otherwise(F.filter(behind, lambda b: b.value.isNotNull()))
    system = F.array(F.struct(F.lit("text").alias("type"), F.lit(SYSTEM).alias("value")))
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))


def message_tokens(messages: Column) -> Column:
    """Tokens of chat messages by rule of thumb: four a message, those of its texts, and two."""
    def own(m: Column) -> Column:
        texts = F.transform(F.filter(m.content, lambda b: b.type == "text"), lambda b: L.token_count(b.value))
        return F.aggregate(texts, F.lit(4).cast("long"), lambda s, x: s + x)

    return F.aggregate(F.transform(messages, own), F.lit(2).cast("long"), lambda s, x: s + x)


def document(reply: Column) -> Column:
    """The rule document of an optimiser's reply: within <prompt> tags, else behind the last mark of the first kind that occurs;
    NULL without either.
    """
    tagged = L.none_if_blank(L.strip(F.regexp_extract(reply, r"(?s)<prompt>(.*?)</prompt>", 1)))
    marked = [L.none_if_blank(L.strip(F.when(reply.contains(m), F.substring_index(reply, m, -1)))) for m in DOCUMENT_MARKS]
    return F.coalesce(tagged, *marked)


# --- scorers of the privacy task


def _presence(c: Column) -> Column:
    t = L.strip(L.tidy(c))
    return F.when(t.startswith(PRESENT), PRESENT).when(t.startswith(ABSENT), ABSENT).otherwise("")


def by_presence(pred: Column, answer: Column) -> Column:
    """Whether an answer says 有 or 无 as expected: in its JSON field, as key and value, alone, or as the only one of the two words."""
    want = L.strip(L.tidy(answer))
    block, kv = L.json_block(pred), L.none_if_blank(L.key_value(pred, PRIVACY))
    said = L.none_if_blank(F.regexp_extract(pred, PRIVACY + "\\s*[:：]\\s*[\"']?(有|无)", 1))
    alone = L.strip(L.tidy(pred))
    only = F.when(pred.contains(PRESENT) & ~pred.contains(ABSENT), PRESENT).when(pred.contains(ABSENT) & ~pred.contains(PRESENT), ABSENT)
    field = L.json_field(block, PRIVACY)
    told = F.when(block.isNotNull(), F.coalesce(_presence(field), F.lit(""))).when(kv.isNotNull(), _presence(kv)).when(alone.isin("有问题", "无问题", PRESENT, ABSENT), _presence(alone)).otherwise(F.coalesce(said, only))
    return F.coalesce(want.isin(PRESENT, ABSENT) & (told == want), F.lit(False))


def by_privacy(pred: Column, answer: Column) -> Column:
    """The privacy task: 有 or 无 by presence; an answer that is an object by its field; any other text against the field."""
    field = L.json_field(L.json_block(pred), PRIVACY)
    inner = L.json_field(F.when(F.try_parse_json(answer).isNotNull() & L.strip(answer).startswith("{"), answer), PRIVACY)
    clean = lambda c: L.strip(L.tidy(c))
    as_object = F.coalesce(clean(field) == clean(inner), F.lit(False)) | F.coalesce(L.key_value(pred, PRIVACY) == inner, F.lit(False))
    return F.coalesce(F.when(answer.isin(PRESENT, ABSENT), by_presence(pred, answer)).when(inner.isNotNull(), as_object).otherwise(clean(field) == clean(answer)), F.lit(False))


# --- images


WEIGHTS = (0.4, 0.35, 0.25)  # of hash, histogram and features in the composite


def image_composite(phash: Column, histogram: Column, features: Column) -> Column:
    """Similarity of two images from those of their hashes, histograms and features, by WEIGHTS of the ones there are; 0.5
    without any.
    """
    parts = list(zip((phash, histogram, features), WEIGHTS, strict=True))
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    score = sum((F.coalesce(c.cast("double") * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(total > 0, score / total).otherwise(0.5)


def histogram_similarity(a: Column, b: Column) -> Column:
    """Correlation of two histograms of equal length, 0 where it is negative; 0.5 where it is undefined."""
    n = F.size(a)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    ma, mb = mean(a), mean(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v, m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    d = norm(a, ma) * norm(b, mb)
    return F.when((n == F.size(b)) & (d > 0), F.greatest(dot / d, F.lit(0.0))).otherwise(0.5)


def feature_similarity(a: Column, b: Column, within: int = 50) -> Column:
    """Share of matched features: descriptors (arrays of 64-bit words) of the one image that differ from one of the other in
    fewer than `within` bits, by the smaller number of features, 1 at most; 0 where an image has none.
    """
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)
    good = F.filter(a, lambda x: F.exists(b, lambda y: bits(x, y) < within))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.least(F.size(good) / F.least(F.size(a), F.size(b)), F.lit(1.0))).otherwise(0.0)


def image_similarity(cosine: Column, composite: Column) -> Column:
    """By embeddings where both images have one (cosine not NULL), else by traditional features."""
    return F.coalesce(cosine, composite)
