"""Problem 4: prompt and response pairs that are broken.

Copies: a response is compressed with its prompt as zstandard dictionary; what the prompt gives back costs next to nothing.
Truncation: structure left open, or an end in a terminal context (the last words) that in all responses together hardly ever
ends anything. Refusals and languages: dictionaries. One defect a pair, the first that holds of: empty, copy, refusal,
truncated, other_language.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, latest, table

COPIED = 0.3  # compressed bytes for a byte of response, at most, in a copy
COPY_PART = 0.5  # of the prompt that a copy holds at least
ENDS = 0.02  # share of its occurrences in which a context ends something, at least, for an ending to pass
BROADCAST = 400_000  # contexts that the JVM joins by broadcast (some 40 MB); beyond, both sides are shuffled
SALTS = 16  # ways a context that very many answers end in is split then
SEEN = 8  # occurrences from which a context of two words is judged; below, the last word is

# Answers without content, phrases of refusal, and common words of some languages.
NOTHING = {"", "-", "--", "—", "...", "…", "none", "null", "nil", "nan", "n/a", "na", "无", "暂无", "没有", "空", "{}", "[]", "()", "\"\"", "''", "?", "？", "未知", "undefined"}
REFUSALS = [
    r"(?:can(?:'|’)?t|cannot|can not|could not|unable to|not able to|won(?:'|’)?t|will not|refuse to|not going to|not allowed to|not permitted to|not in a position to|(?:must|have to) decline(?: to)?)\s+(?:\w+\s+){0,3}(?:help|assist|answer|judge|label|provide|comply|discuss|respond|comment|classify|annotate|do that|give|say|rate|take part|engage)",
    r"(?:falls?|is|lies|goes) (?:outside|beyond) (?:of )?(?:what i (?:may|can|am)|my (?:scope|role|remit|competence|abilities))", r"no comment (?:on|about) this", r"as an? (?:\w+ )?(?:ai|assistant|language model|automated)\b.{0,40}\b(?:not|cannot|can't|unable)", r"breaks? my policy|against (?:my|our|the) (?:policy|policies|guidelines|rules)", r"i(?:'|’)?m sorry,? but", r"please (?:ask|consult) a (?:qualified|professional)",
    r"i(?:'|’)?d (?:rather|prefer) not(?: to)?\b|i would (?:rather|prefer) not(?: to)?\b", r"i (?:must |have to |respectfully )?(?:decline|refuse)\b", r"i(?:'|’)?m not comfortable|i do ?n(?:'|’)?o?t feel comfortable", r"i have no (?:opinion|view) on (?:this|that)",
    r"(?:我)?(?:无法|没法|不便|不能够|无权|拒绝|不愿|不宜|难以)(?:对[^，。,.]{0,10}?|就此|为此|为您|给您|继续|直接)?(?:协助|帮助|回答|处理|提供|判断|标注|完成|作答|作出|做出|评论|评价|回应|讨论|给出|置评)", r"恕(?:我|难|不)", r"超出了?我(?:可以|能|的(?:能力|职责|权限|范围))", r"(?:按照|根据|依照)(?:相关)?(?:政策|规定)[,，]?(?:我)?(?:不|无)", r"不(?:会|能|予)给出(?:标签|答案)", r"换个(?:问题|话题)", r"请咨询专业", r"不能(?:回答|标注(?:该|这)|提供(?:帮助|答案|标签))", r"不予(?:置评|回答|评论)|无可奉告",
    r"lo siento,? (?:pero )?no puedo|no puedo (?:ayudar|responder|ofrecer)", r"je (?:suis désolée?|regrette)|je ne peux pas (?:répondre|aider|vous aider)", r"não posso (?:ajudar|responder)", r"es tut mir leid,? (?:aber )?ich kann|ich kann (?:dabei|das|diese frage) nicht", r"mi dispiace,? (?:ma )?non posso", r"申し訳(?:ありません|ございません)|お答えできません", r"не могу (?:помочь|ответить|обсуждать)", r"답변(?:드릴|할) 수 없", r"لا (?:أستطيع|يمكنني)",
]
COMMON = {
    "en": "the is of and to a in it that for be as with are on at or by this which so although because not no i was meets applies".split(),
    "es": "el la los las de del que y en un una por para con no hay es este esta se su lo elijo habla eso caso".split(),
    "fr": "le la les de du des et un une est ce cette dans pour que qui ne pas donc d'après l rien n indique autre réponse règle convient texte".split(),
    "pt": "o a os as de do da que e em um uma não é para com por se esta este há dos das".split(),
    "de": "der die das und ist ein eine nicht zu den mit für auf dem des im es diese".split(),
    "it": "il lo la gli le di che e un una è non per con del della questo questa".split(),
    "nl": "de het een en van is dat niet op voor met zijn aan dit deze wordt ook maar er geen door naar".split(),
    "pl": "i w na z do nie to jest się że o jak za od po dla tego tej jest oraz ale przez".split(),
    "tr": "ve bir bu için ile de da değil olarak daha çok var yok ama olan göre bunun kural metin".split(),
    "sv": "och att det som en på är av för med den till inte ett om har detta".split(),
    "vi": "là và của không có được cho một này với các những trong để người".split(),
    "id": "yang dan di untuk dengan ini itu tidak adalah dari pada dalam ke karena juga".split(),
}
SCRIPTS = {"ko": "가-힯", "ar": "؀-ۿ", "he": "֐-׿", "hi": "ऀ-ॿ", "th": "฀-๿", "el": "Ͱ-Ͽ", "ru": "Ѐ-ӿ"}
_REFUSE = re.compile("|".join(REFUSALS), re.I)
_WORDS: dict[str, list[str]] = {}
for _k, _v in COMMON.items():
    for _w in _v:
        _WORDS.setdefault(_w, []).append(_k)
_HAN = re.compile(r"[㐀-鿿]+")
_KANA = re.compile(r"[぀-ヿ]+")
_SCRIPTS = {k: re.compile(f"[{v}]+") for k, v in SCRIPTS.items()}
_ANY_SCRIPT = re.compile(f"[{''.join(SCRIPTS.values())}]")
_LATIN = re.compile(r"[a-zà-ÿąćęłńóśźżğışçăđơưạ-ỹ]+")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_FENCE = re.compile(r"^```[\w-]*\s*|\s*```$")
_TAGS = re.compile(r"</?[a-z_]+/?>", re.I)
_ASKED = re.compile(r"^\s*(?:question|query|prompt|input|q|问题|问|输入|题目)\s*[:：]\s*", re.I)
_BARE = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"[a-zà-ÿа-яё]+(?:['’][a-z]+)?|[㐀-鿿]|[぀-ヿ]+|\d+", re.I)
_LOW = re.compile(_TOKEN.pattern)  # of lower-case text
_END = re.compile(r"[.。!！?？;；\"”\n}\]]")
_TERMINAL = ".。!！?？”\"')）}]」`>♪~"
_ELLIPSIS = ("…", "...", "。。")
_REASON = re.compile(r"reason|理由|why|rationale|explanation|原因|解释", re.I)
_PATH = re.compile(r"^\S*\.(?:png|jpe?g|gif|webp|bmp)\S*$", re.I)


def _inner(answer: str) -> str:
    t = answer.strip()
    return _FENCE.sub("", t).strip() if "```" in t else t


def _parsed(t: str) -> object:
    """JSON of the whole text (without a fence around it), or of its last object; None if neither parses."""
    for s in (t, t[t.rfind("\n{") + 1 :] if "\n{" in t else ""):
        if s[:1] in "{[" and s:
            try:
                return json.loads(s)
            except ValueError:
                pass
    return None


class Answer:
    """A response, without the fence around it and read as JSON where it is, both once."""

    __slots__ = ("inner", "text", "value")

    def __init__(self, text: str) -> None:
        self.text = text
        self.inner = _inner(text)
        self.value = _parsed(self.inner)


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)
    elif value is not None:
        yield str(value)


def is_empty(answer: str | None) -> bool:
    """No content: nothing, a filler, empty tags or fences, JSON without a label or entity."""
    if answer is None:
        return True
    if len(answer) > 60 and answer[0] not in "{[`<" and _LETTERS.match(answer):
        return False
    t = answer if answer.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", answer))
    t = _inner(t)
    if "<" in t:
        t = _TAGS.sub("", t).strip()
    if t.lower() in NOTHING or not _WORD.search(t):
        return True
    if t[0] in "{[":
        try:
            value = json.loads(t)
        except ValueError:
            return False
        if isinstance(value, dict):
            value = {k: v for k, v in value.items() if not _REASON.search(k)} or value
        return not any(s.strip().lower() not in NOTHING for s in _strings(value))
    m = _LABELLED.fullmatch(t)
    return bool(m) and m[1].strip().lower() in NOTHING


_LETTERS = re.compile(r"[^\W\d_]{2}")
_WORD = re.compile(r"\w")
_LABELLED = re.compile(r"(?:label|answer|标签|答案)\s*[:：]\s*(.*)", re.I | re.S)
_SMALL = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}


def _plain(text: str) -> bytes:
    return _BARE.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()).encode()


def is_copy(answer: Answer, query: str | None) -> bool:
    """Whether the response gives back the prompt: most of it comes from the prompt, and it holds much of the prompt."""
    if not query:
        return False
    told = "".join(s for s in _strings(answer.value)) if answer.value is not None else _ASKED.sub("", _TAGS.sub("", answer.inner) if "<" in answer.inner else answer.inner)
    q = _plain(query)
    if len(q) < 4 or 4 * len(told) < COPY_PART * len(q):  # a character has four bytes at most
        return False
    a = _plain(told)
    if len(a) < COPY_PART * len(q):
        return False
    if a in q or q in a and len(a) <= 1.3 * len(q):
        return True
    dictionary = zstandard.ZstdCompressionDict(q * (1 if len(q) > 64 else 64 // len(q) + 1), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = len(zstandard.ZstdCompressor(dict_data=dictionary, **_SMALL).compress(a)) - 9
    if packed > COPIED * len(a):
        return False
    alone = len(zstandard.ZstdCompressor(**_SMALL).compress(a)) - 9  # what repeats itself is no copy for that
    return packed <= 0.6 * alone


def language(text: str) -> str | None:
    """zh, ja, a language of SCRIPTS or of COMMON; None where nothing tells (labels, numbers, paths)."""
    han = 0
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        han = sum(map(len, _HAN.findall(text)))
        if sum(map(len, _KANA.findall(text))) >= 3:
            return "ja"
        for name, script in _SCRIPTS.items() if _ANY_SCRIPT.search(text) else ():
            if sum(map(len, script.findall(text))) >= (3 if name == "ko" else 6):
                return name
    words = _LATIN.findall(text.lower())
    if han > len(words):
        return "zh" if han >= 4 else None
    if len(words) < 3:
        return None
    hits: Counter[str] = Counter()
    for w in words:
        for k in _WORDS.get(w, ()):
            hits[k] += 1
    best = max(hits, key=lambda k: (hits[k], k == "en", k), default="en")
    return best if hits[best] > hits["en"] + 1 else "en"


def reasons(answer: Answer) -> str:
    """What a response gives as reasons: JSON fields of that kind, or its sentences without the statement of the label."""
    value, t = answer.value, answer.inner
    if isinstance(value, dict):
        told = " ".join(s for k, v in value.items() if _REASON.search(k) for s in _strings(v))
        before = t[: t.rfind("\n{")] if "\n{" in t and not t.startswith("{") else ""
        return f"{before} {told}".strip()
    if value is not None:
        return ""
    t = _STATED.sub(" ", t)
    return t if _MARK.search(t) or len(_TOKEN.findall(t)) > 6 else ""


_STATED = re.compile(r"(?:the label is|label\s*[:：]|标签为|标签\s*[:：])[^.。\n]*[.。]?", re.I)
_MARK = re.compile(r"[.。!！?？,，;；]")
_ANY_HAN = re.compile(r"[㐀-鿿]")
_ANY_LATIN = re.compile(r"[a-z]", re.I)


def is_foreign(told: str, query: str | None) -> bool:
    """Whether reasons are in another language than the prompt; a path or an empty prompt has none."""
    if not query or not told or _PATH.match(query.strip()):
        return False
    said = language(told)
    if said is None:
        return False
    asked = language(query) or ("zh" if _ANY_HAN.search(query) else "en" if _ANY_LATIN.search(query) else None)
    return asked is not None and said != asked


def is_open(answer: Answer) -> bool:
    """Structure left open: a fence, bracket, string or tag that never closes, or an ellipsis in the place of the rest."""
    if answer.text.count("```") % 2:
        return True
    inner = answer.inner
    if answer.value is not None:
        return any(s.rstrip().endswith(_ELLIPSIS) for s in _strings(answer.value))
    if inner.endswith(_ELLIPSIS):
        return True
    at = max(inner.rfind("\n{"), 0 if inner[:1] in "{[" else -1)
    return at >= 0 or inner.endswith(("{", "[", '{"'))


def context(text: str) -> tuple[str, str, int]:
    """The last two words, the last word, and the number of words; '^' stands before the first."""
    words = _LOW.findall(text.lower())
    two = ["^", *words][-2:]
    return " ".join(two), two[-1], len(words)


def _pieces(answer: str) -> Iterator[tuple[list[str], bool]]:
    """Runs of words, and whether a mark of an end follows each."""
    parts = _END.split(answer.lower())
    for part in parts[:-1]:
        yield ["^", *_LOW.findall(part)], True
    rest = ["^", *_LOW.findall(parts[-1])]
    yield rest, len(rest) <= 4  # a bare label ends where it ends


def contexts(answers: DataFrame) -> DataFrame:
    """(context, n, n_end): how often each pair of words and each word occurs in all responses, and ends something there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        for b in batches:
            for a, times in Counter(b.column("annotation").to_pylist()).items():
                for words, ended in _pieces(a):
                    for _ in range(times):
                        n.update(words[1:])
                        n.update(map(" ".join, zip(words, words[1:], strict=False)))
                    if ended and len(words) > 1:
                        ends[words[-1]] += times
                        ends[" ".join(words[-2:])] += times
            if len(n) > 200_000:
                yield rows(n, ends)
                n, ends = Counter(), Counter()
        yield rows(n, ends)

    def rows(n: Counter, ends: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([ends[k] for k in n], pa.int64())], names=["context", "n", "n_end"])

    return answers.where("annotation is not null").select("annotation").mapInArrow(count, "context string, n long, n_end long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def _lookup(asked: DataFrame, name: str, table_: DataFrame, n: int) -> DataFrame:
    """asked with the row of table_ (name, ...) of its value, if any; a value that very many rows have is spread over tasks."""
    if n <= BROADCAST:
        return asked.join(F.broadcast(table_), name, "left")
    salted = table_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked.withColumn("_salt", F.pmod(F.xxhash64("result_id"), F.lit(SALTS)).cast("int")).join(salted, [name, "_salt"], "left").drop("_salt")


def judged(once: DataFrame) -> DataFrame:
    """(result_id, defect, pair, last, words, stop, other): the defects an answer shows by itself; where it shows none, how it
    ends and whether it is in another language than its prompt.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refused = pc.fill_null(pc.match_substring_regex(b.column("annotation"), "|".join(REFUSALS), ignore_case=True), False).to_pylist()
            rows = [one(q, a, r) for q, a, r in zip(b.column("query").to_pylist(), b.column("annotation").to_pylist(), refused, strict=True)]
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("result_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["result_id", "defect", "pair", "last", "words", "stop", "other"])

    def one(query: str | None, text: str | None, refused: bool) -> tuple:
        if is_empty(text):
            return "empty", None, None, 0, True, False
        answer = Answer(text)
        if is_copy(answer, query):
            return "copy", None, None, 0, True, False
        if refused:
            return "refusal", None, None, 0, True, False
        if is_open(answer):
            return "truncated", None, None, 0, True, False
        why = reasons(answer)
        told = why if answer.value is not None else answer.inner
        if not told:
            return None, None, None, 0, True, is_foreign(why, query)
        return None, *context(told), told.rstrip()[-1:] in _TERMINAL, is_foreign(why, query)

    return once.select("result_id", "query", "annotation").mapInArrow(judge, "result_id long, defect string, pair string, last string, words int, stop boolean, other boolean")


def defects(results: DataFrame) -> DataFrame:
    """(result_id, defect) of each broken pair, each id once (last delivery).

    A null answer is empty; a null or blank query can neither be copied nor have a language.
    """
    once = latest(results.select("result_id", "query", "annotation", "finished_at").where("result_id is not null"), ["result_id"], ["finished_at"])
    # What needs no look at how other answers end is decided; of the rest each stands with its last words.
    first = cut(judged(once).where("defect is not null or pair is not null or other"))
    decided = first.where("pair is null").select("result_id", F.coalesce("defect", F.lit("other_language")).alias("defect"))
    ending = first.where("pair is not null").drop("defect")
    wanted = ending.select(F.explode(F.array("pair", "last")).alias("context")).distinct()
    seen = cut(contexts(once).join(wanted, "context", "left_semi"))
    n = seen.count()
    joined = _lookup(ending, "pair", seen.select(F.col("context").alias("pair"), F.col("n").alias("n2"), F.col("n_end").alias("e2")), n)
    joined = _lookup(joined, "last", seen.select(F.col("context").alias("last"), F.col("n").alias("n1"), F.col("n_end").alias("e1")), n)
    # An ending passes where its context ends things elsewhere too; what has no mark of an end must do so in its own right.
    rare = F.when(F.col("n2") >= SEEN, F.col("e2") < ENDS * F.col("n2")).otherwise(F.coalesce(F.col("e1") < ENDS * F.col("n1"), F.lit(False)) | (F.coalesce(F.col("n1") <= 1, F.lit(False)) & (F.col("words") > 3) & ~F.col("other")))
    verdict = F.when((~F.col("stop") & (F.col("words") > 6)) | rare, "truncated").when(F.col("other"), "other_language")
    return decided.unionByName(joined.select("result_id", verdict.alias("defect")).where("defect is not null"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result_id, defect) of every broken pair."""
    return defects(table(spark, sf_dir, "results"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken pairs per model and defect, and the model's number of results."""
    results = table(spark, sf_dir, "results")
    once = latest(results.select("result_id", "model_name", "finished_at").where("result_id is not null"), ["result_id"], ["finished_at"])
    total = once.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_results"))
    return once.join(defects(results), "result_id").groupBy("model_name", "defect").agg(F.count(F.lit(1)).alias("n")).join(total, "model_name")


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
