"""Problem 6: abusive, hateful or sexual content.

A chain of linear classifiers. Each category's model sees hashed character trigrams and the probabilities of the categories
before it; while training, those are out-of-fold predictions, so that a later model learns how far an earlier one can be
trusted. The last link is the verdict; it also sees cues (counts of word lists and phrase patterns, after spellings meant to
hide a word are undone). Reviewers judged texts as a whole, so what kind of abuse a text holds is told by cues, for training
only: the links of the kinds have to find it from trigrams. Texts judged abusive also serve embedded in texts judged harmless,
since abuse does not pass by being part of a longer text. Folds part templates, not rows: texts that share most of their
trigrams are held out together.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import latest, table

MAX_LABELLED = 20_000  # reviewed texts used for fitting, at most: those of smallest label_id
FOLDS = 5
HASHED = 256
ALIKE = 0.4  # share of trigrams from which two labelled texts count as one template
CATEGORIES = ("insult", "threat", "hate", "sexual", "abusive")

# Word lists and phrase patterns of abusive language, and of contexts that only look like it.
INSULTS_EN = "bitch bastard asshole arsehole jackass dumbass dumbfuck moron idiot imbecile cretin retard scumbag slut whore wanker pig loser fucker motherfucker cunt dickhead prick twat bellend douchebag shithead piece of shit trash vermin swine freak pervert tramp skank hag pig".split()
INSULTS_ZH = "傻逼 傻屄 煞笔 沙比 沙雕 傻叉 傻子 王八蛋 王八羔子 王8蛋 忘八蛋 狗东西 狗杂种 狗娘养 杂种 畜生 畜牲 牲口 婊子 表子 贱人 贝戋人 贱货 贱货 骚货 混蛋 昏蛋 混账 废物 蠢货 蠢猪 笨蛋 白痴 白吃 脑残 弱智 智障 二百五 垃圾 辣鸡 人渣 败类 死全家 妓女 荡妇 流氓 狗逼 妈逼 操你 草泥马 尼玛 你妈逼 他妈的 去你妈 猪脑子 神经病 丑八怪".split()
SHORT_ZH = "sb wbd fw lj nc nt nmsl cnm tmd zz shabi sha\\s?bi fei\\s?wu la\\s?ji nao\\s?can bai\\s?chi jian\\s?ren biao\\s?zi za\\s?zhong chu\\s?sheng sao\\s?huo hun\\s?dan wang\\s?ba\\s?dan chun\\s?huo gou\\s?dong\\s?xi er\\s?bai\\s?wu".split()
MIXED_ZH = "脑c 傻b 傻\\* 混dan jian人 biao子 sha逼 za种 sao货 fei物 la圾 chu生 chun货 贱ren 婊zi 废wu 白chi 煞b".split()
DEHUMANISING = "vermin|parasites?|filthy?|(?:a )?disease|animals?|cockroach(?:es)?|rats?|virus(?:es)?|scum|plague|savages?|subhuman".split("|")
_HASHES = np.uint32(2654435761)


def _stretch(word: str) -> str:
    """Each letter may be repeated; a space in the word may be any white space."""
    return "".join(r"\s+" if c == " " else f"{c}+" for c in word)


_EN = re.compile(r"(?<![a-z])(?:" + "|".join(_stretch(w) for w in sorted(set(INSULTS_EN) - {"of", "piece", "shit", "trash", "freak", "hag", "vermin"} | {"piece of shit"}, key=len, reverse=True)) + r")s?(?![a-z])")
_MASK = re.compile(r"(?<![a-z*])[a-z]\*{1,8}[a-z](?![a-z*])|(?<![a-z*])[a-z]{1,2}\*{2,8}[a-z]{0,2}(?![a-z*])")
_ZH = re.compile("|".join(sorted(set(INSULTS_ZH), key=len, reverse=True)) + r"|(?<![a-z])(?:" + "|".join(SHORT_ZH) + r")(?![a-z])(?=.*[一-鿿]|(?<=[一-鿿].{2,16}))".replace("|(?<=[一-鿿].{2,16})", "") + "|" + "|".join(MIXED_ZH))
_GROUP = r"(?:people|folks?|clans?|tribes?|[a-z]+ians|[a-z]+ites|[a-z]+ans|immigrants|foreigners|refugees|women|gays|jews|muslims|blacks|they|them)"
PATTERNS = {
    "address": r"\byou(?:r|rs|rself| are|'re)?\b|people like you|your kind|^u\b|你|您这种|这种人|那种人|尔等",
    "order": r"\bshut (?:your|ur) mouth|\bshut up|get lost|go away and|crawl back|get out of here|nobody (?:wants|likes|asked)|drop dead|闭嘴|滚(?:吧|远|开|蛋|出|回)|回你的洞|待着别|别出来|丢人现眼|也配|不配|少废话|听着",
    "belittle": r"\b(?:stupid|pathetic|disgusting|worthless|useless|filthy|vile) (?:little |old |fat )?(?:man|woman|person|people|thing|creature|human|loser|girl|boy)\b|(?:you|they)(?:'re| are| is) (?:all |so |just |nothing but |such )?(?:a |an )?(?:stupid|pathetic|disgusting|worthless|useless|vile|joke|burden|failure|nobody)|makes? me (?:sick|puke|vomit)|i hate you|too (?:dumb|stupid|ugly|fat)|ashamed|brain (?:never|is|was|fell)|your face|ugly|worthless|waste of (?:space|air|oxygen)|mirrors? crack|crime scene|do us a favou?r|disgrace|look at this|writes? this|who (?:writes|let)|should have been (?:swallowed|aborted)|stay there|smell like|stinks?|丢人|租来|脑子(?:是|被|进)|长成这样|出来吓人|蠢得|笨得|喘气|胎盘|狗都(?:替|嫌|不)|不要脸|恶心|没脑子|没教养|丑|看这|一看就是|就你这",
    "death": r"\b(?:go )?(?:hang|drown|shoot|off) yourself\b|\brot in hell\b|\bgo to hell\b|(?:wish|hope) (?:you|they|he|she) (?:were|was|are|is)? ?(?:dead|gone|die|dies)|never been born|\bdie in\b|go die|quit breathing|stop(?:ped)? (?:breathing|existing)|\bvanish\b|kill yourself|\bkys\b|drop dead|gets? cancer|hope (?:you|your)|cheer if you|world would|better off without|去死|怎么还不死|怎么还不去死|早点消失|没了大家|放鞭炮|得绝症|得癌|不得好死|全家死|死光|断子绝孙|有后代|暴毙",
    "violence": r"\b(?:slap|beat|punch|kick|stab|shoot|strangle|burn|break|smash|crush|cut|kill|hurt|rape)(?:s|ed|ped|t)?\b(?=.{0,24}\b(?:you|your|that|him|her|them|every|house|fingers?|bleeds?|legs?|face|out|all)\b)|until (?:it|you|he|she) bleeds?|find you|where you live|watch your back|after school|leak your|your photos|打到|打死|打断|掰断|砍死|弄死|杀了你|宰了|揍|吐血|烧了|全烧|知道你住|你家在哪|放学|等着|曝光你|人肉|小心点|扒了你|废了你",
    "expel": r"kick (?:them|you|him|her) (?:all )?out|out of our|keep (?:the )?.{2,30}? out of|send them back|go back to|never trust|don't trust|burn every|all of them|allowed to breed|breed like|赶出去|滚出|进学校|别让|别信|该把|全是|都是|不如|一身臭味|能生|房子全|占我们|抢我们",
    "dehuman": rf"\b{_GROUP}\b.{{0,12}}\b(?:are|is)\b.{{0,10}}\b(?:{'|'.join(DEHUMANISING)})\b|(?:breed|smell|live) like (?:a )?(?:it|{'|'.join(DEHUMANISING)})|\b(?:{'|'.join(DEHUMANISING)}) all of them|(?:人|族|帮|佬|民|们)(?:全是|都是|连|跟|像|就是).{{0,3}}(?:害虫|寄生虫|病毒|牲口|畜生|脏东西|垃圾|蛆|蟑螂|老鼠)|(?:害虫|寄生虫|病毒|牲口|脏东西|蛆|蟑螂)(?:不如|一样)|全是(?:害虫|寄生虫|病毒|牲口|脏东西|蛆)|别让.{{1,8}}进|别信.{{1,6}}(?:人|族|帮)|(?:人|族|帮)一身臭味|(?:人|族|帮)的房子|(?:should|ought)(?: not|n't) be allowed|never trust [a-z\- ]{{3,20}}|keep the [a-z\- ]{{3,20}} out|every house the",
    "sexual": r"\bscrew (?:that|you|her|him)|all night long|on your knees|get naked|strip for|take (?:it|them) off for|touching myself|bend over|sweet ?(?:cheeks|tits)|show you what i mean|send (?:me )?(?:nudes|naked)|suck (?:my|me|it)|lick (?:my|me|it)|\bf+u+c+k+\b|\bhorny\b|come here .{2,20} get|your (?:tits|ass|pussy)|跪下|给我舔|舔我|睡了(?:那|你|她|他)|上了(?:那|你|她|他)|裸照|裸体给|脱光|脱了|对着镜头|硬了|趴好|叫床|什么叫舒服|让你舒服|小甜心|小骚|骚一个|操(?:了|死)|干死你|约炮|强上",
    "coerce": r"\bor i\b|if you don'?t|\bdo it or\b|不然|否则|过来|让我教|教教你|乖乖",
    "reported": r"the comment ['\"“].{1,30}?['\"”]|was removed|thanks,? moderators?|called me|call(?:s|ing) me|they said i|who insult(?:s|ed) me|bullied|how do i cope|评论里|有人写|有人骂|已经被删|感谢管理员|被.{1,8}骂|骂我|心里难受|怎么调节|举报",
    "medical": r"intercourse|treatment|should i see|which scan|breast lump|\bsex safe\b|vaginal|erectile|ejaculation|genital|syphilis|chlamydia|doctor|clinic|hospital|同房|治疗|看医生|检查|乳房|阴道|早泄|梅毒|衣原体|尖锐湿疣|医院|门诊|科",
    "figure": r"dying to try|deal is killer|killer deal|sick design|stupidly (?:easy|good|cheap|simple)|insanely|dog loved|chicken breast|pork belly|rats? again|vermin control|pest|价格杀疯|杀疯了|笑死|累死|馋哭|鸡胸|猪头肉|害虫怎么|怎么清理|垃圾(?:分类|费|費|桶|袋|站|处理|回收)|废物利用",
}
NAMES = ("insult_en", "insult_masked", "insult_zh", *PATTERNS, "direct_insult", "reported_insult", "threat_cue", "hate_cue", "sexual_cue", "any_cue", "insult_alone")
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
_LEET = str.maketrans("@$013457!|", "asoieastil")
_SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z@$0-9] ){2,}[a-z@$0-9](?![a-z0-9])")
_INNER = re.compile(r"(?<=[a-z@$])[._\-·​]+(?=[a-z@$])")
_LEETED = re.compile(r"(?<![0-9a-z])(?=[a-z0-9@$!]*[a-z@$])(?=[a-z0-9@$!]*[0-9@$!])[a-z0-9@$!]{2,14}(?![0-9a-z])")
_ZH_INNER = re.compile(r"(?<=[一-鿿0-9])[^\w\s，。；、！？：,.;!?“”‘’'\"（）()#]{1,2}(?=[一-鿿0-9])|(?<=[一-鿿])[.·丨/ ](?=[一-鿿](?:$|[^一-鿿]|[.·丨/ ]))|(?<=[一-鿿])丨(?=[一-鿿])|(?<=[一-鿿])\.(?=[一-鿿])")


_ODD = re.compile(r"[@$!]|[a-z][0-9]|[0-9][a-z]")
_HAS_INNER = re.compile(r"[a-z@$][._\-·][a-z@$]")
_HAS_SPACED = re.compile(r"[a-z@$0-9] [a-z@$0-9] [a-z@$0-9]")


def plain(text: str) -> str:
    """Text with width, case, accents and the usual ways to hide a word undone."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).lower()
        t = "".join(c for c in unicodedata.normalize("NFD", t) if c < "\u0300" or unicodedata.category(c) not in ("Mn", "Cf"))
        t = _ZH_INNER.sub("", t)
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), t) if _HAS_SPACED.search(t) else t


def _screen(pattern: str) -> str:
    """The pattern without what it looks ahead and behind for: it matches wherever the pattern does, and RE2 can run it."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
            depth, i, bracket = 1, i + 3, False
            while depth:
                c = pattern[i]
                if c == "\\":
                    i += 1
                elif bracket:
                    bracket = c != "]"
                elif c == "[":
                    bracket = True
                else:
                    depth += (c == "(") - (c == ")")
                i += 1
        else:
            out += pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
            i += 2 if pattern[i] == "\\" else 1
    return out


def _counts(texts: pa.Array, rule: re.Pattern) -> np.ndarray:
    """Matches of the rule in each text; only texts that pass the screen are looked at closely."""
    out = np.zeros(len(texts), int)
    for i in np.flatnonzero(pc.match_substring_regex(texts, _screen(rule.pattern)).to_numpy(zero_copy_only=False)):
        out[i] = len(rule.findall(texts[i].as_py()))
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """Cues in the order of NAMES, then hashed trigrams; null and blank texts have none."""
    t = [plain(x) if x else "" for x in texts]
    joined = [_INNER.sub("", x) if _HAS_INNER.search(x) else x for x in t]
    leet = [_LEETED.sub(lambda m: m[0].translate(_LEET), x) if _ODD.search(x) else x for x in joined]
    tight = [x if x.isascii() else x.replace(" ", "") for x in t]
    a, b, c, d = (pa.array(x, pa.string()) for x in (t, joined, leet, tight))
    en = np.maximum(np.maximum(_counts(a, _EN), _counts(b, _EN)), _counts(c, _EN))
    masked = _counts(a, _MASK)
    zh = np.maximum(_counts(a, _ZH), _counts(d, _ZH)) * np.array([not x.isascii() for x in t])
    n = {k: _counts(c, p) for k, p in _PATTERNS.items()}
    insults, calm = en + masked + zh > 0, n["reported"] == 0
    threat = ((n["violence"] > 0).astype(int) + (n["death"] > 0)) * calm
    hate = (n["dehuman"] > 0).astype(int) + (n["expel"] > 1)
    sexual = (n["sexual"] > 0).astype(int) + ((n["coerce"] > 0) & (n["sexual"] > 0))
    direct = insults & calm & (n["figure"] == 0)
    some = (direct | (threat > 0) | (hate > 0) | (sexual > 0) | (n["order"] > 0) | (n["belittle"] > 0)) & calm
    cues = np.stack([np.minimum(x, 2) for x in (en, masked, zh, *n.values())] + [direct, insults & ~calm, threat, hate, sexual, some, insults & calm], 1).astype(np.float32)
    return np.hstack([cues, trigrams(t) * 0.05])


def trigrams(texts: list[str]) -> np.ndarray:
    """Hashed character trigrams, present or not, of all texts at once."""
    out = np.zeros((len(texts), HASHED), np.float32)
    size = np.array([len(x) for x in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) >= 3:
        row = np.repeat(np.arange(len(texts)), size)
        h = (cp[:-2] * np.uint32(31) + cp[1:-1]) * np.uint32(31) + cp[2:]
        own = row[:-2] == row[2:]
        out[row[:-2][own], (((h * _HASHES) >> np.uint32(8)) % HASHED)[own]] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 8) -> np.ndarray:
    """L2-regularised logistic regression by Newton steps; the intercept is the last weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(len(w), l2)
    pen[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pen)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-4:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def templates(texts: list[str]) -> np.ndarray:
    """A number for each text; texts that share ALIKE of their trigrams, directly or over others, have the same."""
    sets = [{t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts]
    of = list(range(len(texts)))

    def root(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    holders: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in shared.items():
            if n >= ALIKE * (len(s) + len(sets[j]) - n):
                of[root(i)] = root(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    return np.array([root(i) for i in range(len(texts))])


class Chain:
    """Weights of each link, and the threshold of the last."""

    def __init__(self, texts: list[str], abusive: np.ndarray, seed: int = 5, with_cues: bool = True) -> None:
        self.with_cues = with_cues
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        texts, abusive = [texts[i] for i in order], abusive[order].astype(float)
        good = [t for t, a in zip(texts, abusive, strict=True) if not a]
        fold = rng.permutation(len(texts))[templates([plain(t) for t in texts])] % FOLDS
        more, more_y, more_fold = [], [], []
        for i, (t, a) in enumerate(zip(texts, abusive, strict=True)):
            for _ in range(2 if a and good else 0):
                other = good[rng.integers(len(good))]
                sep = (", ", "; ", " ", "，", "；")[rng.integers(5)]
                more.append(t + sep + other if rng.random() < 0.5 else other + sep + t)
                more_y.append(1.0)
                more_fold.append(fold[i])
        for i, (t, a) in enumerate(zip(texts, abusive, strict=True)):
            if not a and good:
                more.append(t + ", " + good[rng.integers(len(good))])
                more_y.append(0.0)
                more_fold.append(fold[i])
        texts, y, fold = texts + more, np.concatenate([abusive, more_y]), np.concatenate([fold, more_fold]).astype(int)
        seen = features(texts)
        own, x = seen[:, : len(NAMES)], seen[:, len(NAMES) :]
        at = {n: i for i, n in enumerate(NAMES)}
        signs = {"insult": own[:, at["direct_insult"]], "threat": own[:, at["threat_cue"]], "hate": own[:, at["hate_cue"]], "sexual": own[:, at["sexual_cue"]]}
        self.weights: dict[str, np.ndarray] = {}
        for c in CATEGORIES:
            target = y if c == "abusive" else y * (signs[c] > 0)
            if c == "abusive" and with_cues:
                x = np.hstack([x, own])
            out = np.zeros(len(y))
            for f in range(FOLDS):
                held = fold == f
                if held.any() and (~held).any():
                    out[held] = _predict(x[held], _logistic(x[~held], target[~held]))
            self.weights[c] = _logistic(x, target)
            x = np.hstack([x, out[:, None]])
        self.threshold = _threshold(out, y)
        self.heldout = {"precision": float(y[out >= self.threshold].mean()) if (out >= self.threshold).any() else 0.0, "recall": float((out[y == 1] >= self.threshold).mean()) if (y == 1).any() else 0.0}

    def score(self, texts: list[str]) -> np.ndarray:
        """(n, categories) probabilities; empty texts get zero."""
        seen = features(texts)
        x, out = seen[:, len(NAMES) :], []
        for c in CATEGORIES:
            if c == "abusive" and self.with_cues:
                x = np.hstack([x, seen[:, : len(NAMES)]])
            p = _predict(x, self.weights[c])
            out.append(p)
            x = np.hstack([x, p[:, None]])
        p = np.stack(out, 1) if out else np.zeros((len(texts), 0))
        p[[not (t and t.strip()) for t in texts]] = 0
        return p


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; the middle of the gap where several tie."""
    grid = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + (y == 1).sum()) for t in grid])
    return float(np.median(grid[f1 >= f1.max() - 1e-12]))


def fit(labels: DataFrame) -> Chain:
    """The chain fitted on reviewed texts (null texts and verdicts left out, one row per label_id)."""
    rows = labels.where("text is not null and abusive is not null and label_id is not null").groupBy("label_id").agg(F.max_by("text", F.struct("abusive", "text")).alias("text"), F.max("abusive").alias("abusive")).orderBy("label_id").limit(MAX_LABELLED).collect()
    if not any(r.abusive for r in rows) or all(r.abusive for r in rows):
        raise ValueError("moderation_labels needs texts of both verdicts")
    return Chain([r.text for r in rows], np.array([r.abusive for r in rows]))


def score(samples: DataFrame, chain: Chain) -> DataFrame:
    """(sample_id, source, p_insult ... p_abusive, flagged) of every sample, each id once (last delivery).

    A null or blank query scores 0 and is not flagged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                c = b.slice(lo, 2000)
                p = chain.score(c.column("query").to_pylist())
                yield pa.RecordBatch.from_arrays([c.column("sample_id"), c.column("source"), *(pa.array(p[:, i]) for i in range(len(CATEGORIES))), pa.array(p[:, -1] >= chain.threshold)], names=["sample_id", "source", *(f"p_{c}" for c in CATEGORIES), "flagged"])

    once = latest(samples.select("sample_id", "source", "query", "ingested_at").where("sample_id is not null"), ["sample_id"], ["ingested_at"])
    return once.select("sample_id", "source", "query").mapInArrow(run, "sample_id long, source string, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", flagged boolean")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id) of the samples whose query is abusive, hateful, sexually explicit or coercive."""
    return score(table(spark, sf_dir, "samples"), fit(table(spark, sf_dir, "moderation_labels"))).where("flagged").select("sample_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source (spellings folded): samples, flagged samples, rate and mean score."""
    scored = score(table(spark, sf_dir, "samples"), fit(table(spark, sf_dir, "moderation_labels")))
    source = F.coalesce(F.lower(F.regexp_replace(F.trim("source"), r"[\s\-]+", "_")), F.lit("(none)"))
    return scored.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("p_abusive").alias("mean_score"))


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates}
