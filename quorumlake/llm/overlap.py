"""Problem 1: records of evaluation splits that recur in the training split.

Edit-distance segment join. Texts are brought to a canonical form (width, case, marks, filler words, common variants of
characters) and turned so that they begin at an anchor, their largest number, because clauses may have changed places; what
is left between two copies is a few edits: characters put in, left out, replaced, or swapped with a neighbour. Evaluation
strings are cut into K + 1 segments; K edits leave the inside of one of them as it is (a swap across a border touches only the
outermost characters of two segments, which are no part of the key), so training strings look their substrings up at the
places such a segment can have moved to. Task, image file and the numbers must be equal for two samples to be one record, so
they are part of every key. Candidates are verified by a banded dynamic program over the two strings, then by what kind of
edits they are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, latest, table
from .bits import contained, table_of

K = 3  # edits between the turned strings of one record, at most
SHORT = 12  # characters under which a string is cut in two and may hold one edit
IMAGE_ONLY = ("image_classification", "image_attribution_recognition")
IMAGE_AND_TEXT = ("image_text_relevance",)

# Filler words, words that a slip may drop, characters often written for one another, traditional forms.
FILLERS_EN = "um uh er hi hello hey please pls plz thanks thank thx asking q question ok so well".split()
FILLERS_ZH = "请问 您好 你好 麻烦看下 麻烦看一下 麻烦 那个 谢谢大家 谢谢 多谢 在线等 急急".split()
ENDINGS_ZH = "啊呢急吧哦呀哈"
MINOR_EN = set("the a an in on at for of by to with and is it as from".split())
MINOR_ZH = set("了的得地在是吗嘛啊呢吧就也都又还因为会要去来到过给")
VARIANTS = "勒了 地的 得的 再在 作做 音因 嘛吗 经径 该改 以已 那哪 象像 座坐 带戴 帐账 须需 她他 它他 决绝 既即 侯候 题提 进近 道到"
TRADITIONAL = "問问 嗎吗 後后 會会 歲岁 個个 給给 發发 買买 過过 醫医 頭头 費费 實实 規规 與与 場场 時时 麼么 裡里 裏里 們们 這这 來来 說说 話话 對对 開开 關关 門门 車车 馬马 鳥鸟 魚鱼 長长 東东 書书 學学 國国 電电 腦脑 機机 單单 號号 檢检 驗验 測测 試试 覺觉 點点 線线 紅红 綠绿 藍蓝 黃黄 鐘钟 錢钱 銀银 鐵铁 雞鸡 豬猪 貓猫 飯饭 湯汤 餅饼 藥药 療疗 痠酸 腫肿 壓压 緊紧 膚肤 鼻鼻 氣气 風风 雲云 雨雨 塵尘 運运 動动 練练 習习 節节 葉叶 萬万 億亿 兩两 雙双 隻只 條条 張张 樓楼 層层 橋桥 橫横 鄉乡 鎮镇 縣县 灣湾 島岛 嶺岭 陽阳 陰阴 陳陈 劉刘 楊杨 趙赵 吳吴 孫孙 華华 歐欧 韓韩 語语 詞词 讀读 寫写 聽听 見见 視视 觀观 認认 識识 記记 錄录 讓让 請请 謝谢 誰谁 為为 無无 從从 應应 當当 經经 結结 約约 級级 紙纸 統统 計计 數数 據据 標标 準准 評评 論论 議议 員员 業业 務务 產产 質质 價价 賣卖 購购 訂订 貨货 費费 還还 選选 邊边 遠远 連连 週周 環环 園园 團团 圖图 聲声 響响 樣样 種种 類类 構构 熱热 燒烧 燈灯 爺爷 離离 難难 難难 靜静 頂顶 順顺 顏颜 額额 願愿 飛飞 餘余 驚惊 體体 鬆松 麗丽 齊齐 龍龙 減减 準准 滿满 漲涨 潔洁 濕湿 災灾 獎奖 現现 療疗 盤盘 監监 確确 禮礼 積积 窩窝 競竞 築筑 簡简 糧粮 縮缩 總总 續续 網网 罰罚 聯联 職职 脫脱 臉脸 舊旧 藝艺 處处 補补 裝装 複复 證证 變变 豐丰 負负 貝贝 財财 貼贴 賽赛 贈赠 趕赶 軟软 輕轻 較较 輛辆 輪轮 轉转 辦办 農农 遊游 遲迟 適适 鄰邻 醬酱 鋪铺 錯错 鍋锅 鎖锁 閉闭 間间 閱阅 隊队 階阶 隨随 險险 雜杂 露露 預预 領领 題题 養养 駕驾 騎骑 骨骨 髮发 鬧闹"
_MAP = {ord(p[0]): p[1] for p in f"{TRADITIONAL} {VARIANTS}".split()}
_MAP = {k: _MAP.get(ord(v), v) for k, v in _MAP.items()}
_FILL = re.compile("|".join(sorted(FILLERS_ZH, key=len, reverse=True)))
_END = re.compile(f"[{ENDINGS_ZH}]+(?=[^\\w]*$|[，,；;。！!？? ])")
_ASKED = re.compile(r"^\W*问\s*[:：]")
_TAG = re.compile(r"<[a-z/!][^<>]{0,200}>", re.I)
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_㐀-鿿]+|[㐀-鿿]")
_GROUPED = re.compile(r"(?<=\d),(?=\d{3}(?:\D|$))")


def tokens(text: str | None) -> list[str]:
    """Words, numbers and Han characters of a canonical text, filler words left out."""
    if not text:
        return []
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    t = unicodedata.normalize("NFKC", text).lower()
    if "<" in t:
        t = _TAG.sub(" ", t)
    if not t.isascii():
        t = _END.sub("", _FILL.sub(" ", _ASKED.sub("", t)))
        t = unicodedata.normalize("NFC", t).translate(_MAP)
    if "," in t:
        t = _GROUPED.sub("", t)
    found = _TOKEN.findall(t)
    kept = [x for x in found if x not in _FILLER_SET]
    return kept or found


_FILLER_SET = set(FILLERS_EN)
_MINOR_LETTERS = {"".join(sorted(x)) for x in MINOR_EN if len(x) > 2}  # minor words with letters swapped are minor words


def forms(toks: list[str]) -> list[str]:
    """The text turned to begin at an anchor: its largest number. Without numbers: at the words of largest and of
    smallest checksum, and as it stands, so that a slip in one anchor leaves another.
    """
    core = [x for x in toks if x not in MINOR_EN and not (3 <= len(x) <= 4 and "".join(sorted(x)) in _MINOR_LETTERS)] or toks
    core = [x for i, x in enumerate(core) if not i or x != core[i - 1] or len(x) == 1 or x[0].isdecimal()]  # a word written twice
    if not core:
        return []
    numbers = [i for i, x in enumerate(core) if x[0].isdecimal()]
    if numbers:
        starts = [max(numbers, key=lambda i: (len(core[i]), core[i], core[(i + 1) % len(core)]))]
    else:
        sums = [(_sum(x), i) for i, x in enumerate(core)]
        starts = sorted({max(sums)[1], min(sums)[1], 0})
    return ["".join(core[i:] + core[:i]) for i in starts]


def _sum(word: str) -> int:
    n = 0
    for c in word:
        n = (n * 1_000_003 + ord(c)) & 0xFFFFFFFF
    return (n * 2_654_435_761) & 0xFFFFFFFF


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, in a band of `most`; most + 1 if it is greater."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    two, one = [far] * (m + 1), [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        low = far
        for j in range(max(1, i - most), min(m, i + most) + 1):
            d = one[j - 1] if a[i - 1] == b[j - 1] else 1 + min(one[j - 1], one[j], row[j - 1])
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, two[j - 2] + 1)
            row[j] = min(d, far)
            low = min(low, row[j])
        if low >= far and min(row[0], low) >= far:
            return far
        two, one = one, row
    return min(one[m], far)


def near(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether osa(a[i], b[i]) <= most[i], of many pairs at once: the band of the matrix, row by row for all of them."""
    n, m = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    out = np.zeros(len(a), bool)
    k = int(most.max()) if len(a) else 0
    fit = np.flatnonzero(np.abs(n - m) <= most)
    for some in np.array_split(fit[np.argsort(n[fit], kind="stable")], max(1, -(-len(fit) // 20_000))):
        if not len(some):
            continue
        rows, far, width = int(n[some].max()), k + 1, 2 * k + 1
        x, y = _padded([a[i] for i in some], rows + 2, 0), _padded([b[i] for i in some], rows + 3 * k + 4, k + 1)
        offset = np.arange(-k, k + 1)
        one = np.where(offset >= 0, np.minimum(offset, far), far)[None, :].repeat(len(some), 0).astype(np.int8)  # row 0
        two = np.full_like(one, far)
        last = one.copy()
        for i in range(1, rows + 1):
            c = x[:, i - 1, None]
            at = i + k  # y[:, at + o] is the character b[i + o - 1]
            d = y[:, at - k : at + k + 1]
            row = one + (c != d)
            row[:, :-1] = np.minimum(row[:, :-1], one[:, 1:] + 1)
            if i > 1:
                swapped = (c == y[:, at - k - 1 : at + k]) & (x[:, i - 2, None] == d)
                row = np.where(swapped, np.minimum(row, two + 1), row)
            row[:, (i + offset) < 0] = far
            if i <= k:
                row[:, k - i] = i  # nothing of b yet
            for o in range(1, width):
                row[:, o] = np.minimum(row[:, o], row[:, o - 1] + 1)
            row = np.minimum(row, far).astype(np.int8)
            two, one = one, row
            done = n[some] == i
            last[done] = row[done]
        out[some] = last[np.arange(len(some)), k + m[some] - n[some]] <= most[some]
    return out


def _padded(texts: list[str], width: int, before: int) -> np.ndarray:
    """Code points of each text in a row, `before` empty places first."""
    out = np.zeros((len(texts), width + before), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    keep = np.minimum(lens, width)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(len(cp)) - np.repeat(np.cumsum(lens) - lens, lens)
    row = np.repeat(np.arange(len(texts)), lens)
    use = at < keep[row]
    out[row[use], before + at[use]] = cp[use] + 1
    return out


def most_edits(text: str) -> int:
    """Edits that a turned string of evaluation may hold."""
    return K if len(text) >= SHORT else 1


def same_record(a: list[str], b: list[str]) -> bool:
    """Whether two canonical texts differ by slips of the pen, small words and order of clauses alone."""
    if a == b:
        return True
    ca, cb = Counter(a), Counter(b)
    da, db = ca - cb, cb - ca
    left, right = list(da.elements()), list(db.elements())
    if len(left) + len(right) > 12:
        return False
    if any(x[0].isdecimal() for x in left + right):
        return False
    slips, small = 0, 0
    for x in list(left):
        if len(x) < 3 or x not in left:
            continue
        for y in right:
            if len(y) >= 2 and x[0] != "" and osa(x, y, 1) <= 1 and (len(x) > 3 or sorted(x) == sorted(y) or len(x) != len(y)):
                left.remove(x)
                right.remove(y)
                slips += 1
                break
    for x in list(left):  # characters that stand for one another
        han = [y for y in right if _han(x) and _han(y) and _variant(x, y)]
        if han:
            left.remove(x)
            right.remove(han[0])
            slips += 1
    for side, other in ((left, cb), (right, ca)):
        for x in side:
            if x in MINOR_EN:
                small += 1
            elif _han(x) and (x in MINOR_ZH or x in other):
                slips += 1
            elif _han(x) and not (left and right):
                slips += 1
            elif x in other and len(x) > 1:  # a word written twice
                slips += 1
            else:
                return False
    if slips > 3 or small > 6 or len(a) < 2:
        return False
    # Clauses may change places, words within them not: few neighbourhoods may break.
    a2, b2 = [x for x in a if x not in MINOR_EN], [x for x in b if x not in MINOR_EN]
    broken = sum((Counter(zip(a2, a2[1:], strict=False)) - Counter(zip(b2, b2[1:], strict=False))).values())
    return broken <= 2 * slips + 3


def _han(x: str) -> bool:
    return len(x) == 1 and "㐀" <= x <= "鿿"


def _variant(x: str, y: str) -> bool:
    """One of two characters is a form outside the simplified standard set, the other inside."""
    inside = []
    for c in (x, y):
        try:
            c.encode("gb2312")
            inside.append(True)
        except UnicodeEncodeError:
            inside.append(False)
    return inside[0] != inside[1]


def image_key(path: Column) -> Column:
    """An image file's name without place, parameters, extension and case; '' where there is none."""
    base = F.element_at(F.split(F.regexp_replace(F.trim(path), r"[?#!].*$", ""), r"[/\\]"), -1)
    return F.coalesce(F.lower(F.regexp_replace(base, r"\.[A-Za-z0-9]{2,5}$", "")), F.lit(""))


_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_keys(texts: list[str], blocks: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): insides of segments of evaluation strings, or the substrings of training strings that can equal one.

    An evaluation string of SHORT characters or more is cut into K + 1 segments, a shorter one in two; under six characters it
    is one key as a whole.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lo = np.concatenate([[0], np.cumsum(lens)])[:-1]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(cp), _B)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(cp), _BI)]), dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((cp + np.uint64(7)) * power[:-1], dtype=np.uint64)])
    block = blocks.astype(np.int64).view(np.uint64)
    rows, keys = [], []
    for k, least, most in ((K, SHORT, np.iinfo(np.int64).max), (1, 6, SHORT)):
        for d in (0,) if query else range(-k, k + 1):
            length = lens + d  # of the evaluation string
            mine = (length >= least) & (length < most)
            base, extra = length // (k + 1), length % (k + 1)
            for i in range(k + 1):
                long = i - (k + 1 - extra)  # how many longer segments lie before, when positive
                start = base * i + np.maximum(long, 0)
                width = base + (long >= 0)
                for s in (0,) if query else range(-k, k + 1):
                    at = start + s + 1
                    ok = mine & (at >= 0) & (at + width - 2 <= lens)
                    if not query:  # with i edits before the segment at most and k - i behind it
                        ok &= (abs(s) <= i) & (np.abs(s + d) <= k - i)
                    r = np.flatnonzero(ok)
                    if not len(r):
                        continue
                    p = lo[r] + at[r]
                    h = (prefix[p + width[r] - 2] - prefix[p]) * inverse[p]
                    rows.append(r)
                    keys.append(_mix(h ^ _mix(block[r] + np.uint64((i + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) ^ (length[r].astype(np.uint64) << np.uint64(40))).view(np.int64))
    short = np.flatnonzero(lens < SHORT)
    if len(short):
        rows.append(short)
        keys.append(_mix((prefix[lo[short] + lens[short]] - prefix[lo[short]]) * inverse[lo[short]] ^ block[short]).view(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys)


def sides(samples: DataFrame) -> DataFrame:
    """(sample_id, task, side, source, split, image, query) of the samples that can take part, each once.

    side is 'train' or 'eval'; another or no split, a blank query, and a null id or task take no part. A row delivered
    twice counts once, by its last delivery.
    """
    split = F.lower(F.regexp_replace(F.translate("split", "ＴＲＡＩＮＤＥＶＳｔｒａｉｎｄｅｖｓ", "TRAINDEVStraindevs"), r"\s", ""))
    once = latest(samples.select("sample_id", "task", "split", "source", "query", "image_url", "ingested_at").where("sample_id is not null and task is not null"), ["sample_id"], ["ingested_at"])
    side = F.when(split == "train", "train").when(split.isin("dev", "test"), "eval")
    image = F.when(F.col("task").isin(*IMAGE_ONLY), image_key(F.col("query"))).when(F.col("task").isin(*IMAGE_AND_TEXT), image_key(F.col("image_url"))).otherwise("")
    return once.select("sample_id", "task", side.alias("side"), "source", split.alias("split"), image.alias("image"), "query").where(side.isNotNull() & (F.regexp_replace(F.coalesce("query", F.lit("")), r"[\s　\x{00A0}]", "") != ""))


def sketches(texts: list[str]) -> np.ndarray:
    """64 parities of the neighbouring characters that occur in each text."""
    lens = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(len(texts), np.uint64)
    if len(cp) > 1:
        row = np.repeat(np.arange(len(texts)), lens)
        own = row[:-1] == row[1:]
        bit = np.uint64(1) << (_mix(cp[:-1][own] * np.uint64(1 << 21) + cp[1:][own]) % np.uint64(64))
        np.bitwise_xor.at(out, row[:-1][own], bit)
    return out


FLIPS = 6 * K  # parities that K edits can flip: a swap of neighbours changes three pairs of characters, each gone and come
PAIRS_AT_ONCE = 4_000_000


def _joined(block: np.ndarray, toks: list[str], spelt: list[list[str]], asks: np.ndarray, has: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (evaluation text, training text) of one record among the texts of some blocks."""
    of = np.repeat(np.arange(len(spelt)), [len(x) for x in spelt])
    flat = [x for xs in spelt for x in xs]
    sides_ = []
    for use, query in ((asks, True), (has, False)):
        mine = np.flatnonzero(use[of])
        r, k = segment_keys([flat[i] for i in mine], block[of[mine]], query)
        o = np.argsort(k, kind="stable")
        sides_.append((k[o], mine[r][o]))
    (ek, et), (tk, tt) = sides_
    lo, hi = np.searchsorted(ek, tk), np.searchsorted(ek, tk, "right")
    n = hi - lo
    some = np.flatnonzero(n)
    shape = sketches(flat)
    seen: set[int] = set()
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // PAIRS_AT_ONCE)) + 1):
        t = np.repeat(tt[part], n[part])
        e = et[np.repeat(lo[part], n[part]) + np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])]
        fit = (of[e] != of[t]) & (np.bitwise_count(shape[e] ^ shape[t]) <= FLIPS)
        both = np.unique(e[fit].astype(np.int64) * len(flat) + t[fit])
        e, t = both // len(flat), both % len(flat)
        a, b = [flat[i] for i in e.tolist()], [flat[i] for i in t.tolist()]
        ok = near(a, b, np.array([most_edits(x) for x in a], np.int64)) if len(a) else np.zeros(0, bool)
        for x in np.unique(of[e[ok]].astype(np.int64) * len(toks) + of[t[ok]]).tolist():
            if x not in seen:
                seen.add(x)
                i, j = divmod(x, len(toks))
                if same_record(toks[i].split(" "), toks[j].split(" ")):
                    yield i, j


MAX_BLOCK = 1024  # samples of one task, image and numbers that one task joins; larger blocks are joined over the cluster
BROADCAST = 400_000  # numbers of blocks that the JVM joins by broadcast; beyond, both sides are shuffled
COPIES = 10_000  # samples of one text that go to one task when its pairs are written out


def overlaps(samples: DataFrame) -> DataFrame:
    """(eval_id, train_id): every pair of one record across the splits, exact copies included.

    Samples of equal task, image file and numbers form a block; blocks are counted first. Those of up to MAX_BLOCK samples are
    joined where they lie after one shuffle, larger ones, which no task could hold, over the cluster, by the same keys and the
    same verification.
    """

    def canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = [["image"] if t in IMAGE_ONLY else tokens(q) for t, q in zip(b.column("task").to_pylist(), b.column("query").to_pylist(), strict=True)]
            numbers = [" ".join(sorted(x for x in t if x[0].isdecimal())) for t in toks]
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), b.column("task"), b.column("eval"), b.column("image"), pa.array([" ".join(t) for t in toks], pa.string()), pa.array(numbers, pa.string())], names=["sample_id", "task", "eval", "image", "toks", "numbers"])

    part = sides(samples).select("sample_id", "task", (F.col("side") == "eval").alias("eval"), "image", "query")
    text = part.mapInArrow(canonical, "sample_id long, task string, eval boolean, image string, toks string, numbers string")
    text = cut(text.where("toks != ''").select("sample_id", "eval", F.xxhash64("task", "image", "numbers").alias("block"), "toks"))
    blocks = cut(text.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("eval").alias("e"), F.min("eval").alias("t")).where("e and not t").select("block", "n"))
    large = blocks.where(F.col("n") > MAX_BLOCK).select("block")  # one in MAX_BLOCK samples at most
    small = blocks.where(F.col("n") <= MAX_BLOCK).select("block")
    rest = text.join(F.broadcast(small), "block", "left_semi") if small.count() <= BROADCAST else text.join(F.broadcast(large), "block", "left_anti").join(small, "block", "left_semi")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 20_000:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                block = whole.column("block").to_numpy()
                use = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
                if use:
                    yield pairs(whole.slice(0, use))
                held = [whole.slice(use)]
        if sum(map(len, held)):
            yield pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def pairs(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, block, is_eval = b.column("sample_id").to_numpy(), b.column("block").to_numpy(), b.column("eval").to_pylist()
        at: dict[tuple[int, str], int] = {}
        members: list[tuple[list[int], list[int]]] = []
        for i, key in enumerate(zip(block.tolist(), b.column("toks").to_pylist(), strict=True)):
            no = at.setdefault(key, len(members))
            if no == len(members):
                members.append(([], []))
            members[no][0 if is_eval[i] else 1].append(int(ids[i]))
        toks = [k[1] for k in at]
        own = np.array([k[0] for k in at], np.int64)
        asks, has = np.array([bool(m[0]) for m in members]), np.array([bool(m[1]) for m in members])
        left, right = [], []
        same = ((i, i) for i in np.flatnonzero(asks & has))
        for i, j in (*same, *_joined(own, toks, [forms(t.split(" ")) for t in toks], asks, has)):
            for e in members[i][0]:  # of one block, so MAX_BLOCK squared at most
                left += [e] * len(members[j][1])
                right += members[j][1]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["eval_id", "train_id"])

    out = rest.repartition("block").sortWithinPartitions("block").select("block", "sample_id", "eval", "toks").mapInArrow(join, "eval_id long, train_id long")
    return out if large.isEmpty() else out.unionByName(spread(text.join(F.broadcast(large), "block", "left_semi")))


def spread(text: DataFrame) -> DataFrame:
    """The join of large blocks over the cluster: (eval_id, train_id) of (sample_id, eval, block, toks).

    One representative for each distinct text is joined; copies meet again through the links between texts.
    """
    text = text.withColumn("text_id", F.xxhash64("block", "toks"))
    texts = text.groupBy("text_id").agg(F.first("block").alias("block"), F.first("toks").alias("toks"), F.count_if("eval").alias("n_eval"), F.count_if(~F.col("eval")).alias("n_train"))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spelt = [forms(t.split(" ")) for t in b.column("toks").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spelt, pa.list_(pa.string()))], names=[*b.schema.names, "forms"])

    texts = cut(texts.mapInArrow(turned, "text_id long, block long, toks string, n_eval long, n_train long, forms array<string>"))

    def keyed(query: bool, held: Broadcast | None = None):  # noqa: ANN202
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None if held is None else np.frombuffer(held.value, np.uint8)
            for b in batches:
                for lo in range(0, len(b), 2000):
                    c = b.slice(lo, 2000)
                    spelt = c.column("forms").to_pylist()
                    of = np.repeat(np.arange(len(c)), [len(x) for x in spelt])
                    no = np.concatenate([np.arange(len(x)) for x in spelt]) if len(of) else of
                    flat = [x for xs in spelt for x in xs]
                    shape = sketches(flat).view(np.int64)
                    r, k = segment_keys(flat, c.column("block").to_numpy()[of], query)
                    if bits is not None:
                        use = contained(bits, k.view(np.uint64))
                        r, k = r[use], k[use]
                    yield pa.RecordBatch.from_arrays([pa.array(k), c.column("text_id").take(pa.array(of[r])), pa.array(no[r].astype(np.int32)), pa.array(shape[r])], names=["h", "text_id", "form", "shape"])

        return emit

    keys = "h long, text_id long, form int, shape long"
    asking = texts.where("n_eval > 0").select("forms", "block", "text_id").mapInArrow(keyed(True), keys)
    # Training strings have many substrings; those that are no segment of any evaluation string don't travel.
    held = text.sparkSession.sparkContext.broadcast(table_of(asking, 8 * texts.where("n_eval > 0").count()))
    have = texts.where("n_train > 0").select("forms", "block", "text_id").mapInArrow(keyed(False, held), keys).alias("y")
    ask = asking.alias("x")
    alike = (F.col("x.h") == F.col("y.h")) & (F.col("x.text_id") != F.col("y.text_id")) & (F.bit_count(F.col("x.shape").bitwiseXOR(F.col("y.shape"))) <= FLIPS)
    pairs = ask.join(have, alike).select(F.col("x.text_id").alias("e"), F.col("x.form").alias("ef"), F.col("y.text_id").alias("t"), F.col("y.form").alias("tf")).distinct()
    written = texts.select("text_id", "toks", "forms")
    pairs = pairs.join(written.select(F.col("text_id").alias("e"), F.col("toks").alias("e_toks"), F.col("forms").alias("e_forms")), "e").join(written.select(F.col("text_id").alias("t"), F.col("toks").alias("t_toks"), F.col("forms").alias("t_forms")), "t")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = near(a, c, np.array([most_edits(x) for x in a], np.int64)) if a else np.zeros(0, bool)
            both = b.filter(pa.array(ok))
            keep = [same_record(x.split(" "), y.split(" ")) for x, y in zip(both.column("e_toks").to_pylist(), both.column("t_toks").to_pylist(), strict=True)]
            both = both.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([both.column("e"), both.column("t")], names=["e", "t"])

    close = pairs.select("e", "t", "e_toks", "t_toks", F.get("e_forms", "ef").alias("a"), F.get("t_forms", "tf").alias("b")).mapInArrow(verify, "e long, t long").distinct()
    same = texts.where("n_eval > 0 and n_train > 0").select(F.col("text_id").alias("e"), F.col("text_id").alias("t"))
    links = cut(close.unionByName(same))
    # Texts of very many copies are few; their samples and links are split alike, so that no task writes out all pairs.
    crowds = cut(texts.select("text_id", F.ceil(F.greatest("n_eval", "n_train") / COPIES).cast("int").alias("ways")).where("ways > 1"))
    ways = F.broadcast(crowds)
    members = text.join(ways, "text_id", "left").select("sample_id", "eval", "text_id", F.pmod(F.xxhash64("sample_id"), F.coalesce("ways", F.lit(1))).cast("int").alias("salt"))
    for side, name, eval_ in (("e", "eval_id", True), ("t", "train_id", False)):
        mine = members.where(F.col("eval") == eval_).select(F.col("text_id").alias(side), F.col("sample_id").alias(name), "salt")
        split = links.join(ways.withColumnRenamed("text_id", side), side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
        links = split.join(mine, [side, "salt"]).drop("salt")
    return links.select("eval_id", "train_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id_1, sample_id_2) of every pair, the smaller id first."""
    return overlaps(table(spark, sf_dir, "samples")).select(F.least("eval_id", "train_id").alias("sample_id_1"), F.greatest("eval_id", "train_id").alias("sample_id_2"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task, split and source of the evaluation side: samples, samples that recur in train, and pairs."""
    samples = table(spark, sf_dir, "samples")
    source = F.coalesce(F.lower(F.regexp_replace(F.trim("source"), r"[\s\-]+", "_")), F.lit("(none)"))
    part = sides(samples).where("side = 'eval'").select("sample_id", "task", "split", source.alias("source"))
    found = overlaps(samples).groupBy("eval_id").agg(F.count(F.lit(1)).alias("pairs"))
    return part.join(found, part.sample_id == found.eval_id, "left").groupBy("task", "split", "source").agg(F.count(F.lit(1)).alias("n_samples"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
