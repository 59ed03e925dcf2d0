"""Problem 9: text decoded with the wrong character encoding.

From every distinct clean word of the corpus (words with characters beyond ASCII, single such characters, and pairs of
neighbours where a chain works on two at once) its garbled forms under all encoding chains are made, and joined by hash
with the tokens of the documents. No word is too rare or too long. What travels with each task is two bit tables of bounded
size that tell which tokens and which forms cannot meet; tokens and forms themselves stay on the cluster. A form that no
ordinary text has, verified by undoing its chain, counts however common it is. Any other counts only where the word it comes
from is far more common than the form itself, so that words that are right as they stand are left alone. Verified originals
are put back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import cut, table
from .bits import contained, table_of

RATIO = 4  # texts with the word for each text with a garbled form that could be ordinary text, at least
BROADCAST = 400_000  # garbled forms found that the JVM joins by broadcast (some 40 MB); beyond, both sides are shuffled
SALTS = 16  # ways a form that very many documents hold is split then
WEAK = 3  # different garbled forms needed where each alone could be ordinary text
CHARS = 400_000  # characters split into tokens at once
TEXTS = 4096  # texts split at once, at most
WORDS = 20_000  # words garbled at once

# Encodings a text may have been in, and ones it may have been read as.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "cp1250")
DOUBLE = ("gbk", "big5", "shift_jis", "euc_kr")
STEPS = [("utf-8", d) for d in SINGLE + DOUBLE] + [("gbk", d) for d in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "big5", "utf-8", "shift_jis")] + [("big5", "gbk"), ("big5", "latin-1"), ("shift_jis", "gbk"), ("shift_jis", "latin-1")]
STEPS += [("cp1252", d) for d in ("mac_roman", "cp437", "cp850", "cp1251")] + [(s, "cp1252") for s in ("mac_roman", "cp437", "cp850", "cp1251", "big5", "shift_jis", "euc_kr")] + [("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("euc_kr", "latin-1")]
CHAINS = [(s,) for s in STEPS] + [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1", "mac_roman", "cp1251") for b in ("cp1252", "latin-1", "mac_roman", "cp1251")]
_TABLE = {e: "".join(bytes([i]).decode(e, "ignore") or chr(i) for i in range(256)) for e in SINGLE}
_BACK = {e: {c: i for i, c in reversed(list(enumerate(t)))} for e, t in _TABLE.items()}
_C1 = re.compile(r"[\x80-\x9f]")
_SOFT = re.compile(r"[\x80-\x9f\xa0\xad]")


def _step(text: str, source: str, read: str) -> str | None:
    try:
        raw = text.encode(source)
    except UnicodeEncodeError:
        return None
    if read in _TABLE:
        return raw.decode("latin-1").translate(_TABLE[read])
    return raw.decode(read, "replace")


def garbled(word: str, chain: tuple) -> set[str]:
    """The forms a word takes under a chain: whole, and with what is lost when control characters or blanks are dropped."""
    out: str | None = word
    for source, read in chain:
        out = _step(out, source, read)
        if out is None or out == word:
            return set()
    return {f for f in _variants(word, out, chain) if f and f != word and not f.isascii()}


_ENDS = re.compile(r"(?m)^[ \t\r\xa0]+|[ \t\r\xa0]+$")


def _variants(text: str, out: str, chain: tuple) -> list[str]:
    """What a chain made of a text (lines of it, one word each), and what is left when characters are lost on the way."""
    forms = [out]
    for lost in (_C1, _SOFT):
        if lost.search(out):
            forms.append(lost.sub("", out))
    if len(chain) == 2:  # dropped between the steps
        first = _step(text, *chain[0])
        for less in {_C1.sub("", first), _SOFT.sub("", first), first.replace("\xa0", " ")} - {first}:
            more = _step(less, *chain[1]) or ""
            forms += [more, _C1.sub("", more)] if _C1.search(more) else [more]
    return [_ENDS.sub("", f) for f in forms]


ALL = range(len(CHAINS))
TOGETHER = [no for no, chain in enumerate(CHAINS) if chain[-1][1] in DOUBLE]  # that read bytes of two characters as one


def garbled_lists(words: list[str], chains: Iterable[int] = ALL) -> Iterator[tuple[int, list[str]]]:
    """(chain number, the forms of all words in their order): as garbled(), many words at once; "" where there is none.

    Words must hold no line feed: they are converted as lines of one text. No multi-byte character can swallow one.
    """
    text = "\n".join(words)
    for no in chains:
        chain = CHAINS[no]
        source = chain[0][0]
        raw = text.encode(source, "xmlcharrefreplace").decode(source)
        if raw == text:
            fit, lines = None, text
        else:  # words that the encoding cannot write take no part
            fit = [i for i, (a, b) in enumerate(zip(words, raw.split("\n"), strict=True)) if a == b]
            lines = "\n".join([words[i] for i in fit])
        out: str | None = lines
        for step in chain:
            out = _step(out, *step) if out is not None else None
        if out is None or (fit is not None and not fit):
            continue
        for forms in _variants(lines, out, chain):
            made = forms.split("\n")
            if fit is None:
                yield no, made
            elif len(made) == len(fit):
                full = [""] * len(words)
                for i, f in zip(fit, made, strict=True):
                    full[i] = f
                yield no, full


def _leads(read: str) -> re.Pattern:
    """Splits a run before each character that a multi-byte lead would be read as."""
    t = _TABLE[read]
    lead, follow = re.escape(t[0xE2:0xF0]), re.escape("".join(c for c in t[0x80:0xC0]))
    return re.compile(f"[{lead}][{follow}]{{1,2}}|[{re.escape(t[0xC2:0xE0])}][{follow}]")


_LEADS = {e: _leads(e) for e in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437")}
_LEAD = re.compile("|".join(p.pattern for p in _LEADS.values()))
_TWICE = re.compile(r"Ã[^Ã\x00-\x7f]{2,9}")
_PAIRS = re.compile(r"[\xa1-\xfe]{4,}")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_LETTERS = re.compile(r"[^\W\d_\x00-\x7f㐀-鿿]+")
_BLANK = r" \t\n\r\x0b\x0c|{}\[\]<>"
_PIECE_OF = re.compile(f"(?<![^{_BLANK}])[^{_BLANK}\x80-\U0010ffff]*+[^\x00-\x7f][^{_BLANK}]*")  # between blanks, beyond ASCII
_HAN = re.compile(r"[\u3000-\u303f\u3400-\u9fff\uff00-\uffef]{4,}")
_EDGE = "0123456789.,;:!?()\"'%#*/+=&-"
_OTHER = re.compile(r"[A-Za-z\x80-\u2e7f]")
_ODD = re.compile(r"[\x80-\u2e7f]")


def pieces(text: str) -> set[str]:
    """Tokens of a text that are longer than three characters or hold ASCII: words of any length, and runs of characters
    that a chain makes of one.
    """
    out: set[str] = set()
    for whole in _PIECE_OF.findall(text):
        for w in _HAN.split(whole) if _HAN.search(whole) else (whole,):  # text in Han characters parts words
            if not w.isascii():
                w = w.strip(_EDGE)
                if w and _OTHER.search(w):
                    out.add(w)
    if _ODD.search(text):
        if _LEAD.search(text):
            for p in _LEADS.values():
                out.update(p.findall(text))
        if "Ã" in text:
            out.update(x.strip() for x in _TWICE.findall(text))
        out.update(_LETTERS.findall(text))
    return {t for t in out if len(t) > 3 or t.encode("ascii", "ignore")}


def tokens(text: str) -> set[str]:
    """All tokens of a text that can be a word beyond ASCII or a garbled form of one: pieces(), and every run of one to three
    characters beyond ASCII.
    """
    if text.isascii():
        return set()
    out = pieces(text)
    for run in _BEYOND.findall(text):
        out.update(run)
        out.update(map("".join, zip(run, run[1:], strict=False)))
        out.update(map("".join, zip(run, run[1:], run[2:], strict=False)))
    return out


_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashes(strings: list[str]) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its characters, mixed."""
    cp = _points("".join(strings))
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(lens)
    starts = ends - lens
    ones = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate([ones, np.full(len(cp), _B)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([ones, np.full(len(cp), _BI)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((cp + np.uint64(7)) * power[:-1], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * back[starts])


def runs(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of one to three characters beyond ASCII: the texts end to end, and of each run the first place, the length,
    the text's number and the hash.
    """
    whole = "".join(texts)
    cp = _points(whole)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    beyond = cp > 127
    x = cp + np.uint64(7)
    at, size, value = [], [], []
    ok, h, factor = beyond, x, np.full(1, _B)
    for n in (1, 2, 3):
        if n > 1:
            m = len(cp) - n + 1
            if m < 1:
                break
            ok = ok[:m] & beyond[n - 1 :] & (owner[:m] == owner[n - 1 :])
            h = h[:m] + x[n - 1 :] * factor
            factor = factor * _B
        p = np.flatnonzero(ok)
        at.append(p)
        size.append(np.full(len(p), n))
        value.append(h[p])
    p = np.concatenate(at)
    return whole, p, np.concatenate(size), owner[p], _mix(np.concatenate(value))


_WORD = re.compile(r"[“”‘’«»]?[^\W\d_]+(?:[’‘'-][^\W\d_]+)*[’‘'“”«»-]?")


def _is_word(token: str) -> bool:
    """Words to garble: words of an alphabet, single characters, and pairs of neighbours beyond ASCII. A longer token with
    other signs within is no clean word (quotation marks may stand around it); each of its signs and letters is one for itself.
    """
    if "�" in token:
        return False
    return len(token) <= 2 or (_WORD.fullmatch(token) is not None and (bool(token.encode("ascii", "ignore")) or all(c < "⺀" for c in token)))


def _weak(form: str) -> bool:
    """Whether ordinary text of some script could look like this form: all Han, kana or hangul, or all Latin letters."""
    if sum(c.isascii() and c.isalpha() for c in form) >= 2:
        return False
    return all("㐀" <= c <= "鿿" or "가" <= c <= "힯" or "぀" <= c <= "ヿ" or c == "�" for c in form) or all("À" <= c <= "ÿ" and c not in "×÷" for c in form) or len(form) == 1


_GB2312 = {c for i in range(0xA1, 0xF8) for j in range(0xA1, 0xFF) if len(c := bytes([i, j]).decode("gb2312", "ignore")) == 1}
_CLOSED = re.compile(r"[A-ZÀ-ÖØ-Þ]+[”’“‘»«›‹…–—•°ºª]+")  # capitals with marks behind them, as in “MAÇÔ
_LATIN_RUN = re.compile(r"[\x80-\xff]{4,}")


def evidence(own: dict[str, tuple[str, int]], text: str) -> bool:
    """Whether the garbled forms that stand in a text show it to be garbled.

    One form that no ordinary text has is enough. Of others it takes WEAK different ones (one beside a replacement
    character): pairs of Han characters and the
    like, Latin letters only within a run of four, single characters only beside replacement characters: two of a chain read
    as UTF-8, or three of any one chain.
    """
    strong = weak = single = 0
    lone: Counter[int] = Counter()  # single characters by chain
    latin_run = bool(_LATIN_RUN.search(text))
    for form, (_, no) in own.items():
        if len(form) == 1:
            single += CHAINS[no][-1][1] == "utf-8" and not "㐀" <= form <= "鿿"
            lone[no] += form != "�"
        elif not _weak(form):
            strong += 1
        elif not all("À" <= c <= "ÿ" for c in form) or latin_run:
            weak += 1
    if strong or weak >= WEAK:
        return True
    return "�" in text and (weak > 0 or single >= 2 or max(lone.values(), default=0) >= 3)


def _possible(own: set[str], text: str) -> bool:
    """Whether forms that stand in a text could be evidence, whatever chains they come of."""
    return "�" in text or evidence(dict.fromkeys(own, ("", 0)), text)


def _certain(form: str, word: str, chain: tuple) -> bool:
    """Whether a form shows by itself that its chain was at work, so that it need not be rarer than its word.

    No ordinary text may look like it, and undoing the chain must give the word. UTF-8 checks itself; of other encodings
    nearly any bytes are text, so there it takes letters and signs mixed, four or more. Text read as Han characters is certain
    only within Latin words, by characters rare in Chinese. Where characters were dropped, three that are left must still mix
    letters and signs.
    """
    if _weak(form) or "�" in form:
        return False
    beyond = [c for c in form if not c.isascii()]
    mixed = any(c.isalpha() for c in beyond) and not all(c.isalpha() for c in beyond)
    exact = _unread(form, chain) == word
    if chain[-1][1] in DOUBLE:
        rare = any(c not in _GB2312 for c in beyond)
        return chain[-1][0] == "utf-8" and rare and sum(c.isascii() and c.isalpha() for c in form) >= 2 and all(c < "⺀" for c in word) and exact
    if any(source != "utf-8" for source, _ in chain):
        return exact and len(beyond) >= 4 and mixed and chain[-1][1] in _TABLE
    top = "ɏ" if chain[-1][1] == "cp1250" else "ÿ"
    if all("À" <= c <= top and c not in "×÷" for c in beyond) or all("Ѐ" <= c <= "ӿ" for c in beyond) or _CLOSED.fullmatch(form):
        return False
    return exact or (mixed and len(beyond) >= 3)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of at most TEXTS texts of about CHARS characters; a longer text stands for itself."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARS or i - lo == TEXTS - 1:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, h, df, n): every token and its hash, in how many different texts it stands, and in how many documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, copies = b.column("text").to_pylist(), b.column("copies").to_numpy()
            for lo, hi in _parts(texts):
                yield counted(texts[lo:hi], copies[lo:hi])

    def counted(texts: list[str], copies: np.ndarray) -> pa.RecordBatch:
        whole, at, size, owner, h = runs(texts)
        o = np.argsort(h & ~np.uint64(TEXTS - 1) | owner.astype(np.uint64))
        at, size, owner, h = at[o], size[o], owner[o], h[o]
        first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]  # of a token
        other = first | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(h)]  # of a text with it
        begin = np.flatnonzero(first)
        if len(begin):
            df, n = np.add.reduceat(other.astype(np.int64), begin), np.add.reduceat(np.where(other, copies[owner], 0), begin)
        else:
            df = n = np.zeros(0, np.int64)
        short = [whole[p : p + k] for p, k in zip(at[begin].tolist(), size[begin].tolist(), strict=True)]
        df2: Counter[str] = Counter()
        n2: Counter[str] = Counter()
        for t, c in zip(texts, copies.tolist(), strict=True):
            for w in pieces(t):
                df2[w] += 1
                n2[w] += c
        long = list(df2)
        return pa.RecordBatch.from_arrays([pa.array(short + long, pa.string()), pa.array(np.concatenate([h[begin], hashes(long)]).view(np.int64)), pa.array(np.concatenate([df, np.array(list(df2.values()), np.int64)])), pa.array(np.concatenate([n, np.array([n2[w] for w in long], np.int64)]))], names=["token", "h", "df", "n"])

    texts = docs.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.mapInArrow(count, "token string, h long, df long, n long").groupBy("h", "token").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def garbled_forms(words: DataFrame, seen: bytes) -> DataFrame:
    """(h, token, df, n) -> (h, form, word, word_df, word_n, chain, certain) under all chains, of forms that may stand in a text.

    h is the hash of the form. Words too rare for RATIO give certain forms only.
    """
    held = words.sparkSession.sparkContext.broadcast(seen)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for b in batches:
            mine = [(i, w) for i, w in enumerate(b.column("token").to_pylist()) if _is_word(w)]
            # Of two Han characters the other chains make no more than of each: what they make of one stands beside the other's.
            han = [i for i, w in mine if len(w) == 2 and w[0] >= "⺀" and w[1] >= "⺀"]
            rest = [i for i, w in mine if not (len(w) == 2 and w[0] >= "⺀" and w[1] >= "⺀")]
            for some, chains in ((han, TOGETHER), (rest, ALL)):
                for lo in range(0, len(some), WORDS):
                    yield made(b.take(pa.array(some[lo : lo + WORDS], pa.int64())), chains, bits)

    def made(b: pa.RecordBatch, chains: Iterable[int], bits: np.ndarray) -> pa.RecordBatch:
        words_, df, n = (b.column(c).to_pylist() for c in ("token", "df", "n"))
        rows: dict[tuple[str, str, int], tuple] = {}
        lost: dict[str, tuple] = {}  # forms of nothing but replacement characters come of very many words: the commonest will do
        for no, forms in garbled_lists(words_, chains):
            h = hashes(forms)
            for i in np.flatnonzero(contained(bits, h)).tolist():
                f, w = forms[i], words_[i]
                if not f or f == w or f.isascii():
                    continue
                sure = _certain(f, w, CHAINS[no])
                if not (sure or n[i] >= RATIO):
                    continue
                row = (int(h[i].view(np.int64)), f, w, df[i], n[i], no, sure)
                if f.strip("�"):
                    rows[f, w, no] = row
                elif f not in lost or lost[f][4] < n[i]:
                    lost[f] = row
        columns = list(zip(*rows.values(), *lost.values(), strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "form", "word", "word_df", "word_n", "chain", "certain"])

    return words.mapInArrow(make, "h long, form string, word string, word_df long, word_n long, chain int, certain boolean")


def found_forms(docs: DataFrame) -> DataFrame:
    """(h, form, word, chain): tokens of the documents that are certain garbled forms, or forms of far commoner words; one
    word per form.

    How common is told by different texts or by documents: copies of a garbled text don't make its forms common.
    """
    words = cut(vocabulary(docs))
    made = garbled_forms(_spread(words), table_of(words, words.count()))
    common = (F.col("word_df") >= RATIO * F.col("df")) | (F.col("word_n") >= RATIO * F.col("n"))
    hits = cut(words.withColumnRenamed("token", "form").join(made, ["h", "form"]).where(F.col("certain") | common))
    again = hits.where("certain").select(F.col("form").alias("word")).distinct().withColumn("again", F.lit(True))
    best = F.row_number().over(Window.partitionBy("form").orderBy(F.col("again").isNotNull(), F.desc("word_n"), "chain", "word"))  # clean words first
    return hits.join(again, "word", "left").withColumn("rank", best).where("rank = 1").select("h", "form", "word", "chain")


def _spread(words: DataFrame) -> DataFrame:
    """The words over as many tasks as the session shuffles into: making forms is work that the size of the rows hides."""
    return words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")


def _unread(text: str, chain: tuple) -> str | None:
    """The text before a chain, where the chain can be undone without loss."""
    for source, read in reversed(chain):
        try:
            if read in _BACK:
                raw = bytearray()
                for c in text:
                    i = _BACK[read].get(c)
                    if i is None:
                        if ord(c) > 255:
                            return None
                        i = ord(c)
                    raw.append(i)
                text = bytes(raw).decode(source)
            else:
                text = text.encode(read).decode(source)
        except UnicodeError:
            return None
    return text


_PIECE = re.compile(r"[^\n。！？﹝]+[\n。！？﹝]?|\n|[。！？﹝]")


def restore(text: str, hits: dict[str, tuple[str, int]]) -> tuple[str, bool]:
    """The text with garbled stretches put right where they can be, and whether any was.

    A stretch between sentence ends is undone as a whole if its chain can be undone exactly; else form by form, the longer
    first, where the form alone could not be ordinary text.
    """
    changed = False
    out = []
    for piece in _PIECE.findall(text):
        mine = Counter(hits[t][1] for t in tokens(piece) if t in hits and len(t) > 1)
        done = None
        for no, _ in sorted(mine.items(), key=lambda x: (-x[1], -len(CHAINS[x[0]]))):
            for part in (piece, piece.strip()):
                whole = _unread(part, CHAINS[no])
                if whole is not None and whole != part and "�" not in whole:
                    done = piece.replace(part, whole) if part else None
                    break
            if done:
                break
        if done is None and mine:
            forms = sorted((t for t in tokens(piece) if t in hits and not _weak(t)), key=len, reverse=True)
            done = piece
            for f in forms:
                done = done.replace(f, hits[f][0])
        if done is not None and done != piece:
            changed = True
        out.append(done if done is not None else piece)
    return "".join(out), changed


def candidates(texts: DataFrame, forms: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, text, tokens): the documents with tokens that may be one of the n forms; row is a hash of the document."""
    held = texts.sparkSession.sparkContext.broadcast(table_of(forms, n))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for b in batches:
            texts_ = b.column("text").to_pylist()
            for lo, hi in _parts(texts_):
                yield with_tokens(b.slice(lo, hi - lo), texts_[lo:hi], bits)

    def with_tokens(b: pa.RecordBatch, texts_: list[str], bits: np.ndarray) -> pa.RecordBatch:
        whole, at, size, owner, h = runs(texts_)
        hit = contained(bits, h)
        own: list[set[str]] = [set() for _ in texts_]
        for i, p, k in zip(owner[hit].tolist(), at[hit].tolist(), size[hit].tolist(), strict=True):
            own[i].add(whole[p : p + k])
        long = [(i, w) for i, t in enumerate(texts_) for w in pieces(t)]
        for j in np.flatnonzero(contained(bits, hashes([w for _, w in long]))).tolist():
            own[long[j][0]].add(long[j][1])
        keep = [i for i, x in enumerate(own) if x and _possible(x, texts_[i])]
        some = b.take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), pa.array([sorted(own[i]) for i in keep], pa.list_(pa.string()))], names=["doc_id", "text", "tokens"])

    found = texts.mapInArrow(look, "doc_id long, text string, tokens array<string>")
    return found.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text", "tokens")


def _joined(asked: DataFrame, forms: DataFrame, n: int) -> DataFrame:
    """asked (row, form) with word and chain; a form that very many rows hold does not go to one task."""
    forms = forms.select("form", "word", "chain")
    if n <= BROADCAST:
        return asked.join(F.broadcast(forms), "form")
    salt: Column = F.pmod("row", F.lit(SALTS))
    return asked.withColumn("salt", salt).join(forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["form", "salt"]).drop("salt")


def affected(docs: DataFrame) -> DataFrame:
    """(doc_id, n_forms, restored, changed) of the documents with garbled text; restored is the text put right as far as possible.

    Null, blank and ASCII texts are never affected. A null doc_id is kept as it is.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    forms = cut(found_forms(texts))
    n = forms.count()
    some = cut(candidates(texts, forms, n))
    known = _joined(some.select("row", F.explode("tokens").alias("form")).distinct(), forms, n)
    own = known.groupBy("row").agg(F.collect_set(F.struct("form", "word", "chain")).alias("own"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for d, t, o in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("own").to_pylist(), strict=True):
                hits = {x["form"]: (x["word"], x["chain"]) for x in o}
                if evidence(hits, t):
                    found.append((d, len(hits), *restore(t, hits)))
            d, k, t, c = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(t, pa.string()), pa.array(c, pa.bool_())], names=["doc_id", "n_forms", "restored", "changed"])

    return some.select("row", "doc_id", "text").join(own, "row").select("doc_id", "text", "own").mapInArrow(judge, "doc_id long, n_forms int, restored string, changed boolean")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents with garbled characters."""
    return affected(table(spark, sf_dir, "documents")).select("doc_id").where("doc_id is not null").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their text put right where that is possible."""
    return affected(table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
