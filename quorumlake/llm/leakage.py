"""Problem 7: passages of evaluation items inside documents.

Weighted SimHash fingerprints of windows of each item meet those of all windows of the documents in a multi-index of four
16-bit blocks, which finds every pair within three differing bits. Since half an item already counts and words in it may be
changed, a window is a fifth of its item: any such half then holds a window without a change. Candidates are verified
exactly: the stretch the two share is followed in both directions over at most CHANGES changed places, must hold half of the
item's characters, and its shingles of two tokens, weighted by rarity among the items, must agree to MIN_SIMILARITY
(or all its words but one).

Items are the stated query set: they are indexed in blocks, each broadcast for itself, and every document is read, tokenised
and fingerprinted once, whatever the number of blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

HALF = 0.5
CHANGES = 2  # changed places in a stretch, each of a word or so
SKIP = 4  # tokens (words, Han characters, digits) that a change may span
MIN_SIMILARITY = 0.8  # weight of the shingles of a stretch that are the same
RADIUS = 3
SIZES = (2, 3, 4, 6, 8, 11, 16, 22, 32, 45, 64, 90, 128, 181, 256)
PART = 5  # a window is a fifth of its item at most, so that half an item with two changes still holds a whole one
ITEMS_AT_ONCE = 5_000  # items in one block of the index
COMMON = 50_000  # tokens of the items whose weight is told apart; all others are rarer than these and weigh most
HEAVIEST = 8
CHUNK = 32_768  # tokens searched at once
STEP = 4_096  # tokens summed at once, so that the sums stay in the cache
_TOKEN = re.compile(r"\d|[^\W\d_㐀-鿿]+|[㐀-鿿]")


def tokens(text: str | None) -> list[str]:
    """Words, Han characters and digits, without case, width, spacing, marks and entities."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Items:
    """A block of items, the weights of tokens, and the multi-index of the windows' fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], weight: dict[str, int]) -> None:
        self.weight = weight
        self.rows = [(i, t) for i, x in rows if (t := tokens(x))]
        self.chars, self.shingles = [], []  # sums up to each token of an item: characters, and weights of shingles
        by_size: dict[int, tuple[list, list, list]] = {}
        for no, (_, t) in enumerate(self.rows):
            self.chars.append(np.concatenate([[0], np.cumsum([len(w) for w in t])]))
            w = np.array([weight.get(x, HEAVIEST) for x in t])
            self.shingles.append(np.concatenate([[0], np.cumsum(w[:-1] + w[1:])]))
            s = max([x for x in SIZES if x <= len(t) / PART], default=min(SIZES[0], len(t)))
            at, fp = prints([t], [s], weight)[s]
            a, b, c = by_size.setdefault(s, ([], [], []))
            a.append(fp)
            b.append(np.full(len(fp), no))
            c.append(at)
        self.index: dict[int, tuple] = {}
        for s, (a, b, c) in by_size.items():
            fp, no, at = np.concatenate(a), np.concatenate(b), np.concatenate(c)
            blocks = []
            for j in range(4):
                v = (fp >> np.uint64(16 * j)).astype(np.int64) & 0xFFFF
                o = np.argsort(v, kind="stable")
                blocks.append((o, np.searchsorted(v[o], np.arange(65_537))))
            self.index[s] = (fp, no, at, blocks)

    def near(self, fp: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, index entry) of all pairs within RADIUS bits."""
        own, _, _, blocks = self.index[s]
        w_all, e_all = [], []
        for j, (order, start) in enumerate(blocks):
            v = (fp >> np.uint64(16 * j)).astype(np.int64) & 0xFFFF
            lo, n = start[v], start[v + 1] - start[v]
            some = np.flatnonzero(n)
            if not len(some):
                continue
            n = n[some]
            w = np.repeat(some, n)
            e = order[np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            ok = np.bitwise_count(fp[w] ^ own[e]) <= RADIUS
            w_all.append(w[ok])
            e_all.append(e[ok])
        if not w_all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(w_all), np.concatenate(e_all)

    def leaked(self, doc: list[str], no: int, d: int, i: int) -> tuple[float, int]:
        """The share of the item's characters in the stretch around a place where both agree, 0 if it fails; and where the
        run without a change around that place ends in the item.
        """
        item, chars, shingles = self.rows[no][1], self.chars[no], self.shingles[no]
        right = _follow(doc, item, d, i, 1)
        left = _follow(doc, item, d - 1, i - 1, -1)
        first, end = left[0][1] + 1, right[0][1]
        best = 0.0
        for c in range(len(right)):
            back = left[: min(CHANGES - c, len(left) - 1) + 1]
            i1, i2 = back[-1][1] + 1, right[c][1]
            share = float(chars[i2] - chars[i1]) / float(chars[-1])
            if share >= HALF and share > best:
                runs = [(first, end), *((a, b) for a, b in right[1 : c + 1]), *((b + 1, a + 1) for a, b in back[1:])]
                agreed = sum(shingles[b - 1] - shingles[a] for a, b in runs if b - a > 1)
                one_word = i2 - i1 - sum(b - a for a, b in runs) <= 1  # of a few words only, one counts for much
                if one_word or agreed >= MIN_SIMILARITY * (shingles[i2 - 1] - shingles[i1]):
                    best = share
        return best, end

    def search(self, texts: list[list[str]], fingerprints: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, float]]:
        """(text number, item id, share) of all leaks in some texts, given the fingerprints of their windows."""
        lens = np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(lens)])
        owner = np.repeat(np.arange(len(texts)), lens)
        found: dict[tuple[int, int], float] = {}
        for s, (_, no, pos, _) in self.index.items():
            at, fp = fingerprints[s]
            if not len(fp):
                continue
            w, e = self.near(fp, s)
            if not len(w):
                continue
            x, item, i = at[w], no[e], pos[e]
            t = owner[x]
            diagonal = x - i
            o = np.lexsort((i, diagonal, item, t))
            t, item, i, diagonal = t[o], item[o], i[o], diagonal[o]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (i[1:] > i[:-1] + s)])
            begin = np.flatnonzero(new)  # windows of one diagonal that overlap are one span of tokens
            stop = i[np.append(begin[1:], len(i)) - 1] + s
            for n, m, shift, k, end in zip(t[begin].tolist(), item[begin].tolist(), (diagonal[begin] - first[t[begin]]).tolist(), i[begin].tolist(), stop.tolist(), strict=True):
                if found.get((n, m), 0) >= 0.999:
                    continue
                doc, words = texts[n], self.rows[m][1]
                while k < end:  # wherever the two really agree; a run without a change is followed once
                    if doc[shift + k] == words[k]:
                        share, k = self.leaked(doc, m, shift + k, k)
                        if share > found.get((n, m), 0):
                            found[n, m] = share
                    else:
                        k += 1
        return [(t, self.rows[item][0], share) for (t, item), share in found.items()]


def prints(texts: list[list[str]], sizes: list[int], weight: dict[str, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By window size: the windows' first tokens (in the texts' tokens end to end) and their fingerprints."""
    flat = [w for t in texts for w in t]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    known = {w: (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), weight.get(w, HEAVIEST)) for w in set(flat)}
    h = np.array([known[w][0] for w in flat], np.uint64)
    if len(flat) < 2:
        return {s: (np.arange(len(flat)), _mix(h)) for s in sizes}
    w = np.array([known[w][1] for w in flat], np.int16)
    pair = _mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))
    w2 = w[:-1] + w[1:]
    held: dict[int, list[np.ndarray]] = {s: [] for s in sizes}
    most = max(sizes)
    for lo in range(0, len(pair), STEP):  # sums wrap around, their differences don't: a window weighs 256 * 16 at most
        part, own = pair[lo : lo + STEP + most - 2], w2[lo : lo + STEP + most - 2]
        sums = np.zeros((len(part) + 1, 64), np.int16)
        np.cumsum(np.unpackbits(part[:, None].view(np.uint8), axis=1) * own[:, None], axis=0, dtype=np.int16, out=sums[1:])
        total = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        for s in sizes:
            n = min(STEP, len(part) - s + 2)
            if s >= 2 and n > 0:
                half = ((total[s - 1 : s - 1 + n] - total[:n]) // 2).astype(np.int16)
                held[s].append(np.packbits(sums[s - 1 : s - 1 + n] - sums[:n] > half[:, None], axis=1).view(np.uint64).ravel())
    out = {}
    for s in sizes:
        fp = np.concatenate(held[s]) if held[s] else np.zeros(0, np.uint64)
        at = np.flatnonzero(owner[: len(fp)] == owner[s - 1 : s - 1 + len(fp)])
        out[s] = (at, fp[at])
    return out


def _follow(doc: list[str], item: list[str], d: int, i: int, step: int) -> list[tuple[int, int]]:
    """The runs of the item's tokens that agree from a place on, each behind one changed place more: where a run begins and
    where it ends (not included), in the direction of step. A change is passed where three tokens agree again behind it.
    """
    out = []
    n, m = len(doc), len(item)
    while True:
        begin = i
        while 0 <= d < n and 0 <= i < m and doc[d] == item[i]:
            d += step
            i += step
        out.append((begin, i))
        if len(out) > CHANGES or not (0 <= d < n and 0 <= i < m):
            return out
        for gap in range(1, 2 * SKIP + 1):
            for a in range(max(0, gap - SKIP), min(gap, SKIP) + 1):
                x, y = d + a * step, i + (gap - a) * step
                if 0 <= x + 2 * step < n and 0 <= y + 2 * step < m and 0 <= x < n and 0 <= y < m and doc[x] == item[y] and doc[x + step] == item[y + step] and doc[x + 2 * step] == item[y + 2 * step]:
                    break
            else:
                continue
            d, i = x, y
            break
        else:
            return out


def weights(items: DataFrame) -> dict[str, int]:
    """The weights of the COMMON commonest tokens of the items, by rarity; every other token weighs HEAVIEST."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in b.column("text").to_pylist() for w in set(tokens(t))], pa.string())], names=["token"])

    seen = items.select("text").mapInArrow(split, "token string").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.orderBy(F.desc("n"), "token").limit(COMMON).collect()
    n = items.count()
    return {r.token: max(1, round(float(HEAVIEST * np.log2((n + 2) / (r.n + 1)) / np.log2(n + 2)))) for r in rows}


def leaks(docs: DataFrame, items: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, share): each document that holds half of an item or more in one stretch, and how much.

    Null and blank texts leak nothing. Repeated rows give repeated results. Where two items share an id, both are looked for.
    """
    held = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    context = docs.sparkSession.sparkContext
    weight = weights(held)
    blocks: list[Broadcast] = []
    sizes: set[int] = set()
    block: list[tuple[int, str]] = []

    def close() -> None:
        index = Items(block, weight)
        sizes.update(index.index)
        blocks.append(context.broadcast(cloudpickle.dumps(index)))

    for r in held.orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == at_once:
            close()
            block = []
    if block or not blocks:
        close()
    wanted = sorted(sizes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [cloudpickle.loads(x.value) for x in blocks]
        for b in batches:
            ids, some, size = [], [], 0
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(d)
                some.append(tokens(t))
                size += len(some[-1])
                if size > CHUNK:
                    yield result(held, ids, some)
                    ids, some, size = [], [], 0
            if ids:
                yield result(held, ids, some)

    def result(held: list[Items], ids: list[int], some: list[list[str]]) -> pa.RecordBatch:
        own = prints(some, wanted, weight) if wanted else {}
        found = [x for index in held for x in index.search(some, own)]
        return pa.RecordBatch.from_arrays([pa.array([ids[t] for t, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())], names=["doc_id", "item_id", "share"])

    return texts.mapInArrow(look, "doc_id long, item_id long, share double")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold at least half of an item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: in how many documents it leaked, and its largest share."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("share").alias("largest_share"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
