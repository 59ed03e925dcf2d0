"""Several values packed in one string field: one row per value, place kept.

Columnar: a whole Arrow batch is scanned at once. Quote state comes from the parity of opening and closing marks, places
of separators are masks over the buffer, and the list offsets follow from cumulative sums. No Python per value but for
the few that hold escapes.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Separators between values, and pairs of quotation marks.
SEPARATORS = ",，、;；|｜/／+＋&＆\n\r\t•"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』"}
BRACKETS = {"[": "]", "【": "】", "［": "］"}

_SPACE = np.array([ord(c) for c in "  　​﻿\n\r\t\u000b\u000c"] + list(range(0x2000, 0x200B)), np.uint32)
_SEP = np.array([ord(c) for c in SEPARATORS], np.uint32)
_BACKSLASH = ord("\\")


def _lower(cp: np.ndarray) -> np.ndarray:
    return np.where((cp >= 65) & (cp <= 90), cp + 32, cp)


def _code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in one buffer, and each row's end offsets (nulls are empty)."""
    col = pc.fill_null(col, "")
    lens = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = col.cast(pa.large_string())
    data = raw.buffers()[2]
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    text = bytes(memoryview(data)[off[0] : off[-1]]).decode("utf-8", "surrogatepass") if data is not None and len(raw) else ""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lens)])


def _runs(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """At each place the length of the run of hits that ends there; runs don't cross rows."""
    at = np.arange(len(hit))
    start = hit & (first | ~np.concatenate([[False], hit[:-1]]))
    began = np.maximum.accumulate(np.where(start, at, -1))
    return np.where(hit, at - began + 1, 0)


def split_batch(col: pa.Array, protected: list[str]) -> pa.ListArray:
    """The values of each string, trimmed, unquoted, in order; null and empty strings give empty lists."""
    cp, ends = _code_points(col)
    n, size = len(col), len(cp)
    lo, hi = ends[:-1], ends[1:]
    if size == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    at = np.arange(size)
    row = np.repeat(np.arange(n), hi - lo)
    first = np.zeros(size, bool)
    first[lo[lo < hi]] = True
    space = np.isin(cp, _SPACE)
    # The neighbours that aren't white space; outside the row where there is none.
    seen = np.maximum.accumulate(np.where(~space, at, -1))
    before = np.concatenate([[-1], seen[:-1]])
    before = np.where(before < lo[row], -1, before)
    after = np.minimum.accumulate(np.where(~space, at, size)[::-1])[::-1]
    after = np.concatenate([after[1:], [size]])
    after = np.where(after >= hi[row], size, after)
    # A pair of brackets around the whole field.
    full = np.flatnonzero(lo < hi)
    head = np.minimum.accumulate(np.where(~space, at, size)[::-1])[::-1][lo[full]]
    tail = seen[hi[full] - 1]
    good = (head < tail) & (head < hi[full]) & (tail >= lo[full])
    full, head, tail = full[good], head[good], tail[good]
    bracket = np.zeros(size, bool)
    for a, b in BRACKETS.items():
        whole = (cp[head] == ord(a)) & (cp[tail] == ord(b))
        bracket[head[whole]] = bracket[tail[whole]] = True
    sep = np.isin(cp, _SEP)
    # Separators inside a protected name belong to it, where the name stands as a value of its own start.
    low = _lower(cp)
    kept = np.zeros(size, bool)
    for name in sorted({p for p in protected if p}, key=len, reverse=True):
        want = _lower(np.frombuffer(name.encode("utf-32-le"), np.uint32))
        inner = np.flatnonzero(np.isin(want, _SEP))
        if not len(inner) or len(want) > size:
            continue
        spots = np.flatnonzero(low[: size - len(want) + 1] == want[0])
        for j in range(1, len(want)):
            spots = spots[low[spots + j] == want[j]]
        spots = spots[row[spots] == row[spots + len(want) - 1]]
        for j in inner:
            kept[spots + j] = True
    edge = (sep & ~kept) | bracket
    escaped = np.concatenate([[False], (_runs(cp == _BACKSLASH, first) % 2 == 1)[:-1]]) & ~first
    starts = ((before < 0) | edge[np.maximum(before, 0)]) & ~escaped
    # Line ends and tabs are white space and separators at once: a mark just after one starts a value too.
    prior = np.concatenate([[False], edge[:-1]]) & ~first
    stops = ((after >= size) | edge[np.minimum(after, size - 1)]) & ~escaped
    nxt = np.concatenate([edge[1:], [False]]) & np.concatenate([row[1:] == row[:-1], [False]])
    white_edge = edge & space
    left = np.maximum.accumulate(np.where(white_edge | ~space, at, -1))
    left = np.concatenate([[-1], left[:-1]])
    starts |= (left >= lo[row]) & white_edge[np.maximum(left, 0)] & ~escaped
    right = np.minimum.accumulate(np.where(white_edge | ~space, at, size)[::-1])[::-1]
    right = np.concatenate([right[1:], [size]])
    stops |= (right < hi[row]) & white_edge[np.minimum(right, size - 1)] & ~escaped
    starts |= prior & ~escaped
    stops |= nxt & ~escaped
    opens, shuts = [], {}
    kind = np.zeros(size, np.int8)
    beyond, own_end = at + 1, np.full(size, size)
    for k, (a, b) in enumerate(QUOTES.items(), 1):
        begin = (cp == ord(a)) & starts
        kind[begin] = k
        opens.append(np.flatnonzero(begin))
        end = (cp == ord(b)) & stops
        if a == b:  # a doubled mark stands for itself: a value ends with a run of odd length, or of even length from its opener
            hit = (cp == ord(a)) & ~escaped
            run = _runs(hit, first)
            more = np.concatenate([hit[1:] & ~first[1:], [False]])
            last = np.minimum.accumulate(np.where(hit & ~more, at, size)[::-1])[::-1]
            even = begin & ((last - at) % 2 == 1) & end[np.minimum(last, size - 1)]
            beyond[begin] = last[begin] + 1
            own_end[even] = last[even]
            end &= run % 2 == 1
        shuts[k] = np.flatnonzero(end)
    opens = np.sort(np.concatenate(opens))
    begin, finish = np.zeros(size, np.int8), np.zeros(size, np.int8)
    active, cur = np.arange(n), lo.copy()
    while len(opens) and len(active):
        i = np.searchsorted(opens, cur[active])
        some = i < len(opens)
        o = np.where(some, opens[np.minimum(i, len(opens) - 1)], size)
        some &= o < hi[active]
        active, o = active[some], o[some]
        if not len(active):
            break
        shut = np.full(len(active), size)
        for k, places in shuts.items():
            mine = np.flatnonzero(kind[o] == k)
            if len(mine) and len(places):
                j = np.searchsorted(places, beyond[o[mine]])
                shut[mine] = np.where(j < len(places), places[np.minimum(j, len(places) - 1)], size)
        shut = np.where(own_end[o] < size, own_end[o], shut)
        closed = shut < hi[active]
        begin[o[closed]], finish[shut[closed]] = 1, 1
        cur[active] = np.where(closed, shut, o) + 1
    parity = np.cumsum(begin) - np.cumsum(finish) + finish  # 1 from an opening mark to its closing one
    edge &= parity == 0
    # Pieces lie between edges; their white space and quotation marks go.
    cuts = np.flatnonzero(edge)
    nonempty = np.flatnonzero(lo < hi)
    a = np.sort(np.concatenate([lo[nonempty], cuts + 1]))
    b = np.sort(np.concatenate([hi[nonempty], cuts]))
    fw = np.minimum.accumulate(np.where(~space, at, size)[::-1])[::-1]
    fw = np.append(fw, size)

    def trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(fw[a], b), np.maximum(np.where(b > 0, seen[np.maximum(b - 1, 0)], -1) + 1, np.minimum(fw[a], b))

    a, b = trim(a, b)
    quoted = np.zeros(len(a), np.int8)
    some = np.flatnonzero(b - a >= 2)
    marked = some[(begin[a[some]] == 1) & (finish[b[some] - 1] == 1)]
    quoted[marked] = kind[a[marked]]
    a[marked] += 1
    b[marked] -= 1
    a, b = trim(a, b)
    real = b > a
    a, b, quoted = a[real], b[real], quoted[real]
    owner = row[a]
    # Values are cut from the buffer: kept code points, then byte offsets.
    mask = np.zeros(size + 1, np.int32)
    np.add.at(mask, a, 1)
    np.add.at(mask, b, -1)
    take = np.cumsum(mask)[:-1] > 0
    wide = cp[take]
    width = 1 + (wide > 0x7F).astype(np.int64) + (wide > 0x7FF) + (wide > 0xFFFF)
    data = wide.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    upto = np.concatenate([[0], np.cumsum(width)])
    offsets = np.concatenate([[0], upto[np.cumsum(b - a)]])
    values = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string()) if len(a) else pa.array([], pa.string())
    slash = np.concatenate([[0], np.cumsum(cp == _BACKSLASH)])
    quote = np.concatenate([[0], np.cumsum((cp == 34) | (cp == 39))])
    odd = np.flatnonzero(((quoted == 1) | (quoted == 2)) & ((slash[b] - slash[a] > 0) | (quote[b] - quote[a] > 1)))
    if len(odd):
        plain = values.to_pylist()
        for i in odd:
            plain[i] = _unescape(plain[i], '"' if quoted[i] == 1 else "'")
        values = pa.array(plain, pa.string())
    counts = np.bincount(owner, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _unescape(value: str, mark: str) -> str:
    """A quoted value's text: JSON or Python escapes, or doubled marks."""
    if "\\" in value:
        try:
            return (json.loads(f'"{value}"') if mark == '"' else ast.literal_eval(f"'{value}'")).strip()
        except (ValueError, SyntaxError):
            return value
    return value.replace(mark * 2, mark)


def split_values(df: DataFrame, column: str, keys: list[str], protected: list[str]) -> DataFrame:
    """One row (keys..., pos, item_value) for each value packed in `column`.

    Separators inside quotation marks or inside a name in `protected` belong to the value. Null, blank and empty-list
    fields give no row; empty pieces are no values and take no place. Repeated rows give repeated results. A very long
    field stays one task's work, linear in its length. Columns of df other than keys are dropped, so they can't clash; a
    key named pos or item_value is refused.
    """
    if {"pos", "item_value"} & set(keys):
        raise ValueError("keys must not be named pos or item_value")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("pos", T.IntegerType()), T.StructField("item_value", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(len(keys))
            lists = split_batch(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, protected)
            parent = pc.list_parent_indices(lists)
            owner = parent.to_numpy()
            start = lists.offsets.to_numpy()
            pos = pa.array((np.arange(len(owner)) - start[owner]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(parent) for i in range(len(keys))), pos, lists.flatten()], names=[*keys, "pos", "item_value"])

    return df.select(*[f"`{k}`" for k in keys], f"`{column}`").mapInArrow(scan, schema)
