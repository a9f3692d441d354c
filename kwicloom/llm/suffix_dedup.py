"""Suffix-array deduplication of bytes.

A window is ``width`` consecutive bytes of a document. Each window has an anchor: the leftmost ``gram`` of least
hash in it, so equal windows have equal anchors at equal places. Only anchors that occur twice matter; for
each of their occurrences, the windows that it anchors lie in one stretch of text, its context.

* Equal contexts are one: the first keeps its windows, the others lose them (first in the unit, then over all).
* The different contexts of an anchor go to one shard. Of these, the windows that another context of the anchor
  could have are kept: windows at nearby places round the anchor have a middle in common, and only where two
  contexts have an equal middle can a window be equal. The shard concatenates what is left and builds the suffix
  array by induced sorting and the permuted common prefixes. Suffixes that share ``width`` bytes are
  neighbours; of each such group, the first window in document order stays.
* An anchor with over ``hot`` occurrences may have too many contexts for one task. Each of its windows is then
  a context of its own, spread over all shards by its bytes, once per unit; equal ones meet there, by their bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .pieces import mix
from .suffix_array import permuted_common_prefixes, suffix_array
from .units import MAIL, Places, STEP, columns_of, delivered, dumps, exchange, loads, meet, n_units, pick_shared, probe_mail, rolling, rows_of, scatter, sha256, shared_places, to_units, with_id

WIDTH = 100
GRAM = 50
HOT = 50_000
#: Classes of the places that an anchor may have in a window; windows of a class have a middle in common.
CLASSES = 17


def leftmost_least(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every ``k`` consecutive values, the place of the least, the leftmost of equals, as stretches of windows
    that share it: the first window, the last one and the place."""
    n = len(values) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    least, span = values, 1
    while 2 * span <= k:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if k > span:
        least = np.minimum(least[: len(least) - (k - span)], least[k - span :])
    lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    hi = np.append(lo[1:], n) - 1
    views = np.lib.stride_tricks.sliding_window_view(values, k)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(4):  # a window may slide past the leftmost of equals: the stretch goes on with the next of them
        at = lo + k - 1
        search = np.flatnonzero((lo == 0) | (least[lo] >= least[lo - 1]))  # else the value that has just come in is the least
        for c in range(0, len(search), 1 << 12):
            part = lo[search[c : c + (1 << 12)]]
            at[search[c : c + (1 << 12)]] = part + np.argmax(views[part] == least[part][:, None], axis=1)
        past = hi > at
        done.append((lo, np.minimum(hi, at), at))
        lo, hi = at[past] + 1, hi[past]
    for a, b in zip(lo.tolist(), hi.tolist()):  # periodic text: the rest of the stretch by doubling, with places
        v = values[a : b + k]
        at, span = np.arange(a, b + k), 1
        for shift in [1 << i for i in range(k.bit_length() - 1)] + [k - (1 << (k.bit_length() - 1))]:
            if shift:
                right = v[shift:] < v[: len(v) - shift]
                at = np.where(right, at[shift:], at[: len(at) - shift])
                v = np.where(right, v[shift:], v[: len(v) - shift])
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        done.append((a + first, a + np.append(first[1:], len(at)) - 1, at[first]))
    lo, hi, at = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order], at[order]


class Unit:
    """The documents of a unit as one row of bytes, and the stretches of windows that share an anchor.

    Anchors are found a stretch of documents at a time, so the arrays per byte stay small.
    """

    def __init__(self, table: pa.Table, width: int, gram: int):
        self.rows = rows_of(table) if table.num_rows else []
        self.raw = b"".join(raw for _, raw in self.rows)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array([len(raw) for _, raw in self.rows], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(self.rows):
            upto = max(at + 1, int(np.searchsorted(self.first, self.first[at] + STEP, side="right")))
            base, end = int(self.first[at]), int(self.first[upto - 1] + self.sizes[upto - 1])
            grams = rolling(self.bytes[base:end], gram)
            lo, hi, anchor = leftmost_least(grams, width - gram + 1)
            # windows must lie in one document: cut the stretches at documents' ends
            starts, ends = self.first[at:upto] - base, self.first[at:upto] + self.sizes[at:upto] - base
            d = np.searchsorted(ends, lo, side="right")
            while len(lo):
                fits = np.minimum(hi, ends[d] - width)
                good = fits >= lo
                found.append((lo[good] + base, fits[good] + base, anchor[good] + base, grams[anchor[good]]))
                d = d + 1
                more = (d < len(ends)) & (hi >= starts[np.minimum(d, len(ends) - 1)])
                lo, hi, anchor, d = starts[d[more]], hi[more], anchor[more], d[more]
            at = upto
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        order = np.argsort(parts[0], kind="stable")
        self.lo, self.hi, self.anchor, self.hash = (x[order] for x in parts)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first + self.sizes, at, side="right")


def windows_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from lo to hi of each stretch, and the stretch of each."""
    n = hi - lo + 1
    of = np.repeat(np.arange(len(lo)), n)
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), of


def plausible(contexts: list[tuple[bytes, int, int]], width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context (its bytes, its anchor's hash and place), the first and last start of windows that another context
    could have; the last is less than the first if there are none. A negative place: any of its windows may be shared.

    Equal windows have their anchor at the same place, so they are of one class and have its middle in common.
    """
    most = width - gram
    step = -(-(most + 1) // CLASSES)
    keys, of, kinds = [], [], []
    for k, (text, h, place) in enumerate(contexts):
        if place < 0:
            keys.append(hash(h))
            of.append(k)
            kinds.append(-1)
            continue
        shift = most - place  # a window that starts at i has the anchor at place - i, its number is i + shift
        for c in range(shift // step, (len(text) - width + shift) // step + 1):
            keys.append(hash((h, c, text[min(c * step + step - 1, most) - shift : c * step - shift + width])))
            of.append(k)
            kinds.append(c)
    _, which, counts = np.unique(np.array(keys, np.int64), return_inverse=True, return_counts=True)
    good = counts[which] > 1
    who, kind = np.array(of, np.int64)[good], np.array(kinds, np.int64)[good]
    lo, hi = np.full(len(contexts), CLASSES, np.int64), np.full(len(contexts), -2, np.int64)
    np.minimum.at(lo, who, kind)
    np.maximum.at(hi, who, kind)
    place = np.array([x[2] for x in contexts], np.int64)
    last = np.array([len(x[0]) for x in contexts], np.int64) - width
    first = np.where(lo < 0, 0, np.maximum(0, lo * step - most + place))
    last = np.where(lo < 0, last, np.minimum(last, hi * step + step - 1 - most + place))
    return first, np.where(hi < -1, -1, last)


class Context(NamedTuple):
    """The windows of one anchor that lie in one stretch. own: document order, with the place in the document last."""

    text: bytes
    own: tuple[int, ...]
    unit: int
    lo: int
    hash: int
    place: int


def merged(contexts: Iterable[Context], width: int, lost: dict[int, list[tuple[int, int]]]) -> list[Context]:
    """The first of equal contexts each; the others' windows are lost."""
    first: dict[bytes, Context] = {}
    for x in contexts:
        old = first.setdefault(x.text, x)
        if old is not x:
            loser = old if x.own < old.own else x
            if loser is old:
                first[x.text] = x
            lost.setdefault(loser.unit, []).append((loser.lo, loser.lo + len(x.text) - width))
    return [*first.values()]


def undecided(contexts: Iterable[Context], width: int, gram: int, lost: dict[int, list[tuple[int, int]]]) -> list[Context]:
    """What is left for the suffix array, in document order: contexts are merged and narrowed in turn, until that takes away little."""
    left = merged(contexts, width, lost)
    anchors = Counter(x.hash for x in left)
    left = [x for x in left if anchors[x.hash] > 1]
    while left:
        size = sum(len(x.text) for x in left)
        begin, end = plausible([(x.text, x.hash, x.place) for x in left], width, gram)
        narrow = (
            Context(x.text[a : b + width], (*x.own[:-1], x.own[-1] + a), x.unit, x.lo + a, x.hash, x.place - a if x.place >= 0 else x.place)
            for x, a, b in zip(left, begin.tolist(), end.tolist())
            if a <= b
        )
        left = merged(narrow, width, lost)
        if sum(len(x.text) for x in left) > 0.9 * size:
            break
    return sorted(left, key=lambda x: x.own)


def later_windows(contexts: list[bytes], keys: list[tuple], width: int) -> dict[int, np.ndarray]:
    """For each context, the starts of its windows that also start earlier, by key and place, in another or in itself.

    keys: sortable, with the place in the document last.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    text = np.append(text, 0)
    sa = suffix_array(text)
    shared = permuted_common_prefixes(text, sa)[sa] >= width
    of = np.searchsorted(ends, sa, side="right")
    inside = np.zeros(len(sa), bool)
    real = of < len(contexts)
    inside[real] = (sa[real] + width <= ends[of[real]]) & (sa[real] >= (ends - sizes)[of[real]])
    group = np.cumsum(~shared)
    sa, of, group = sa[inside], of[inside], group[inside]
    many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    sa, of, group = sa[many], of[many], group[many]
    if not len(sa):
        return {}
    docs = sorted({k[:-1] for k in keys})
    number = {d: i for i, d in enumerate(docs)}
    doc = np.array([number[k[:-1]] for k in keys], np.int64)[of]
    inner = sa - (ends - sizes)[of]
    place = np.array([k[-1] for k in keys], np.int64)[of] + inner
    order = np.lexsort((place, doc, group))
    g = group[order]
    later = order[np.append(False, g[1:] == g[:-1])]
    out: dict[int, np.ndarray] = {}
    by = later[np.argsort(of[later], kind="stable")]
    for part in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
        if len(part):
            out[int(of[part[0]])] = inner[part]
    return out


def removed_bytes(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int, hot: int, emit, schema: str) -> DataFrame:
    n = n_units(docs, text_col)
    places = Places.of(n)
    units = to_units(docs, id_col, text_col, n)

    def anchors(unit: int, table: pa.Table) -> Iterator[tuple]:
        u = Unit(table, width, gram)
        own, counts = np.unique(u.hash, return_counts=True)
        yield from probe_mail(unit, own, np.zeros(len(own), np.uint8), np.minimum(counts, 1 << 30).astype(np.int32), places)

    def hit(marks: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return np.where(counts > hot, 2, counts > 1)

    def contexts(unit: int, texts: pa.Table, hits: pa.Table) -> Iterator[tuple]:
        if not hits.num_rows or not texts.num_rows:
            return
        u = Unit(texts, width, gram)
        kind = shared_places(u.hash, n, hits)
        raw = u.raw
        some, many = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        at, _ = windows_of(u.lo[many], u.hi[many])
        whole = rolling(u.bytes, width)[at] if len(at) else np.zeros(0, np.uint64)
        first, last = np.concatenate([u.lo[some], at]), np.concatenate([u.hi[some], at])
        place = np.concatenate([u.anchor[some] - u.lo[some], np.full(len(at), -1)]).astype(np.int32)
        route = np.concatenate([u.hash[some], whole])
        order = np.argsort(first, kind="stable")  # document order, so the first in the unit comes first
        seen: set[bytes] = set()
        gone, sent, parts = [], [], []
        for k, lo, hi in zip(order.tolist(), first[order].tolist(), last[order].tolist()):
            text = raw[lo : hi + width]
            if text in seen:
                gone.append((lo, hi))
            else:
                seen.add(text)
                sent.append(k)
                parts.append(text)
        del seen
        if sent:
            text = np.empty(len(parts), object)
            text[:] = parts
            lo, route = first[sent], route[sent]
            d = u.doc(lo)
            ids = np.array([k for k, _ in u.rows], np.int64)[d]
            yield from scatter((mix(route) % np.uint64(n)).astype(np.int64), (lo, ids, d, lo - u.first[d], route, place[sent], text, np.full(len(lo), unit, np.int32)), places, unit, 3)
        yield -1, unit, dumps(np.array(gone, np.int64).reshape(-1, 2))

    def shard(bucket: int, table: pa.Table) -> Iterator[tuple]:
        lost: dict[int, list[tuple[int, int]]] = {}
        # equal windows have their anchor at the same place, so a context never repeats one within itself
        left = undecided((Context(text, (key, unit, d, at), unit, lo, h, place) for lo, key, d, at, h, place, text, unit in zip(*(c.tolist() for c in columns_of(table)))), width, gram, lost)
        if left:
            found = later_windows([x.text for x in left], [x.own for x in left], width)
            for k, inner in found.items():
                lost.setdefault(left[k].unit, []).extend((left[k].lo + i, left[k].lo + i) for i in inner.tolist())
        for unit, pairs in lost.items():
            both = np.array(pairs, np.int64).reshape(-1, 2)
            yield from scatter(np.full(len(both), unit, np.int32), (both,), places, bucket)

    def cut(unit: int, texts: pa.Table, told: pa.Table) -> Iterator[tuple]:
        rows = rows_of(texts) if texts.num_rows else []
        begin = np.concatenate([[0], np.cumsum([len(raw) for _, raw in rows])]).astype(np.int64)
        step = np.zeros(int(begin[-1]) + 1, np.int64)
        for blob, own in zip(told.column("data").to_pylist(), told.column("own").to_pylist()):
            pairs = loads(blob) if own else loads(blob)[1]
            np.add.at(step, pairs[:, 0], 1)
            np.add.at(step, pairs[:, 1] + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        for k, (key, raw) in enumerate(rows):
            yield emit(key, raw, gone[begin[k] : begin[k + 1]])

    asked = delivered(exchange(units, "unit", anchors, MAIL), places)
    hits = delivered(exchange(asked, "dest", lambda b, t: pick_shared(b, t, hit, places), MAIL), places).withColumnRenamed("dest", "unit")
    found = materialise(meet(units, hits, "unit", contexts, MAIL), "contexts")
    later = delivered(exchange(delivered(found.where("dest >= 0"), places), "dest", shard, MAIL), places)
    own = found.where("dest < 0").select(F.col("source").alias("unit"), "data", F.lit(True).alias("own"))
    return meet(units, own.union(later.select(F.col("dest").alias("unit"), "data", F.lit(False).alias("own"))), "unit", cut, schema)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, with_spans: bool = False
) -> DataFrame:
    """One row per document: id, ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``spans`` (JSON pairs).

    Removed is each byte covered by a string of ``width`` bytes that also starts earlier: in a document with a
    smaller id, or before in the same document; strings are judged on the input. Null counts as empty; no match
    crosses documents. Rows that repeat an id follow each other by their bytes. ids are whole numbers; a null id
    is smaller than all others. No rows give no rows.
    """

    def emit(key: int, raw: bytes, gone: np.ndarray) -> tuple:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        kept = raw if not len(edge) else np.frombuffer(raw, np.uint8)[~gone].tobytes()
        more = [str(edge.reshape(-1, 2).tolist())] if with_spans else []
        return (key, len(raw), int(gone.sum()), len(edge) // 2, sha256(kept), *more)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans string" if with_spans else "")
    return with_id(removed_bytes(docs, id_col, text_col, width, gram, hot, emit, schema), id_col)
