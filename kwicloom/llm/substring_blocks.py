"""Substring deduplication by fixed-block anchors, over words.

Reference blocks are the non-overlapping runs of ``window / 2`` words of each document; every rolling run of
that many words of every document probes them. A window of ``window`` words that occurs in two documents holds
a whole reference block of either, so some probe of each hits. A hit is extended by half a window to both
sides; windows there are compared by a 128-bit BLAKE2 digest of their words, whose runs are the maximal exact
repeats. The rolling hashes only propose: what they confuse, the digest of the words tells apart.

Each unit sends every distinct probe once, as 32 bits per hash, so a passage of a third of all documents costs
one value per unit; windows go out once per unit too, with the smallest id that has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialise, unboxed
from .pieces import span_hashes
from .units import MAIL, Places, columns_of, covered, delivered, distinct_pairs, dumps, exchange, id_of, loads, meet, n_units, pick_shared, probe_mail, rolling, rows_of, scatter, sha256, shared_places, to_units, with_id

WINDOW = 50
IS_BLOCK, IN_SEVERAL = 1, 2


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    b = np.frombuffer(raw, np.uint8)
    solid = np.zeros(len(b) + 2, bool)
    solid[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a stretch of about a million bytes at a time."""
    b = np.frombuffer(raw, np.uint8)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20))))
        at = int(starts[lo])
        out[lo:hi] = span_hashes(b[at : int(ends[hi - 1])], starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return out


def joined(raw: bytes) -> bytes:
    """The words of UTF-8 bytes, joined by single blanks; ``bytes.split`` knows the same white space as the words."""
    return b" ".join(raw.split())


class Unit:
    """The documents of a unit as one row of word hashes."""

    def __init__(self, table: pa.Table):
        self.rows = rows_of(table)
        self.texts, self.starts, self.ends = [], [], []
        hashes, sizes = [], []
        for _, raw in self.rows:
            text = joined(raw)
            starts, ends = word_spans(text)
            self.texts.append(text)
            self.starts.append(starts)
            self.ends.append(ends)
            hashes.append(word_hashes(text, starts, ends))
            sizes.append(len(starts))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.ids = np.array([k for k, _ in self.rows], np.int64)

    def inside(self, k: int) -> np.ndarray:
        """Places where ``k`` words begin that are all of one document."""
        n = len(self.words) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])

    def probes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.inside(k)
        return at, rolling(self.words, k)[at]

    def digests(self, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit digests, in two halves, of the ``k`` words at each of the places, which ascend."""
        out = bytearray()
        doc = self.doc[starts]
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(doc)) + 1):
            d = int(doc[part[0]])
            at = starts[part] - self.first[d]
            view = memoryview(self.texts[d])
            for a, b in zip(self.starts[d][at].tolist(), self.ends[d][at + k - 1].tolist()):
                out += blake2b(view[a:b], digest_size=16).digest()
        both = np.frombuffer(bytes(out), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def removed_words(docs: DataFrame, id_col: str, text_col: str, window: int, emit, schema: str) -> DataFrame:
    """``emit(id, text, starts, ends, removed mask)`` of every document, as rows of ``schema``."""
    half = window // 2
    n = n_units(docs, text_col)
    places = Places.of(n)
    units = to_units(docs, id_col, text_col, n)

    def probe(unit: int, table: pa.Table) -> Iterator[tuple]:
        u = Unit(table)
        at, hashes = u.probes(half)
        if not len(at):
            return
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        ids = u.ids[u.doc[at]]
        block = np.bitwise_or.reduceat(((at - u.first[u.doc[at]]) % half == 0).astype(np.uint8), first)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        yield from probe_mail(unit, hashes[first], block * IS_BLOCK + several.astype(np.uint8) * IN_SEVERAL, np.ones(len(first), np.uint8), places)

    def hit(marks: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return ((marks & IS_BLOCK) > 0) & ((seen > 1) | ((marks & IN_SEVERAL) > 0))

    def windows(unit: int, texts: pa.Table, hits: pa.Table) -> Iterator[tuple]:
        if not hits.num_rows or not texts.num_rows:
            return
        u = Unit(texts)
        at, hashes = u.probes(half)
        mark = np.zeros(len(u.words) + 1, np.int64)
        mark[at[shared_places(hashes, n, hits) > 0] + 1] = 1
        total = np.cumsum(mark)
        starts = u.inside(window)
        starts = starts[total[starts + (window - half) + 1] > total[starts]]
        if not len(starts):
            return
        h1, h2 = u.digests(starts, window)
        order, first, which = distinct_pairs(h1, h2)
        doc = u.doc[starts]
        least = np.minimum.reduceat(doc[order], first)  # rows are sorted by id
        v1, v2 = h1[order[first]], h2[order[first]]
        yield -1, unit, dumps((starts.astype(np.int64), which.astype(np.int32), least))
        yield from scatter((v1 % np.uint64(n)).astype(np.int64), (np.arange(len(v1), dtype=np.int32), v1, v2, u.ids[least], np.full(len(v1), unit, np.int32)), places, unit)

    def earliest(bucket: int, table: pa.Table) -> Iterator[tuple]:
        k, h1, h2, ids, unit = columns_of(table)
        order, first, which = distinct_pairs(h1, h2)
        later = np.minimum.reduceat(ids[order], first)[which] < ids
        yield from scatter(unit[later], (k[later],), places, bucket)

    def cut(unit: int, texts: pa.Table, told: pa.Table) -> Iterator[tuple]:
        rows = rows_of(texts) if texts.num_rows else []
        spans = [word_spans(raw) for _, raw in rows]
        sizes = np.array([len(s) for s, _ in spans], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        gone = np.zeros(int(begin[-1]), bool)
        own = [loads(d) for d, mine in zip(told.column("data").to_pylist(), told.column("own").to_pylist()) if mine]
        if own:
            starts, which, least = own[0]
            later = np.zeros(len(least), bool)
            replies = told.filter(pc.invert(told.column("own")))
            if replies.num_rows:
                later[columns_of(replies)[0]] = True
            doc = np.searchsorted(begin, starts, side="right") - 1
            ids = [k for k, _ in rows]
            same = np.zeros(len(rows), np.int64)  # rows of one id are one document here
            for k in range(1, len(rows)):
                same[k] = same[k - 1] if ids[k] == ids[k - 1] else k
            gone = covered(len(gone), starts[later[which] | (same[doc] > same[least[which]])], window)
        for k, (key, raw) in enumerate(rows):
            yield emit(key, raw, *spans[k], gone[begin[k] : begin[k + 1]])

    asked = delivered(exchange(units, "unit", probe, MAIL), places)
    hits = delivered(exchange(asked, "dest", lambda b, t: pick_shared(b, t, hit, places), MAIL), places).withColumnRenamed("dest", "unit")
    found = materialise(meet(units, hits, "unit", windows, MAIL), "windows")
    later = delivered(exchange(delivered(found.where("dest >= 0"), places), "dest", earliest, MAIL), places)
    own = found.where("dest < 0").select(F.col("source").alias("unit"), "data", F.lit(True).alias("own"))
    return meet(units, own.union(later.select(F.col("dest").alias("unit"), "data", F.lit(False).alias("own"))), "unit", cut, schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: id, ``n_words, n_removed, kept_sha256`` and, if asked, ``kept`` (words joined by a blank).

    A word is removed when a window of ``window`` words that covers it also starts in a document with a smaller
    id; windows are judged on the input. Null or empty text has no words. Rows that repeat an id count as one
    document: their windows do not remove each other's words. ids are whole numbers; a null id is smaller than
    all others. No rows give no rows.
    """

    def emit(key: int, raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
        kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())])
        return (key, len(starts), int(gone.sum()), sha256(kept), *([kept.decode("utf-8", "replace")] if with_text else []))

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return with_id(removed_words(docs, id_col, text_col, window, emit, schema), id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out of the texts; white space elsewhere stays. Documents that lose
    all their words are dropped; those that lose none are unchanged. Same columns."""

    def emit(key: int, raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
        if not gone.any():
            return key, sha256(raw), 0, None
        if gone.all():
            return key, sha256(raw), 2, None
        parts, at = [], 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            parts.append(raw[at : int(starts[a])])
            at = int(starts[b]) if b < len(starts) else len(raw)
        parts.append(raw[at:])
        return key, sha256(raw), 1, b"".join(parts).rstrip().decode("utf-8", "replace")

    changes = removed_words(docs, id_col, text_col, window, emit, "_key long, _sha string, _kind int, _text string")
    changes = materialise(changes.where("_kind > 0").dropDuplicates(["_key", "_sha"]), "cuts")
    rows = boxed(docs, id_of(id_col).alias("_id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("_own"))
    found = rows.join(changes, (F.col("_id") == F.col("_key")) & (F.col("_own") == F.col("_sha")), "left").where(F.coalesce("_kind", F.lit(0)) < 2)
    changed, new = F.col("_kind") == 1, {}
    new[text_col] = F.when(changed, F.col("_text")).otherwise(F.col("_row").getField(text_col))
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(changed, F.length("_text").cast(docs.schema[n_chars_col].dataType)).otherwise(F.col("_row").getField(n_chars_col))
    return unboxed(found, docs.columns, new)
