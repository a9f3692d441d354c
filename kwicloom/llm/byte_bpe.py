"""Byte-pair encoding by a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at position i (with i itself, so that the least value
is the leftmost pair of least rank); the root is the next merge. A merge updates three leaves, those of the
merged pair, its right part and its live left neighbour, each a logarithmic path. Short pieces go through the
same tree in batches, one column of the node array each; long ones through a scalar tree.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import distinct, pieces_of

#: Longer pieces use the scalar tree.
BATCH_LENGTH = 64
#: Pieces of a worker's cache, which is emptied when full.
CACHE = 400_000
INF = np.int64(1) << 60


class PairTable:
    """Pairs of ids that merge: open addressing over arrays, looked up by vector or one by one."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.one = pairs
        size = 1 << max(4, (len(pairs) * 3).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.value = np.zeros((size, 2), np.int64)
        ab = np.array(list(pairs), np.uint64).reshape(-1, 2)
        keys = (ab[:, 0] << np.uint64(32)) | ab[:, 1]
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.iinfo(np.uint64).max
            _, winner = np.unique(slot[todo][free], return_index=True)
            put = todo[free][winner]
            self.keys[slot[put]] = keys[put]
            self.value[slot[put]] = values[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(32))) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``INF`` if none) and merged id of each pair."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(keys)
        rank, new = np.full(len(keys), INF, np.int64), np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            at = todo[hit]
            rank[at], new[at] = self.value[slot[at], 0], self.value[slot[at], 1]
            todo = todo[~hit & (there != np.iinfo(np.uint64).max)]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        return rank, new


def merge_long(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """One piece through a scalar segment tree."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    size = 1 << (n - 1).bit_length()
    none = (1 << 60, -1)
    leaf = lambda a, b, i: (pairs[ids[a], ids[b]][0], i) if (ids[a], ids[b]) in pairs else none
    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = leaf(i, i + 1, i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: tuple[int, int]) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while tree[1] is not none and tree[1][1] >= 0:
        i = tree[1][1]
        j = after[i]
        k = after[j]
        ids[i] = pairs[ids[i], ids[j]][1]
        ids[j] = -1
        after[i] = k
        put(j, none)
        if k < n:
            before[k] = i
            put(i, leaf(i, k, i))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], leaf(before[i], i, before[i]))
    return [x for x in ids if x >= 0]


def merge_batch(flat: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of at most ``BATCH_LENGTH`` ids, concatenated in ``flat``: their merged ids and new lengths, in order."""
    m = len(lengths)
    longest = int(lengths.max(initial=1))
    size = 1 << max(0, (longest - 1).bit_length())
    starts = np.cumsum(lengths) - lengths
    ids = np.full((size + 1, m), -1, np.int64)
    col = np.repeat(np.arange(m), lengths)
    row = np.arange(len(flat)) - np.repeat(starts, lengths)
    ids[row, col] = flat
    tree = np.full((2 * size, m), INF, np.int64)
    merged = np.zeros((size, m), np.int64)
    has = row + 1 < np.repeat(lengths, lengths)
    r, c = row[has], col[has]
    rank, new = table.find(ids[r, c], ids[r + 1, c])
    tree[size + r, c] = np.where(rank < INF, rank * size + r, INF)
    merged[r, c] = new
    for k in range(size - 1, 0, -1):
        np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
    after = np.repeat(np.arange(1, size + 2, dtype=np.int64)[:, None], m, 1)
    before = np.repeat(np.arange(-1, size, dtype=np.int64)[:, None], m, 1)

    def put(i: np.ndarray, c: np.ndarray, value: np.ndarray) -> None:
        k = size + i
        tree[k, c] = value
        while size > 1 and k[0] > 1:
            k = k >> 1
            tree[k, c] = np.minimum(tree[2 * k, c], tree[2 * k + 1, c])

    live = np.flatnonzero(tree[1] < INF) if size > 1 else np.zeros(0, np.int64)
    while len(live):
        i = tree[1, live] & (size - 1)
        j = after[i, live]
        ids[i, live] = merged[i, live]
        ids[j, live] = -1
        k = after[j, live]
        after[i, live] = k
        put(j, live, np.full(len(live), INF))
        on = k < lengths[live]
        before[k[on], live[on]] = i[on]
        rank, new = table.find(ids[i[on], live[on]], ids[k[on], live[on]])
        value = np.full(len(live), INF)
        value[on] = np.where(rank < INF, rank * size + i[on], INF)
        merged[i[on], live[on]] = new
        put(i, live, value)
        p = before[i, live]
        back = p >= 0
        if back.any():
            pb, cb = p[back], live[back]
            rank, new = table.find(ids[pb, cb], ids[i[back], cb])
            merged[pb, cb] = new
            put(pb, cb, np.where(rank < INF, rank * size + pb, INF))
        live = live[tree[1, live] < INF]
    kept = ids.T >= 0
    return ids.T[kept], kept.sum(1)


class Encoder:
    """Pieces to ids, with a bounded cache of piece -> packed ids (little-endian unsigned 32-bit)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], start: np.ndarray, end: np.ndarray | None = None):
        """start: the first id of each byte; end: the same for a piece's last byte, where that differs."""
        self.table, self.pairs, self.start, self.end = PairTable(pairs), pairs, start, end
        self.cache: dict[str, bytes] = {}

    def first_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.start[raw]
        if self.end is not None:
            last = np.cumsum(lengths) - 1
            ids[last] = self.end[raw[last]]
        return ids, lengths

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece; pieces are distinct and not empty."""
        if len(self.cache) + len(pieces) > CACHE:
            self.cache.clear()
        missing = [p for p in pieces if p not in self.cache]
        raws = [p.encode("utf-8", "replace") for p in missing]
        depth = np.ceil(np.log2(np.maximum(1, np.array([*map(len, raws)], np.int64))))
        fresh: dict[str, bytes] = {}
        for level in np.unique(depth).tolist():
            group = np.flatnonzero(depth == level).tolist()
            if 2**level > BATCH_LENGTH:
                for k in group:
                    ids, _ = self.first_ids([raws[k]])
                    fresh[missing[k]] = np.array(merge_long(ids.tolist(), self.pairs), "<u4").tobytes()
                continue
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                ids, lengths = merge_batch(*self.first_ids([raws[k] for k in part]), self.table)
                packed, ends = ids.astype("<u4").tobytes(), (np.cumsum(lengths) * 4).tolist()
                fresh.update(zip([missing[k] for k in part], [packed[a:b] for a, b in zip([0, *ends], ends)]))
        if len(pieces) > CACHE:
            return [fresh[p] if p in fresh else self.cache[p] for p in pieces]
        self.cache |= fresh
        return list(map(self.cache.__getitem__, pieces))

    def encode_texts(self, texts: list[str], spaced: bool) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for lo, hi in chunks(texts):
            points, starts, ends, counts = pieces_of(texts[lo:hi], spaced)
            words, which = distinct("".join(texts[lo:hi]), points, starts, ends)
            packed = self.encode(words)
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            flat = np.frombuffer(b"".join(packed), "<u4")
            begin = np.cumsum(sizes) - sizes
            n = sizes[which] if len(which) else np.zeros(0, np.int64)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids = flat[np.repeat(begin[which] if len(which) else n, n) + offset] if len(n) else flat
            total = np.concatenate([[0], np.cumsum(n)])
            cut = total[np.concatenate([[0], np.cumsum(counts)])]
            out += [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return out


def chunks(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so that memory is bounded by it and by the longest text."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def rank_encoder(path: str) -> tuple[Encoder, list[bytes]]:
    """The encoder of a rank file, where a pair's rank is the merged token's, and the bytes of each id."""
    ranks = read_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                pairs[a, b] = (rank, rank)
    start = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    names = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        names[rank] = token
    return Encoder(pairs, start), names


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


@lru_cache(1)
def word_encoder(path: str) -> Encoder:
    """The encoder of a vocabulary whose words end in ``</w>``, from its JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    letters = byte_letters()
    return Encoder(pairs, np.array([vocab[x] for x in letters], np.int64), np.array([vocab[x + end] for x in letters], np.int64))


def encode_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids`` and ``decoded``.

    Each match of the pattern is encoded separately, without special tokens; ``decoded`` joins the bytes of the
    ids. Null counts as empty, which has no ids. Rows stay in their tasks; memory is bounded by a chunk of
    about 2 million characters or one text, and by the cache. Repeated rows are each encoded.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = rank_encoder(ranks_path)
        blob, sizes = np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names], np.int64)
        begin = np.cumsum(sizes) - sizes
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
            for ids in encoder.encode_texts(texts, spaced=True):
                n = sizes[ids]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                decoded = blob[np.repeat(begin[ids], n) + offset].tobytes()
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    rows["ids"].append(ids.astype(np.int32))
                    rows["decoded"].append(decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.values())], names=[id_col, *rows])

    more = ", ids array<int>, decoded binary" if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
