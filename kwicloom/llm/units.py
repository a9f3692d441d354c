"""Units of documents and blobs between them: the exchange that the substring operators share.

A unit is all documents whose id hashes to one number, about ``UNIT_BYTES`` of text. Columns (equally long
arrays) travel between units and buckets as compressed blobs, which keeps per-row costs away from millions of
small values. A sender makes at most ``FAN`` blobs: beyond that many destinations they go by relays, each of
which reads the blobs of ``FAN`` senders for one first hop, so blobs grow in proportion to the input and not
with its square. Whatever a stage needs from an earlier one is computed again or sent: units are
deterministic, so a lost task is simply repeated.
"""

from __future__ import annotations

import ctypes
import hashlib
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .pieces import mix

UNIT_BYTES = 8 << 20
#: Blobs of one sender at most, and senders of one relay.
FAN = 4096
#: Stands for a null id, which comes before all others.
NO_ID = -(1 << 63)
#: Rows of this many values at most are hashed at once.
STEP = 1 << 20


def dumps(value: object, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, 5))


def loads(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def trim() -> None:
    """Give freed memory back to the system: workers live on, and would keep it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def n_units(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // UNIT_BYTES))


def id_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def with_id(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` whose first column holds ids, under the name ``id_col`` and with nulls again."""
    first, *rest = df.columns
    return df.select(F.nullif(F.col(first), F.lit(NO_ID)).alias(id_col), *rest)


def to_units(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(unit, data)`` rows; each blob holds ids and UTF-8 texts of some of the unit's documents."""
    unit: Column = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0).to_numpy(zero_copy_only=False)
            ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            order = np.argsort(units, kind="stable")
            cuts = np.flatnonzero(np.diff(units[order])) + 1
            out_units, blobs = [], []
            for part in np.split(order, cuts):
                if len(part):
                    out_units.append(int(units[part[0]]))
                    blobs.append(dumps([(ids[k], (texts[k] or "").encode("utf-8", "replace")) for k in part.tolist()], 3))
            yield pa.RecordBatch.from_arrays([pa.array(out_units, pa.int32()), pa.array(blobs, pa.binary())], names=["unit", "data"])
            del ids, texts, blobs
            trim()

    return docs.select(unit.alias("unit"), id_of(id_col), F.col(text_col)).mapInArrow(run, "unit int, data binary")


def rows_of(table: pa.Table) -> list[tuple[int, bytes]]:
    """Ids and texts of a unit, by id and then text, so that the order is always the same."""
    return sorted(x for blob in table.column("data").to_pylist() for x in loads(blob))


def exchange(df: DataFrame, key: str | Column, fn: Callable[[int, pa.Table], Iterator[tuple]], schema: str) -> DataFrame:
    """Group by ``key`` and turn each group into rows by ``fn(key, table)``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return as_table(fn(k[0].as_py(), table), schema, names)
        finally:
            trim()

    return df.groupBy(key).applyInArrow(run, schema)


def meet(left: DataFrame, right: DataFrame, key: str, fn: Callable[[int, pa.Table, pa.Table], Iterator[tuple]], schema: str) -> DataFrame:
    """Both groups of each ``key``, either of which may be empty, to rows by ``fn(key, left, right)``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(k: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return as_table(fn(k[0].as_py(), a, b), schema, names)
        finally:
            trim()

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def as_table(rows: Iterator[tuple], schema: str, names: list[str]) -> pa.Table:
    types = [TYPES[x.split()[1]] for x in schema.split(", ")]
    columns = [*zip(*rows)] or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def second(values: np.ndarray) -> np.ndarray:
    """Other values of the same items, for a second hash."""
    return mix(values.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive values (as unsigned 64-bit), by content."""
    from .pieces import powers

    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pw, inv = powers()
    out = np.empty(n, np.uint64)
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        part = values[lo : hi + k - 1].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * pw[: len(part)], out=total[1:])
        out[lo:hi] = mix((total[k:] - total[: hi - lo]) * inv[: hi - lo])
    return out


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each number below ``n`` that ``bucket`` has, and its places."""
    bucket = bucket.astype(np.uint16 if n <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ranked)]):
        yield int(ranked[a]), order[a:b]


MAIL = "dest int, source int, data binary"


class Places(NamedTuple):
    """``n`` destinations; a sender makes at most ``fan`` blobs."""

    n: int
    fan: int

    @classmethod
    def of(cls, n: int) -> Places:
        return cls(n, FAN)


def scatter(dest: np.ndarray, columns: tuple[np.ndarray, ...], places: Places, source: int, level: int = 1) -> Iterator[tuple[int, int, bytes]]:
    """Rows of ``MAIL``: the columns cut by destination or by the first hop to it."""
    n, fan = places
    far = n > fan
    for hop, at in by_bucket(dest % fan if far else dest, min(n, fan)):
        further = (dest[at] // fan).astype(np.int32) if far else None
        yield hop, source, dumps((further, *[c[at] for c in columns]), level)


def columns_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The columns of all blobs that came to one destination."""
    parts = [loads(b) for b in table.column("data").to_pylist()]
    return tuple(np.concatenate(c) for c in list(zip(*parts))[1:])


def delivered(mail: DataFrame, places: Places) -> DataFrame:
    """Rows ``(dest, data)`` of ``mail`` at their destinations."""
    n, fan = places
    if n <= fan:
        return mail.select("dest", "data")

    def run(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            parts = [loads(b) for b in table.column("data").to_pylist()]
            further, *columns = (np.concatenate(c) for c in zip(*parts))
            rows = ((int(f) * fan + k[0].as_py(), dumps((None, *[c[at] for c in columns]))) for f, at in by_bucket(further, -(-n // fan)))
            return as_table(rows, "dest int, data binary", ["dest", "data"])
        finally:
            trim()

    relays = mail.withColumn("relay", F.floor(F.col("source") / fan).cast("int"))
    return relays.select("dest", "relay", "data").groupBy("dest", "relay").applyInArrow(run, "dest int, data binary")


def short(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits that stand for a hash within its bucket; what they confuse is told apart later."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask of ``n`` places: those inside ``[s, s + width)`` for any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def probe_mail(unit: int, hashes: np.ndarray, marks: np.ndarray, counts: np.ndarray, places: Places) -> Iterator[tuple[int, int, bytes]]:
    """The hashes of a unit, each with its mark and count, to their buckets."""
    yield from scatter((hashes % np.uint64(places.n)).astype(np.int64), (short(hashes), marks, counts, np.full(len(hashes), unit, np.int32)), places, unit)


def pick_shared(bucket: int, table: pa.Table, shared: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], places: Places) -> Iterator[tuple[int, int, bytes]]:
    """Tell each unit which of its short hashes are shared.

    ``shared(marks, counts, units)`` gets, for each distinct short hash, the marks or-ed, the counts added and the
    number of times that units sent it, and returns 0 for no, or another number, which is passed on.
    """
    every, marks, counts, units = columns_of(table)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    first = np.flatnonzero(new)
    marks = np.bitwise_or.reduceat(marks[order], first)
    counts = np.add.reduceat(counts[order].astype(np.int64), first)
    kind = shared(marks, counts, np.diff(np.append(first, len(ranked)))).astype(np.uint8)[np.cumsum(new) - 1]
    told = kind > 0
    units, values, kind = units[order[told]], ranked[told], kind[told]
    yield from scatter(units, (np.full(len(units), bucket, np.int32), values, kind), places, bucket)


def shared_places(hashes: np.ndarray, n: int, replies: pa.Table) -> np.ndarray:
    """The number that ``pick_shared`` gave each hash, 0 for those not shared."""
    out = np.zeros(len(hashes), np.uint8)
    if not replies.num_rows or not len(hashes):
        return out
    bucket, values, kind = columns_of(replies)
    key = (bucket.astype(np.uint64) << np.uint64(32)) | values
    order = np.argsort(key, kind="stable")
    key, kind = key[order], kind[order]
    for b, at in by_bucket((hashes % np.uint64(n)).astype(np.int64), n):
        lo, hi = np.searchsorted(key, np.array([b, b + 1], np.uint64) << np.uint64(32))
        if lo < hi:
            own = (np.uint64(b) << np.uint64(32)) | short(hashes[at])
            k = lo + np.searchsorted(key[lo:hi], own)
            k[k == hi] = lo
            out[at] = np.where(key[k] == own, kind[k], 0)
    return out


def distinct_pairs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (h1, h2), the places in it where a new pair begins, and each element's pair number."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which
