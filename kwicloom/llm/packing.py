"""Best-fit packing of token sequences, bulk-synchronous.

1. Tokenise: each task writes its pieces (at most ``capacity`` tokens) with the rank of each piece among the
   task's pieces of the same length.
2. Range-sort: lengths and gaps are integers up to ``capacity``, so the sorted order of all documents is a
   histogram of at most ``capacity`` classes; a piece's global rank in its class is its task's offset (a
   prefix sum over tasks) plus its rank in the task. No task sees more than one row per task and length.
3. Successor sweep: from the longest class down, each class takes the least gap that is at least its length,
   by rank, until the class or the gap's run is used up; what is left over repeats with the next gap or
   opens sequences; used gaps shrink. Classes and gaps are runs, so a sweep costs runs, not documents.
4. The runs are joined back to the pieces by (task, length), a key that no task's rows exceed.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import word_encoder
from .common import materialise

CAPACITY = 4096
END_ID = 1
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def normal(text: str) -> str:
    """NFC and the lower case of single characters (a final sigma is like any other)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(1)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_ids(path: str, texts: list[str]) -> list[np.ndarray]:
    """The ids that the tokenizers library gives without adding special tokens. Texts that spell out a special
    token go through the library itself."""
    out = word_encoder(path).encode_texts(["" if "<|" in t and any(s in t for s in SPECIAL) else normal(t) for t in texts], spaced=False)
    for k, t in enumerate(texts):
        if "<|" in t and any(s in t for s in SPECIAL):
            out[k] = np.array(library(path).encode(t, add_special_tokens=False).ids, np.uint32)
    return out


def tokenised_pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "rank")} | ({"ids": []} if with_ids else {})
            for key, ids in zip(keys, word_ids(vocabulary, texts)):
                ids = np.append(ids, END_ID).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows["id"].append(key)
                    rows["piece"].append(piece)
                    rows["start"].append(start)
                    rows["length"].append(len(own))
                    rows["ids_crc32"].append(zlib.crc32(own.tobytes()))
                    rows["rank"].append(int(seen[len(own)]))
                    if with_ids:
                        rows["ids"].append(own.astype(np.int32))
                    seen[len(own)] += 1
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(v, t) for v, t in zip(rows.values(), types)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows["id"]), pa.int32())], names=[*rows, "part"])

    more = ", ids array<int>" if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, rank long{more}, part int")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs ``(length, rank_from, rank_to, first sequence, offset)`` and the number of sequences.

    The piece of rank r of a run lies in sequence ``first + r - rank_from``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gaps that exist, ascending
    runs, opened = [], 0

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].pop()
                take = min(left, count)
                if count > take:
                    gaps[gap].append((first + take, count - take))
                elif not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                runs.append((length, rank, rank + take, first, capacity - gap))
                free(gap - length, first, take)
                left, rank = left - take, rank + take
                continue
            per = capacity // length
            whole, rest = divmod(left, per)
            for layer in range(per):
                count = whole + (layer < rest)
                if count:
                    runs.append((length, rank, rank + count, opened, layer * length))
                    rank += count
            free(capacity - per * length, opened, whole)
            free(capacity - rest * length, opened + whole, 1 if rest else 0)
            opened += whole + (1 if rest else 0)
            left = 0
    return runs, opened


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset`` and, if asked, ``ids``.

    Null or empty text is the one token ``END_ID``. Documents of more than ``capacity`` tokens are cut into
    pieces of that length, the last one shorter; others stay whole. Repeated rows are packed each. No rows give
    no rows. On the driver: one count per length, so at most ``capacity`` numbers, and the runs made of them.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, vocabulary, id_col, text_col, capacity, with_ids), "pieces")
    per_task = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    runs, _ = best_fit({r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = per_task.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    plan = spark.createDataFrame(runs, "length long, r0 long, r1 long, first long, offset long")
    local = (
        tasks.join(plan, "length")
        .where((F.col("r0") < F.col("skip") + F.col("n")) & (F.col("r1") > F.col("skip")))
        .select("part", "length", (F.col("r0") - F.col("skip")).alias("lo"), (F.col("r1") - F.col("skip")).alias("hi"), "first", "offset")
    )
    local = local.hint("merge")
    placed = pieces.join(local, ["part", "length"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    more = ["ids"] if with_ids else []
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *more
    )
