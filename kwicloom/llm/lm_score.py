"""Language-model scoring by compression: zstandard sizes under an in-domain and a general dictionary.

A dictionary has every word that occurs twice or more in its corpus and is long enough to save anything, so it
grows with the vocabulary; the words that save most are nearest its end, where matches are cheapest. Word counts cover every document (the general corpus) and every in-domain document, and
are aggregated by word with map-side combine. The cross-entropy of a text under a dictionary is its compressed
size in bits per byte; the score is the general less the in-domain cross-entropy, so higher is more in-domain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LEVEL = 3
#: Words that a task counts before it hands on its counts.
FLUSH = 300_000


def word_counts(docs: DataFrame, text_col: str, flag: str) -> DataFrame:
    """``(word, n_general, n_domain)`` over all documents; ``flag`` says which are in the domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        general: Counter[str] = Counter()
        domain: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            words = list(general)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([general[w] for w in words], pa.int64()), pa.array([domain[w] for w in words], pa.int64())],
                names=["word", "n_general", "n_domain"],
            )
            general.clear()
            domain.clear()
            return out

        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").split()
                general.update(words)
                if own:
                    domain.update(words)
                if len(general) > FLUSH:
                    yield flushed()
        yield flushed()

    parts = docs.select(text_col, flag).mapInArrow(run, "word string, n_general long, n_domain long")
    return parts.groupBy("word").agg(F.sum("n_general").alias("n_general"), F.sum("n_domain").alias("n_domain"))


def dictionary(counts: DataFrame, n: str, size: int | None = None) -> bytes:
    """The words that save most, best last, in at most ``size`` bytes if given; a word of b bytes saves about b - 3 each time."""
    saved = F.col(n) * (F.octet_length("word") - 3)
    best = counts.where((F.col(n) > 1) & (F.octet_length("word") >= 4)).orderBy(saved.desc(), "word").select("word")
    if size is not None:
        best = best.limit(size // 5)  # a word that counts has 4 bytes and a blank, so more never fit
    out, left = [], size
    for word in best.toArrow().column("word"):
        raw = word.as_py().encode() + b" "
        if left is not None:
            if len(raw) > left:
                break
            left -= len(raw)
        out.append(raw)
    return b"".join(reversed(out))


def compression_scores(docs: DataFrame, domain_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """One row per document: id, ``n_bytes, general_bytes, domain_bytes, score``.

    domain_ids: the ids of the in-domain documents, in a column named ``id_col``. score is
    ``8 * (general_bytes - domain_bytes) / n_bytes``, in bits per byte; 0 for null or empty text. Without
    in-domain documents the domain dictionary is empty and scores compare with that. Repeated rows are each
    scored; no rows give no rows. ``size`` bounds a dictionary's bytes; None takes all words. Whole texts are compressed, one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = domain_ids.select(F.col(id_col).alias("_own")).distinct()
    flags = docs.select(F.col(id_col).alias("_id")).join(own, F.col("_id") == F.col("_own"), "left_semi").distinct().withColumn("_flag", F.lit(True))
    counted = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    in_domain = counted.join(flags, "_id", "left").select("_text", F.coalesce("_flag", F.lit(False)).alias("_flag"))
    counts = materialise(word_counts(in_domain, "_text", "_flag"), "word-counts")
    general, domain = dictionary(counts, "n_general", size), dictionary(counts, "n_domain", size)
    return score_with(docs, general, domain, id_col, text_col, kind)


def score_with(docs: DataFrame, general: bytes, domain: bytes, id_col: str, text_col: str, kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((general, domain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            if not raw:
                return zstandard.ZstdCompressor(level=LEVEL)
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=data)

        g, d = map(compressor, shared.value)
        for batch in batches:
            raws = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            n, a, b = [len(r) for r in raws], [len(g.compress(r)) if r else 0 for r in raws], [len(d.compress(r)) if r else 0 for r in raws]
            score = [8 * (x - y) / k if k else 0.0 for k, x, y in zip(n, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], names=[id_col, "n_bytes", "general_bytes", "domain_bytes", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, general_bytes long, domain_bytes long, score double")
