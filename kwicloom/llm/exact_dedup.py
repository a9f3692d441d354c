"""Exact deduplication by a log-structured merge index of digests. DataFrame operations only.

* Memtables: rows come in batches; each batch is aggregated by digest (map-side combine, so a digest that holds a
  third of all rows costs one row per task) and flushed as one run, sorted by digest in each file, with a filter.
* Hits: before a run joins the index, its digests probe the filters of the live runs; those that pass are looked
  up in the runs. A digest that is there, or twice in its own batch, is a hit.
* Compaction: two runs of the same tier merge into one of the next tier, which keeps the smallest identifier and
  the number of rows of each digest; so there are as many live runs as the logarithm of the batches.
* Verification: the bytes of all hits are compared, by the least and the greatest text of each digest. Where the
  two differ, the digest collided and its rows are grouped by their bytes instead.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITS, hit_filter, lookup, materialise, may_hit, text_of

#: Batches that a table is flushed in.
MEMTABLES = 4
#: Bits of a run's filter to a digest, and bitmaps of 4 KB of a filter at most; a fuller filter only lets more digests through.
BITS_PER_DIGEST = 8
FILTER = 1024


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Run:
    """``rows(digest, key, n)``: the smallest key and the number of rows of each digest; ``bitmaps``: its filter."""

    rows: DataFrame
    bitmaps: DataFrame
    buckets: int
    tier: int

    @classmethod
    def sealed(cls, rows: DataFrame, tier: int) -> Run:
        rows = materialise(rows.sortWithinPartitions("digest"), "run")
        buckets = min(FILTER, -(-rows.count() * BITS_PER_DIGEST // BITS) or 1)
        return cls(rows, materialise(hit_filter(rows, "digest", buckets), "run-filter"), buckets, tier)

    def seen(self, digests: DataFrame) -> DataFrame:
        """Those of the digests that the run has."""
        return may_hit(digests, self.bitmaps, "digest", self.buckets).join(self.rows.select("digest"), "digest", "left_semi")


def flush(entries: DataFrame) -> Run:
    """The run of a batch ``(digest, key)``."""
    return Run.sealed(entries.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n")), 0)


def compact(a: Run, b: Run) -> Run:
    """One run of two."""
    rows = a.rows.unionByName(b.rows).groupBy("digest").agg(F.min("key").alias("key"), F.sum("n").alias("n"))
    return Run.sealed(rows, max(a.tier, b.tier) + 1)


@dataclass
class MergeIndex:
    runs: list[Run] = field(default_factory=list)

    def add(self, entries: DataFrame) -> DataFrame:
        """Add a batch ``(digest, key)``; gives its digests that occur twice in it or are in the index already."""
        run = flush(entries)
        hits = run.rows.where("n > 1").select("digest")
        for older in self.runs:
            hits = hits.union(older.seen(run.rows.select("digest")))
        hits = materialise(hits.distinct(), "run-hits")
        self.runs.append(run)
        while len(self.runs) > 1 and self.runs[-1].tier == self.runs[-2].tier:
            self.runs[-2:] = [compact(*self.runs[-2:])]
        return hits

    def level(self) -> DataFrame:
        """All of the index as one run."""
        while len(self.runs) > 1:
            self.runs[-2:] = [compact(*self.runs[-2:])]
        return self.runs[0].rows


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256, memtables: int = MEMTABLES
) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, digest``; text compared after A-Z lower-casing.

    keep: ``smallest`` or ``largest`` identifier of equal texts (the index keeps the smallest of the negated
    identifier for the latter). digest: a function of a text column; any will do, as hits are verified.
    memtables: how many batches the rows are flushed in.

    Null text counts as empty; empty texts equal each other. Ids are taken to be unique; if an id repeats,
    each of its rows is reported. A null id is kept only where no other row has the text. Other columns are
    ignored. No rows give no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    norm = ascii_lower(text_of(text_col))
    order = F.col(id_col) if keep == "smallest" else -F.col(id_col)
    entries = docs.select(F.col(id_col).alias("id"), order.alias("key"), digest(norm).alias("digest"), F.pmod(F.xxhash64(id_col), F.lit(memtables)).alias("batch"))
    entries = materialise(entries.sortWithinPartitions("batch"), "entries")  # so a batch reads its own row groups
    index = MergeIndex()
    found = [index.add(entries.where(F.col("batch") == k).select("digest", "key")) for k in range(memtables)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    hits = materialise(index.level().join(hits.distinct(), "digest", "left_semi"), "hits")
    runs, total = entries.drop("batch"), entries.count()

    suspects = docs.select(order.alias("key"), norm.alias("norm"), digest(norm).alias("digest"))
    verified = may_hit(suspects, hit_filter(hits, "digest", FILTER), "digest", FILTER)
    collided = verified.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest")
    collided = materialise(collided, "collided")

    out = lookup(runs, hits.withColumnRenamed("key", "keep_key"), "digest", "n", total)
    out = out.withColumns({"keep_key": F.coalesce("keep_key", "key"), "n": F.coalesce("n", F.lit(1))})
    if not collided.limit(1).isEmpty():
        texts = materialise(suspects.join(collided, "digest", "left_semi").withColumn("part", F.concat(F.col("digest"), F.unhex(F.sha2("norm", 512)))), "collisions")
        groups = texts.groupBy("part", "norm").agg(F.min("key").alias("keep_key"), F.count("*").alias("n"))
        exact = texts.join(groups, ["part", "norm"]).select("digest", "key", "keep_key", "n").distinct()
        fixed = runs.join(exact, ["digest", "key"]).select(*out.columns)
        out = out.join(collided, "digest", "left_anti").select(*fixed.columns).unionByName(fixed)
    sign = 1 if keep == "smallest" else -1
    return out.select(
        F.col("id").alias(id_col), (F.col("keep_key") * sign).alias("keep_id"), F.col("n").alias("group_size"), F.col("key").eqNullSafe(F.col("keep_key")).alias("kept"), "digest"
    )
