"""What several operators of this folder share: shared storage, total hashing of
documents into units, skew-safe lookups and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` as Java and DuckDB both read it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 4096
#: Bits of one bitmap of Spark's bitmap functions.
BITS = 32768


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine) gets a folder of its own; a cluster is refused, as a
    machine's own folder would not outlive it.
    """
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kwicloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` with all its columns in one, ``_row``, so that no name of theirs meets a name of ours; ``more`` columns beside it."""
    return docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("_row"), *more)


def unboxed(df: DataFrame, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """The columns of ``_row`` again, some changed."""
    return df.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text."""
    return F.array_remove(F.split(text, SPACE), "")


def gram_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of the word n-grams in order; none if there are fewer words than n.

    The shifted arrays are zipped, so no lambda refers to a whole array, which Spark would compute anew for each element.
    """
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    parts = [F.slice(words, k + 1, many) for k in range(n)]
    if n == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)]), lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(n)]))


def hit_filter(hits: DataFrame, key: str, buckets: int) -> DataFrame:
    """A filter of at most ``buckets`` bitmaps of 4 KB: rows ``(bucket, bits)``."""
    slot = F.pmod(F.xxhash64(key), F.lit(buckets * BITS))
    return hits.select(F.floor(slot / BITS).alias("bucket"), (slot % BITS).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hit(rows: DataFrame, bitmaps: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows whose key the filter has; a few others pass too."""
    slot = F.pmod(F.xxhash64(key), F.lit(buckets * BITS))
    bit = slot % BITS
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.floor(slot / BITS) == F.col("bucket")
    return rows.join(F.broadcast(bitmaps), on).where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1).select(*rows.columns)


def lookup(left: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join with ``table``, which has one row per ``key``; ``weight`` is how many rows of ``left`` have the key.

    Keys that hold over ``total / HOT_SHARE`` rows are fewer than ``HOT_SHARE``: that part of the table is
    broadcast, with this bound. The others join by shuffle, where no key has more than that share.
    Rows whose key is hot take part in the shuffle under a key of their own, spread evenly.
    """
    limit = max(1, total // HOT_SHARE)
    values = [c for c in table.columns if c != key]
    hot = table.where(F.col(weight) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot"))
    cold = table.where(F.col(weight) <= limit).select(F.col(key).alias("_ck"), F.struct(*values).alias("_cold"))
    joined = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    joined = joined.withColumn("_spread", F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    cold = cold.withColumn("_cspread", F.lit(-1).cast("long"))
    joined = joined.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_spread") == F.col("_cspread")), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*left.columns, *[found[c].alias(c) for c in values])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, root)`` where root is the component's smallest id.

    Distributed union-find in rounds: each node takes the least root among its neighbours (an aggregation
    with map-side combine, so a node of any degree is safe), roots are hooked to the least root offered to
    them, then pointers are halved. Each round is written to shared storage. Raises if ``max_rounds`` is
    not enough; rounds needed grow as the logarithm of the diameter.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    roots = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "roots")
    for _ in range(max_rounds):
        of_b = roots.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
        of_a = roots.select(F.col("id").alias("a"), F.col("root").alias("root_a"))
        offers = both.join(of_b, "b").join(of_a, "a").where("root_b < root_a")
        hooks = offers.select(F.col("a").alias("id"), "root_b").union(offers.select(F.col("root_a").alias("id"), "root_b"))
        hooks = hooks.groupBy("id").agg(F.min("root_b").alias("offer"))
        hooked = roots.join(hooks, "id", "left").select("id", F.least("root", F.coalesce("offer", "root")).alias("root"), F.col("offer").isNotNull().alias("moved"))
        hooked = materialise(hooked, "hooked")
        moved = not hooked.where("moved").limit(1).isEmpty()
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("up"))
        roots = materialise(hooked.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "roots")
        if not moved:
            up = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
            if roots.join(up, "root").where("up <> root").limit(1).isEmpty():
                return roots
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
