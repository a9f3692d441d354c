"""Global ranks without one task holding all rows.

Up to ``ONE_TASK`` rows, one ordered window does. Beyond, rows are cut into ranges of the sort key at bounds
taken from a sample of it, ranked within their range in parallel, and shifted by the sizes of the ranges
before; bounds are literals, ordered by Spark as the rows are (nulls and collations alike), and found by
bisection. A repeated task gives the same ranks. Equal keys never straddle a bound.

What is ranked is stored, as it is read for its size, a sample, the ranges' sizes and the ranks: ranks of ranks would
else make it anew for each of these at every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE_TASK = 1_000_000
RANGE_ROWS = 250_000
SAMPLED = 20_000


def globally(df: DataFrame, keys: list[Column], name: str, rank: bool = True, one_task: int = ONE_TASK) -> DataFrame:
    """``df`` with column ``name``: the competition rank (1, 1, 3) by ``keys``, or the row number if not ``rank``."""
    fn = F.rank if rank else F.row_number
    df = df.persist()
    ranged = in_ranges(df, keys, one_task)
    if ranged is None:
        return df.withColumn(name, fn().over(Window.orderBy(*keys)).cast("long"))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # at most n / RANGE_ROWS rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = ranged.withColumn(name, fn().over(Window.partitionBy("_range").orderBy(*keys)).cast("long"))
    return inner.join(sizes, "_range").withColumn(name, F.col(name) + F.col("_skip")).drop("_range", "_skip")


def cumulated(df: DataFrame, keys: list[Column], sums: dict[str, str], one_task: int = ONE_TASK) -> DataFrame:
    """``df`` with further columns: for each name in ``sums``, the sum of a column of numbers over the rows before, by different ``keys``."""
    df = df.persist()
    ranged = in_ranges(df, keys, one_task)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0)).cast("long")
    if ranged is None:
        return df.withColumns({name: summed(c, Window.orderBy(*keys)) for name, c in sums.items()})
    skip = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_skip_{name}") for name, c in sums.items()])
    skip = skip.select("_range", *[summed(f"_skip_{name}", Window.orderBy("_range")).alias(f"_skip_{name}") for name in sums])
    inner = ranged.withColumns({name: summed(c, Window.partitionBy("_range").orderBy(*keys)) for name, c in sums.items()})
    return inner.join(skip, "_range").withColumns({name: F.col(name) + F.col(f"_skip_{name}") for name in sums}).drop("_range", *[f"_skip_{name}" for name in sums])


def in_ranges(df: DataFrame, keys: list[Column], one_task: int) -> DataFrame | None:
    """``df`` with ``_range``, numbers of ranges of the key; nothing if it has at most ``one_task`` rows."""
    n = df.limit(one_task + 1).count()
    if n <= one_task:
        return None
    n = df.count()
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    sample = df.select(key.alias("k")).sample(min(1.0, SAMPLED / n), seed=5).limit(4 * SAMPLED)
    sample = [r["k"] for r in sample.coalesce(1).sortWithinPartitions("k").collect()]
    cuts = max(1, min(len(sample), n // RANGE_ROWS))
    bounds = [sample[len(sample) * i // cuts] for i in range(1, cuts)]
    kinds = [f.dataType for f in df.select(key.alias("k")).schema["k"].dataType.fields]
    literals = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, kinds))]) for b in bounds]
    return df.withColumn("_range", bisected(literals, key, 0))


def bisected(bounds: list[Column], key: Column, skip: int) -> Column:
    """How many of the ordered ``bounds`` are less than ``key``, by as many comparisons as their logarithm."""
    if not bounds:
        return F.lit(skip)
    half = len(bounds) // 2
    return F.when(bounds[half] < key, bisected(bounds[half + 1 :], key, skip + half + 1)).otherwise(bisected(bounds[:half], key, skip))
