"""What needs all pairs of vectors, in bounded memory: each task holds the vectors once, as a broadcast, and a tile of
their distances at a time. The driver holds the vectors too, and a few numbers for each; no list of pairs is made."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Distances that a task holds at a time.
TILE = 1 << 22
#: Pairs up to which no job is worth its start.
ALONE = 1 << 24
#: Pairs as close as this to the radius are compared again by sums in the order of their elements, as SQL has them.
CLOSE = 1e-9


def collected(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``vectors(line_id, v)`` in the order of the ids; without rows of null. All are of one length."""
    table = vectors.where("v is not null").select("line_id", "v").toArrow()
    ids = table["line_id"].to_numpy().astype(np.int64)
    sizes = pc.unique(pc.list_value_length(table["v"])).to_pylist()
    if len(sizes) > 1:
        raise ValueError("vectors are of several lengths")
    flat = [pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in table["v"].chunks]
    order = np.argsort(ids, kind="stable")
    return ids[order], np.concatenate([np.zeros(0), *flat]).reshape(len(ids), *(sizes or [0]))[order]


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def frame(spark: SparkSession, schema: str, **columns: Any) -> DataFrame:
    return spark.createDataFrame(pa.table(columns), schema)


def in_tasks(spark: SparkSession, n: int, pairs: int, work: Callable[..., Any], *shared: Any) -> list[Any]:
    """``work(lo, hi, *shared)`` of ranges that cover ``n`` rows, as tasks if there are many ``pairs``."""
    if n == 0:
        return []
    if pairs <= ALONE:
        return [work(0, n, *shared)]
    sc = spark.sparkContext
    parts = min(n, 3 * sc.defaultParallelism)
    cuts = [n * k // parts for k in range(parts + 1)]
    sent = sc.broadcast(shared)
    try:
        return sc.parallelize(list(zip(cuts, cuts[1:])), parts).map(lambda r: work(*r, *sent.value)).collect()
    finally:
        sent.destroy()


def tiles(lo: int, hi: int, width: int):
    step = max(1, TILE // max(1, width))
    for a in range(lo, hi, step):
        yield a, min(hi, a + step)


def near(part: np.ndarray, v: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """Whether each row of ``part`` is within ``eps`` of each of ``v``; for cosine, both are of unit length or zero."""
    if metric == "cosine":
        d = 1 - part @ v.T
        slack = np.full(1, CLOSE)
    else:
        one, two = (part**2).sum(1)[:, None], (v**2).sum(1)[None]
        d = np.sqrt(np.maximum(0, one + two - 2 * part @ v.T))
        slack = CLOSE * (1 + one + two) / max(eps, CLOSE)
    out = d <= eps
    rows, cols = np.nonzero(np.abs(d - eps) <= slack)
    for k in range(0, len(rows), TILE // 64):
        x, y = part[rows[k : k + TILE // 64]], v[cols[k : k + TILE // 64]]
        total = np.zeros(len(x))
        for i in range(v.shape[1]):
            total += x[:, i] * y[:, i] if metric == "cosine" else (x[:, i] - y[:, i]) ** 2
        out[rows[k : k + TILE // 64], cols[k : k + TILE // 64]] = (1 - total if metric == "cosine" else np.sqrt(total)) <= eps
    return out


def count_near(lo: int, hi: int, v: np.ndarray, eps: float, metric: str) -> np.ndarray:
    return np.concatenate([near(v[a:b], v, eps, metric).sum(1) for a, b in tiles(lo, hi, len(v))])


def neighbours(spark: SparkSession, v: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """How many vectors, itself included, are within ``eps`` of each."""
    v = unit(v) if metric == "cosine" else v
    return np.concatenate([np.zeros(0, np.int64), *in_tasks(spark, len(v), len(v) ** 2, count_near, v, eps, metric)])


def linked(lo: int, hi: int, v: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """Which vectors the links of the rows ``lo`` to ``hi`` connect: equal numbers from 1, 0 where there is no link."""
    label = np.zeros(len(v), np.int32)
    to = [0]  # a label's next name

    def last(x: int) -> int:
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in tiles(lo, hi, len(v)):
        for row in near(v[a:b], v, eps, metric):
            at = np.flatnonzero(row)
            had = {last(x) for x in np.unique(label[at]).tolist() if x}
            if not had:
                had = {len(to)}
                to.append(len(to))
            one = min(had)
            for x in had:
                to[x] = one
            label[at[label[at] == 0]] = one
    return np.array([last(x) for x in range(len(to))], np.int32)[label]


def least_near(lo: int, hi: int, v: np.ndarray, core: np.ndarray, label: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """The least label of the near core vectors, -1 if there are none."""
    none = len(label)
    best = [np.where(near(v[a:b], core, eps, metric), label[None], none).min(1, initial=none) for a, b in tiles(lo, hi, len(core))]
    out = np.concatenate(best)
    return np.where(out == none, -1, out)


def density_clusters(spark: SparkSession, v: np.ndarray, eps: float, min_samples: int, metric: str) -> np.ndarray:
    """What ``cluster.dbscan`` gives, by three sweeps over the pairs: counts, links of core points, border points."""
    v = unit(v) if metric == "cosine" else v
    core = np.flatnonzero(np.concatenate(in_tasks(spark, len(v), len(v) ** 2, count_near, v, eps, metric)) >= min_samples)
    out = np.full(len(v), -1)
    if not len(core):
        return out
    inner = v[core]
    parent = list(range(len(core)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for label in in_tasks(spark, len(core), len(core) ** 2, linked, inner, eps, metric):
        at = np.flatnonzero(label)
        _, first, which = np.unique(label[at], return_index=True, return_inverse=True)
        for x, y in zip(at.tolist(), at[first][which].tolist()):
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
    group = np.array([top(x) for x in range(len(core))])
    out[core] = np.unique(group, return_inverse=True)[1]  # a component is named by its first core point
    rest = np.flatnonzero(out < 0)
    if len(rest):
        out[rest] = np.concatenate(in_tasks(spark, len(rest), len(rest) * len(core), least_near, v[rest], inner, out[core], eps, metric))
    return out


def nearest(lo: int, hi: int, rows: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ``rows``, the other row of ``v`` with the largest product, the first of equal ones, and the product."""
    at, value = np.empty(hi - lo, np.int64), np.empty(hi - lo)
    for a, b in tiles(lo, hi, len(v)):
        s = v[rows[a:b]] @ v.T
        s[np.arange(b - a), rows[a:b]] = -np.inf
        best = s.argmax(1)
        at[a - lo : b - lo], value[a - lo : b - lo] = best, s[np.arange(b - a), best]
    return at, value


def average_linkage(spark: SparkSession, vectors: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers by merging the closest pair (mean cosine distance) until ``k`` are left, by first member.

    The mean distance of two clusters is one minus the product of their mean unit vectors, so no matrix is kept. A
    merger never comes nearer to a third cluster than the nearer of the two was; so all pairs that are each other's
    nearest are merged at once, only clusters whose nearest was merged look for it anew, and the pairs merged below
    the height at which ``k`` are left are those that merging one at a time gives.
    """
    n = len(vectors)
    if n == 0:
        return np.zeros(0, np.int64)
    mean = unit(vectors)
    first = np.arange(n)  # of each live cluster, its least member
    size = np.ones(n)
    high = np.zeros(n)
    merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    _, same_first, same = np.unique(mean, axis=0, return_index=True, return_inverse=True)
    same = same_first[same.reshape(-1)]  # equal directions have distance 0 and merge first; zeros have distance 1
    same = np.where((mean != 0).any(1), same, np.arange(n))
    copies = np.flatnonzero(same != np.arange(n))
    if len(copies):
        merges.append((same[copies], copies, np.zeros(len(copies))))
        size = np.bincount(same, minlength=n).astype(float)
        keep = np.flatnonzero(same == np.arange(n))
        mean, first, size, high = mean[keep], keep, size[keep], high[keep]
    near_at, near_value = np.zeros(len(mean), np.int64), np.zeros(len(mean))
    dirty = np.arange(len(mean))
    while len(mean) > 1:
        found = in_tasks(spark, len(dirty), len(dirty) * len(mean), nearest, dirty, mean)
        near_at[dirty], near_value[dirty] = (np.concatenate(x) for x in zip(*found))
        i = np.arange(len(mean))
        mutual = np.flatnonzero((near_at[near_at] == i) & (i < near_at))
        best = int(near_value.argmax())
        pair = {best, int(near_at[best])}
        if not len(mutual):  # rounding told the two sides of a tie apart
            mutual = np.array([min(pair)])
            near_at[min(pair)] = max(pair)
        one, two = mutual, near_at[mutual]
        height = np.maximum(1 - near_value[one], np.maximum(high[one], high[two]))
        merges.append((first[one], first[two], height))
        total = size[one] + size[two]
        mean[one] = (mean[one] * size[one, None] + mean[two] * size[two, None]) / total[:, None]
        size[one], high[one], first[one] = total, height, np.minimum(first[one], first[two])
        merged = np.zeros(len(mean), bool)
        merged[one] = merged[two] = True
        again = merged | merged[near_at]
        alive = np.ones(len(mean), bool)
        alive[two] = False
        place = np.cumsum(alive) - 1
        near_at, near_value = place[near_at][alive], near_value[alive]
        mean, size, high, first, dirty = mean[alive], size[alive], high[alive], first[alive], np.flatnonzero(again[alive])
    label = np.arange(n)
    if merges:
        one, two, height = (np.concatenate(x) for x in zip(*merges))
        for m in np.argsort(height, kind="stable")[: n - max(1, min(k, n))].tolist():
            a, b = int(one[m]), int(two[m])
            while label[a] != a:
                label[a] = a = label[label[a]]
            while label[b] != b:
                label[b] = b = label[label[b]]
            label[max(a, b)] = min(a, b)
    for x in range(n):
        label[x] = label[label[x]]  # a cluster's name is less than its other members
    return np.unique(label, return_inverse=True)[1]


def grouped_work(spark: SparkSession, jobs: list[np.ndarray], pairs: int, work: Callable[[np.ndarray], Any], v: np.ndarray) -> list[Any]:
    """``work(v[rows])`` for each of many small sets of rows, several sets a task."""
    return [x for part in in_tasks(spark, len(jobs), pairs, partial(one_by_one, work), jobs, v) for x in part]


def one_by_one(work: Callable[[np.ndarray], Any], lo: int, hi: int, jobs: list[np.ndarray], v: np.ndarray) -> list[Any]:
    return [work(v[rows]) for rows in jobs[lo:hi]]
