"""Clustering: trees of groups of lines."""

from __future__ import annotations

import hashlib
import random
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..concordance import View
from ..functions.ranking import globally
from ..registry import algorithm, token_attributes, vector_columns
from . import pairs
from .grouping import Grouping
from .select import FLAG

SEP = "\u0001"


@algorithm(
    "Context Tree Clustering", "clustering", enrich={"tokens_attribute": token_attributes}, tokens_attribute={"type": "string", "default": "word"}, offset={"type": "integer", "default": 1},
    direction={"type": "string", "enum": ["right", "left"], "default": "right"}, case_sensitive=FLAG, min_cluster_size={"type": "integer", "minimum": 1, "default": 2}, max_depth={"type": "integer", "minimum": 1, "default": 10},
)
def cluster_context_tree(view: View, tokens_attribute: str = "word", offset: int = 1, direction: str = "right", case_sensitive: bool = False, min_cluster_size: int = 2, max_depth: int = 10) -> Grouping:
    """The prefix tree of the words from an offset outwards.

    No recursion: the clusters are the prefixes, shorter than ``max_depth``, that at least ``min_cluster_size``
    lines share; each line is counted under all its prefixes in one aggregation.
    """
    sign = 1 if direction == "right" else -1
    start = sign * abs(offset)
    step = lambda t: (t["offset"] - start) * sign
    word = lambda t: t[tokens_attribute].cast("string") if case_sensitive else F.lower(t[tokens_attribute].cast("string"))
    used = F.transform(F.filter("toks", lambda t: (step(t) >= 0) & (step(t) < max_depth)), lambda t: F.struct(step(t).alias("k"), word(t).alias("v")))
    near = view.by_line(tokens_attribute).select("line_id", used.alias("used"))
    steps = F.array(*[F.array_join(F.transform(F.filter("used", lambda t: t["k"] == k), lambda t: t["v"]), " ") for k in range(max_depth)])  # noqa: B023
    paths = near.select("line_id", steps.alias("path"))
    under = paths.select("line_id", "path", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("depth"))
    under = under.select("line_id", "depth", F.array_join(F.slice("path", 1, F.col("depth") + 1), SEP).alias("next"), F.length(F.col("path")[F.col("depth")]).alias("size"))
    # what lines share is counted once; lines themselves travel once, to the node and word that they are under
    tokens = under.groupBy("depth", "next", "size").agg(F.count("*").alias("k"))
    key = F.when(F.col("depth") > 0, F.substring("next", F.lit(1), F.length("next") - F.col("size") - 1)).otherwise("")
    tokens = tokens.select("*", key.alias("key"), F.right("next", F.col("size")).alias("token")).persist()
    nodes = tokens.groupBy("depth", "key").agg(F.sum("k").alias("n"), F.max("k").alias("top")).where((F.col("depth") == 0) | (F.col("n") >= min_cluster_size)).persist()
    # pre-order: a node sorts by the (size desc, token) of every step of its path
    parts = F.split("key", SEP)
    steps_of = nodes.where("depth > 0").select("depth", "key", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.array_join(F.slice(parts, 1, d), SEP))).alias("i", "prefix"))
    sizes = nodes.select(F.col("key").alias("prefix"), F.col("depth").alias("pd"), F.col("n").alias("size"))
    order = steps_of.join(sizes, (steps_of["prefix"] == sizes["prefix"]) & (steps_of["i"] + 1 == sizes["pd"]))
    order = order.select("depth", "key", "i", F.struct((-F.col("size")).alias("s"), F.element_at(F.split("key", SEP), F.col("i") + 1).alias("t")).alias("o"))
    order = order.groupBy("depth", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: x["o"]).alias("path_order"))
    tree = nodes.join(order, ["depth", "key"], "left").withColumn("path_order", F.coalesce("path_order", F.array().cast("array<struct<s:bigint,t:string>>")))
    tree = globally(tree, [F.col("path_order")], "id", rank=False)
    parent = tree.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("pkey"), F.col("id").alias("parent_id"))
    tree = tree.withColumn("pkey", F.when(F.col("depth") > 0, F.array_join(F.slice(F.split("key", SEP), 1, F.col("depth") - 1), SEP)))
    tree = tree.join(parent, ["depth", "pkey"], "left")
    groups = tree.select("id", "parent_id", (F.col("depth") + 1).alias("level"), F.when(F.col("depth") == 0, "root").otherwise(F.replace("key", F.lit(SEP), F.lit(" "))).alias("label"), F.col("id").alias("ord"), F.col("n").alias("size"))
    grown = tree.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("key").alias("next"), F.lit(True).alias("grown"))
    words = tokens.join(tree.select("depth", "key", "top", "id"), ["depth", "key"]).join(grown, ["depth", "next"], "left")
    words = words.select("depth", "next", "size", "id", "token", (F.col("k") / F.col("top")).alias("prototypicality"), F.col("grown").isNull().alias("own"))
    members = under.join(words, ["depth", "next", "size"])
    pos = F.row_number().over(Window.partitionBy("id").orderBy("token", "line_id")).cast("long")
    return Grouping("cluster", groups, members.select("id", "line_id", pos.alias("pos"), "prototypicality", "own"))


def core_points(vectors: DataFrame, eps: float, min_samples: int, metric: str = "cosine") -> DataFrame:
    """``(line_id, n)`` of vectors ``(line_id, v)`` with at least ``min_samples`` neighbours within ``eps``, themselves included.

    Vectors with a null element, and those of different lengths, are no neighbours.
    """
    spark = vectors.sparkSession
    whole = vectors.where("v is not null and not exists(v, x -> x is null)")
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in sorted(r[0] for r in whole.select(F.size("v")).distinct().collect()):
        some, v = pairs.collected(whole.where(F.size("v") == size))
        ids.append(some)
        counts.append(pairs.neighbours(spark, v, eps, metric))
    ids, which = np.unique(np.concatenate(ids), return_inverse=True)
    n = np.bincount(which, np.concatenate(counts), len(ids)).astype(np.int64)
    return pairs.frame(spark, "line_id long, n long", line_id=ids[n >= min_samples], n=n[n >= min_samples])


def dbscan(v: np.ndarray, eps: float, min_samples: int, metric: str, block: int = 2048) -> np.ndarray:
    """Cluster numbers in the order of their first core point, -1 for noise; a border point goes to its smallest cluster."""
    n = len(v)
    if metric == "cosine":
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(norm == 0, 1, norm)
    near: list[np.ndarray] = []
    for lo in range(0, n, block):
        part = v[lo : lo + block]
        d = 1 - part @ v.T if metric == "cosine" else np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * part @ v.T))
        near += [np.flatnonzero(row <= eps) for row in d]
    core = np.array([len(x) >= min_samples for x in near], bool)
    label = np.full(n, -1)
    c = 0
    for i in range(n):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = c
            while stack:
                new = near[stack.pop()]
                new = new[label[new] < 0]
                label[new] = c
                stack += new[core[new]].tolist()
            c += 1
    return label


#: Lines of a cluster up to which one task splits it; it lists their neighbours.
ONE_TASK = 4096


def prototypicalities(v: np.ndarray) -> np.ndarray:
    d = np.linalg.norm(v - v.mean(0), axis=1)
    return 1 - d / d.max() if d.max() > 0 else np.ones(len(v))


def split(spark, v: np.ndarray, clusters: list[np.ndarray], radius: float, min_samples: int, metric: str) -> list[np.ndarray]:
    """The child that each line of each cluster goes to (-2: none); small clusters are split several in a task, large ones each by many."""
    need = [max(min_samples, min(len(rows) // 4, 3)) for rows in clusters]
    out = [np.full(len(rows), -2) for rows in clusters]
    splits = [c for c, rows in enumerate(clusters) if len(rows) > 1 and len(rows) >= need[c]]
    for n in sorted({need[c] for c in splits}):
        small = [c for c in splits if need[c] == n and len(clusters[c]) <= ONE_TASK]
        todo = [clusters[c] for c in small]
        found = pairs.grouped_work(spark, todo, sum(len(rows) ** 2 for rows in todo), partial(dbscan, eps=radius, min_samples=n, metric=metric), v)
        large = [c for c in splits if need[c] == n and len(clusters[c]) > ONE_TASK]
        found += [pairs.density_clusters(spark, v[clusters[c]], radius, n, metric) for c in large]
        for c, label in zip(small + large, found):
            out[c] = label if label.max() >= 0 else out[c]
    return out


@algorithm(
    "Hierarchical Clustering by Embeddings", "clustering", applies=lambda v: bool(vector_columns(v)), enrich={"embeddings_column": lambda v: {"enum": vector_columns(v)}}, embeddings_column={"type": "string", "required": True},
    depth={"type": "integer", "minimum": 1, "default": 3}, eps={"type": "number", "default": 0.5}, min_samples={"type": "integer", "minimum": 1, "default": 2}, metric={"type": "string", "default": "cosine"},
)
def clustering_hierarchical_embeddings(view: View, embeddings_column: str, depth: int = 3, eps: float = 0.5, min_samples: int = 2, metric: str = "cosine") -> Grouping:
    """Density clusters within density clusters, the radius shrinking by a fifth a level. Noise is a child of its own, the last.

    One level at a time, all of its clusters in parallel. The driver holds the vectors, tasks compare them in tiles.
    """
    spark = view.metadata.sparkSession
    ids, v = pairs.collected(view.metadata.select("line_id", F.col(embeddings_column).cast("array<double>").alias("v")))
    groups, pictures = [(1, None, 1, "root", 1)], {}
    members: dict[str, list[np.ndarray]] = {"id": [], "line_id": [], "prototypicality": [], "own": []}
    live = [(1, "root", np.arange(len(ids)))] if len(ids) else []
    for level in range(1, depth + 1):
        rows = [r for _, _, r in live]
        labels = split(spark, v, rows, eps * 0.8 ** (level - 1), min_samples, metric) if level < depth else [np.full(len(r), -2) for r in rows]
        down = []
        for (gid, name, r), label in zip(live, labels):
            proto = prototypicalities(v[r])
            pictures[gid] = ids[r[np.lexsort((r, -proto))[:2]]].tolist()
            for column, values in (("id", np.full(len(r), gid)), ("line_id", ids[r]), ("prototypicality", proto), ("own", label == -2)):
                members[column].append(values)
            order = np.argsort(label, kind="stable")
            kinds, start = np.unique(label[order], return_index=True)
            parts = dict(zip(kinds.tolist(), np.split(order, start[1:])))
            for child in sorted((x for x in parts if x != -2), key=lambda x: (x < 0, x)):
                groups.append((len(groups) + 1, gid, level + 1, f"{'' if name == 'root' else name + '.'}{'noise' if child < 0 else child}", len(groups) + 1))
                down.append((len(groups), groups[-1][3], r[parts[child]]))
        live = down
    all_of = {k: np.concatenate([np.zeros(0, {"own": bool, "prototypicality": float}.get(k, np.int64)), *x]) for k, x in members.items()}
    frame = pairs.frame(spark, "id long, line_id long, pos long, prototypicality double, own boolean", **{k: all_of[c] for k, c in (("id", "id"), ("line_id", "line_id"), ("pos", "line_id"), ("prototypicality", "prototypicality"), ("own", "own"))})
    return Grouping("cluster", spark.createDataFrame(groups, "id long, parent_id long, level int, label string, ord long"), frame, pictures)


@algorithm(
    "Random Hierarchical Clustering", "clustering", seed={"type": "integer", "default": 42}, depth={"type": "integer", "minimum": 1, "default": 3}, min_split={"type": "integer", "minimum": 1, "default": 2},
    max_split={"type": "integer", "minimum": 1, "default": 4}, min_stray_lines={"type": "integer", "minimum": 0, "default": 0}, max_stray_lines={"type": "integer", "minimum": 0, "default": 3},
)
def clustering_random(view: View, seed: int = 42, depth: int = 3, min_split: int = 2, max_split: int = 4, min_stray_lines: int = 0, max_stray_lines: int = 3) -> Grouping:
    """A random tree, for trying out displays; lines are first put in the order of an md5 of seed and id. One sequence of
    random numbers makes it, on the driver, which holds the ids and a number for each line and level."""
    spark = view.metadata.sparkSession
    ids = view.lines.toArrow()["line_id"].to_pylist()
    ids.sort(key=lambda x: hashlib.md5(f"{seed}_{x}".encode()).hexdigest())
    rng = random.Random(seed)
    groups, pictures = [], {}
    members: dict[str, list[np.ndarray]] = {"id": [], "line_id": [], "pos": [], "prototypicality": [], "own": []}

    def grow(lines: list[int], level: int, parent: int | None, label: str) -> None:
        me = len(groups) + 1
        groups.append((me, parent, level, label, me))
        pictures[me] = lines[:5]
        proto = np.array([rng.random() for _ in lines], float)
        stray = min(rng.randint(min_stray_lines, max(min_stray_lines, max_stray_lines)), len(lines)) if level < depth else len(lines)
        rest = lines[stray:]
        parts = min(rng.randint(min_split, max(min_split, max_split)), len(rest)) if rest else 0
        rng.shuffle(rest)
        place = np.arange(len(lines))
        for column, values in (("id", np.full(len(lines), me)), ("line_id", np.array(lines, np.int64)), ("pos", place), ("prototypicality", proto), ("own", place < stray)):
            members[column].append(values)
        for k in range(parts):
            grow(rest[k::parts], level + 1, me, f"{label}.{k + 1}")

    grow(ids, 1, None, "C")
    frame = pairs.frame(spark, "id long, line_id long, pos long, prototypicality double, own boolean", **{k: np.concatenate(x) for k, x in members.items()})
    return Grouping("cluster", spark.createDataFrame(groups, "id long, parent_id long, level int, label string, ord long"), frame, pictures)
