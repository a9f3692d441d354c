"""Partitioning: flat groups of lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..concordance import View
from ..registry import algorithm, metadata_attributes, token_attributes, vector_columns
from . import pairs
from .grouping import Grouping
from .select import FLAG

#: Lines beyond which a clustering that needs a matrix of all pairs is refused.
MAX_LINES = 100_000


def partitions(keyed: DataFrame, order: list, label: str = "label") -> Grouping:
    """Groups of ``keyed(line_id, label)``, numbered from 0 in an order of ``(label, n)``. There are as many rows as labels."""
    groups = keyed.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    groups = groups.withColumn("id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    members = keyed.select("line_id", F.col(label).alias("label")).join(groups.select("label", "id"), "label")
    groups = groups.select("id", F.lit(None).cast("long").alias("parent_id"), F.lit(1).alias("level"), "label", F.col("id").alias("ord"))
    members = members.select("id", "line_id", F.col("line_id").cast("long").alias("pos"), F.lit(1.0).alias("prototypicality"), F.lit(True).alias("own"))
    return Grouping("partitions", groups, members)


@algorithm(
    "Partition by Metadata Attribute", "partitioning", enrich={"metadata_attribute": metadata_attributes}, metadata_attribute={"type": "string", "required": True},
    sort_by_partition_size={"type": "boolean", "default": True}, sorted_values={"type": "array"},
)
def partition_by_metadata_attribute(view: View, metadata_attribute: str, sort_by_partition_size: bool = True, sorted_values: list | None = None) -> Grouping:
    """By the value as text: the largest first, ties by value; or in a given order, other values left out."""
    keyed = view.metadata.select("line_id", F.col(f"`{metadata_attribute}`").cast("string").alias("label")).where("label is not null")
    if sort_by_partition_size:
        return partitions(keyed, [F.desc("n"), "label"])
    if sorted_values is None:
        raise ValueError("sorted_values is needed without sort_by_partition_size")
    values = [str(v) for v in sorted_values]
    keyed = keyed.where(F.col("label").isin(values))
    return partitions(keyed, [F.array_position(F.array(*map(F.lit, values)), F.col("label"))])


def tuple_repr(words: list[str]) -> str:
    return repr(tuple(words))


@algorithm("Partition by Ngrams", "partitioning", enrich={"tokens_attribute": token_attributes}, positions={"type": "array", "items": {"type": "integer"}, "required": True}, tokens_attribute={"type": "string", "default": "word"}, case_sensitive=FLAG)
def partition_ngrams(view: View, positions: list[int], tokens_attribute: str = "word", case_sensitive: bool = False) -> Grouping:
    """By the words at some offsets, in token order; a line without any is in no group. Labels are written as tuples."""
    word = F.col(tokens_attribute).cast("string")
    items = F.array_sort(F.collect_list(F.struct("id_in_line", (word if case_sensitive else F.lower(word)).alias("v"))))
    grams = view.tokens.where(F.col("offset").isin(list(positions))).groupBy("line_id").agg(F.transform(items, lambda x: x["v"]).alias("gram"))
    quote = F.transform("gram", lambda w: F.when(w.contains("'") & ~w.contains('"'), F.concat(F.lit('"'), F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))))
    label = F.concat(F.lit("("), F.array_join(quote, ", "), F.when(F.size("gram") == 1, ",").otherwise(""), F.lit(")"))
    return partitions(grams.select("line_id", label.alias("label")), [F.desc("n"), "label"])


def agglomerate(vectors: np.ndarray, k: int, linkage: str = "average") -> np.ndarray:
    """Cluster numbers by merging the closest pair (cosine) until ``k`` are left; distances follow Lance and Williams."""
    n = len(vectors)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm == 0, 1, norm)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - max(1, min(k, n))):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        if linkage == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            new = np.maximum(d[i], d[j]) if linkage == "complete" else np.minimum(d[i], d[j])
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


@algorithm(
    "Flat Clustering by Embeddings", "partitioning", applies=lambda v: bool(vector_columns(v)), enrich={"embeddings_column": lambda v: {"enum": vector_columns(v)}}, embeddings_column={"type": "string", "required": True},
    n_partitions={"type": "integer", "minimum": 1, "default": 5}, metric={"type": "string", "default": "cosine"}, linkage={"type": "string", "enum": ["average", "complete", "single"], "default": "average"},
    method={"type": "string", "enum": ["kmeans", "agglomerative"], "default": "kmeans"},
)
def partition_by_embeddings(view: View, embeddings_column: str, n_partitions: int = 5, metric: str = "cosine", linkage: str = "average", method: str = "kmeans") -> Grouping:
    """k-means, distributed; or agglomeration: by mean distances in sweeps over all pairs, by others with a matrix of at most ``MAX_LINES`` lines."""
    vectors = view.metadata.select("line_id", F.col(embeddings_column).cast("array<double>").alias("v")).where("v is not null")
    if method == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        data = vectors.select("line_id", array_to_vector("v").alias("features"))
        keyed = KMeans(k=n_partitions, seed=42, maxIter=50).fit(data).transform(data).select("line_id", F.col("prediction").cast("long").alias("c"))
    elif linkage == "average":
        ids, v = pairs.collected(vectors)
        keyed = pairs.frame(vectors.sparkSession, "line_id long, c long", line_id=ids, c=pairs.average_linkage(vectors.sparkSession, v, n_partitions))
    else:
        if vectors.limit(MAX_LINES + 1).count() > MAX_LINES:
            raise ValueError(f"agglomeration takes at most {MAX_LINES} lines")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("line_id")
            return pd.DataFrame({"line_id": pdf["line_id"], "c": agglomerate(np.stack(pdf["v"].to_list()), n_partitions, linkage)})

        keyed = vectors.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "line_id long, c long")
    keyed = keyed.select("line_id", F.concat(F.lit("Cluster_"), F.col("c")).alias("label"))
    return partitions(keyed, [F.substring_index("label", "_", -1).cast("long")])
