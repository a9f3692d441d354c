"""Concordances in files: three tables, tab-separated or Parquet, with their information, resources and tree."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..concordance import Concordance


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or a tab-separated one whose types are inferred."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True, quote='"', escape='"')


def first_rows(tokens: DataFrame) -> DataFrame:
    """``(line_id, first)``: the number of tokens in the lines before. One row per line."""
    sizes = tokens.groupBy("line_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("line_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def local_matches(matches: DataFrame, tokens: DataFrame) -> DataFrame:
    """Matches given by token rows, counted over all lines from 0, as places within their lines."""
    joined = matches.join(first_rows(tokens), "line_id")
    return joined.withColumn("match_start", F.col("match_start") - F.col("first")).withColumn("match_end", F.col("match_end") - F.col("first")).drop("first")


def global_matches(matches: DataFrame, tokens: DataFrame) -> DataFrame:
    joined = matches.join(first_rows(tokens), "line_id")
    return joined.withColumn("match_start", F.col("match_start") + F.col("first")).withColumn("match_end", F.col("match_end") + F.col("first")).drop("first")


def integer_keys(value: Any) -> Any:
    """JSON objects with keys that are whole numbers get them as numbers."""
    if isinstance(value, dict):
        return {int(k) if isinstance(k, str) and k.lstrip("-").isdigit() else k: integer_keys(v) for k, v in value.items()}
    return [integer_keys(v) for v in value] if isinstance(value, list) else value


def load(spark: SparkSession, metadata: str | DataFrame, tokens: str | DataFrame, matches: str | DataFrame, info: str | dict | None = None, match_rows: bool = True) -> Concordance:
    """Frames or paths; ``match_rows``: matches count token rows over all lines (else within the line)."""
    m, t, x = (read_table(spark, v) if isinstance(v, str) else v for v in (metadata, tokens, matches))
    for df, name in ((m, "metadata"), (t, "tokens"), (x, "matches")):
        if "line_id" not in df.columns:
            raise ValueError(f"{name} has no column line_id")
    if match_rows:
        x = local_matches(x, t)
    if isinstance(info, str):
        info = integer_keys(json.loads(Path(info).read_text(encoding="utf-8")))
    return Concordance(m, t.drop("offset"), x, info=dict(info or {}))


def load_folder(spark: SparkSession, path: str) -> Concordance:
    """What ``sinks.export`` wrote: the tables and the information; the tree is replayed from its template."""
    from ..tree import apply_template

    folder = Path(path)
    conc = load(spark, *(str(folder / f"{n}.tsv") for n in ("metadata", "tokens", "matches")), str(folder / "info.json"))
    types = folder / "metadata.field_types.tsv"
    if types.exists():
        kinds = dict(line.split("\t")[:2] for line in types.read_text().splitlines()[1:])
        for name, kind in kinds.items():
            if kind.startswith("numpy_array"):
                conc.metadata = conc.metadata.withColumn(name, F.from_json(F.col(f"`{name}`").cast("string"), "array<double>"))
    tree = folder / "tree.json"
    if tree.exists():
        apply_template(conc, json.loads(tree.read_text(encoding="utf-8")))
    return conc
