"""Labelling: new names for groups. Each returns a frame ``(id, new_label)``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..concordance import View, within
from ..functions.stats import conservative_log_ratio
from ..registry import algorithm, token_attributes
from .grouping import Grouping
from .rank import WINDOW


def keyword_counts(view: View, grouping: Grouping, tokens_attribute: str = "word", window_start: int = -5, window_end: int = 5, whitelist: dict | None = None, blacklist: dict | None = None) -> DataFrame:
    """``(id, word, f1, f2, n1, n2)``: a word's frequency in a group and in all its sister groups, and their sizes, in windows without nodes."""
    def keep(name: Callable[[str], Column]) -> Column:
        cond = within(window_start, window_end, node=False)(name) & name(tokens_attribute).isNotNull()
        for attr, values in (whitelist or {}).items():
            cond = cond & name(attr).isin(list(values))
        for attr, values in (blacklist or {}).items():
            cond = cond & ~F.coalesce(name(attr).isin(list(values)), F.lit(False))
        return cond

    sisters = grouping.groups.select("id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))
    kept = F.transform(F.filter("toks", lambda t: keep(lambda name: t[name])), lambda t: F.lower(t[tokens_attribute].cast("string")))
    lines = view.by_line(tokens_attribute, *(whitelist or {}), *(blacklist or {})).join(grouping.members.select("id", "line_id"), "line_id")
    words = lines.select("id", F.explode(kept).alias("word")).groupBy("id", "word").agg(F.count("*").alias("f1"))
    counted = words.join(sisters, "id").select("parent_id", "id", "word", "f1").persist()
    total = Window.partitionBy("parent_id", "word")
    sizes = counted.groupBy("parent_id", "id").agg(F.sum("f1").alias("n1"))
    every = sizes.groupBy("parent_id").agg(F.sum("n1").alias("all"))
    counted = counted.withColumn("f2", F.sum("f1").over(total) - F.col("f1")).join(sizes, ["parent_id", "id"]).join(every, "parent_id")
    return counted.select("id", "word", "f1", "f2", "n1", (F.col("all") - F.col("n1")).alias("n2"))


@F.pandas_udf(DoubleType())
def lrc(f1: pd.Series, f2: pd.Series, n1: pd.Series, n2: pd.Series, alpha: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for key in zip(f1, f2, n1, n2, alpha):
        if key not in seen:
            seen[key] = conservative_log_ratio(*key)
        out.append(seen[key])
    return pd.Series(out, dtype="float64")


@algorithm(
    "LRC Keyword Labels", "labelling", enrich={"tokens_attribute": token_attributes}, max_keywords={"type": "integer", "minimum": 1, "default": 5}, lrc_cutoff={"type": "number", "minimum": 0, "default": 0.0},
    include_negative={"type": "boolean", "default": False}, whitelist={"type": "object", "default": {}}, blacklist={"type": "object", "default": {}}, window_start=WINDOW | {"default": -5}, window_end=WINDOW | {"default": 5},
    tokens_attribute={"type": "string", "default": "word"}, alpha={"type": "number", "default": 0.05},
)
def label_lrc_keywords(view: View, grouping: Grouping, max_keywords: int = 5, lrc_cutoff: float = 0.0, include_negative: bool = False, whitelist: dict | None = None, blacklist: dict | None = None, window_start: int = -5, window_end: int = 5, tokens_attribute: str = "word", alpha: float = 0.05) -> DataFrame:
    """The words that most set a group apart from its sisters, by the conservative log ratio; ties by word."""
    counts = keyword_counts(view, grouping, tokens_attribute, window_start, window_end, whitelist, blacklist)
    scored = counts.withColumn("lrc", lrc("f1", "f2", "n1", "n2", F.lit(float(alpha)))).where((F.abs("lrc") >= lrc_cutoff) & (F.col("lrc") != 0))
    if not include_negative:
        scored = scored.where("lrc > 0")
    sign = F.when(F.col("lrc") > 0, "+").otherwise("-")
    best = scored.withColumn("sign", sign).withColumn("r", F.row_number().over(Window.partitionBy("id", "sign").orderBy(F.desc(F.abs("lrc")), "word"))).where(F.col("r") <= max_keywords)
    named = best.groupBy("id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sign") == s, F.struct("r", "word")))), lambda x: x["word"]), " ").alias(n) for s, n in (("+", "pos"), ("-", "neg"))])
    number = F.regexp_extract("label", r"(\d+)$", 1)
    words = F.when(F.coalesce("pos", F.lit("")) == "", "no keywords").otherwise(F.col("pos"))
    words = F.when(F.coalesce("neg", F.lit("")) != "", F.concat(words, F.lit(" (not: "), F.col("neg"), F.lit(")"))).otherwise(words)
    out = grouping.groups.join(named, "id", "left")
    return out.select("id", F.concat(F.when(number != "", number).otherwise(F.col("id").cast("string")), F.lit(" ("), words, F.lit(")")).alias("new_label"))


@algorithm("Sequential Letter Labels", "labelling", start_letter={"type": "string", "default": "A"})
def label_sequential_letters(view: View, grouping: Grouping, start_letter: str = "A") -> DataFrame:
    """A, B, C, ... in the order of the groups."""
    place = F.row_number().over(Window.orderBy("ord"))
    return grouping.groups.select("id", F.call_function("chr", (F.lit(ord(start_letter)) + place - 1).cast("long")).alias("new_label"))
