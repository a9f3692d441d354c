"""Selecting: algorithms that keep some lines. Each returns ``(lines, spans)``: a frame of line ids, and token spans or None."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..concordance import View
from ..functions.ranking import globally
from ..functions.regexes import search
from ..registry import algorithm, metadata_attributes, numeric_token_attributes, token_attributes

FLAG = {"type": "boolean", "default": False}
COMPARE = {"type": "string", "enum": ["==", "<", "<=", ">", ">="], "default": "=="}


def compare(a: Column, op: str, b: Any) -> Column:
    return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def negated(cond: Column, negative: bool) -> Column:
    cond = F.coalesce(cond, F.lit(False))
    return ~cond if negative else cond


def strict_double(col: Column) -> Column:
    """As a number; a value that is none is an error, null stays null."""
    number = col.cast("string").try_cast("double")
    return F.when(col.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), col.cast("string")))).otherwise(number)


@algorithm(
    "Select by Metadata Attribute", "selecting", enrich={"metadata_attribute": metadata_attributes}, metadata_attribute={"type": "string", "required": True},
    value={"type": ["string", "number", "array"], "required": True}, operator=COMPARE, regex=FLAG, case_sensitive=FLAG, negative=FLAG,
)
def select_by_metadata_attribute(view: View, metadata_attribute: str, value: Any, operator: str = "==", regex: bool = False, case_sensitive: bool = False, negative: bool = False):
    """Lines whose attribute is in a list, compares with a number, equals a string or has a match of a regular expression."""
    col = F.col(f"`{metadata_attribute}`")
    text = col.cast("string")
    fold = (lambda c: c) if case_sensitive else F.lower
    if isinstance(value, (list, tuple)):
        if value and all(map(is_number, value)):
            cond = strict_double(col).isin([float(x) for x in value])
        else:
            cond = fold(text).isin([str(x) if case_sensitive else str(x).lower() for x in value]) if value else F.lit(False)
    elif is_number(value):
        cond = compare(strict_double(col), operator, float(value))
    elif regex:
        cond = search(text, value, not case_sensitive)
    else:
        cond = fold(text) == (value if case_sensitive else value.lower())
    return view.metadata.where(negated(cond, negative)).select("line_id"), None


def spans_at(view: View, lines: DataFrame, offset: int, attribute: str, category: str = "A") -> DataFrame:
    """One span per line over its tokens at the offset."""
    at = view.tokens.where(F.col("offset") == offset).join(lines, "line_id", "left_semi")
    return spans_of(at, attribute, category)


def spans_of(tokens: DataFrame, attribute: str, category: str) -> DataFrame:
    values = F.transform(F.array_sort(F.collect_list(F.struct("id_in_line", F.col(attribute).cast("string").alias("v")))), lambda x: x["v"])
    out = tokens.groupBy("line_id").agg(F.min("id_in_line").alias("start_id_in_line"), F.max("id_in_line").alias("end_id_in_line"), values.alias("values"))
    return out.select("line_id", "start_id_in_line", "end_id_in_line", F.lit(category).alias("category"), F.lit(1.0).alias("weight"), F.lit(attribute).alias("tokens_attribute"), "values")


@algorithm(
    "Select by Token-Level Numeric Attribute", "selecting", applies=lambda v: bool(numeric_token_attributes(v)["enum"]), enrich={"tokens_attribute": numeric_token_attributes},
    value={"type": ["number", "array"], "required": True, "default": 0}, tokens_attribute={"type": "string", "required": True}, offset={"type": "integer", "default": 0},
    comparison_operator=COMPARE, negative=FLAG,
)
def select_by_token_numeric_value(view: View, value: Any, tokens_attribute: str, offset: int = 0, comparison_operator: str = "==", negative: bool = False):
    """Lines by the number at an offset; missing or unreadable values match nothing."""
    number = F.col("value").try_cast("double")
    values = view.value_at(tokens_attribute, offset)
    cond = number.isin([float(x) for x in value]) if isinstance(value, (list, tuple)) else compare(number, comparison_operator, float(value))
    lines = values.where(negated(cond, negative)).select("line_id")
    return lines, spans_at(view, lines, offset, tokens_attribute)


@algorithm(
    "Select by Token-Level String Attribute", "selecting", enrich={"tokens_attribute": token_attributes}, search_terms={"type": "array", "items": {"type": "string"}, "required": True, "default": []},
    tokens_attribute={"type": "string", "default": "word"}, offset={"type": "integer", "default": 0}, case_sensitive=FLAG, regex=FLAG, negative=FLAG,
)
def select_by_token_string(view: View, search_terms: list[str], tokens_attribute: str = "word", offset: int = 0, case_sensitive: bool = False, regex: bool = False, negative: bool = False):
    """Lines whose token at an offset equals a term, or has a match of one; several tokens are joined by blanks."""
    values = view.value_at(tokens_attribute, offset)
    if regex:
        cond = search(F.col("value"), "|".join(search_terms), not case_sensitive)
    elif search_terms:
        cond = (F.col("value") if case_sensitive else F.lower("value")).isin([t if case_sensitive else t.lower() for t in search_terms])
    else:
        cond = F.lit(False)
    lines = values.where(negated(cond, negative)).select("line_id")
    return lines, spans_at(view, lines, offset, tokens_attribute)


@algorithm("Manual Line Selection", "selecting", line_ids={"type": "array", "items": {"type": "integer"}}, groups={"type": "array", "items": {"type": ["integer", "string"]}})
def select_manual(view: View, line_ids: list[int] | None = None, groups: list[int | str] | None = None):
    """Named lines, and the lines of groups (by number or label, with their subgroups) of the active node."""
    spark = view.metadata.sparkSession
    lines = spark.createDataFrame([(int(x),) for x in line_ids or []], "line_id long")
    grouping = getattr(view.node, "grouping", None) if view.node is not None else None
    if groups:
        if grouping is None:
            raise ValueError("the node has no groups")
        lines = lines.union(grouping.lines_of(groups))
    return view.lines.join(lines.distinct(), "line_id", "left_semi"), None


@algorithm("Random Sample", "selecting", enrich={"sample_size": lambda v: {"maximum": v.metadata.count()}}, sample_size={"type": "integer", "minimum": 1, "required": True}, seed={"type": "integer", "default": 42})
def select_random(view: View, sample_size: int, seed: int = 42):
    """A sample without replacement, in line order: places are drawn from the number of lines alone, so no data reach the driver."""
    n = view.metadata.count()
    places = sorted(random.Random(seed).sample(range(n), min(sample_size, n)))
    chosen = view.metadata.sparkSession.createDataFrame([(p + 1,) for p in places], "_place long")
    placed = globally(view.lines, [F.col("line_id")], "_place", rank=False)
    return placed.join(chosen, "_place", "left_semi").select("line_id"), None


@algorithm("Select by Rank", "selecting", status="experimental", ranking_column={"type": "string"}, comparison_operator=COMPARE, value={"type": "number", "default": 0})
def select_by_rank(view: View, ranking_column: str | None = None, comparison_operator: str = "==", value: float = 0):
    """Lines by the raw score of a ranking of the active node (``"0: name"``; the first by default)."""
    ranks = getattr(view.node, "rank_keys", {}) if view.node is not None else {}
    if not ranks:
        raise ValueError("the node has no ranking")
    key = int(ranking_column.split(":")[0]) if ranking_column else min(ranks)
    return ranks[key].where(compare(F.col("key"), comparison_operator, value)).select("line_id"), None


@algorithm("Select Slot", "selecting", applies=lambda v: v.matches.select("slot").distinct().limit(2).count() > 1, slot_id={"type": "integer", "required": True})
def select_slot(view: View, slot_id: int):
    """All lines, with the offsets of another slot."""
    return view.lines, {"slot": slot_id}


def quotas(counts: list[tuple[Any, int]], size: int) -> list[int]:
    """Proportional shares, rounded half to even, with one pass of corrections by one over the largest first."""
    total = sum(n for _, n in counts)
    size = min(size, total)
    share = [int((Decimal(n) / Decimal(total) * size).quantize(Decimal(1), ROUND_HALF_EVEN)) if total else 0 for _, n in counts]
    order = sorted(range(len(share)), key=lambda k: -share[k])
    for k in order:
        gap = size - sum(share)
        if gap == 0:
            break
        share[k] += 1 if gap > 0 else -1
    return [max(0, min(s, n)) for s, (_, n) in zip(share, counts)]


@algorithm("Select Weighted Sample by Metadata", "selecting", enrich={"metadata_attribute": metadata_attributes}, metadata_attribute={"type": "string", "required": True}, sample_size={"type": "integer", "minimum": 1, "required": True}, seed={"type": "integer", "default": 42})
def select_weighted_sample_by_metadata(view: View, metadata_attribute: str, sample_size: int, seed: int = 42):
    """A sample whose shares by attribute follow the lines'. Places within a stratum are drawn from its size alone."""
    from pyspark.sql import Window

    value = F.col(f"`{metadata_attribute}`")
    first = F.min("line_id").alias("first")
    counts = view.metadata.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"), first).orderBy(F.desc("n"), "first").collect()
    share = quotas([(r["value"], r["n"]) for r in counts], sample_size)
    draw = np.random.RandomState(seed)
    chosen = [(r["value"], int(p) + 1) for r, k in zip(counts, share) if k for p in draw.choice(r["n"], size=k, replace=False)]
    kind = view.metadata.schema[metadata_attribute].dataType.simpleString()
    places = view.metadata.sparkSession.createDataFrame(chosen, f"_value {kind}, _place long")
    placed = view.metadata.select("line_id", value.alias("_value"), F.row_number().over(Window.partitionBy(value).orderBy("line_id")).cast("long").alias("_place"))
    return placed.join(places, ["_value", "_place"], "left_semi").select("line_id"), None


@algorithm("Select by Sort", "selecting", comparison_operator=COMPARE, value={"type": "integer", "required": True})
def select_by_sort(view: View, value: int, comparison_operator: str = "=="):
    """Lines by their rank in the active node's ordering."""
    ordering = getattr(view.node, "ordering", None) if view.node is not None else None
    if ordering is None:
        raise ValueError("the node has no ordering")
    return ordering.where(compare(F.col("rank"), comparison_operator, value)).select("line_id"), None


SET_OPERATIONS = ("union", "intersection", "difference", "disjunctive union", "complement")


def combine(operation: str, a: DataFrame, b: DataFrame | None = None, every: DataFrame | None = None) -> DataFrame:
    """Set operations on frames of line ids; the complement is taken in ``every``."""
    if operation == "union":
        return a.union(b).distinct()
    if operation == "intersection":
        return a.intersect(b)
    if operation == "difference":
        return a.subtract(b)
    if operation == "disjunctive union":
        return a.subtract(b).union(b.subtract(a))
    if operation == "complement":
        return every.subtract(a)
    raise ValueError(f"no set operation {operation!r}")


@algorithm("Set Operation", "selecting", operation={"type": "string", "enum": list(SET_OPERATIONS), "required": True}, node_ids={"type": "array", "items": {"type": "integer"}, "required": True})
def set_operation(view: View, operation: str, node_ids: list[int]):
    """The lines of other nodes, combined from the first to the last; the complement of their union for ``complement``."""
    nodes = [view.node.concordance.find_node(k) for k in node_ids]
    if not nodes or None in nodes:
        raise ValueError("no such node")
    sets = [n.lines() for n in nodes]
    out = sets[0]
    for s in sets[1:]:
        out = combine("union" if operation == "complement" else operation, out, s)
    if operation == "complement":
        out = combine("complement", out, every=view.lines)
    return view.lines.join(out, "line_id", "left_semi"), None
