"""Ranking: algorithms that give lines a score; higher comes earlier. Each returns ``(keys, spans)``."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..concordance import View
from ..functions.ranking import globally
from ..functions.regexes import full_match
from ..plans.cqp import QueryError, condition, parse
from ..registry import algorithm, token_attributes
from .select import FLAG

WINDOW = {"type": "integer"}


def per_line(view: View, scores: DataFrame, zero: Any = 0) -> DataFrame:
    return view.lines.join(scores, "line_id", "left").select("line_id", F.coalesce("key", F.lit(zero)).alias("key"))


def token_spans(tokens: DataFrame, attribute: str, category: str, weight: Column | None = None) -> DataFrame:
    return tokens.select(
        "line_id", F.col("id_in_line").alias("start_id_in_line"), F.col("id_in_line").alias("end_id_in_line"), F.lit(category).alias("category"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"), F.lit(attribute).alias("tokens_attribute"), F.array(F.col(attribute).cast("string")).alias("values"),
    )


@algorithm(
    "KWIC Grouper Ranker", "ranking", enrich={"tokens_attribute": token_attributes}, search_terms={"type": "array", "items": {"type": "string"}, "required": True}, tokens_attribute={"type": "string", "default": "word"},
    mode={"type": "string", "enum": ["literal", "regex", "cqp"], "default": "literal"}, case_sensitive=FLAG, include_node=FLAG, window_start=WINDOW, window_end=WINDOW, count_types={"type": "boolean", "default": True},
)
def rank_kwic_grouper(view: View, search_terms: list[str], tokens_attribute: str = "word", mode: str = "literal", case_sensitive: bool = False, include_node: bool = False, window_start: int | None = None, window_end: int | None = None, count_types: bool = True):
    """How many distinct types (or tokens) of a line's window match a term."""
    col = F.col(tokens_attribute).cast("string")
    folded = col if case_sensitive else F.lower(col)
    if mode == "literal":
        cond = folded.isin([t if case_sensitive else t.lower() for t in search_terms]) if search_terms else F.lit(False)
    elif mode == "regex":
        cond = reduce(lambda a, b: a | b, [full_match(col, t, not case_sensitive) for t in search_terms], F.lit(False))
    else:
        cond = F.lit(False)
        for term in search_terms:
            parts = parse(term, tokens_attribute)
            if len(parts) != 1:
                raise QueryError(f"{term!r} has more than one token")
            cond = cond | condition(parts[0].token, F.col)
    hits = view.window(window_start, window_end, include_node).where(F.coalesce(cond, F.lit(False)))
    count = F.countDistinct(folded) if count_types else F.count("*")
    return per_line(view, hits.groupBy("line_id").agg(count.alias("key"))), token_spans(hits, tokens_attribute, "A")


def filtered(tokens: DataFrame, positive: dict[str, list] | None, negative: dict[str, list] | None) -> DataFrame:
    """Tokens with any of the positive values and none of the negative ones."""
    if positive:
        tokens = tokens.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(a).isin(list(v)), F.lit(False)) for a, v in positive.items()]))
    for a, v in (negative or {}).items():
        tokens = tokens.where(~F.coalesce(F.col(a).isin(list(v)), F.lit(False)))
    return tokens


@algorithm(
    "Collocation Ranker", "ranking", scores_list={"type": "string", "required": True}, token_attribute={"type": "string", "default": "word"}, score_column={"type": "string", "default": "log_local_MI"},
    top_n={"type": "integer", "minimum": 1}, method={"type": "string", "enum": ["sum", "count"], "default": "sum"}, window_start=WINDOW, window_end=WINDOW, include_node=FLAG,
    positive_filter={"type": "object"}, negative_filter={"type": "object"},
)
def rank_by_collocations(view: View, scores_list: str, token_attribute: str = "word", score_column: str = "log_local_MI", top_n: int | None = None, method: str = "sum", window_start: int | None = None, window_end: int | None = None, include_node: bool = False, positive_filter: dict | None = None, negative_filter: dict | None = None):
    """The sum (or number) of the positive scores of a line's collocates."""
    scores = view.resources.get_scores(scores_list).select(F.col(token_attribute).alias("_word"), F.col(score_column).alias("_score")).where("_score > 0")
    if top_n:
        scores = scores.orderBy(F.desc("_score"), "_word").limit(top_n)
    if scores.limit(1).isEmpty():
        raise ValueError("no positive scores")
    tokens = filtered(view.window(window_start, window_end, include_node), positive_filter, negative_filter)
    word = F.col(token_attribute)
    if view.resources.info("scores", scores_list).get("ignore_case"):
        word = F.lower(word)
    hits = tokens.withColumn("_word", word).join(scores, "_word")  # the table of scores may be long: Spark picks the join
    agg = F.sum("_score") if method == "sum" else F.count("*").cast("double")
    return per_line(view, hits.groupBy("line_id").agg(agg.alias("key")), 0.0), token_spans(hits, token_attribute, "COL", F.col("_score"))


@algorithm(
    "Rank by Number of Rare Words", "ranking", p_attr={"type": "string", "default": "word"}, freq_list={"type": "string", "required": True}, frequency_type={"type": "string", "enum": ["f", "pmw", "rel_f"], "default": "pmw"},
    threshold={"type": "number"}, rank_threshold={"type": "integer"}, window_start=WINDOW, window_end=WINDOW, case_sensitive=FLAG, positive=FLAG, ignore_attrs={"type": "object", "default": {}},
)
def rank_number_of_rare_words(view: View, freq_list: str, p_attr: str = "word", frequency_type: str = "pmw", threshold: float | None = None, rank_threshold: int | None = None, window_start: int | None = None, window_end: int | None = None, case_sensitive: bool = False, positive: bool = False, ignore_attrs: dict | None = None):
    """Minus the number of a line's words that are not in the list, below a frequency or beyond a rank; plus, if ``positive``."""
    data = view.resources.get_frequency_list(freq_list, ignore_case=not case_sensitive, attributes=[p_attr])
    table = data.select(F.col(p_attr).alias("_key"), F.col(frequency_type).alias("_f"))
    if rank_threshold is not None:
        table = globally(table.withColumn("_neg", -F.col("_f")), [F.col("_neg"), F.col("_key")], "_rank", rank=False)
    col = F.col(p_attr).cast("string")
    tokens = filtered(view.window(window_start, window_end), None, ignore_attrs).where(F.trim(col) != "")
    joined = tokens.withColumn("_key", col if case_sensitive else F.lower(col)).join(table, "_key", "left")
    rare = F.col("_f").isNull()
    if threshold is not None:
        rare = rare | (F.col("_f") < threshold)
    if rank_threshold is not None:
        rare = rare | (F.col("_rank") > rank_threshold)
    hits = joined.where(rare)
    count = F.count("*") if positive else -F.count("*")
    return per_line(view, hits.groupBy("line_id").agg(count.alias("key"))), token_spans(hits, p_attr, "rare")
