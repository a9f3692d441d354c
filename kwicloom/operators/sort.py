"""Sorting: algorithms that give lines a rank. Each returns ``(keys, spans)``: a frame ``(line_id, key)`` and token spans or None."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..concordance import View
from ..functions.ranking import globally
from ..registry import algorithm, token_attributes
from .select import FLAG, spans_of


@algorithm("Sort by Corpus Position", "sorting")
def sort_by_corpus_position(view: View):
    """Rank by line id."""
    return globally(view.lines, [F.col("line_id")], "key", rank=False), None


@algorithm(
    "Sort by Token-Level Attribute", "sorting", enrich={"tokens_attribute": token_attributes}, tokens_attribute={"type": "string", "default": "word"},
    sorting_scope={"type": "string", "enum": ["token", "left", "right"], "default": "token"}, offset={"type": "integer", "default": 0},
    case_sensitive=FLAG, reverse=FLAG, backwards=FLAG, locale_str={"type": "string", "default": "en"},
)
def sort_by_token_attribute(view: View, tokens_attribute: str = "word", sorting_scope: str = "token", offset: int = 0, case_sensitive: bool = False, reverse: bool = False, backwards: bool = False, locale_str: str = "en"):
    """Competition rank by the token at an offset, or by the left context (outwards) or the right one, in the order of a locale.

    Ties are equal strings. An empty ``locale_str`` sorts by code point.
    """
    side = {"token": lambda t: t("offset") == offset, "left": lambda t: t("offset") < 0, "right": lambda t: t("offset") > 0}[sorting_scope]
    tokens = view.tokens.where(side(F.col))
    values = view.joined(side, tokens_attribute, descending=sorting_scope == "left")
    key = F.col("value") if case_sensitive else F.lower("value")
    if backwards:
        key = F.reverse(key)
    values = values.withColumn("value", key)
    order = F.collate(F.col("value"), locale_str) if locale_str else F.col("value")
    columns = [order, F.col("value")]
    if reverse:
        # ranks count from the end: equal values get the rank of the first of them in the reverse order
        up = globally(values, columns, "_up")
        sizes = values.groupBy("value").agg(F.count("*").alias("_n"))
        total = values.count()
        ranked = up.join(sizes, "value").select("line_id", (F.lit(total) - F.col("_up") - F.col("_n") + 2).alias("key"))
    else:
        ranked = globally(values, columns, "key").select("line_id", "key")
    return ranked, spans_of(tokens, tokens_attribute, "A")


@algorithm("Random Sort", "sorting", seed={"type": "integer", "default": 42})
def sort_random(view: View, seed: int = 42):
    """Rank by the md5 of seed and line id, so that two lines keep their order in every subset."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}_"), F.col("line_id").cast("string"))), 1, 8), 16, 10).cast("long")
    hashed = view.lines.withColumn("_h", key)
    return globally(hashed, [F.col("_h"), F.col("line_id")], "key", rank=False).select("line_id", "key"), None
