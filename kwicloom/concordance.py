"""Concordances: lines, tokens and matches as lazy DataFrames, and views of them at a node of the analysis tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resources import Resources


def with_offsets(tokens: DataFrame, matches: DataFrame, slot: int = 0) -> DataFrame:
    """``tokens`` with ``offset``, the signed distance to the line's first match of the slot; 0 where there is none.

    Matches are given by ``id_in_line``, ends included.
    """
    first = matches.where(F.col("slot") == slot).groupBy("line_id").agg(F.min(F.struct("match_start", "match_end")).alias("_m"))
    joined = tokens.drop("offset").join(first, "line_id", "left")
    at, s, e = F.col("id_in_line"), F.col("_m.match_start"), F.col("_m.match_end")
    offset = F.when(at < s, at - s).when(at > e, at - e).otherwise(0)
    return joined.withColumn("offset", offset.cast("int")).drop("_m")


def within(start: int | None, end: int | None, node: bool = True) -> Callable[[Callable[[str], Column]], Column]:
    """The condition of ``View.window``, for ``View.joined``."""

    def keep(t: Callable[[str], Column]) -> Column:
        cond = F.lit(True) if start is None else t("offset") >= start
        cond = cond if end is None else cond & (t("offset") <= end)
        return cond if node else cond & (t("offset") != 0)

    return keep


@dataclass
class View:
    """What an algorithm works on: the frames restricted to the node's lines, offsets for its slot."""

    metadata: DataFrame
    tokens: DataFrame
    matches: DataFrame
    resources: Resources
    node: Any = None
    slot: int = 0
    #: ``(line_id, toks)`` of all lines, if ``tokens`` are made of it and nothing else.
    packed: DataFrame | None = None

    @property
    def lines(self) -> DataFrame:
        return self.metadata.select("line_id")

    def window(self, start: int | None = None, end: int | None = None, node: bool = True) -> DataFrame:
        out = self.tokens
        if start is not None:
            out = out.where(F.col("offset") >= start)
        if end is not None:
            out = out.where(F.col("offset") <= end)
        return out if node else out.where(F.col("offset") != 0)

    def value_at(self, attribute: str, offset: int) -> DataFrame:
        """``(line_id, value)`` for every line: the tokens at an offset joined by blanks, "" if there are none."""
        return self.joined(lambda t: t("offset") == offset, attribute)

    def by_line(self, *columns: str) -> DataFrame:
        """``(line_id, toks)``: the tokens of each line that has any, as structs in order. Where lines are stored with their tokens, no row is made for a token."""
        if self.packed is not None and set(columns) <= set(self.packed.schema["toks"].dataType.elementType.names):
            return self.packed
        items = F.array_sort(F.collect_list(F.struct("id_in_line", "offset", *[c for c in dict.fromkeys(columns) if c not in ("id_in_line", "offset")])))
        return self.tokens.groupBy("line_id").agg(items.alias("toks"))

    def joined(self, keep: Callable[[Callable[[str], Column]], Column], attribute: str, descending: bool = False, reads: tuple[str, ...] = ()) -> DataFrame:
        """``(line_id, value)`` for every line: its tokens that are not null joined by blanks, last first if ``descending``.

        ``keep`` gets a function from names (``offset``, the attribute and what else it ``reads``) to columns of a token.
        """
        by_line = self.by_line(attribute, *reads)
        words = F.transform(F.filter("toks", lambda t: keep(lambda name: t[name]) & t[attribute].isNotNull()), lambda t: t[attribute].cast("string"))
        per_line = by_line.select("line_id", F.array_join(F.reverse(words) if descending else words, " ").alias("value"))
        if by_line is self.packed:
            return per_line
        return self.lines.join(per_line, "line_id", "left").select("line_id", F.coalesce("value", F.lit("")).alias("value"))


@dataclass
class Concordance:
    metadata: DataFrame
    tokens: DataFrame
    matches: DataFrame
    info: dict[str, Any] = field(default_factory=dict)
    resources: Resources = field(default_factory=Resources)
    root: Any = None
    annotations: list[dict[str, Any]] = field(default_factory=list)
    #: The tokens that lines are stored with, and ``(line_id, toks)``; of no use once ``tokens`` are others.
    stored: tuple[DataFrame, DataFrame] | None = None

    def __post_init__(self) -> None:
        for name, df, need in (("metadata", self.metadata, {"line_id"}), ("tokens", self.tokens, {"line_id", "id_in_line"}), ("matches", self.matches, {"line_id", "match_start", "match_end"})):
            missing = need - set(df.columns)
            if missing:
                raise ValueError(f"{name} has no column {', '.join(sorted(missing))}")
        if "slot" not in self.matches.columns:
            self.matches = self.matches.withColumn("slot", F.lit(0))
        if "offset" not in self.tokens.columns:
            self.tokens = with_offsets(self.tokens, self.matches)
        from .tree import Node

        if self.root is None:
            self.root = Node(self, "query", None)

    def view(self) -> View:
        return View(self.metadata, self.tokens, self.matches, self.resources, packed=self.packed())

    def packed(self) -> DataFrame | None:
        return self.stored[1] if self.stored and self.stored[0] is self.tokens else None

    def persist(self) -> Concordance:
        """Keep the three frames; work on a concordance reads them many times."""
        self.metadata, self.tokens, self.matches = (df.persist() for df in (self.metadata, self.tokens, self.matches))
        return self

    def add_annotation(self, algo: tuple[str, dict[str, Any]], column_names: list[str] | None = None) -> None:
        """Run an annotation on the whole concordance and attach what it gives: columns of lines or tokens, or a resource."""
        from .registry import ALGORITHMS, execute

        name, args = algo
        a = ALGORITHMS.get(name)
        if a is None or a.kind != "annotation":
            raise ValueError(f"no annotation {name!r}")
        result = execute(self.view(), name, args)
        if a.scope == "type":
            kind, data, info = result
            register = self.resources.register_frequency_list if kind == "frequency_list" else self.resources.register_scores
            register((column_names or [name])[0], data, info)
        else:
            keys = ["line_id"] if a.scope == "line" else ["line_id", "id_in_line"]
            frame = self.metadata if a.scope == "line" else self.tokens
            new = [c for c in result.columns if c not in keys]
            names = column_names or new
            if len(names) != len(new):
                raise ValueError(f"{name} gives {len(new)} columns")
            clash = [c for c in names if c in frame.columns]
            if clash:
                raise ValueError(f"there is a column {clash[0]} already")
            for old, c in zip(new, names):
                result = result.withColumnRenamed(old, c)
            frame = frame.join(result, keys, "left")
            if a.scope == "line":
                self.metadata = frame
            else:
                self.tokens = frame
        self.annotations.append({"algorithm_name": name, "args": args, "column_names": column_names, "scope": a.scope})

    def find_node(self, node_id: int):
        return next((n for n in self.root.walk() if n.id == node_id), None)


def rank_within(df: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """Competition ranks of a frame of lines by a column."""
    from .functions.ranking import globally

    return globally(df, [F.col(by)], name)


def top_rows(df: DataFrame, by: list, n: int, group: list[str]) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col("_n") <= n).drop("_n")
