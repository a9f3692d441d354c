"""Frequency lists and score tables, registered by name."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = ("f", "pmw", "rel_f")


@dataclass
class Resource:
    kind: str
    data: DataFrame
    info: dict[str, Any]
    attributes: list[str]


@dataclass
class Resources:
    items: dict[tuple[str, str], Resource] = field(default_factory=dict)

    def register_frequency_list(self, name: str, data: DataFrame, info: dict[str, Any] | None = None) -> None:
        """A list with at least one of ``f``, ``pmw``, ``rel_f``; the others follow from it and ``sample_size``. It is stored.

        ``sample_size`` is the sum of ``f`` for a list that is ``complete`` (the default if it has ``f``).
        """
        info = dict(info or {})
        have = [c for c in NUMBERS if c in data.columns]
        if not have:
            raise ValueError("a frequency list needs f, pmw or rel_f")
        info.setdefault("complete", "f" in have)
        data = data.persist()  # a row for each type; made from all tokens as a rule, and read for sums, joins and ranks
        if "sample_size" not in info and "f" in have and info["complete"]:
            info["sample_size"] = data.agg(F.sum("f")).first()[0] or 0
        n = info.get("sample_size")
        if "rel_f" not in have:
            if "pmw" in have:
                data = data.withColumn("rel_f", F.col("pmw") / 1e6)
            elif n is not None:
                data = data.withColumn("rel_f", F.col("f") / F.lit(float(n)) if n else F.lit(0.0))
        if "pmw" not in have and "rel_f" in data.columns:
            data = data.withColumn("pmw", F.col("rel_f") * 1e6)
        if "f" not in have and n is not None:
            data = data.withColumn("f", F.round(F.col("rel_f") * n).cast("long"))
        attributes = [c for c in data.columns if c not in NUMBERS]
        info["p_attrs"] = attributes
        self.items["frequency_list", name] = Resource("frequency_list", data, info, attributes)

    def get_frequency_list(self, name: str, ignore_case: bool = False, attributes: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The list, optionally lower-cased and summed over ``attributes``."""
        r = self._get("frequency_list", name)
        data, attributes = r.data, attributes or r.attributes
        if ignore_case or attributes != r.attributes:
            keys = [(F.lower(a) if ignore_case and dict(data.dtypes)[a] == "string" else F.col(a)).alias(a) for a in attributes]
            data = data.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in NUMBERS if c in data.columns])
        return data.select(*columns) if columns else data

    def ranked(self, name: str, **options: Any) -> DataFrame:
        """The list with its 1-based ``rank`` by frequency, ties by attribute; ranked in ranges, not in one task, when long."""
        from .functions.ranking import globally

        data = self.get_frequency_list(name, **options)
        by = next(c for c in NUMBERS if c in data.columns)
        return globally(data.withColumn("_neg", -F.col(by)), [F.col("_neg"), *[F.col(c) for c in data.columns if c not in NUMBERS]], "rank", rank=False).drop("_neg")

    def register_scores(self, name: str, data: DataFrame, info: dict[str, Any] | None = None) -> None:
        data = data.persist()
        attributes = [c for c, t in data.dtypes if t == "string"]
        self.items["scores", name] = Resource("scores", data, dict(info or {}), attributes)

    def get_scores(self, name: str, columns: list[str] | None = None) -> DataFrame:
        data = self._get("scores", name).data
        return data.select(*columns) if columns else data

    def info(self, kind: str, name: str) -> dict[str, Any]:
        return self._get(kind, name).info

    def list(self, kind: str | None = None) -> list[str]:
        if kind not in (None, "frequency_list", "scores"):
            raise ValueError(f"no resources of kind {kind!r}")
        return sorted(n for k, n in self.items if kind in (None, k))

    def _get(self, kind: str, name: str) -> Resource:
        if (kind, name) not in self.items:
            raise KeyError(f"no {kind.replace('_', ' ')} {name!r}")
        return self.items[kind, name]
