"""What grouping algorithms give: flat partitions or a tree of clusters, as frames."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Grouping:
    """groups: ``(id, parent_id, level, label, ord)``; lines: ``(id, line_id, pos, prototypicality)``, where a cluster's own
    lines (not those of its subclusters) have ``own`` true. For partitions there are no parents and all lines are own."""

    kind: str
    groups: DataFrame
    members: DataFrame
    illustrations: dict[int, list[int]] | None = None

    def lines_of(self, names: list[int | str]) -> DataFrame:
        """Lines of groups named by number or label, with those of their subgroups."""
        ids = [x for x in names if isinstance(x, int)]
        labels = [x for x in names if isinstance(x, str)]
        chosen = self.groups.where(F.col("id").isin(ids) | F.col("label").isin(labels)).select("id")
        return self.members.join(chosen, "id", "left_semi").select("line_id").distinct()

    def restrict(self, lines: DataFrame) -> Grouping:
        """The groups' lines that are among ``lines``; groups left empty go."""
        members = self.members.join(lines, "line_id", "left_semi")
        groups = self.groups.join(members.select("id").distinct(), "id", "left_semi")
        return Grouping(self.kind, groups, members, self.illustrations)

    def ordered(self, ordering: DataFrame | None) -> Grouping:
        """Partition lines by rank, unranked ones last; clusters keep their own order."""
        if ordering is None or self.kind != "partitions":
            return self
        members = self.members.join(ordering.select("line_id", F.col("rank").alias("_rank")), "line_id", "left")
        members = members.withColumn("pos", F.coalesce(F.col("_rank") * F.lit(1 << 20) + F.least(F.col("pos"), F.lit((1 << 20) - 1)), F.lit(1 << 62) + F.col("pos"))).drop("_rank")
        return Grouping(self.kind, self.groups, members, self.illustrations)

    def relabel(self, labels: DataFrame) -> Grouping:
        """With other labels ``(id, new_label)``."""
        groups = self.groups.join(labels, "id", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
        return Grouping(self.kind, groups, self.members, self.illustrations)

    def to_dict(self) -> dict[str, Any]:
        """The nested form, for presentation: everything comes to the driver."""
        groups = sorted((r.asDict() for r in self.groups.collect()), key=lambda g: g["ord"])
        lines: dict[int, list] = {}
        for r in self.members.orderBy("id", "pos", "line_id").collect():
            lines.setdefault(r["id"], []).append(r)
        if self.kind == "partitions":
            return {"partitions": [{"id": g["id"], "label": g["label"], "line_ids": [r["line_id"] for r in lines.get(g["id"], [])]} for g in groups]}
        made: dict[int, dict[str, Any]] = {}
        root = None
        for g in groups:
            own = lines.get(g["id"], [])
            node = {"id": g["id"], "label": g["label"], "type": "cluster", "children": [], "illustrations": (self.illustrations or {}).get(g["id"], []), "prototypicality": {r["line_id"]: r["prototypicality"] for r in own}}
            direct = [r["line_id"] for r in own if r["own"]]
            if direct:
                node["children"].append({"type": "lines", "line_ids": direct})
            made[g["id"]] = node
            if g["parent_id"] is None or g["parent_id"] not in made:
                root = root or node
            else:
                made[g["parent_id"]]["children"].append(node)
        return {"cluster": root}
