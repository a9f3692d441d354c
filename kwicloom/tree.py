"""The analysis tree: subset and arrangement nodes over a concordance.

The tree is small and lives on the driver; what a node holds about lines are lazy frames. Only ``view`` and the
sinks collect.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .concordance import Concordance, View
from .functions.ranking import globally
from .operators.grouping import Grouping
from .registry import ALGORITHMS, available, digest, execute, schema_for

Algo = tuple[str, dict[str, Any]]


def combine_orderings(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(line_id, rank, k0, k1, ...)``: one key per algorithm, rankings negated, aligned to the first one's lines; missing keys come last."""
    out = None
    for i, (kind, keys) in enumerate(results):
        key = F.col("key").cast("double") * (-1 if kind == "ranking" else 1)
        column = keys.select("line_id", key.alias(f"k{i}"))
        out = column if out is None else out.join(column, "line_id", "left").withColumn(f"k{i}", F.coalesce(f"k{i}", F.lit(float("inf"))))
    return globally(out, [F.col(f"k{i}") for i in range(len(results))], "rank")


def differentiation(ordering: DataFrame, n: int) -> dict[str, int]:
    """How many neighbouring groups of equal lines each algorithm is the first to tell apart."""
    keys = [f"k{i}" for i in range(n)]
    distinct = ordering.select("rank", *keys).distinct()
    # neighbours are told apart first by algorithm i when their prefix of i keys is equal and that of i + 1 is not
    counts = {0: 0}
    for i in range(n + 1):
        counts[i] = distinct.select(*keys[:i]).distinct().count() if i else 1
    return {f"algo_{i}": max(0, counts[i + 1] - counts[i]) for i in range(n)}


@dataclass(eq=False)
class Node:
    concordance: Concordance
    node_type: str
    parent: Node | None
    algorithms: dict[str, Any] = field(default_factory=dict)
    label: str | None = None
    bookmarked: bool = False
    hash: str = ""
    id: int = 0
    children: list[Node] = field(default_factory=list)
    selected: DataFrame | None = None
    slot: int | None = None
    ordering: DataFrame | None = None
    rank_keys: dict[int, DataFrame] = field(default_factory=dict)
    grouping: Grouping | None = None
    spans: DataFrame | None = None
    info: dict[str, Any] = field(default_factory=dict)
    last_id: int = 1

    def __post_init__(self) -> None:
        if self.parent is None:
            self.id = 1
        else:
            root = self.root
            root.last_id += 1
            self.id = root.last_id
            self.parent.children.append(self)

    @property
    def root(self) -> Node:
        return self if self.parent is None else self.parent.root

    def ancestors(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def lines(self) -> DataFrame:
        """The lines of the nearest node that selects; an empty selection stays empty."""
        return next((n.selected for n in self.ancestors() if n.selected is not None), self.concordance.metadata.select("line_id"))

    def active_slot(self) -> int:
        return next((n.slot for n in self.ancestors() if n.slot is not None), 0)

    def subset(self) -> View:
        """The frames restricted to this node's lines, offsets by the active slot."""
        from .concordance import with_offsets

        c, slot = self.concordance, self.active_slot()
        selecting = any(n.selected is not None for n in self.ancestors())
        lines = self.lines()
        cut = (lambda df: df.join(lines, "line_id", "left_semi")) if selecting else (lambda df: df)
        tokens, packed = cut(c.tokens), c.packed()
        if slot or "offset" not in tokens.columns:
            tokens, packed = with_offsets(tokens, c.matches, slot), None
        return View(cut(c.metadata), tokens, cut(c.matches), c.resources, self, slot, None if packed is None else cut(packed))

    def add_subset_node(self, algo: Algo, keep_arrangement: bool = True) -> Node:
        """Select lines. The same algorithm under the same node gives the node there is. An ordering and a grouping of
        this node are kept, restricted to the lines and ranked anew."""
        key = digest("subset", algo)
        same = next((c for c in self.children if c.hash == key), None)
        if same:
            return same
        if ALGORITHMS.get(algo[0]) is None or ALGORITHMS[algo[0]].kind != "selecting":
            raise ValueError(f"no selecting algorithm {algo[0]!r}")
        lines, extra = execute(self.subset(), *algo)
        node = Node(self.concordance, "subset", self, {"subset": {"algorithm_name": algo[0], "args": algo[1]}}, hash=key)
        node.selected = lines
        if isinstance(extra, dict):
            node.slot = extra.get("slot")
        elif extra is not None:
            node.spans = extra
        if keep_arrangement:
            if self.ordering is not None:
                kept = self.ordering.join(lines, "line_id", "left_semi").withColumnRenamed("rank", "_old")
                node.ordering = globally(kept, [F.col("_old")], "rank").drop("_old")
                node.rank_keys = {k: df.join(lines, "line_id", "left_semi") for k, df in self.rank_keys.items()}
                if "ordering" in self.algorithms:
                    node.algorithms["ordering"] = self.algorithms["ordering"]
            if self.grouping is not None:
                node.grouping = self.grouping.restrict(lines)
        return node

    def add_arrangement_node(self, ordering: list[Algo] | None = None, grouping: Algo | None = None, labelling: Algo | None = None, max_depth: int | None = None) -> Node:
        """Order and group lines. On an arrangement node, the new one is its sibling."""
        ordering = ordering or []
        if labelling and not grouping:
            raise ValueError("labelling needs a grouping")
        base = self.parent if self.node_type == "arrangement" and self.parent is not None else self
        key = digest("arrangement", ordering, grouping, labelling, max_depth)
        same = next((c for c in base.children if c.hash == key), None)
        if same:
            return same
        for name, _ in ordering:
            if ALGORITHMS.get(name) is None or ALGORITHMS[name].kind not in ("sorting", "ranking"):
                raise ValueError(f"no ordering algorithm {name!r}")
        view = base.subset()
        results, spans, ranks = [], [], {}
        for i, (name, args) in enumerate(ordering):
            keys, span = execute(view, name, args)
            results.append((ALGORITHMS[name].kind, keys))
            if ALGORITHMS[name].kind == "ranking":
                ranks[i] = keys
            if span is not None:
                spans.append((i + 1, span))
        ordered = combine_orderings(results) if results else None
        groups = None
        if grouping:
            if max_depth is not None and "max_depth" in ALGORITHMS[grouping[0]].args:
                grouping = (grouping[0], {"max_depth": max_depth} | grouping[1])
            groups = execute(view, *grouping).ordered(ordered)
        if labelling:
            groups = groups.relabel(ALGORITHMS[labelling[0]].fn(view, groups, **labelling[1]))
        algos: dict[str, Any] = {"ordering": [{"algorithm_name": n, "args": a} for n, a in ordering]}
        for name, algo in (("grouping", grouping), ("labelling", labelling)):
            if algo:
                algos[name] = {"algorithm_name": algo[0], "args": algo[1]}
        node = Node(self.concordance, "arrangement", base, algos, hash=key)
        node.ordering, node.rank_keys, node.grouping = ordered, ranks, groups
        node.spans = relabel_spans(spans)
        if results:
            node.info["differentiation_columns"] = len(results)
        return node

    def differentiation_info(self) -> dict[str, int] | None:
        n = self.info.get("differentiation_columns")
        return differentiation(self.ordering, n) if self.ordering is not None and n else None

    def view(self, inherit_spans: bool = True) -> dict[str, Any]:
        """Everything to show this node, on the driver: selected lines, their order, groups, scores and marked tokens."""
        selected = [r[0] for r in self.lines().orderBy("line_id").collect()]
        chosen = set(selected)
        source = next((n.ordering for n in self.ancestors() if n.ordering is not None), None)
        order = [r[0] for r in source.orderBy("rank", "line_id").select("line_id").collect() if r[0] in chosen] if source is not None else selected
        out: dict[str, Any] = {"selected_lines": selected, "ordering": order}
        if self.grouping is not None:
            out["grouping"] = self.grouping.to_dict()
        info = self.differentiation_info()
        if info:
            out["global_info"] = {"differentiation_info": info}
        if self.rank_keys:
            columns, data = [], {}
            for k, keys in self.rank_keys.items():
                name = self.algorithms["ordering"][k]["algorithm_name"]
                columns.append({"key": f"Ranking: {name}", "algorithm": name, "algorithm_index_within_ordering": k, "type": "rank", "description": f"Ranking score of the line from {name} (ordering algorithm #{k})"})
                for r in keys.collect():
                    if r["line_id"] in chosen:
                        data.setdefault(r["line_id"], {})[f"Ranking: {name}"] = r["key"]
            out["line_info"] = {"column_info": columns, "data": data}
        spans = self._view_spans(chosen, inherit_spans)
        if spans:
            out["token_spans"] = spans
        out["node_type"] = self.node_type
        return out

    def _view_spans(self, chosen: set[int], inherit: bool) -> list[dict[str, Any]]:
        used: list[str] = []
        out: list[dict[str, Any]] = []
        for depth, node in enumerate(self.ancestors()):
            if node.spans is not None and (inherit or depth == 0):
                names: dict[str, str] = {}
                for r in node.spans.orderBy("category", "line_id", "start_id_in_line").collect():
                    if r["line_id"] not in chosen:
                        continue
                    cat = r["category"]
                    if cat not in names:
                        names[cat] = cat if depth == 0 and cat not in used else next_letter(used)
                        used.append(names[cat])
                    out.append(r.asDict() | {"category": names[cat]})
        return sorted(out, key=lambda s: (s["line_id"], s["start_id_in_line"]))

    def available_algorithms(self) -> list[str]:
        return [a.name for a in available(self.subset())]

    def schema_for(self, name: str) -> dict[str, Any]:
        return schema_for(name, self.subset())

    def summary(self, format: str = "dict") -> Any:
        """What the node is: ``dict``, ``json``, ``text`` or ``html``."""
        data = {"id": self.id, "node_type": self.node_type, "label": self.label, "bookmarked": self.bookmarked, "parent": self.parent.id if self.parent else None, "children": [c.id for c in self.children], "algorithms": self.algorithms, "line_count": self.lines().count()}
        if format == "dict":
            return data
        if format == "json":
            return json.dumps(data, default=str)
        if format == "text":
            return "\n".join(f"{k}: {v}" for k, v in data.items())
        if format == "html":
            import html

            return "<table>" + "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in data.items()) + "</table>"
        raise ValueError(f"no format {format!r}")

    def remove(self) -> None:
        """Take this node and all below it out of the tree."""
        for c in list(self.children):
            c.remove()
        if self.parent:
            self.parent.children.remove(self)
            self.parent = None


def next_letter(used: list[str]) -> str:
    """The next of A..Z, AA, BB, ... that is not in use."""
    k = len(used)
    while True:
        name = chr(65 + k % 26) * (k // 26 + 1)
        if name not in used:
            return name
        k += 1


def relabel_spans(spans: list[tuple[int, DataFrame]]) -> DataFrame | None:
    """Spans of several algorithms as one frame, each (algorithm, category) a letter of its own."""
    if not spans:
        return None
    every = None
    for i, df in spans:
        df = df.withColumn("_algo", F.lit(i))
        every = df if every is None else every.unionByName(df)
    names = every.select("_algo", "category").distinct()
    names = names.withColumn("_letter", F.call_function("chr", (F.lit(64) + F.dense_rank().over(Window.orderBy("_algo", "category"))).cast("long")))
    return every.join(names, ["_algo", "category"]).withColumn("category", F.col("_letter")).drop("_algo", "_letter")


def save_template(conc: Concordance, path: str | None = None) -> dict[str, Any]:
    """The annotations and the tree's algorithms, to replay elsewhere."""
    nodes = [{"id": n.id, "parent_id": n.parent.id, "node_type": n.node_type, "algorithms": n.algorithms, "label": n.label, "bookmarked": n.bookmarked} for n in conc.root.walk() if n.parent is not None]
    out = {"root_id": conc.root.id, "annotations": conc.annotations, "nodes": nodes}
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, default=str)
    return out


def load_template(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def apply_template(conc: Concordance, template: dict[str, Any]) -> dict[int, int]:
    """Replay a template, labelling included; returns the new id of each of its nodes."""
    for a in template["annotations"]:
        conc.add_annotation((a["algorithm_name"], a["args"]), a.get("column_names"))
    made = {template["root_id"]: conc.root}
    algo = lambda x: (x["algorithm_name"], x["args"]) if x else None
    for n in template["nodes"]:
        parent, a = made[n["parent_id"]], n["algorithms"]
        if n["node_type"] == "subset":
            node = parent.add_subset_node(algo(a["subset"]))
        else:
            node = parent.add_arrangement_node([algo(x) for x in a.get("ordering", [])], algo(a.get("grouping")), algo(a.get("labelling")))
        node.label, node.bookmarked = n.get("label"), n.get("bookmarked", False)
        made[n["id"]] = node
    return {k: v.id for k, v in made.items()}
