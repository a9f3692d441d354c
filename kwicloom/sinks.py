"""Sinks: concordance folders and archives, CSV views, KWIC text and HTML."""

from __future__ import annotations

import csv
import html
import json
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .concordance import Concordance, View, top_rows
from .sources.files import global_matches
from .tree import Node, save_template

COLOURS = ("#fff3a3", "#c9f0ff", "#ffd3d3", "#d5f5d0", "#ead7ff", "#ffe0bd")


def field_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return "numpy_array[float64]"
    for types, name in (((T.IntegralType,), "integer"), ((T.FractionalType,), "float"), ((T.BooleanType,), "boolean"), ((T.TimestampType, T.DateType), "datetime"), ((T.StringType,), "string")):
        if isinstance(kind, types):
            return name
    return "object"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON."""
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema])


def write_rows(df: DataFrame, path: Path, sep: str = "\t") -> None:
    """One file, row by row through the driver, a partition at a time; ``write_tables`` is the distributed form."""
    with path.open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter=sep, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def write_tables(conc: Concordance, path: str) -> None:
    """The three tables as Parquet, in parallel."""
    for name in ("metadata", "tokens", "matches"):
        getattr(conc, name).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def export(conc: Concordance, path: str, as_zip: bool = False) -> str:
    """Tables, field types, information and tree as files of a folder, or of a zip archive."""
    folder = Path(tempfile.mkdtemp()) if as_zip else Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    frames = {"metadata": conc.metadata.orderBy("line_id"), "tokens": conc.tokens.orderBy("line_id", "id_in_line"), "matches": global_matches(conc.matches, conc.tokens).orderBy("line_id", "slot")}
    for name, df in frames.items():
        write_rows(flat(df), folder / f"{name}.tsv")
        (folder / f"{name}.field_types.tsv").write_text("field\ttype\n" + "".join(f"{f.name}\t{field_kind(f.dataType)}\n" for f in df.schema))
    (folder / "info.json").write_text(json.dumps(conc.info, default=str), encoding="utf-8")
    (folder / "tree.json").write_text(json.dumps(save_template(conc), default=str), encoding="utf-8")
    if not as_zip:
        return str(folder)
    archive = shutil.make_archive(path.removesuffix(".zip"), "zip", folder)
    shutil.rmtree(folder)
    return archive


def spaced(text: Column) -> Column:
    """Tokens joined by blanks, as written: no blank before closing marks or after opening ones."""
    text = F.regexp_replace(text, r"\s+([.,;:!?…)\]}»”’%])", "$1")
    text = F.regexp_replace(text, r"([(\[{«“‘])\s+", "$1")
    return F.regexp_replace(text, r"\s+('(?:s|t|re|ve|ll|d|m)\b)", "$1")


def tripartite(tokens: DataFrame, attribute: str = "word") -> DataFrame:
    """``(line_id, left_context, kwic, right_context)`` in one aggregation."""

    def part(cond: Column) -> Column:
        items = F.array_sort(F.collect_list(F.when(cond, F.struct("id_in_line", F.col(attribute).cast("string").alias("w")))))
        return F.array_join(F.transform(items, lambda x: x["w"]), " ")

    o = F.col("offset")
    return tokens.groupBy("line_id").agg(part(o < 0).alias("left_context"), part(o == 0).alias("kwic"), part(o > 0).alias("right_context"))


def contexts(view: View, attribute: str = "word") -> DataFrame:
    """``tripartite`` of a view."""

    def part(keep: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.filter("toks", lambda t: keep(t["offset"])), lambda t: t[attribute].cast("string")), " ")

    return view.by_line(attribute).select("line_id", part(lambda o: o < 0).alias("left_context"), part(lambda o: o == 0).alias("kwic"), part(lambda o: o > 0).alias("right_context"))


def view_frame(node: Node, token_attr: str = "word") -> DataFrame:
    """A node's lines in order: group label, scores, the three contexts and the metadata."""
    view = node.subset()
    out = view.lines.join(contexts(view, token_attr), "line_id", "left")
    for k, keys in node.rank_keys.items():
        out = out.join(keys.select("line_id", F.col("key").alias(f"R{k}")), "line_id", "left")
    if node.grouping is not None and node.grouping.kind == "partitions":
        names = node.grouping.members.join(node.grouping.groups.select("id", "label", "ord"), "id").select("line_id", F.col("label").alias("Partition"), "ord")
        out = out.join(names, "line_id", "left")
    else:
        out = out.withColumn("Partition", F.lit(None).cast("string")).withColumn("ord", F.lit(0))
    ordering = next((n.ordering for n in node.ancestors() if n.ordering is not None), None)
    out = out.join(ordering.select("line_id", "rank"), "line_id", "left") if ordering is not None else out.withColumn("rank", F.col("line_id"))
    return out.join(view.metadata, "line_id", "left")


def view_to_csv(node: Node, path: str, token_attr: str = "word") -> None:
    """The view as one CSV file."""
    df = view_frame(node, token_attr)
    ranks = [c for c in df.columns if c.startswith("R") and c[1:].isdigit()]
    meta = [c for c in node.concordance.metadata.columns if c != "line_id"]
    first = ["line_id"] + (["Partition"] if node.grouping is not None else []) + ranks
    named = df.orderBy("ord", "rank", "line_id").select(*first, F.col("left_context").alias("Left context"), F.col("kwic").alias("KWIC"), F.col("right_context").alias("Right context"), *[F.col(f"`{c}`") for c in meta])
    write_rows(flat(named), Path(path), ",")


def rounding(scores: list[float], least: int = 1, most: int = 9, default: int = 3, fallback: int = 6) -> int:
    """The fewest decimals that keep different scores different."""
    values = sorted({float(s) for s in scores if s is not None})
    if len(values) < 2:
        return default
    for k in range(least, most + 1):
        if len({round(v, k) for v in values}) == len(values):
            return k
    return fallback


def kwic_html(node: Node, n: int = 20, n_groups: int | None = None, token_attr: str = "word", metadata_columns: list[str] | None = None) -> str:
    """The first ``n`` lines of each group as an HTML table; only those lines are collected. Marked tokens are coloured."""
    view = node.subset()
    lines = view_frame(node, token_attr).select("line_id", "Partition", "ord", "rank", *[F.col(f"`{c}`") for c in metadata_columns or []], *[f"R{k}" for k in node.rank_keys])
    grouping = node.grouping
    if grouping is not None and grouping.kind == "cluster":
        own = grouping.members.where("own").join(grouping.groups.select("id", "label", F.col("ord").alias("_ord")), "id")
        lines = lines.drop("Partition", "ord").join(own.select("line_id", F.col("label").alias("Partition"), F.col("_ord").alias("ord")), "line_id")
    if n_groups is not None:
        lines = lines.join(lines.select("ord").distinct().orderBy("ord").limit(n_groups), "ord", "left_semi")
    shown = top_rows(lines, [F.col("rank"), F.col("line_id")], n, ["ord"])
    rows = shown.orderBy("ord", "rank", "line_id").collect()
    chosen = node.concordance.metadata.sparkSession.createDataFrame([(r["line_id"],) for r in rows], "line_id long")
    words: dict[int, list] = {}
    for t in view.tokens.join(chosen, "line_id", "left_semi").select("line_id", "id_in_line", "offset", token_attr).orderBy("line_id", "id_in_line").collect():
        words.setdefault(t["line_id"], []).append(t)
    marks: dict[tuple[int, int], str] = {}
    for s in node._view_spans({r["line_id"] for r in rows}, True):
        for k in range(s["start_id_in_line"], s["end_id_in_line"] + 1):
            marks[s["line_id"], k] = COLOURS[(ord(s["category"][0]) - 65) % len(COLOURS)]

    def text(line: int, keep) -> str:
        out = []
        for t in words.get(line, []):
            if keep(t["offset"]):
                w = html.escape(str(t[token_attr]))
                colour = marks.get((line, t["id_in_line"]))
                out.append(f'<span style="background:{colour}">{w}</span>' if colour else w)
        return " ".join(out)

    digits = {k: rounding([r[f"R{k}"] for r in rows]) for k in node.rank_keys}
    head = ["line", *(metadata_columns or []), *[f"R{k}" for k in node.rank_keys], "left", "node", "right"]
    out, last = ["<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>"], object()
    for r in rows:
        if grouping is not None and r["Partition"] != last:
            last = r["Partition"]
            out.append(f'<tr><th colspan="{len(head)}">{html.escape(str(last))}</th></tr>')
        cells = [str(r["line_id"]), *[html.escape(str(r[c])) for c in metadata_columns or []], *[f"{r[f'R{k}']:.{digits[k]}f}" for k in node.rank_keys]]
        cells += [text(r["line_id"], lambda o: o < 0), "<b>" + text(r["line_id"], lambda o: o == 0) + "</b>", text(r["line_id"], lambda o: o > 0)]
        out.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
    return "\n".join(out) + "</table>"


def tree_html(conc: Concordance) -> str:
    """The analysis tree as nested lists."""

    def item(n: Node) -> str:
        names = [a["algorithm_name"] for v in n.algorithms.values() for a in (v if isinstance(v, list) else [v])]
        kids = "".join(item(c) for c in n.children)
        return f"<li>[{n.id}] {n.node_type}: {html.escape(n.label or ', '.join(names) or str(conc.info.get('query', '')))}{f'<ul>{kids}</ul>' if kids else ''}</li>"

    notes = "".join(f"<li>{html.escape(a['algorithm_name'])}</li>" for a in conc.annotations)
    return f"<ul>{item(conc.root)}</ul>" + (f"<p>Annotations</p><ul>{notes}</ul>" if notes else "")


def show(node: Node, **options: Any) -> str:
    return kwic_html(node, **options)
