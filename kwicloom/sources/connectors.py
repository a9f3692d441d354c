"""Exports and payloads of corpus tools as concordances: CQPweb and BNCweb tables, CLiC, Sketch Engine and KorAP
payloads, Wmatrix databases, frequency lists. Fetching over a network is left to the caller: these read what
was fetched, as DataFrames or files.
"""

from __future__ import annotations

import re
import sqlite3
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..concordance import Concordance
from ..functions.ranking import cumulated, globally

TOKEN = r"(?U)\w+(?:-\w+)?|[^\w\s]+"
#: Columns of CQPweb and BNCweb exports, by what they mean; compared without case.
ALIASES = {
    "left": ("context before", "left context"),
    "node": ("query item", "query result", "node"),
    "right": ("context after", "right context"),
    "tagged_left": ("tagged context before",),
    "tagged_node": ("tagged query item",),
    "tagged_right": ("tagged context after",),
}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(col: Column) -> Column:
    for a, b in ENTITIES:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def from_parts(rows: DataFrame, metadata: list[str], extra: list[str] | None = None, info: dict[str, Any] | None = None) -> Concordance:
    """A concordance of rows ``(line_id, l, n, r)``, arrays of structs with ``word`` and the ``extra`` attributes, and metadata columns."""
    every = F.concat("l", "n", "r")
    tokens = rows.select("line_id", F.size("l").alias("_s"), F.size("n").alias("_n"), F.posexplode(every).alias("id_in_line", "t"))
    at = F.col("id_in_line")
    offset = F.when(at < F.col("_s"), at - F.col("_s")).when(at >= F.col("_s") + F.col("_n"), at - F.col("_s") - F.col("_n") + 1).otherwise(0)
    tokens = tokens.select("line_id", "id_in_line", offset.cast("int").alias("offset"), "t.word", *[f"t.{c}" for c in extra or []])
    matches = rows.where(F.size("n") > 0).select("line_id", F.size("l").cast("long").alias("match_start"), (F.size("l") + F.size("n") - 1).cast("long").alias("match_end"), F.lit(0).alias("slot"))
    return Concordance(rows.select("line_id", *metadata), tokens, matches, dict(info or {}))


def numbered_from(df: DataFrame, order: list[str]) -> DataFrame:
    return globally(df, [F.col(c) for c in order], "line_id", rank=False).withColumn("line_id", F.col("line_id") - 1)


def words(col: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.trim(F.coalesce(col, F.lit(""))), r"\s+"), ""), lambda w: F.struct(w.alias("word")))


def tagged(col: Column) -> Column:
    """``word_POS`` items; the last underscore separates."""

    def cut(w: Column) -> Column:
        return F.struct(F.when(w.contains("_"), F.regexp_extract(w, r"^(.*)_([^_]*)$", 1)).otherwise(w).alias("word"), F.when(w.contains("_"), F.regexp_extract(w, r"^(.*)_([^_]*)$", 2)).otherwise("").alias("pos"))

    return F.transform(F.array_remove(F.split(F.trim(F.coalesce(col, F.lit(""))), r"\s+"), ""), cut)


def read_export(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "UTF-16", "ISO-8859-1")) -> DataFrame:
    """A tab-separated export in the first encoding that gives known column names; ``_row`` is the row's place."""
    for encoding in encodings:
        df = spark.read.csv(path, sep="\t", header=True, encoding=encoding, quote="", multiLine=encoding == "UTF-16")
        names = {c.strip().lower().lstrip("﻿") for c in df.columns}
        if names & set(ALIASES["node"]):
            df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
            return df.withColumn("_row", F.monotonically_increasing_id())
    raise ValueError("no known columns in the export")


def cqpweb(df: DataFrame) -> Concordance:
    """A CQPweb or BNCweb export: known columns become tokens, with tags if there are tagged columns, the others metadata."""
    by = {c.strip().lower(): c for c in df.columns}
    col = {k: next((by[a] for a in names if a in by), None) for k, names in ALIASES.items()}
    if not (col["left"] and col["node"] and col["right"]):
        raise ValueError("the export needs a left context, a query item and a right context")
    use_tags = all(col[f"tagged_{k}"] for k in ("left", "node", "right"))
    clean = lambda c: unescape(F.regexp_replace(F.col(f"`{c}`"), r"<<<\s*|\s*>>>", ""))
    parts = {s: tagged(clean(col[f"tagged_{k}"])) if use_tags else words(clean(col[k])) for s, k in (("l", "left"), ("n", "node"), ("r", "right"))}
    meta = [c for c in df.columns if c not in col.values() and c != "_row"]
    if "_row" not in df.columns:
        df = df.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered_from(df, ["_row"]).select("line_id", *[parts[s].alias(s) for s in "lnr"], *[F.col(f"`{c}`") for c in meta])
    return from_parts(rows, meta, ["pos"] if use_tags else None)


CLIC_SUBSETS = ("longsus", "shortsus", "nonquote", "quote")


def clic(df: DataFrame, subset_col: str | None = None) -> Concordance:
    """CLiC rows as ``(left, node, right, corpus, start, end, chapter, paragraph, sentence)``; contexts are arrays of
    strings without their offset lists. Marks at the node's end go to the right context. Several rows of the same
    place become one, with the first subset of ``CLIC_SUBSETS`` that it is in."""
    text = lambda c: F.array_join(c, "") if dict(df.dtypes)[c].startswith("array") else F.col(c)
    cut = lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))
    node = F.trim(text("node"))
    mark = F.regexp_extract(node, r"(?U)([^\w\s]+)\s*$", 1)
    df = df.withColumn("_mark", mark).withColumn("_node", F.regexp_replace(node, r"(?U)[^\w\s]+\s*$", ""))
    if subset_col:
        rank = F.array_position(F.array(*map(F.lit, CLIC_SUBSETS)), F.col(subset_col))
        df = df.groupBy("corpus", "start", "end").agg(F.min_by(F.struct(*df.columns), F.when(rank > 0, rank).otherwise(99)).alias("r")).select("r.*")
    as_words = lambda a: F.transform(a, lambda w: F.struct(w.alias("word")))
    rows = numbered_from(df, ["corpus", "start", "end"])
    right = F.concat(F.when(F.col("_mark") != "", F.array("_mark")).otherwise(F.array().cast("array<string>")), cut(text("right")))
    meta = [c for c in df.columns if c not in ("left", "node", "right", "_mark", "_node")]
    rows = rows.select("line_id", as_words(cut(text("left"))).alias("l"), as_words(cut(F.col("_node"))).alias("n"), as_words(right).alias("r"), *meta)
    return from_parts(rows, meta)


def clic_payload(spark: SparkSession, data: list[list[Any]]) -> DataFrame:
    """The rows of a CLiC response, ``[left, node, right, [corpus, start, end], [chapter, paragraph, sentence]]``, as a frame."""
    strings = lambda part: [x for x in part if isinstance(x, str)]
    rows = [(strings(r[0]), strings(r[1]), strings(r[2]), str(r[3][0]), int(r[3][1]), int(r[3][2]), *[int(x) for x in r[4][:3]]) for r in data]
    return spark.createDataFrame(rows, "left array<string>, node array<string>, right array<string>, corpus string, start long, end long, chapter long, paragraph long, sentence long")


SKETCH = "struct<Lines:array<struct<Left:array<struct<str:string,attr:string,strc:string>>,Kwic:array<struct<str:string,attr:string,strc:string>>,Right:array<struct<str:string,attr:string,strc:string>>,Refs:array<string>>>>"


def sketch_engine(pages: DataFrame, attributes: list[str] | None = None, references: list[str] | None = None, structures: tuple[str, ...] = ("s",)) -> Concordance:
    """Sketch Engine pages ``(page, json)``. Attributes come as ``/a/b`` after a word; structure tags count into
    ``same_<structure>``: 1 for tokens in the node's unit, else 0. Reference columns that are numbers in 95 % of
    the lines become numbers."""
    attributes, references = attributes or [], references or []
    lines = pages.select("page", F.posexplode(F.from_json("json", SKETCH)["Lines"]).alias("at", "x"))
    rows = numbered_from(lines, ["page", "at"])

    def items(part: Column) -> Column:
        def one(x: Column) -> Column:
            texts = F.array_remove(F.split(F.trim(F.coalesce(x["str"], F.lit(""))), r"\s+"), "")
            values = F.split(F.coalesce(x["attr"], F.lit("")), "/")
            opens = [F.size(F.regexp_extract_all(F.coalesce(x["strc"], F.lit("")), F.lit(rf"<{s}(?:\s[^>]*)?>"), F.lit(0))) for s in structures]
            real = F.transform(texts, lambda w: F.struct(w.alias("word"), *[F.coalesce(F.get(values, F.lit(k + 1)), F.lit("")).alias(a) for k, a in enumerate(attributes)], *[F.lit(0).alias(f"_{s}") for s in structures]))
            mark = F.array(F.struct(F.lit("").alias("word"), *[F.lit("").alias(a) for a in attributes], *[o.alias(f"_{s}") for o, s in zip(opens, structures)]))
            return F.when(F.coalesce(x["strc"], F.lit("")) != "", F.concat(mark, real)).otherwise(real)

        return F.flatten(F.transform(F.coalesce(part, F.array()), one))

    rows = rows.withColumn("_l", items(F.col("x.Left"))).withColumn("_n", items(F.col("x.Kwic"))).withColumn("_r", items(F.col("x.Right")))

    def marked(c: str, part: int) -> Column:
        return F.transform(F.col(c), lambda t: F.struct(F.lit(part).alias("part"), t.alias("t")))

    every = F.concat(marked("_l", 0), marked("_n", 1), marked("_r", 2))
    flat = rows.select("line_id", F.posexplode(every).alias("i", "e")).select("line_id", "i", "e.part", "e.t.*")
    from pyspark.sql import Window

    w = Window.partitionBy("line_id").orderBy("i")
    for s in structures:
        flat = flat.withColumn(f"_c{s}", F.sum(f"_{s}").over(w))
    flat = flat.where("word <> ''").withColumn("id_in_line", F.row_number().over(w) - 1)
    node = flat.where("part = 1").groupBy("line_id").agg(F.min("id_in_line").alias("match_start"), F.max("id_in_line").alias("match_end"), *[F.min_by(f"_c{s}", "id_in_line").alias(f"_n{s}") for s in structures])
    flat = flat.join(node, "line_id", "left")
    at, a, b = F.col("id_in_line"), F.col("match_start"), F.col("match_end")
    tokens = flat.select("line_id", "id_in_line", F.when(at < a, at - a).when(at > b, at - b).otherwise(0).cast("int").alias("offset"), "word", *attributes, *[(F.col(f"_c{s}") == F.col(f"_n{s}")).cast("int").alias(f"same_{s}") for s in structures])
    meta = rows.select("line_id", *[F.regexp_replace(F.get(F.col("x.Refs"), F.lit(k)), r"^[\w.]+=", "").alias(r) for k, r in enumerate(references)])
    matches = node.select("line_id", F.col("match_start").cast("long").alias("match_start"), F.col("match_end").cast("long").alias("match_end"), F.lit(0).alias("slot"))
    return Concordance(coerced(meta, references), tokens, matches)


def coerced(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """Text columns of which this share are numbers, as numbers (whole ones if all are)."""
    if not columns:
        return df
    stats = df.agg(*[F.avg(F.col(c).try_cast("double").isNotNull().cast("int")).alias(c) for c in columns], *[F.avg((F.col(c).try_cast("double").isNull() | (F.col(c).try_cast("double") == F.floor(F.col(c).try_cast("double")))).cast("int")).alias(f"_{c}") for c in columns]).first()
    for c in columns:
        if stats[c] is not None and stats[c] >= share:
            number = F.col(c).try_cast("double")
            df = df.withColumn(c, number.cast("long") if stats[f"_{c}"] == 1 else number)
    return df


def korap(df: DataFrame) -> Concordance:
    """KorAP matches with ``tokens.left``, ``tokens.match`` and ``tokens.right``, tab-separated; other columns are metadata."""
    cut = lambda c: F.transform(F.array_remove(F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), "\t"), ""), lambda w: F.struct(w.alias("word")))
    meta = [c for c in df.columns if not c.startswith("tokens.")]
    df = df.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered_from(df, ["_row"]).select("line_id", cut("tokens.left").alias("l"), cut("tokens.match").alias("n"), cut("tokens.right").alias("r"), *meta)
    return from_parts(rows, meta)


def cwb_lines(cpos: DataFrame, hits: DataFrame, left: int = 20, right: int = 20) -> Concordance:
    """Hits ``(match, matchend)`` in a corpus ``(cpos, word, ...)`` by global position, as a workbench gives them.

    Positions are joined by blocks of them, so a context meets one or two blocks and no other.
    """
    block = max(64, left + right)
    lines = numbered_from(hits, ["match", "matchend"])
    wanted = lines.select("line_id", "match", "matchend", F.explode(F.sequence(F.greatest(F.lit(0), F.col("match") - left), F.col("matchend") + right)).alias("cpos"))
    attributes = [c for c in cpos.columns if c != "cpos"]
    joined = wanted.withColumn("_b", F.floor(F.col("cpos") / block)).join(cpos.withColumn("_b", F.floor(F.col("cpos") / block)), ["_b", "cpos"])
    at = F.col("cpos")
    offset = F.when(at < F.col("match"), at - F.col("match")).when(at > F.col("matchend"), at - F.col("matchend")).otherwise(0)
    start = F.greatest(F.lit(0), F.col("match") - left)
    tokens = joined.select("line_id", (at - start).cast("int").alias("id_in_line"), offset.cast("int").alias("offset"), "cpos", *attributes)
    matches = lines.select("line_id", (F.col("match") - start).alias("match_start"), (F.col("matchend") - start).alias("match_end"), F.lit(0).alias("slot"))
    meta = [c for c in hits.columns if c not in ("match", "matchend")]
    return Concordance(lines.select("line_id", *meta), tokens, matches)


def wmatrix(spark: SparkSession, path: str, table: str = "corpus", file_col: str = "file") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens, sentence spans and file spans of a Wmatrix database. The file is read on the driver, a batch at a time."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError(f"no table name: {table!r}")
    with sqlite3.connect(path) as db:
        cursor = db.execute(f"SELECT * FROM {table} ORDER BY rowid")
        names = [d[0] for d in cursor.description]
        frames = None
        at = 0
        while batch := cursor.fetchmany(100_000):
            rows = [(at + k, *["" if v is None else str(v) for v in r]) for k, r in enumerate(batch)]
            at += len(rows)
            df = spark.createDataFrame(rows, ", ".join(["_row long", *[f"`{n}` string" for n in names]]))
            frames = df if frames is None else frames.unionByName(df)
    if frames is None:
        raise ValueError("the table is empty")
    return wmatrix_spans(frames, file_col)


def wmatrix_spans(rows: DataFrame, file_col: str = "file") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(_row, word, ..., file)`` with ``<s>`` and ``</s>`` rows: tokens with ``cpos``, sentences from the marks, files from runs.

    A file is one run of rows, so all but the sizes of files is done within them: rows that are spread by file stay
    where they are. Sentences are stored, as the numbers of files follow from them.
    """
    from pyspark.sql import Window

    per_file = Window.partitionBy(file_col).orderBy("_row")
    marked = rows.withColumn("s_id", F.sum(F.when(F.col("word") == "<s>", 1).otherwise(0)).over(per_file))
    real = marked.where(~F.col("word").isin("<s>", "</s>")).withColumn("_at", F.row_number().over(per_file) - 1)
    found = real.groupBy(file_col, "s_id").agg(F.min("_row").alias("_row"), F.min("_at").alias("start"), F.max("_at").alias("end")).persist()
    sizes = found.groupBy(file_col).agg(F.min("_row").alias("_row"), (F.max("end") + 1).cast("long").alias("_n"), F.count("*").alias("_m"), F.lit(1).alias("_one"))
    files = cumulated(sizes, [F.col("_row")], {"_skip": "_n", "_before": "_m", "id": "_one"})
    skip = files.select(F.col(file_col).alias("_file"), "_skip", "_before")
    tokens = real.join(skip, F.col(file_col).eqNullSafe(F.col("_file"))).withColumn("cpos", (F.col("_at") + F.col("_skip")).cast("long")).drop("_row", "_at", "_file", "_skip", "_before")
    place = F.row_number().over(Window.partitionBy(file_col).orderBy("start"))
    sentences = found.withColumn("_place", place).join(skip, F.col(file_col).eqNullSafe(F.col("_file")))
    at = lambda c: (F.col(c) + F.col("_skip")).cast("long").alias(c)
    sentences = sentences.select(file_col, "s_id", at("start"), at("end"), (F.col("_before") + F.col("_place") - 1).cast("long").alias("id"))
    return tokens, sentences, files.select(file_col, F.col("_skip").alias("start"), (F.col("_skip") + F.col("_n") - 1).alias("end"), "id")


def frequency_list(conc: Concordance, name: str, data: DataFrame, attribute: str, value: str, kind: str = "f", info: dict[str, Any] | None = None) -> None:
    """Register a tool's list: ``f`` (counts), ``rel_f`` (shares) or ``pmw`` (per million) under the attribute's name."""
    if kind not in ("f", "rel_f", "pmw"):
        raise ValueError(f"no frequency {kind!r}")
    conc.resources.register_frequency_list(name, data.select(F.col(attribute).alias("word"), F.col(value).alias(kind)), info)
