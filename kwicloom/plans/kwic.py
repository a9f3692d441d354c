"""Sequence matching and keyword-in-context lines over token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..concordance import Concordance
from ..functions.ranking import globally
from ..sources.text import Corpus
from .cqp import Match, Not, Part, Region, condition, parse_or_words


def attributes_of(token: object) -> set[str]:
    """The token attributes that a predicate reads."""
    if isinstance(token, (Match, Region)):
        return {token.attr}
    if isinstance(token, Not):
        return attributes_of(token.item)
    return set().union(*map(attributes_of, getattr(token, "items", ())))


def match_starts(parts: list[Part], toks: Column, others: dict[str, Column] | None = None) -> Column:
    """The positions in a token array at which the sequence matches, without a join or shuffle.

    ``others``: arrays of further attributes, in step with ``toks``. Shifted slices are zipped, so that no lambda
    refers to an array itself.
    """
    k = len(parts)
    arrays = {"word": toks} | (others or {})
    names = sorted(set().union(*[attributes_of(p.token) for p in parts])) or ["word"]
    unknown = [n for n in names if n not in arrays]
    if unknown:
        raise ValueError(f"the corpus has no token attribute {unknown[0]!r}")
    many = F.greatest(F.size(toks) - (k - 1), F.lit(0))
    alone = k == 1 and len(names) == 1
    shifted = arrays[names[0]] if alone else F.arrays_zip(*[F.slice(arrays[n], j + 1, many).alias(f"t{j}_{n}") for j in range(k) for n in names])

    def at(x: Column, i: Column) -> Column:
        hit = F.lit(True)
        for j, part in enumerate(parts):
            hit = hit & condition(part.token, lambda name, j=j: x if alone else x[f"t{j}_{name}"])
        return F.when(hit, i)

    return F.array_compact(F.transform(shifted, at))


def matched(corpus: Corpus, parts: list[Part], *columns: Column | str) -> DataFrame:
    """Columns of the documents, exploded to one row per match ``m`` to ``m_end``."""
    starts = match_starts(parts, F.col("toks"), {n: F.col(n) for n in corpus.attributes})
    return corpus.docs.select(*columns, F.explode(starts).alias("m")).withColumn("m_end", F.col("m") + len(parts) - 1)


def matches(corpus: Corpus, query: str) -> DataFrame:
    """``(doc_id, m, m_end)``: the matches of a query, ends included. Quantifiers, labels and targets are read but not used."""
    return matched(corpus, parse_or_words(query), "doc_id")


def clipped(corpus: Corpus, parts: list[Part], left: int, right: int, limit: str | None, *columns: Column | str, kinds: list[str] | None = None, inner: Callable[..., list[Column]] | None = None) -> DataFrame:
    """``m``, ``m_end``, ``lo`` and ``hi``: matches and their contexts within the document or the span of kind ``limit``; no join, as spans are arrays of their document.

    ``inner(m, m_end, lo, hi)``: further columns of a match, which may read arrays of the document (and the spans of
    ``kinds``). They are made before matches become rows, so no row carries an array of its document. What they read
    has to be named twice at least, else Spark makes it anew for each match.
    """
    limited = limit not in (None, "file")
    docs = corpus.with_holders(sorted({*(kinds or []), *([limit] if limited else [])}))
    starts = match_starts(parts, F.col("toks"), {n: F.col(n) for n in corpus.attributes})

    def row(m: Column, first: Column, last: Column) -> Column:
        m_end = m + (len(parts) - 1)
        ends = m.alias("m"), m_end.alias("m_end"), F.greatest(first, m - left).alias("lo"), F.least(last, m_end + right).alias("hi")
        return F.struct(*ends, *(inner(m, m_end, ends[2], ends[3]) if inner else []))

    if limited:
        found = F.flatten(F.transform(starts, lambda m: F.transform(corpus.held(limit, m, m + (len(parts) - 1)), lambda s: row(m, s["start"], s["end"]))))
    else:
        found = F.transform(starts, lambda m: row(m, F.lit(0), F.size("toks") - 1))
    rows = docs.select(*columns, F.explode(found).alias("_row"))
    return rows.select("*", "_row.*").drop("_row")


def contexts(corpus: Corpus, query: str, left: int = 100, right: int = 100, limit: str | None = "s") -> DataFrame:
    """``(doc_id, m, m_end, lo, hi)``: matches and their contexts, clipped to the document or to the span of kind ``limit``.

    A match that no such span holds is left out.
    """
    return clipped(corpus, parse_or_words(query), left, right, limit, "doc_id")


def numbered(found: DataFrame) -> DataFrame:
    """Contexts with ``line_id`` from 0 in document and position order; only match rows are numbered, never tokens."""
    return globally(found, [F.col("doc_id"), F.col("m")], "line_id", rank=False).withColumn("line_id", F.col("line_id") - 1)


def kwic(corpus: Corpus, query: str, left: int = 20, right: int = 20, limit: str | None = None) -> DataFrame:
    """One row per match: ``doc_id, m, left_context, node, right_context`` and the metadata. One scan, no shuffle."""
    piece = lambda a, b: F.array_join(F.slice("toks", a + 1, F.greatest(b - a + 1, F.lit(0))), " ")
    inner = lambda m, m_end, lo, hi: [piece(lo, m - 1).alias("left_context"), piece(m, m_end).alias("node"), piece(m_end + 1, hi).alias("right_context")]
    rows = clipped(corpus, parse_or_words(query), left, right, limit, "doc_id", *corpus.metadata, inner=inner)
    return rows.select("doc_id", "m", "left_context", "node", "right_context", *corpus.metadata)


def collocates(corpus: Corpus, query: str, left: int = 5, right: int = 5) -> DataFrame:
    """``(word, f)``: how often each word stands in the windows of the matches, the node left out."""
    parts = parse_or_words(query)
    k = len(parts)
    rows = matched(corpus, parts, "toks")
    before = F.slice("toks", F.greatest(F.col("m") - left, F.lit(0)) + 1, F.least(F.col("m"), F.lit(left)))
    after = F.slice("toks", F.col("m") + k + 1, F.lit(right))
    return rows.select(F.explode(F.concat(before, after)).alias("word")).groupBy("word").agg(F.count("*").alias("f"))


def concordance(corpus: Corpus, query: str, left: int = 20, right: int = 20, limit: str | None = None, span_metadata: bool | list[str] = True, metadata: list[str] | None = None, keep: bool = True) -> Concordance:
    """The concordance of a query: lines, their tokens and matches as DataFrames.

    One scan: contexts are sliced where the match is found, and spans and metadata are taken from the same row.
    ``span_metadata``: whether, or for which kinds of spans, lines get the columns of the span that holds the match,
    as ``kind.column``; ``metadata``: documents' columns that lines get under their own names. ``keep``: lines are
    stored (in memory, or on disk beyond it), as numbering and every view read them; they are as many as matches.
    They are stored in parts by ``line_id``, so what is grouped or joined by line needs no exchange.
    """
    kinds = [k for k in corpus.span_kinds if k != "file"] if span_metadata is True else [k for k in span_metadata or [] if k != "file"]
    file_columns = corpus.metadata if span_metadata is True or "file" in (span_metadata or []) else []
    named = [F.col(c).alias(f"file.{c}") for c in file_columns] + [F.col(c) for c in metadata or []]
    arrays = [("word", F.col("toks")), *[(n, F.col(n)) for n in corpus.attributes]]
    names = [f"`file.{c}`" for c in file_columns] + list(metadata or [])

    def inner(m: Column, m_end: Column, lo: Column, hi: Column) -> list[Column]:
        size = F.least(hi - lo + 1, F.size("toks"))
        words = F.arrays_zip(*[F.slice(c, lo + 1, size).alias(name) for name, c in arrays]).alias("_words")
        return [words, *[F.get(corpus.held(k, m, m), F.lit(0)).alias(f"_s{i}") for i, k in enumerate(kinds)]]

    found = clipped(corpus, parse_or_words(query), left, right, limit, "doc_id", *named, kinds=kinds, inner=inner)
    found = found.select("doc_id", "m", "m_end", "lo", "hi", "_words", *[f"_s{i}" for i, _ in enumerate(kinds)], *names)
    lines = numbered(found.persist() if keep else found)
    if keep:
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lines = lines.repartition(parts, "line_id").persist()
        lines.count()  # from here on nothing reads what was found
        found.unpersist()

    def offset_of(cpos: Column) -> Column:
        return F.when(cpos < F.col("m"), cpos - F.col("m")).when(cpos > F.col("m_end"), cpos - F.col("m_end")).otherwise(0).cast("int")

    words = lines.select("line_id", "m", "m_end", "lo", F.posexplode("_words").alias("id_in_line", "_w"))
    cpos = F.col("lo") + F.col("id_in_line")
    tokens = words.select("line_id", "id_in_line", offset_of(cpos).alias("offset"), *[F.col("_w")[n].alias(n) for n, _ in arrays], cpos.alias("cpos"))
    token = lambda w, i: F.struct(i.alias("id_in_line"), offset_of(F.col("lo") + i).alias("offset"), *[w[n].alias(n) for n, _ in arrays])
    stored = (tokens, lines.select("line_id", F.transform("_words", token).alias("toks"))) if keep else None
    match_rows = lines.select("line_id", (F.col("m") - F.col("lo")).cast("long").alias("match_start"), (F.col("m_end") - F.col("lo")).cast("long").alias("match_end"), F.lit(0).alias("slot"))
    spans = [F.col(f"_s{i}")[c].alias(f"{k}.{c}") for i, k in enumerate(kinds) for c in corpus.span_columns(k)]
    meta = lines.select(
        "line_id", "doc_id", F.col("m").alias("original_match_start"), F.col("m_end").alias("original_match_end"), F.col("lo").alias("original_context_start"), F.col("hi").alias("original_context_end"), *names, *spans
    )
    return Concordance(meta, tokens, match_rows, info={"query": query}, stored=stored)
