"""Text as a corpus: tokens, sentences and files, by Spark's own functions.

A document is one row; its tokens are an array, so sequence matching and contexts need neither a join nor a
shuffle. The relational form (one row per token) is a view of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Words with inner hyphens, or single other characters.
TOKEN = r"[\p{L}\p{N}_']+(?:-[\p{L}\p{N}_'’]+)*|[^\p{L}\p{N}_\s-]"
#: What ends a sentence, with its closing quotes and white space.
SENTENCE = r"""([.?!…]+["')\]]*\s+)"""


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def sentences_of(text: Column) -> Column:
    """The sentences of a text, without empty ones."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE, "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


@dataclass
class Corpus:
    """``docs``: doc_id, ``toks`` (an array of words, over the sentences in order), ``sents`` (sentence sizes in tokens) and metadata columns.

    ``attributes``: further columns, arrays in step with ``toks`` (lemma, pos, tag, ...). ``own_spans``: kinds of
    spans beside sentences and files, each a column of arrays of structs with ``start``, ``end`` and any others.
    """

    docs: DataFrame
    metadata: list[str]
    attributes: list[str] = field(default_factory=list)
    own_spans: list[str] = field(default_factory=list)

    @property
    def span_kinds(self) -> list[str]:
        return ["s", "file", *self.own_spans]

    def with_attribute(self, name: str, value: Callable[[Column], Column]) -> Corpus:
        """A token attribute that is a function of the word."""
        return replace(self, docs=self.docs.withColumn(name, F.transform("toks", value)), attributes=[*self.attributes, name])

    def tagged(self, tagger: Callable[[list[str]], list[dict[str, str]]], *names: str) -> Corpus:
        """Token attributes that a tagger gives the words of each document, all its words at once."""
        others = self.docs.columns
        schema = StructType([*self.docs.schema.fields, *[StructField(n, ArrayType(StringType())) for n in names]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [tagger(words or []) for words in batch.column("toks").to_pylist()]
                new = [pa.array([[t.get(n) for t in row] for row in rows], pa.list_(pa.string())) for n in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*others, *names])

        return replace(self, docs=self.docs.mapInArrow(run, schema), attributes=[*self.attributes, *names])

    def with_spans(self, kind: str, spans: Column) -> Corpus:
        """Spans of another kind: an array of structs with ``start`` and ``end`` (inclusive, in tokens) and further columns."""
        return replace(self, docs=self.docs.withColumn(kind, spans), own_spans=[*self.own_spans, kind])

    def span_array(self, kind: str) -> Column:
        """The spans of a kind as a column of ``docs``."""
        if kind == "file":
            return F.when(F.size("toks") > 0, F.array(F.named_struct(F.lit("id"), F.lit(0), F.lit("start"), F.lit(0), F.lit("end"), F.size("toks") - 1))).otherwise(F.array().cast("array<struct<id:int,start:int,end:int>>"))
        if kind in self.own_spans:
            return F.col(kind)
        if kind != "s":
            raise ValueError(f"no spans of kind {kind!r}")
        # one element a token, so no sum is made anew for each sentence
        first = F.flatten(F.transform(F.filter("sents", lambda n: n > 0), lambda n, k: F.transform(F.sequence(F.lit(1), n), lambda j: F.when(j == 1, F.struct(k.alias("id"), n.alias("n"))))))
        return F.array_compact(F.transform(first, lambda x, i: F.when(x.isNotNull(), F.struct(x["id"].alias("id"), i.alias("start"), (i + x["n"] - 1).alias("end")))))

    def with_holders(self, kinds: list[str]) -> DataFrame:
        """``docs`` with what ``held`` reads of each kind of spans: ``_at_s``, the sentence of each token, or the spans as ``_at_kind``."""
        docs = self.docs.select("*", *[self.span_array(k).alias(f"_at_{k}") for k in kinds])
        if "s" not in kinds:
            return docs
        return docs.withColumn("_at_s", F.flatten(F.transform("_at_s", lambda x: F.array_repeat(x, x["end"] - x["start"] + 1))))

    def held(self, kind: str, m: Column, m_end: Column) -> Column:
        """The spans of a kind that hold a match, as an array. The column is named twice, so that Spark keeps it instead of making it for each match."""
        at = F.col(f"_at_{kind}")
        if kind == "s":
            return F.when((m < F.size(at)) & (F.get(at, m)["end"] >= m_end), F.array(F.get(at, m))).otherwise(F.slice(at, 1, 0))
        return F.when(F.size(at) > 0, F.filter(at, lambda s: (s["start"] <= m) & (s["end"] >= m_end))).otherwise(F.slice(at, 1, 0))

    def span_columns(self, kind: str) -> list[str]:
        """What a line takes from its span: the number of a sentence, all columns but the ends of other spans."""
        if kind == "s":
            return ["id"]
        return [c for c in self.docs.schema[kind].dataType.elementType.names if c not in ("start", "end")]

    def tokens(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """``(doc_id, pos, word)`` and the other attributes, positions from 0; the range is within each document, both ends included."""
        if self.attributes:
            zipped = F.arrays_zip(F.col("toks").alias("word"), *self.attributes)
            out = self.docs.select("doc_id", F.posexplode(zipped).alias("pos", "_t")).select("doc_id", F.col("pos"), "_t.*")
        else:
            out = self.docs.select("doc_id", F.posexplode("toks").alias("pos", "word"))
        if first is not None:
            out = out.where(F.col("pos") >= first)
        return out if last is None else out.where(F.col("pos") <= last)

    def spans(self, kind: str = "s") -> DataFrame:
        """``(doc_id, id, start, end)`` with inclusive ends: sentences (``s``), whole documents (``file``) or spans of a further kind, with their columns."""
        if kind == "file":
            return self.docs.where(F.size("toks") > 0).select("doc_id", F.lit(0).alias("id"), F.lit(0).alias("start"), (F.size("toks") - 1).alias("end"), *self.metadata)
        if kind in self.own_spans:
            return self.docs.select("doc_id", F.explode(kind).alias("_span")).select("doc_id", "_span.*")
        return self.docs.select("doc_id", F.explode(self.span_array(kind)).alias("_span")).select("doc_id", "_span.id", "_span.start", "_span.end")

    def spans_covering(self, kind: str, doc_id: int, pos: int) -> DataFrame:
        return self.spans(kind).where((F.col("doc_id") == doc_id) & (F.col("start") <= pos) & (F.col("end") >= pos))

    def counts(self) -> DataFrame:
        return self.docs.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.size(F.filter("sents", lambda n: n > 0))), F.lit(0)).alias("sentences"))


def from_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sentences: bool = True) -> Corpus:
    """A corpus of a table of texts; all other columns become metadata."""
    metadata = [c for c in docs.columns if c not in (text_col, id_col)]
    if not sentences:
        return Corpus(docs.select(F.col(id_col).alias("doc_id"), tokens_of(F.col(text_col)).alias("toks"), F.array().cast("array<int>").alias("sents"), *metadata), metadata)
    split = docs.select(F.col(id_col).alias("doc_id"), F.transform(sentences_of(F.col(text_col)), tokens_of).alias("_s"), *metadata)
    return Corpus(split.select("doc_id", F.flatten("_s").alias("toks"), F.transform("_s", lambda x: F.size(x)).alias("sents"), *metadata), metadata)


def load_files(spark: SparkSession, *paths: str, pattern: str = "*.txt") -> Corpus:
    """Text files, folders searched recursively, one document each; ``path`` is metadata."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).format("text").option("wholetext", "true").load(list(paths))
    raw = raw.select(F.input_file_name().alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])
    from ..functions.ranking import globally

    numbered = globally(raw, [F.col("path")], "doc_id", rank=False).withColumn("doc_id", F.col("doc_id") - 1)
    return from_documents(numbered)
