"""Line-first quality cleaning. DataFrame operations only; every document is judged alone, without a shuffle.

Lines that fail a rule are taken out first; a document is rejected when too much of its text went with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, gram_hashes, text_of, unboxed, words_of

SYMBOLS = r"[#*$%&|<>]"
#: A line passes the punctuation rule when a sentence ends in it.
SENTENCE_END = r"""[.?!…:;]["'”’»)\]]*(?:[\x20\x09-\x0D]|$)"""
#: Two or more menu separators, or a lone menu entry.
NAVIGATION = r"(?i)(?:[|»›>•][^|»›>•\n]*){2,}|^[\x20\x09-\x0D]*(?:home|menu|next|previous|back|login|log in|sign in|sign up|search|share)[\x20\x09-\x0D.]*$"
BOILERPLATE = r"(?i)all rights reserved|cookie policy|use of cookies|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum|click here|subscribe to our"
#: A shouted or marked-up word: doubled exclamation or symbol marks at its end.
MARKED = r"[!#*$%&|<>]{2,}(?:[\x20\x09-\x0D]|$)"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_MARKED_PERCENT = 30


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails: no sentence end, navigation, boilerplate, or mostly marks."""
    solid = F.length(F.regexp_replace(line, SPACE, ""))
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    return (
        ~line.rlike(SENTENCE_END)
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE)
        | (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > solid * MAX_SYMBOL_PERCENT)
        | (F.regexp_count(line, F.lit(MARKED)) * 100 > n_words * MAX_MARKED_PERCENT)
    )


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``_q`` (a struct of all measures) added; internal columns start with ``_q``."""
    text = text_of(text_col)
    df = docs.withColumn("_qt", text)
    df = df.withColumn("_qw", words_of(F.col("_qt"))).withColumn("_qn", F.size("_qw"))
    df = df.withColumn("_qg", gram_hashes(F.col("_qw"), 3))
    df = df.withColumn("_qd", F.size(F.array_distinct("_qg")) < F.size("_qg"))
    df = df.withColumn("_qs", F.when(F.col("_qd"), F.array_sort(F.transform("_qg", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    pair = F.zip_with(F.col("_qs"), F.slice(F.col("_qs"), 2, F.greatest(F.size("_qs") - 1, F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    df = df.withColumn("_qr", F.when(F.col("_qd"), F.size(F.array_distinct(F.flatten(F.array_compact(pair))))).otherwise(0))
    df = df.withColumn("_ql", F.transform(F.split("_qt", "\n"), lambda line: F.struct(line.alias("line"), F.length(F.regexp_replace(line, SPACE, "")).alias("solid"))))
    df = df.withColumn("_ql", F.transform("_ql", lambda x: F.struct(x["line"].alias("line"), x["solid"].alias("solid"), ((x["solid"] > 0) & line_fails(x["line"])).alias("fails"))))
    df = df.withColumn("_qf", F.transform(F.filter("_ql", lambda x: x["solid"] > 0), lambda x: x["line"]))
    solid = F.aggregate("_ql", F.lit(0), lambda s, x: s + x["solid"])
    lost = F.aggregate("_ql", F.lit(0), lambda s, x: s + F.when(x["fails"], x["solid"]).otherwise(0))
    df = df.withColumn(
        "_q",
        F.struct(
            F.col("_qn").cast("long").alias("n_words"),
            solid.cast("long").alias("word_chars"),
            F.regexp_count("_qt", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("_qf") - F.size(F.array_distinct("_qf"))).cast("long").alias("n_dup_lines"),
            F.col("_qr").cast("long").alias("n_repeat_words"),
            F.size(F.filter("_ql", lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
            lost.cast("long").alias("lost_chars"),
            F.size(F.array_distinct("_qw")).cast("long").alias("n_distinct_words"),
        ),
    )
    return df


def verdicts(df: DataFrame) -> tuple[Column, Column]:
    """base_failed and kept, from ``_q``."""
    q = F.col("_q")
    base = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)
    kept = ~base & (q["lost_chars"] * 100 <= q["word_chars"] * MAX_LOST_PERCENT)
    return base, kept


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with all measures, ``base_failed`` and ``kept``.

    Null or empty text has no words: measures 0, base_failed true, kept false. Repeated rows are each
    reported, other columns are ignored, no rows give no rows. Repeated trigrams are compared by 64-bit hash within one document.
    """
    docs = docs.select(F.col(id_col).alias("_qid"), F.col(text_col).alias("_qtext"))
    df = measures(docs, "_qtext")
    base, kept = verdicts(df)
    return df.select(F.col("_qid").alias(id_col), "_q.*", base.alias("base_failed"), kept.alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without rejected documents and, in those kept, without failed lines; same columns.

    A document that loses no line keeps its text unchanged. ``n_chars`` follows the text if there is such a column.
    Null and empty texts are rejected; repeated rows are each judged; columns may have any names.
    """
    df = measures(boxed(docs, F.col(text_col).alias("_qtext")), "_qtext")
    # a generator, lest the filter on the verdict be moved before the measures and computes them once for each use
    df = df.select("_row", F.explode(F.array(F.struct("_q", "_ql"))).alias("_m")).select("_row", "_m.*")
    _, kept = verdicts(df)
    cleaned = F.array_join(F.transform(F.filter("_ql", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    own, lost = F.col("_row").getField(text_col), F.col("_q.n_failed_lines") > 0
    df = df.where(kept).withColumn("_new", F.when(lost, cleaned).otherwise(own))
    new = {text_col: F.col("_new")}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(lost, F.length("_new").cast(docs.schema[n_chars_col].dataType)).otherwise(F.col("_row").getField(n_chars_col))
    return unboxed(df, docs.columns, new)
