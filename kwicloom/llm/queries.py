"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as rules
from .byte_bpe import encode_decode
from .common import SPACE, WORD
from .exact_dedup import exact_dedup
from .language_id import identify
from .line_dedup import line_dedup
from .lm_score import compression_scores
from .ngram_join import ngram_join
from .packing import pack
from .quality_rules import quality_report
from .substring_blocks import substring_dedup
from .suffix_dedup import suffix_dedup


def vocabulary(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-domain: the documents labelled as of good quality."""
    return compression_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_exact_dedup, op3_byte_bpe, op4_lm_scoring, op5_line_dedup, op6_ngram_jaccard_join, op7_substring_dedup, op8_language_id, op9_quality_rules, op10_best_fit_packing)}

OP2_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, {sql_text(SPACE)}), lambda x: x <> '') AS w FROM d),
x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, c, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
l AS (SELECT doc_id, line, length(regexp_replace(line, {sql_text(SPACE)}, '', 'g')) AS solid FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, line, solid, solid > 0 AND (NOT regexp_matches(line, {sql_text(rules.SENTENCE_END)}) OR regexp_matches(line, {sql_text(rules.NAVIGATION)}) OR regexp_matches(line, {sql_text(rules.BOILERPLATE)})
  OR len(regexp_extract_all(line, {sql_text(rules.SYMBOLS)})) * 100 > solid * {rules.MAX_SYMBOL_PERCENT}
  OR len(regexp_extract_all(line, {sql_text(rules.MARKED)})) * 100 > len(regexp_extract_all(line, {sql_text(WORD)})) * {rules.MAX_MARKED_PERCENT}) AS fails FROM l),
s AS (SELECT doc_id, sum(solid)::BIGINT AS word_chars, count(*) FILTER (solid > 0) - count(DISTINCT line) FILTER (solid > 0) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(solid) FILTER (fails), 0)::BIGINT AS lost_chars FROM f GROUP BY 1),
m AS (SELECT d.doc_id, len(w.w) AS n_words, s.word_chars, len(regexp_extract_all(d.t, {sql_text(rules.SYMBOLS)})) AS n_symbols, s.n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words, s.n_failed_lines, s.lost_chars, len(list_distinct(w.w)) AS n_distinct_words
  FROM d JOIN w USING (doc_id) JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < {rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {rules.MAX_REPEAT_PERCENT} AS base_failed FROM m)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {rules.MAX_LOST_PERCENT} AS kept FROM v
"""

OP7_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {sql_text(SPACE)}), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
v AS (SELECT doc_id, i, word, md5(string_agg(word, ' ') OVER o) AS win, count(*) OVER o AS n FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT doc_id, i, word, n = 50 AND min(doc_id) OVER (PARTITION BY n = 50, win) < doc_id AS later FROM v),
c AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op7_substring_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL}
