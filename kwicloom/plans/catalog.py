"""The query catalogue: each operator over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, tree
from ..concordance import Concordance, with_offsets
from ..functions.ranking import globally
from ..operators import annotate, cluster, label, partition, rank, select, sort
from ..operators.grouping import Grouping
from ..sources.connectors import wmatrix_spans
from ..sources.text import Corpus, from_documents
from . import kwic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN = r"[\p{L}\p{N}_'']+(?:-[\p{L}\p{N}_''’]+)*|[^\p{L}\p{N}_\s-]"
TOKENS = f"t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS w FROM documents))"
LINES = f"""{TOKENS}, lines AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_id, doc_id, pos AS m FROM t WHERE word = 'and'),
k AS (SELECT l.line_id, l.doc_id, t.pos - l.m AS o, t.word, t.pos - greatest(l.m - 5, 0) AS i FROM lines l JOIN t ON t.doc_id = l.doc_id AND t.pos BETWEEN l.m - 5 AND l.m + 5)"""
META = "meta AS (SELECT l.line_id, d.lang, d.source, d.n_chars FROM lines l JOIN documents d USING (doc_id))"
AT1 = "v AS (SELECT l.line_id, coalesce(min(k.word), '') AS v FROM lines l LEFT JOIN k ON k.line_id = l.line_id AND k.o = 1 GROUP BY 1)"
RANDOM_KEY = "('0x' || substr(md5('42_' || line_id), 1, 8))::BIGINT"


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus(spark: SparkSession, sf_dir: str, sentences: bool = False) -> Corpus:
    """Documents; those of fewer files than cores are spread over the cores, as tokenising is what costs."""
    docs = documents(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    return from_documents(docs.repartition(cores) if len(docs.inputFiles()) < cores else docs, sentences=sentences)


def conc(spark: SparkSession, sf_dir: str) -> Concordance:
    """Lines of "and" with five tokens to either side."""
    found = kwic.concordance(corpus(spark, sf_dir), '"and"', 5, 5, span_metadata=False, metadata=["lang", "source", "n_chars"])
    found.metadata = found.metadata.select("line_id", "lang", "source", "n_chars")
    return found


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# Corpus and query language


@query(f"WITH {TOKENS} SELECT doc_id, pos::BIGINT AS pos, word FROM t")
def tokenize(spark, sf_dir):
    return longs(corpus(spark, sf_dir).tokens(), "pos")


SENTENCES = f"""s0 AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.?!…]+["'')\\]]*\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents),
s1 AS (SELECT doc_id, generate_subscripts(s, 1) AS k, len(regexp_extract_all(unnest(s), '{TOKEN}')) AS n FROM s0),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS id, (sum(n) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT - n AS a, (sum(n) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT - 1 AS b FROM s1 WHERE n > 0)"""


@query(f'WITH {SENTENCES} SELECT doc_id, id, a AS "start", b AS "end" FROM s')
def sentence_spans(spark, sf_dir):
    return longs(corpus(spark, sf_dir, True).spans("s"), "id", "start", "end")


@query(f"WITH {TOKENS} SELECT (SELECT count(*) FROM t) AS tokens, (SELECT count(*) FROM documents) AS documents")
def corpus_counts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.docs.agg(F.sum(F.size("toks")).cast("long").alias("tokens"), F.count("*").alias("documents"))


@query(f"""WITH {LINES} SELECT l.doc_id, l.m, coalesce(string_agg(k.word, ' ' ORDER BY k.o) FILTER (k.o < 0), '') AS left_context, 'and' AS node,
coalesce(string_agg(k.word, ' ' ORDER BY k.o) FILTER (k.o > 0), '') AS right_context, any_value(d.lang) AS lang, any_value(d.source) AS source
FROM lines l JOIN k USING (line_id) JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.doc_id, l.m""")
def kwic_lines(spark, sf_dir):
    return longs(kwic.kwic(corpus(spark, sf_dir), '"and"', 5, 5).drop("n_chars"), "m")


@query(f"WITH {LINES} SELECT word, count(*) AS f FROM k WHERE o <> 0 GROUP BY 1")
def kwic_collocates(spark, sf_dir):
    return kwic.collocates(corpus(spark, sf_dir), '"and"', 5, 5)


@query(f"""WITH {TOKENS}, x AS (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM t)
SELECT doc_id, pos AS m FROM x WHERE lower(word) = 'of' AND lower(w2) = 'the'""")
def seq_match_of_the(spark, sf_dir):
    return longs(kwic.matches(corpus(spark, sf_dir), "of the").select("doc_id", "m"), "m")


@query(f"""WITH {TOKENS}, x AS (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM t)
SELECT doc_id, pos AS m FROM x WHERE (word = 'of' OR word = 'in') AND w2 IS NOT NULL AND NOT regexp_full_match(w2, 'th.*')""")
def cqp_or_not(spark, sf_dir):
    return longs(kwic.matches(corpus(spark, sf_dir), '[word="of" | word="in"] [word!="th.*"]').select("doc_id", "m"), "m")


@query(f"WITH {TOKENS} SELECT doc_id, pos AS m FROM t WHERE regexp_full_match(word, '(?i)the.*(?:ing|ed)')")
def cqp_regex_ci(spark, sf_dir):
    return longs(kwic.matches(corpus(spark, sf_dir), '"the.*(?:ing|ed)" %c').select("doc_id", "m"), "m")


@query(f"WITH {TOKENS}, {SENTENCES} SELECT t.doc_id, t.pos AS m, greatest(s.a, t.pos - 10) AS lo, least(s.b, t.pos + 10) AS hi FROM t JOIN s ON s.doc_id = t.doc_id AND t.pos BETWEEN s.a AND s.b WHERE t.word = 'and'")
def span_limited_kwic(spark, sf_dir):
    return longs(kwic.contexts(corpus(spark, sf_dir, True), '"and"', 10, 10, "s").select("doc_id", "m", "lo", "hi"), "m", "lo", "hi")


KIND = "CASE WHEN regexp_full_match(word, '[0-9]+') THEN 'NUM' WHEN regexp_full_match(word, '[A-Z].*') THEN 'NAME' WHEN regexp_full_match(word, '.*ing') THEN 'VERB' ELSE '' END"


def attributed(spark: SparkSession, sf_dir: str) -> Corpus:
    """The documents with two more token attributes, and spans of 40 tokens that are numbered in ``no``."""
    kind = lambda w: F.when(w.rlike("^[0-9]+$"), "NUM").when(w.rlike("^[A-Z]"), "NAME").when(w.rlike("ing$"), "VERB").otherwise("")
    c = corpus(spark, sf_dir).with_attribute("pos", kind).with_attribute("lemma", F.lower)
    blocks = F.when(F.size("toks") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("toks") - 1) / 40).cast("int")), lambda b: F.struct((b * 40).alias("start"), (b * 40 + 39).alias("end"), b.alias("no"))))
    return c.with_spans("block", F.coalesce(blocks, F.array().cast("array<struct<start:int,end:int,no:int>>")))


@query(f"""WITH {TOKENS}, x AS (SELECT doc_id, pos, lower(word) AS lemma, {KIND} AS kind FROM t), y AS (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS k2 FROM x)
SELECT doc_id, pos AS m FROM y WHERE lemma IN ('the', 'of') AND regexp_full_match(k2, 'NA.*|VERB')""")
def cqp_pos(spark, sf_dir):
    return longs(kwic.matches(attributed(spark, sf_dir), '[lemma="the|of"] [pos="NA.*|VERB"]').select("doc_id", "m"), "m")


@query(f"WITH {TOKENS} SELECT doc_id, pos AS m FROM t WHERE {KIND} <> '' AND NOT regexp_full_match(lower(word), '[0-9]+|the')")
def cqp_region(spark, sf_dir):
    return longs(kwic.matches(attributed(spark, sf_dir), '[pos & !(lemma="[0-9]+" | lemma="the")]').select("doc_id", "m"), "m")


@query(f"WITH {TOKENS}, n AS (SELECT doc_id, max(pos) AS last FROM t GROUP BY 1) SELECT t.doc_id, t.pos AS m, greatest(t.pos // 40 * 40, t.pos - 10) AS lo, least(t.pos // 40 * 40 + 39, t.pos + 10) AS hi FROM t WHERE word = 'and'")
def span_limited_any(spark, sf_dir):
    return longs(kwic.contexts(attributed(spark, sf_dir), '"and"', 10, 10, "block").select("doc_id", "m", "lo", "hi"), "m", "lo", "hi")


@query(f"WITH {LINES}, x AS (SELECT *, {KIND} AS kind FROM k) SELECT l.line_id, l.m // 40 AS no, x.i AS id_in_line, lower(x.word) AS lemma, x.kind AS pos FROM lines l JOIN x USING (line_id)")
def concordance_attributes(spark, sf_dir):
    c = kwic.concordance(attributed(spark, sf_dir), '"and"', 5, 5, span_metadata=["block"])
    lines = c.metadata.select("line_id", F.col("`block.no`").alias("no"))
    return longs(c.tokens.join(lines, "line_id").select("line_id", "no", "id_in_line", "lemma", "pos"), "no", "id_in_line")


@query(f"WITH {LINES}, {SENTENCES} SELECT l.line_id, l.doc_id, s.id AS s_id, d.lang FROM lines l JOIN documents d USING (doc_id) LEFT JOIN s ON s.doc_id = l.doc_id AND l.m BETWEEN s.a AND s.b")
def span_metadata_join(spark, sf_dir):
    c = kwic.concordance(corpus(spark, sf_dir, True), '"and"', 5, 5)
    return longs(c.metadata.select("line_id", "doc_id", F.col("`s.id`").alias("s_id"), F.col("`file.lang`").alias("lang")), "s_id")


@query(f'WITH {LINES} SELECT line_id, i AS id_in_line, o AS "offset", word FROM k')
def offsets_from_matches(spark, sf_dir):
    c = conc(spark, sf_dir)
    return longs(with_offsets(c.tokens, c.matches).select("line_id", "id_in_line", "offset", "word"), "id_in_line", "offset")


@query(f"""WITH {LINES}, z AS (SELECT line_id, i AS at FROM k WHERE o = 0)
SELECT k.line_id, k.i AS id_in_line, CASE WHEN k.i < z.at + 1 THEN k.i - z.at - 1 WHEN k.i > z.at + 2 THEN k.i - z.at - 2 ELSE 0 END AS "offset" FROM k JOIN z USING (line_id)""")
def slot_offsets(spark, sf_dir):
    c = conc(spark, sf_dir)
    second = c.matches.select("line_id", (F.col("match_start") + 1).alias("match_start"), (F.col("match_end") + 2).alias("match_end"), F.lit(1).alias("slot"))
    c.matches = c.matches.unionByName(second)
    node = c.root.add_subset_node(("Select Slot", {"slot_id": 1}))
    return longs(node.subset().tokens.select("line_id", "id_in_line", "offset"), "id_in_line", "offset")


@query(f"""WITH {LINES} SELECT l.line_id, coalesce(string_agg(k.word, ' ' ORDER BY k.o) FILTER (k.o < 0), '') AS left_context, string_agg(k.word, ' ' ORDER BY k.o) FILTER (k.o = 0) AS kwic,
coalesce(string_agg(k.word, ' ' ORDER BY k.o) FILTER (k.o > 0), '') AS right_context FROM lines l JOIN k USING (line_id) GROUP BY 1""")
def kwic_tripartite(spark, sf_dir):
    return sinks.tripartite(conc(spark, sf_dir).tokens)


# Frequency lists and association


@query(f"WITH {LINES} SELECT word, count(*) AS f FROM k WHERE o <> 0 GROUP BY 1")
def freq_list(spark, sf_dir):
    c = conc(spark, sf_dir)
    c.add_annotation(("Annotate with Token-Level Frequency List", {}), ["list"])
    return c.resources.get_frequency_list("list", columns=["word", "f"])


@query(f"WITH {LINES}, g AS (SELECT word, count(*) AS f FROM k WHERE o <> 0 GROUP BY 1) SELECT word, f, round(1e6 * f / sum(f) OVER (), 6) AS pmw, round(f / sum(f) OVER (), 9) AS rel_f FROM g")
def freq_list_pmw(spark, sf_dir):
    c = conc(spark, sf_dir)
    c.add_annotation(("Annotate with Token-Level Frequency List", {}), ["list"])
    return c.resources.get_frequency_list("list").select("word", "f", F.round("pmw", 6).alias("pmw"), F.round("rel_f", 9).alias("rel_f"))


@query(f"WITH {LINES} SELECT lower(word) AS word, count(*) AS f FROM k WHERE o <> 0 GROUP BY 1")
def freq_list_grouped(spark, sf_dir):
    c = conc(spark, sf_dir)
    c.add_annotation(("Annotate with Token-Level Frequency List", {}), ["list"])
    return c.resources.get_frequency_list("list", ignore_case=True, columns=["word", "f"])


SCORES = f"""{LINES}, g AS (SELECT lower(word) AS word, count(*)::DOUBLE AS obs FROM k WHERE o <> 0 GROUP BY 1), cf AS (SELECT lower(word) AS word, count(*) / (SELECT count(*) FROM t) AS rel_f FROM t GROUP BY 1),
sc AS (SELECT word, obs, rel_f * (SELECT sum(obs) FROM g) AS ex FROM g JOIN cf USING (word)),
scores AS (SELECT word, obs, ex, log2(obs / ex) AS mi, log2(obs ** 3 / ex) AS mi3, obs * log2(obs / ex) AS lmi, sign(log2(obs / ex)) * ln(1 + abs(obs * log2(obs / ex))) AS llmi, (obs - ex) / sqrt(ex) AS z, (obs - ex) / sqrt(obs) AS ts, 2 * (obs * ln(obs / ex) - (obs - ex)) AS ll FROM sc)"""


def scored(spark: SparkSession, sf_dir: str) -> Concordance:
    c = conc(spark, sf_dir)
    c.add_annotation(("Annotate with Token-Level Frequency List", {}), ["list"])
    words = corpus(spark, sf_dir).tokens().groupBy("word").agg(F.count("*").alias("f"))
    c.resources.register_frequency_list("corpus", words)
    c.add_annotation(("Annotate Association Scores", {"corpus_frequency_list": "corpus", "concordance_frequency_list": "list"}), ["scores"])
    return c


@query(f'WITH {SCORES} SELECT word, round(mi, 6) AS "MI", round(mi3, 6) AS "MI3", round(lmi, 5) AS "local_MI", round(llmi, 6) AS "log_local_MI", round(z, 6) AS z_score, round(ts, 6) AS t_score, round(ll, 5) AS simple_ll FROM scores')
def association_scores(spark, sf_dir):
    s = scored(spark, sf_dir).resources.get_scores("scores")
    digits = {"local_MI": 5, "simple_ll": 5}
    return s.select("word", *[F.round(c, digits.get(c, 6)).alias(c) for c in ("MI", "MI3", "local_MI", "log_local_MI", "z_score", "t_score", "simple_ll")])


RANKED = "SELECT l.line_id, round(coalesce({agg}, 0), 5) AS score FROM lines l LEFT JOIN (SELECT k.line_id, s.{v} AS v FROM k JOIN {s} s ON s.word = lower(k.word) WHERE k.o <> 0) x USING (line_id) GROUP BY 1"


def score(keys: DataFrame, digits: int = 5) -> DataFrame:
    return keys.select("line_id", F.round(F.col("key").cast("double"), digits).alias("score"))


@query(f"WITH {SCORES}, p AS (SELECT * FROM scores WHERE llmi > 0) " + RANKED.format(agg="sum(v)", v="llmi", s="p"))
def rank_collocations_sum(spark, sf_dir):
    return score(rank.rank_by_collocations(scored(spark, sf_dir).view(), "scores")[0])


@query(f"WITH {SCORES}, p AS (SELECT * FROM scores WHERE z > 0) " + RANKED.format(agg="count(v)::DOUBLE", v="z", s="p"))
def rank_collocations_count(spark, sf_dir):
    return score(rank.rank_by_collocations(scored(spark, sf_dir).view(), "scores", score_column="z_score", method="count")[0])


@query(f"WITH {SCORES}, p AS (SELECT word, obs FROM scores WHERE obs > 0 ORDER BY obs DESC, word LIMIT 50) " + RANKED.format(agg="sum(v)", v="obs", s="p"))
def rank_collocations_topn(spark, sf_dir):
    return score(rank.rank_by_collocations(scored(spark, sf_dir).view(), "scores", score_column="O", top_n=50)[0])


def grouper(what: str, cond: str) -> str:
    return f"WITH {LINES} SELECT l.line_id, count({what}) FILTER (k.o <> 0 AND {cond}) AS score FROM lines l JOIN k USING (line_id) GROUP BY 1"



def whole(keys: DataFrame) -> DataFrame:
    return keys.select("line_id", F.col("key").cast("long").alias("score"))


@query(grouper(what="DISTINCT lower(k.word)", cond="lower(k.word) IN ('the', 'of', 'in')"))
def rank_kwic_grouper_literal(spark, sf_dir):
    return whole(rank.rank_kwic_grouper(conc(spark, sf_dir).view(), ["the", "of", "In"])[0])


@query(grouper(what="DISTINCT lower(k.word)", cond="regexp_full_match(k.word, '(?i)th.*|.*ing')"))
def rank_kwic_grouper_regex(spark, sf_dir):
    return whole(rank.rank_kwic_grouper(conc(spark, sf_dir).view(), ["th.*", ".*ing"], mode="regex")[0])


@query(grouper(what="*", cond="k.o BETWEEN -3 AND 3 AND k.word IN ('the', 'of')"))
def rank_kwic_grouper_tokens(spark, sf_dir):
    return whole(rank.rank_kwic_grouper(conc(spark, sf_dir).view(), ["the", "of"], case_sensitive=True, window_start=-3, window_end=3, count_types=False)[0])


@query(grouper(what="DISTINCT lower(k.word)", cond="(regexp_full_match(k.word, 'th.*') AND k.word <> 'the')"))
def rank_kwic_grouper_cqp(spark, sf_dir):
    return whole(rank.rank_kwic_grouper(conc(spark, sf_dir).view(), ['[word="th.*" & word!="the"]'], mode="cqp")[0])


@query(f"""WITH {LINES}, c AS (SELECT lower(word) AS word, count(*) AS f FROM t GROUP BY 1), r AS (SELECT word, f, row_number() OVER (ORDER BY f DESC, word) AS r FROM c)
SELECT l.line_id, -(count(*) FILTER (r.f < 20 OR r.r > 500)) AS score FROM lines l JOIN k USING (line_id) JOIN r ON r.word = lower(k.word) GROUP BY 1""")
def rank_rare_words(spark, sf_dir):
    c = conc(spark, sf_dir)
    c.resources.register_frequency_list("corpus", corpus(spark, sf_dir).tokens().groupBy("word").agg(F.count("*").alias("f")))
    return whole(rank.rank_number_of_rare_words(c.view(), "corpus", frequency_type="f", threshold=20, rank_threshold=500)[0])


# Selecting


@query(f"WITH {LINES}, {META} SELECT line_id FROM meta WHERE lower(source) = 'src3'")
def select_metadata_equal(spark, sf_dir):
    return select.select_by_metadata_attribute(conc(spark, sf_dir).view(), "source", "SRC3")[0]


@query(f"WITH {LINES}, {META} SELECT line_id FROM meta WHERE source IN ('src1', 'src2')")
def select_metadata_list(spark, sf_dir):
    return select.select_by_metadata_attribute(conc(spark, sf_dir).view(), "source", ["src1", "src2"], case_sensitive=True)[0]


@query(f"WITH {LINES}, {META} SELECT line_id FROM meta WHERE n_chars >= 2000")
def select_metadata_numeric(spark, sf_dir):
    return select.select_by_metadata_attribute(conc(spark, sf_dir).view(), "n_chars", 2000, operator=">=")[0]


@query(f"WITH {LINES}, {META} SELECT line_id FROM meta WHERE NOT regexp_matches(source, '(?i)SRC1[0-5]?$')")
def select_metadata_regex_negative(spark, sf_dir):
    return select.select_by_metadata_attribute(conc(spark, sf_dir).view(), "source", "SRC1[0-5]?$", regex=True, negative=True)[0]


@query(f"WITH {LINES}, {AT1} SELECT line_id FROM v WHERE lower(v) IN ('the', 'of')")
def select_token_string(spark, sf_dir):
    return select.select_by_token_string(conc(spark, sf_dir).view(), ["The", "of"], offset=1)[0]


@query(f"WITH {LINES}, {AT1} SELECT line_id FROM v WHERE regexp_matches(v, '^th|ing$')")
def select_token_regex(spark, sf_dir):
    return select.select_by_token_string(conc(spark, sf_dir).view(), ["^th", "ing$"], offset=1, regex=True, case_sensitive=True)[0]


@query(f"WITH {LINES}, {AT1} SELECT line_id FROM v WHERE lower(v) <> 'the'")
def select_token_negative(spark, sf_dir):
    return select.select_by_token_string(conc(spark, sf_dir).view(), ["the"], offset=1, negative=True)[0]


@query(f"WITH {LINES}, {AT1} SELECT line_id FROM v WHERE v <> '' AND length(v) > 6")
def select_token_numeric(spark, sf_dir):
    c = conc(spark, sf_dir)
    c.tokens = c.tokens.withColumn("len", F.length("word"))
    return select.select_by_token_numeric_value(c.view(), 6, "len", offset=1, comparison_operator=">")[0]


@query(grouper(what="DISTINCT lower(k.word)", cond="lower(k.word) IN ('the', 'of')") + " HAVING score >= 2")
def select_by_rank(spark, sf_dir):
    node = conc(spark, sf_dir).root.add_arrangement_node([("KWIC Grouper Ranker", {"search_terms": ["the", "of"]})])
    lines = node.add_subset_node(("Select by Rank", {"comparison_operator": ">=", "value": 2})).lines()
    return lines.join(whole(node.rank_keys[0]), "line_id")


@query(f"WITH {LINES}, {META} SELECT line_id FROM meta WHERE lang = 'en' OR line_id IN (1, 2, 3)")
def manual_by_group(spark, sf_dir):
    node = conc(spark, sf_dir).root.add_arrangement_node(grouping=("Partition by Metadata Attribute", {"metadata_attribute": "lang"}))
    return node.add_subset_node(("Manual Line Selection", {"line_ids": [1, 2, 3], "groups": ["en"]})).lines()


@query(f"""WITH {LINES}, {META}, {AT1}, a AS (SELECT line_id FROM v WHERE lower(v) = 'the'), b AS (SELECT line_id FROM meta WHERE source IN ('src1', 'src2', 'src3'))
SELECT 'complement' AS op, line_id FROM lines WHERE line_id NOT IN (FROM a UNION FROM b) UNION ALL SELECT 'difference', line_id FROM a WHERE line_id NOT IN (FROM b)
UNION ALL SELECT 'disjunctive union', line_id FROM ((FROM a EXCEPT FROM b) UNION (FROM b EXCEPT FROM a)) UNION ALL SELECT 'intersection', line_id FROM a WHERE line_id IN (FROM b) UNION ALL SELECT 'union', line_id FROM (FROM a UNION FROM b)""")
def set_operations(spark, sf_dir):
    root = conc(spark, sf_dir).root
    a = root.add_subset_node(("Select by Token-Level String Attribute", {"search_terms": ["the"], "offset": 1}))
    b = root.add_subset_node(("Select by Metadata Attribute", {"metadata_attribute": "source", "value": ["src1", "src2", "src3"]}))
    out = None
    for op in select.SET_OPERATIONS:
        lines = root.add_subset_node(("Set Operation", {"operation": op, "node_ids": [a.id, b.id]})).lines().select(F.lit(op).alias("op"), "line_id")
        out = lines if out is None else out.union(lines)
    return out


@query()
def sample_seeded(spark, sf_dir):
    return select.select_random(conc(spark, sf_dir).view(), 50, 42)[0]


@query(f"WITH {LINES}, r AS (SELECT line_id, row_number() OVER (ORDER BY {RANDOM_KEY}, line_id) AS r FROM lines) SELECT line_id FROM r WHERE r <= 50")
def sample_md5(spark, sf_dir):
    node = conc(spark, sf_dir).root.add_arrangement_node([("Random Sort", {})])
    return node.add_subset_node(("Select by Sort", {"comparison_operator": "<=", "value": 50})).lines()


@query()
def sample_stratified(spark, sf_dir):
    c = conc(spark, sf_dir)
    chosen = select.select_weighted_sample_by_metadata(c.view(), "source", 100)[0]
    return c.metadata.join(chosen, "line_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


# Sorting and combining


def ranks(keys: DataFrame) -> DataFrame:
    return keys.select("line_id", F.col("key").cast("long").alias("rank"))


@query(f"WITH {LINES} SELECT line_id, row_number() OVER (ORDER BY line_id) AS rank FROM lines")
def sort_corpus(spark, sf_dir):
    return ranks(sort.sort_by_corpus_position(conc(spark, sf_dir).view())[0])


@query(f"WITH {LINES} SELECT line_id, row_number() OVER (ORDER BY {RANDOM_KEY}, line_id) AS rank FROM lines")
def sort_random(spark, sf_dir):
    return ranks(sort.sort_random(conc(spark, sf_dir).view())[0])


@query(f"WITH {LINES}, {AT1} SELECT line_id, rank() OVER (ORDER BY lower(v)) AS rank FROM v")
def sort_token(spark, sf_dir):
    return ranks(sort.sort_by_token_attribute(conc(spark, sf_dir).view(), offset=1, locale_str="")[0])


SIDE = "v AS (SELECT l.line_id, lower(coalesce(string_agg(k.word, ' ' ORDER BY abs(k.o)) FILTER (k.o {op} 0), '')) AS v FROM lines l JOIN k USING (line_id) GROUP BY 1)"


@query(f"WITH {LINES}, {SIDE.format(op='<')} SELECT line_id, rank() OVER (ORDER BY v) AS rank FROM v")
def sort_left(spark, sf_dir):
    return ranks(sort.sort_by_token_attribute(conc(spark, sf_dir).view(), sorting_scope="left", locale_str="")[0])


@query(f"WITH {LINES}, {SIDE.format(op='>')} SELECT line_id, rank() OVER (ORDER BY v DESC) AS rank FROM v")
def sort_right_reverse(spark, sf_dir):
    return ranks(sort.sort_by_token_attribute(conc(spark, sf_dir).view(), sorting_scope="right", reverse=True, locale_str="")[0])


@query(f"WITH {LINES}, {AT1} SELECT line_id, rank() OVER (ORDER BY reverse(lower(v))) AS rank FROM v")
def sort_backwards(spark, sf_dir):
    return ranks(sort.sort_by_token_attribute(conc(spark, sf_dir).view(), offset=1, backwards=True, locale_str="")[0])


@query(f"WITH {LINES}, {AT1} SELECT line_id, rank() OVER (ORDER BY v COLLATE en, v) AS rank FROM v")
def sort_locale(spark, sf_dir):
    return ranks(sort.sort_by_token_attribute(conc(spark, sf_dir).view(), offset=1, case_sensitive=True)[0])


COMBINED = f"""{LINES}, {AT1}, g AS (SELECT l.line_id, count(DISTINCT lower(k.word)) FILTER (k.o <> 0 AND lower(k.word) IN ('the', 'of', 'in')) AS c FROM lines l JOIN k USING (line_id) GROUP BY 1),
w AS (SELECT line_id, -c AS k0, rank() OVER (ORDER BY lower(v)) AS k1 FROM v JOIN g USING (line_id)), r AS (SELECT line_id, k0, k1, rank() OVER (ORDER BY k0, k1) AS rank FROM w)"""
ORDERING = [("KWIC Grouper Ranker", {"search_terms": ["the", "of", "in"]}), ("Sort by Token-Level Attribute", {"offset": 1, "locale_str": ""})]


@query(f"WITH {COMBINED} SELECT line_id, rank FROM r")
def order_combined(spark, sf_dir):
    return conc(spark, sf_dir).root.add_arrangement_node(ORDERING).ordering.select("line_id", "rank")


@query(f"""WITH {COMBINED}, d AS (SELECT DISTINCT k0, k1 FROM r), x AS (SELECT k0, k1, lag(k0) OVER (ORDER BY k0, k1) AS p0 FROM d)
SELECT count(*) FILTER (p0 IS NOT NULL AND p0 <> k0) AS algo_0, count(*) FILTER (p0 = k0) AS algo_1 FROM x""")
def order_differentiation(spark, sf_dir):
    info = conc(spark, sf_dir).root.add_arrangement_node(ORDERING).differentiation_info()
    return spark.createDataFrame([(info["algo_0"], info["algo_1"])], "algo_0 long, algo_1 long")


@query(f"WITH {COMBINED}, {META} SELECT line_id, rank() OVER (ORDER BY rank) AS rank FROM r JOIN meta USING (line_id) WHERE source = 'src3'")
def subset_reranked(spark, sf_dir):
    node = conc(spark, sf_dir).root.add_arrangement_node(ORDERING)
    return node.add_subset_node(("Select by Metadata Attribute", {"metadata_attribute": "source", "value": "src3"})).ordering.select("line_id", "rank")


# Grouping and labelling


def grouped(g: Grouping) -> DataFrame:
    return g.members.join(g.groups.select("id", "label"), "id").select("id", "label", "line_id")


@query(f"WITH {LINES}, {META}, g AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS id FROM meta GROUP BY 1) SELECT id, source AS label, line_id FROM meta JOIN g USING (source)")
def partition_metadata(spark, sf_dir):
    return grouped(partition.partition_by_metadata_attribute(conc(spark, sf_dir).view(), "source"))


@query(f"""WITH {LINES}, x AS (SELECT line_id, list_transform(list(lower(word) ORDER BY o), lambda w: CASE WHEN contains(w, '''') THEN '"' || w || '"' ELSE '''' || w || '''' END) AS g FROM k WHERE o IN (1, 2) GROUP BY 1),
y AS (SELECT line_id, '(' || array_to_string(g, ', ') || CASE WHEN len(g) = 1 THEN ',)' ELSE ')' END AS label FROM x), g AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS id FROM y GROUP BY 1) SELECT id, label, line_id FROM y JOIN g USING (label)""")
def partition_ngrams(spark, sf_dir):
    return grouped(partition.partition_ngrams(conc(spark, sf_dir).view(), [1, 2]))


TREE = f"""{LINES}, p AS (SELECT l.line_id, [coalesce(max(lower(k.word)) FILTER (k.o = 1), ''), coalesce(max(lower(k.word)) FILTER (k.o = 2), ''), coalesce(max(lower(k.word)) FILTER (k.o = 3), '')] AS p FROM lines l JOIN k USING (line_id) GROUP BY 1),
u AS (SELECT line_id, d, array_to_string(p[1:d], chr(1)) AS key, p[d + 1] AS tok FROM p, range(0, 3) AS r(d)), nodes AS (SELECT d, key, count(*) AS n FROM u GROUP BY ALL HAVING d = 0 OR n >= 3)"""


@query(f"WITH {TREE} SELECT CASE WHEN d = 0 THEN 'root' ELSE replace(key, chr(1), ' ') END AS label, d + 1 AS level, n FROM nodes")
def context_tree_nodes(spark, sf_dir):
    g = cluster.cluster_context_tree(conc(spark, sf_dir).view(), min_cluster_size=3, max_depth=3)
    return longs(g.groups.select("label", "level", F.col("size").alias("n")), "level")


@query(f"""WITH {TREE}, c AS (SELECT d, key, tok, count(*) AS c FROM u GROUP BY ALL), b AS (SELECT d, key, max(c) AS top FROM c GROUP BY ALL)
SELECT CASE WHEN d = 0 THEN 'root' ELSE replace(key, chr(1), ' ') END AS label, line_id, round(c / top, 6) AS prototypicality FROM u JOIN nodes USING (d, key) JOIN c USING (d, key, tok) JOIN b USING (d, key)""")
def context_tree_prototypicality(spark, sf_dir):
    g = cluster.cluster_context_tree(conc(spark, sf_dir).view(), min_cluster_size=3, max_depth=3)
    return g.members.join(g.groups.select("id", "label"), "id").select("label", "line_id", F.round("prototypicality", 6).alias("prototypicality"))


@query(f"""WITH {LINES}, terms AS (SELECT line_id, unnest(regexp_extract_all(lower(word), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+')) AS term FROM k), tf AS (SELECT line_id, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT line_id, term, tf * (ln((1 + (SELECT count(*) FROM lines)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
SELECT line_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY line_id)), 6) AS w FROM w""")
def tfidf(spark, sf_dir):
    view = conc(spark, sf_dir).view()
    return annotate.tfidf_long(annotate.line_texts(view, "word", -5, 5, True)).select("line_id", "term", F.round("w", 6).alias("w"))


@query(f"""WITH {LINES}, {META}, c AS (SELECT lang, lower(word) AS word, count(*) AS f1 FROM k JOIN meta USING (line_id) WHERE o <> 0 GROUP BY ALL), s AS (SELECT lang, sum(f1) AS n1 FROM c GROUP BY 1)
SELECT lang AS label, word, f1, (sum(f1) OVER (PARTITION BY word) - f1)::BIGINT AS f2, n1::BIGINT AS n1, ((SELECT sum(n1) FROM s) - n1)::BIGINT AS n2 FROM c JOIN s USING (lang)""")
def lrc_counts(spark, sf_dir):
    view = conc(spark, sf_dir).view()
    g = partition.partition_by_metadata_attribute(view, "lang")
    return label.keyword_counts(view, g).join(g.groups.select("id", "label"), "id").select("label", "word", "f1", "f2", "n1", "n2")


@query()
def lrc_labels(spark, sf_dir):
    view = conc(spark, sf_dir).view()
    return label.label_lrc_keywords(view, partition.partition_by_metadata_attribute(view, "source"))


@query(f"WITH {LINES}, {META} SELECT source, chr((64 + row_number() OVER (ORDER BY count(*) DESC, source))::INT) AS letter FROM meta GROUP BY 1")
def label_letters(spark, sf_dir):
    view = conc(spark, sf_dir).view()
    g = partition.partition_by_metadata_attribute(view, "source")
    return label.label_sequential_letters(view, g).join(g.groups, "id").select(F.col("label").alias("source"), F.col("new_label").alias("letter"))


@query(f"""WITH {LINES} SELECT 'A' AS category, line_id, i AS start_id_in_line, i AS end_id_in_line FROM k WHERE o <> 0 AND lower(word) IN ('the', 'of', 'in') UNION ALL SELECT 'B', line_id, min(i), max(i) FROM k WHERE o = 1 GROUP BY line_id""")
def span_relabel(spark, sf_dir):
    node = conc(spark, sf_dir).root.add_arrangement_node(ORDERING)
    return longs(node.spans.select("category", "line_id", "start_id_in_line", "end_id_in_line"), "start_id_in_line", "end_id_in_line")


def vectors(spark: SparkSession, sf_dir: str) -> Concordance:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lines = e.select(F.col("vec_id").alias("line_id"), "embedding", "label")
    tokens = lines.select("line_id", F.lit(0).alias("id_in_line"), F.lit(0).alias("offset"), F.col("label").cast("string").alias("word"))
    return Concordance(lines, tokens, lines.select("line_id", F.lit(0).cast("long").alias("match_start"), F.lit(0).cast("long").alias("match_end"), F.lit(0).alias("slot")))


@query()
def cluster_kmeans(spark, sf_dir):
    return grouped(partition.partition_by_embeddings(vectors(spark, sf_dir).view(), "embedding", 10))


@query()
def cluster_agglomerative(spark, sf_dir):
    return grouped(partition.partition_by_embeddings(vectors(spark, sf_dir).view(), "embedding", 10, method="agglomerative"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS d FROM e a, e b)
SELECT vec_id AS line_id, count(*) AS n FROM x WHERE d <= 0.7 GROUP BY 1 HAVING n >= 5""")
def dbscan_core_points(spark, sf_dir):
    lines = vectors(spark, sf_dir).metadata.select("line_id", F.col("embedding").cast("array<double>").alias("v"))
    return cluster.core_points(lines, 0.7, 5)


@query()
def cluster_hierarchical(spark, sf_dir):
    return grouped(cluster.clustering_hierarchical_embeddings(vectors(spark, sf_dir).view(), "embedding", depth=2))


@query()
def cluster_random(spark, sf_dir):
    return grouped(cluster.clustering_random(vectors(spark, sf_dir).view()))


# Other sources and sinks


@query(f"""WITH t AS (SELECT conv_id, turn, role, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '{TOKEN}') AS w FROM conversations))
SELECT role, b.word, count(*) AS f FROM t a JOIN t b USING (conv_id, turn, role) WHERE a.word = 'the' AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND b.pos <> a.pos GROUP BY 1, 2""")
def turns_by_role_kwic(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "role", "text")
    c = kwic.kwic(from_documents(turns, sentences=False), '"the"', 3, 3)
    return c.select("role", F.explode(F.array_remove(F.concat(F.split("left_context", " "), F.split("right_context", " ")), "")).alias("word")).groupBy("role", "word").agg(F.count("*").alias("f"))


@query(f"""WITH {TOKENS}, {SENTENCES}, n AS (SELECT doc_id, coalesce(sum(count(*)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip FROM t GROUP BY 1)
SELECT row_number() OVER (ORDER BY skip + a) - 1 AS id, skip + a AS "start", skip + b AS "end" FROM s JOIN n USING (doc_id)""")
def wmatrix_sentences(spark, sf_dir):
    """Sentence spans rebuilt from a table of words with marks, as an annotation tool exports it, each document a file."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    order = globally(docs.select("doc_id").distinct(), [F.col("doc_id")], "_file", rank=False)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 2000)
    spread = docs.repartition(parts, "doc_id").join(order, "doc_id")  # each file's rows stay in one part
    c = from_documents(spread)
    words = F.transform(c.span_array("s"), lambda s: F.concat(F.array(F.lit("<s>")), F.slice("toks", s["start"] + 1, F.least(s["end"] - s["start"] + 1, F.size("toks"))), F.array(F.lit("</s>"))))
    rows = c.docs.select("doc_id", "_file", F.posexplode(F.flatten(words)).alias("_at", "word"))
    rows = rows.select((F.col("_file") * (1 << 32) + F.col("_at")).alias("_row"), "word", F.col("doc_id").alias("file"))
    return longs(wmatrix_spans(rows)[1].select("id", "start", "end"), "start", "end")


@query()
def view_csv_frame(spark, sf_dir):
    node = conc(spark, sf_dir).root.add_arrangement_node(ORDERING, ("Partition by Metadata Attribute", {"metadata_attribute": "lang"}))
    return sinks.view_frame(node).drop("ord")


@query()
def tree_template(spark, sf_dir):
    c = conc(spark, sf_dir)
    c.root.add_arrangement_node(ORDERING).add_subset_node(("Select by Metadata Attribute", {"metadata_attribute": "source", "value": "src3"}))
    again = conc(spark, sf_dir)
    ids = tree.apply_template(again, tree.save_template(c))
    return spark.createDataFrame(sorted(ids.items()), "old long, new long")
