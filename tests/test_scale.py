"""What large tables need: no work is done anew for each match, line or token, and small limits give the same results."""

from pyspark.sql import functions as F

from kwicloom.concordance import Concordance
from kwicloom.functions import ranking, stats
from kwicloom.operators import annotate, cluster, label, partition
from kwicloom.plans import kwic
from kwicloom.sources import text
from kwicloom.sources.connectors import wmatrix_spans


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spans_are_found_before_matches_become_rows(spark):
    rows = [(0, "A and b. " * 40 + "and."), (1, "and"), (2, ""), (3, "x. and y and. ... Z and")]
    corpus = text.from_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    for df in (kwic.contexts(corpus, '"and"', 1, 9, "s"), kwic.clipped(corpus, kwic.parse_or_words("and"), 1, 9, None, "doc_id", kinds=["s"], inner=lambda m, m_end, lo, hi: [F.get(corpus.held("s", m, m), F.lit(0)).alias("s")])):
        assert "lambda" not in plan_of(df).partition("Generate")[0]
    got = [tuple(r) for r in kwic.contexts(corpus, '"and"', 1, 9, "s").orderBy("doc_id", "m").select("doc_id", "m", "lo", "hi").collect()]
    want = [(0, 4 * k + 1, 4 * k, 4 * k + 3) for k in range(40)] + [(0, 160, 160, 161), (1, 0, 0, 0), (3, 2, 2, 5), (3, 4, 3, 5), (3, 10, 9, 10)]
    assert got == want
    two = kwic.contexts(corpus, '"and" []', 1, 9, "s").where("doc_id > 0").orderBy("doc_id", "m").collect()
    assert [(r["doc_id"], r["m"], r["m_end"]) for r in two] == [(3, 2, 3), (3, 4, 5)]
    assert [tuple(r) for r in corpus.spans("s").where("doc_id = 3").orderBy("id").select("id", "start", "end").collect()] == [(0, 0, 1), (1, 2, 5), (2, 6, 8), (3, 9, 10)]


def test_sums_before_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 3)
    rows = [(k * 7 % 20, k, 1) for k in range(20)]
    df = spark.createDataFrame(rows, "o int, n long, one int")
    for one_task in (3, 100):
        got = sorted(tuple(r) for r in ranking.cumulated(df, [F.col("o")], {"skip": "n", "at": "one"}, one_task).collect())
        ordered = sorted(rows)
        assert [(r[0], r[3], r[4]) for r in got] == [(o, sum(x[1] for x in ordered[:i]), i) for i, (o, _, _) in enumerate(ordered)]


def test_wmatrix_rows_are_numbered_within_their_files(spark):
    files = {"b": "<s> x y </s> <s> z </s>", "a": "<s> u </s>", "c": "v <s> w </s>", None: "<s> q </s>"}
    rows = [(w, f) for f, words in files.items() for w in words.split()]
    df = spark.createDataFrame([(i, w, f) for i, (w, f) in enumerate(rows)], "_row long, word string, file string")
    tokens, sentences, runs = wmatrix_spans(df)
    assert [r["word"] for r in tokens.orderBy("cpos").collect()] == list("xyzuvwq") and sorted(r["cpos"] for r in tokens.collect()) == list(range(7))
    assert [tuple(r) for r in sentences.orderBy("id").select("file", "id", "start", "end").collect()] == [("b", 0, 0, 1), ("b", 1, 2, 2), ("a", 2, 3, 3), ("c", 3, 4, 4), ("c", 4, 5, 5), (None, 5, 6, 6)]
    assert [tuple(r) for r in runs.orderBy("id").select("id", "start", "end").collect()] == [(0, 0, 2), (1, 3, 3), (2, 4, 5), (3, 6, 6)]
    assert "Window [row_number() windowspecdefinition(_row" not in plan_of(tokens)  # rows are in no one task


def test_lists_are_made_once_and_lines_stay_with_their_tokens(spark):
    docs = spark.createDataFrame([(i, "this and that and more") for i in range(5)], "doc_id long, text string")
    corpus = text.from_documents(docs)
    c = kwic.concordance(corpus, '"and"', 2, 2, span_metadata=False)
    c.add_annotation(("Annotate with Token-Level Frequency List", {}), ["list"])
    c.resources.register_frequency_list("corpus", corpus.tokens().groupBy("word").agg(F.count("*").alias("f")))
    c.add_annotation(("Annotate Association Scores", {"corpus_frequency_list": "corpus", "concordance_frequency_list": "list"}), ["scores"])
    for stored in (c.resources.get_frequency_list("corpus"), c.resources.get_scores("scores")):
        plan = stored._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "regexp_extract_all" not in plan.partition("InMemoryRelation")[0]
    assert {r["word"]: r["f"] for r in c.resources.get_frequency_list("corpus").collect()} == {"this": 5, "and": 10, "that": 5, "more": 5}
    grouped = c.tokens.groupBy("line_id").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString().partition("InMemoryTableScan")[0]
    assert sorted(r["count"] for r in grouped.collect()) == [4] * 10


def lines_of_words(spark, n=30):
    docs = spark.createDataFrame([(i, f"of w{i % 3} and the w{i % 4} w{i % 2} and so") for i in range(n)], "doc_id long, text string")
    return kwic.concordance(text.from_documents(docs), '"and"', 3, 3, span_metadata=False, metadata=[])


def own_plan(df):
    """The plan without what stored frames are made of."""
    return [x.strip(" :+-") for x in df._jdf.queryExecution().withCachedData().toString().split("\n") if not x.lstrip(" :").startswith("+- *")]


def test_lines_of_the_context_tree_travel_once(spark):
    c = lines_of_words(spark)
    g = cluster.cluster_context_tree(c.view(), min_cluster_size=3, max_depth=3)
    assert {r["id"]: r["size"] for r in g.groups.collect()} == {r["id"]: r["count"] for r in g.members.groupBy("id").count().collect()}
    assert sum("explode(sequence(" in x for x in own_plan(g.members)) == 1
    plain = Concordance(c.metadata, c.tokens.select("*"), c.matches)
    assert plain.packed() is None and c.packed() is not None
    again = cluster.cluster_context_tree(plain.view(), min_cluster_size=3, max_depth=3)
    rows = lambda g: sorted(tuple(r) for r in g.members.join(g.groups.select("id", "label", "level"), "id").select("label", "level", "line_id", "pos", "prototypicality", "own").collect())
    assert rows(g) == rows(again) and len(rows(g)) > 100


def test_texts_of_lines_need_no_row_for_each_token(spark):
    c = lines_of_words(spark)
    plain = Concordance(c.metadata, c.tokens.select("*"), c.matches)
    for args in ((-2, 2, True), (None, 1, False), (1, None, True), (-3, 3, True, "word", ["w1", "the"])):
        texts = annotate.line_texts(c.view(), "word", *args)
        plan = texts._jdf.queryExecution().withCachedData().toString().partition("InMemoryRelation")[0]
        assert not [x for x in ("Aggregate", "Generate", "Join") if x in plan]
        assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, annotate.line_texts(plain.view(), "word", *args).collect()))
    weights = {(r["line_id"], r["term"]): r["w"] for r in annotate.tfidf_long(annotate.line_texts(c.view(), "word", -1, 1, True)).collect()}
    assert abs(sum(w * w for (line, _), w in weights.items() if line == 0) - 1) < 1e-12 and weights[0, "w0"] > weights[0, "and"]


def test_what_is_ranked_is_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(20).mapInArrow(tell, "id long")
    ranked = ranking.globally(ranking.globally(df, [F.col("id") % 3], "a"), [F.col("a"), F.col("id")], "b", rank=False)
    assert [r["id"] for r in ranked.orderBy("b").collect()] == sorted(range(20), key=lambda x: (x % 3, x))
    assert seen.value == 20


def test_bounds_are_sought_for_words_apart_only(monkeypatch):
    cases = [(f1, f2, n1, n2) for f1 in (0, 1, 5, 40, 300) for f2 in (0, 1, 7, 60) for n1, n2 in ((100, 100), (1000, 90), (400, 9000), (5, 0))]
    plain = {}
    for f1, f2, n1, n2 in cases:
        if f1 + f2:
            level = 0.05 / (f1 + f2) / 2
            low = stats.beta_quantile(level, f1, f2 + 1) if f1 else 0.0
            plain[f1, f2, n1, n2] = low, stats.beta_quantile(1 - level, f1 + 1, f2) if f2 else 1.0
    for (f1, f2, n1, n2), (low, high) in plain.items():
        if n2:
            got, even = stats.conservative_log_ratio(f1, f2, n1, n2), n1 / (n1 + n2)
            assert (got > 0) == (low > even) and (got < 0) == (high < even)
    monkeypatch.setattr(stats, "beta_quantile", None)
    assert stats.conservative_log_ratio(50, 50, 1000, 1000) == stats.conservative_log_ratio(1, 0, 10, 10) == 0


def test_keywords_are_counted_line_by_line(spark):
    c = lines_of_words(spark)
    plain = Concordance(c.metadata, c.tokens.select("*"), c.matches)
    rows = lambda v, **k: sorted(map(tuple, label.keyword_counts(v, partition.partition_by_metadata_attribute(v, "doc_id"), **k).collect()))
    for k in ({}, {"window_start": None, "window_end": 2}, {"whitelist": {"word": ["w1", "the"]}}, {"blacklist": {"word": ["of"]}}):
        assert rows(c.view(), **k) == rows(plain.view(), **k) != []
    counts = label.keyword_counts(c.view(), partition.partition_by_metadata_attribute(c.view(), "doc_id"))
    plan = counts._jdf.queryExecution().withCachedData().toString()
    assert "Generate" not in plan.partition("InMemoryRelation")[0]  # counts are stored, tokens not exploded for each use
