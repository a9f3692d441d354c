"""Text source, sinks, connectors, statistics, ranking, streaming, and the catalogue's contract."""

import json
import math
import sqlite3
import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kwicloom import sinks
from kwicloom.functions import ranking, regexes, stats
from kwicloom.operators.cluster import clustering_random, dbscan
from kwicloom.plans import kwic
from kwicloom.sources import connectors, files, text
from kwicloom.streaming.kwic import keyword_counts, kwic_stream

from .golden import golden


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(0, "The cat sat. It's the end.", "x"), (1, "A well-known cat, no? Yes!", "y"), (2, "", "x"), (3, None, "y")], "doc_id long, text string, g string")
    return text.from_documents(docs)


def test_tokens_and_sentences(corpus):
    words = [r["word"] for r in corpus.tokens().where("doc_id = 1").orderBy("pos").collect()]
    assert words == ["A", "well-known", "cat", ",", "no", "?", "Yes", "!"]
    spans = [tuple(r) for r in corpus.spans("s").orderBy("doc_id", "id").collect()]
    assert spans == [(0, 0, 0, 3), (0, 1, 4, 7), (1, 0, 0, 5), (1, 1, 6, 7)]
    assert [r["id"] for r in corpus.spans_covering("s", 0, 3).collect()] == [0]
    assert corpus.counts().first()["tokens"] == 16
    assert corpus.tokens(2, 3).count() == 4


def test_sequences(corpus):
    found = lambda q: sorted((r["doc_id"], r["m"]) for r in kwic.matches(corpus, q).collect())
    assert found("the cat") == [(0, 0)]
    assert found('"the" %c []') == [(0, 0), (0, 5)]
    assert found('[word="c.*" | word="end"]') == [(0, 1), (0, 6), (1, 2)]
    assert found('[!word="[a-z].*"]') == [(0, 0), (0, 3), (0, 4), (0, 7), (1, 0), (1, 3), (1, 5), (1, 6), (1, 7)]
    assert found('"."') and found('"[.]" "It\'s"') == [(0, 3)]


def test_concordance_from_query(corpus):
    c = kwic.concordance(corpus, '"cat"', 2, 1, "s")
    assert [(r["line_id"], r["doc_id"], r["s.id"], r["file.g"]) for r in c.metadata.orderBy("line_id").collect()] == [(0, 0, 0, "x"), (1, 1, 0, "y")]
    assert [r["word"] for r in c.tokens.where("line_id = 1").orderBy("id_in_line").collect()] == ["A", "well-known", "cat", ","]
    assert sinks.tripartite(c.tokens).where("line_id = 0").first()["left_context"] == "The"
    last = kwic.contexts(corpus, '"[.]"', 9, 9, "s").collect()  # a match on a sentence's last token
    assert {(r["lo"], r["hi"]) for r in last} == {(0, 3), (4, 7)}


def test_load_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("One cat.")
    (tmp_path / "sub" / "b.txt").write_text("Two cats.")
    c = text.load_files(spark, str(tmp_path))
    assert sorted(r["word"] for r in c.tokens().collect()) == [".", ".", "One", "Two", "cat", "cats"]


def test_regexes(spark):
    df = spark.createDataFrame([("Äpfel",), ("äpfel",), (None,), ("x\n",)], "w string")
    got = [tuple(r) for r in df.select(regexes.full_match(F.col("w"), r"(?P<a>ä)\w+"), regexes.full_match(F.col("w"), "ÄPFEL", True), regexes.search(F.col("w"), r"x\Z")).collect()]
    assert got == [(False, True, False), (True, True, False), (False, False, False), (False, False, False)]


def test_global_ranks_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)
    df = spark.range(2000).select("id", (F.col("id") % 37).alias("k"))
    one = {r["id"]: r["r"] for r in ranking.globally(df, [F.col("k")], "r").collect()}
    many = {r["id"]: r["r"] for r in ranking.globally(df, [F.col("k")], "r", one_task=10).collect()}
    assert one == many
    rows = sorted(r["r"] for r in ranking.globally(df, [F.col("k"), F.col("id")], "r", rank=False, one_task=10).collect())
    assert rows == list(range(1, 2001))


@pytest.mark.parametrize("a,b,x", [(3, 5, 0.2), (1, 1, 0.7), (10, 2, 0.9), (4, 40, 0.05)])
def test_incomplete_beta(a, b, x):
    n, p = a + b - 1, Fraction(x)
    want = float(sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(a, n + 1)))
    assert stats.incomplete_beta(a, b, x) == pytest.approx(want, rel=1e-10)
    assert stats.beta_quantile(want, a, b) == pytest.approx(x, rel=1e-9)


def test_conservative_log_ratio():
    assert stats.conservative_log_ratio(0, 0, 10, 10) == 0
    assert stats.conservative_log_ratio(5, 5, 100, 100) == 0
    up, down = stats.conservative_log_ratio(50, 2, 100, 100), stats.conservative_log_ratio(2, 50, 100, 100)
    assert up > 0 and down == pytest.approx(-up)
    assert stats.conservative_log_ratio(50, 0, 100, 100) > up


def test_dbscan_and_random_tree(spark):
    import numpy as np

    v = np.array([[0, 0], [0, 1], [1, 0], [9, 9], [9, 8], [8, 9], [50, 50]], float)
    assert dbscan(v, 1.5, 2, "euclidean").tolist() == [0, 0, 0, 1, 1, 1, -1]
    g = clustering_random(golden(spark).view())
    assert sorted(r["line_id"] for r in g.members.where("own").collect()) == list(range(6))


def test_export_and_load(spark, tmp_path):
    c = golden(spark)
    c.metadata = c.metadata.withColumn("v", F.array(F.lit(1.0), F.col("line_id").cast("double")))
    c.root.add_subset_node(("Select by Metadata Attribute", {"metadata_attribute": "g", "value": "y"}))
    folder = sinks.export(c, str(tmp_path / "out"))
    again = files.load_folder(spark, folder)
    for name, keys in (("metadata", ["line_id", "g", "v"]), ("tokens", ["line_id", "id_in_line", "word", "offset"]), ("matches", ["line_id", "match_start", "match_end", "slot"])):
        assert sorted(map(str, map(tuple, getattr(c, name).select(*keys).collect()))) == sorted(map(str, map(tuple, getattr(again, name).select(*keys).collect())))
    assert again.find_node(2).lines().count() == 3
    archive = sinks.export(c, str(tmp_path / "z.zip"), as_zip=True)
    assert "metadata.tsv" in zipfile.ZipFile(archive).namelist()
    assert "line_id\tmatch_start" in (tmp_path / "out" / "matches.tsv").read_text()
    with pytest.raises(ValueError, match="line_id"):
        files.load(spark, c.metadata.drop("line_id"), c.tokens, c.matches)


def test_csv_and_html(spark, tmp_path):
    c = golden(spark)
    node = c.root.add_arrangement_node([("KWIC Grouper Ranker", {"search_terms": ["cat"]})], ("Partition by Metadata Attribute", {"metadata_attribute": "g"}))
    sinks.view_to_csv(node, str(tmp_path / "v.csv"))
    lines = (tmp_path / "v.csv").read_text().splitlines()
    assert lines[0] == "line_id,Partition,R0,Left context,KWIC,Right context,g" and len(lines) == 7 and lines[1] == "2,y,1,A cat,and,the dog,y"
    page = sinks.kwic_html(node, n=1)
    assert page.count("<b>and</b>") == 3 and "background" in page
    tree = ("Context Tree Clustering", {})
    assert "a dog" in sinks.kwic_html(c.root.add_arrangement_node(grouping=tree))
    assert "KWIC Grouper Ranker" in sinks.tree_html(c)
    assert sinks.rounding([0.11, 0.12]) == 2 and sinks.rounding([1.0]) == 3
    assert spark.range(1).select(sinks.spaced(F.lit("( a , b ) .")).alias("s")).first()["s"] == "(a, b)."


def words(c, line=0):
    return [(r["word"], r["offset"]) for r in c.tokens.where(f"line_id = {line}").orderBy("id_in_line").collect()]


def test_cqpweb(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("Text ID\tContext before\tQuery item\tContext after\tTagged context before\tTagged query item\tTagged context after\nt1\ta &amp;\t<<< cat >>>\tb\ta_DT &amp;_CC\t<<< cat_NN >>>\tb_c_X\n")
    c = connectors.cqpweb(connectors.read_export(spark, str(path)))
    assert [(r["word"], r["pos"], r["offset"]) for r in c.tokens.orderBy("id_in_line").collect()] == [("a", "DT", -2), ("&", "CC", -1), ("cat", "NN", 0), ("b_c", "X", 1)]
    assert c.metadata.first()["Text ID"] == "t1"
    bnc = spark.createDataFrame([("x y", "<<< z >>>", "&lt;w")], "`Left context` string, `Query item` string, `Right context` string")
    assert words(connectors.cqpweb(bnc)) == [("x", -2), ("y", -1), ("z", 0), ("<w", 1)]


def test_clic(spark):
    row = [["The ", "cat", [0]], ["sat", "."], ["Then", " on", [1]], ["BH", 3, 9], [1, 2, 3]]
    df = connectors.clic_payload(spark, [row])
    assert words(connectors.clic(df)) == [("The", -2), ("cat", -1), ("sat", 0), (".", 1), ("Then", 2), ("on", 3)]
    two = df.withColumn("clic_subset", F.lit("quote")).unionByName(df.withColumn("clic_subset", F.lit("longsus")))
    assert [r["clic_subset"] for r in connectors.clic(two, "clic_subset").metadata.collect()] == ["longsus"]


def test_sketch_engine(spark):
    page = {"Lines": [{"Left": [{"strc": "<s>"}, {"str": "old", "attr": "/JJ"}, {"strc": "</s><s>"}, {"str": "big", "attr": "/JJ"}], "Kwic": [{"str": "cat", "attr": "/NN"}], "Right": [{"str": "sat", "attr": "/VV"}], "Refs": ["doc.id=5"]}]}
    c = connectors.sketch_engine(spark.createDataFrame([(0, json.dumps(page))], "page int, json string"), ["tag"], ["doc"])
    assert [(r["word"], r["tag"], r["same_s"], r["offset"]) for r in c.tokens.orderBy("id_in_line").collect()] == [("old", "JJ", 0, -2), ("big", "JJ", 1, -1), ("cat", "NN", 1, 0), ("sat", "VV", 1, 1)]
    assert c.metadata.first()["doc"] == 5


def test_korap_cwb_wmatrix(spark, tmp_path):
    k = spark.createDataFrame([("a\tb", "c", "d", "s1")], "`tokens.left` string, `tokens.match` string, `tokens.right` string, textSigle string")
    assert words(connectors.korap(k)) == [("a", -2), ("b", -1), ("c", 0), ("d", 1)]
    cpos = spark.createDataFrame([(i, f"w{i}") for i in range(300)], "cpos long, word string")
    hits = spark.createDataFrame([(1, 2), (150, 150)], "match long, matchend long")
    c = connectors.cwb_lines(cpos, hits, 2, 2)
    assert words(c) == [("w0", -1), ("w1", 0), ("w2", 0), ("w3", 1), ("w4", 2)] and words(c, 1)[0] == ("w148", -2)
    with sqlite3.connect(tmp_path / "w.db") as db:
        db.execute("create table corpus (word text, file text)")
        db.executemany("insert into corpus values (?, ?)", [("<s>", "f"), ("a", "f"), ("b", "f"), ("</s>", "f"), ("<s>", "g"), ("c", "g"), ("</s>", "g")])
    tokens, sentences, spans = connectors.wmatrix(spark, str(tmp_path / "w.db"))
    assert [(r["cpos"], r["word"]) for r in tokens.orderBy("cpos").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert [(r["start"], r["end"]) for r in sentences.orderBy("id").collect()] == [(0, 1), (2, 2)]
    assert [(r["file"], r["start"]) for r in spans.orderBy("id").collect()] == [("f", 0), ("g", 2)]


def test_resources(spark):
    c = golden(spark)
    c.resources.register_frequency_list("x", spark.createDataFrame([("The", "D", 3), ("the", "D", 1), ("cat", "N", 4)], "word string, pos string, f long"))
    assert c.resources.get_frequency_list("x", True, ["word"]).where("word = 'the'").first()["f"] == 4
    assert c.resources.ranked("x").where("rank = 1").first()["word"] == "cat"
    assert c.resources.list("frequency_list") == ["x"] and c.resources.list("scores") == []
    with pytest.raises(ValueError):
        c.resources.list("other")
    connectors.frequency_list(c, "y", spark.createDataFrame([("a", 12.0)], "item string, v double"), "item", "v", "pmw")
    assert c.resources.get_frequency_list("y").first()["rel_f"] == pytest.approx(12e-6)


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the cat and the dog", "2024-01-01 00:01:00"), (2, "no", "2024-01-01 00:02:00"), (3, "and and", "2024-01-01 00:07:00")], "doc_id long, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("lines", kwic_stream(stream(), '"and"', 1, 1), "append"), ("counts", keyword_counts(stream(), '"and"'), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["right_context"] for r in spark.table("lines").collect()) == ["", "and", "the"]
    assert [r["hits"] for r in spark.table("counts").orderBy("window").collect()] == [1, 2]


def test_catalogue():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and "kwic_lines" in queries


def test_wmatrix_sentences_of_all_documents(spark, tmp_path):
    from kwicloom.plans import catalog

    rows = [(i, f"One of {i} here. And two" + " more" * (i % 3) + "!") for i in range(230)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    skip, expected = 0, []
    for i in range(230):
        ends = [4, 7 + i % 3]  # "." and "!"
        expected += [(skip, skip + ends[0]), (skip + ends[0] + 1, skip + ends[1])]
        skip += ends[1] + 1
    got = catalog.wmatrix_sentences(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(k, a, b) for k, (a, b) in enumerate(expected)]


def test_further_attributes_and_spans(spark):
    corpus = text.from_documents(spark.createDataFrame([(0, "Cats saw 3 dogs. The cats ran."), (1, "dogs"), (2, None)], "doc_id long, text string"))
    tagger = lambda words: [{"pos": "N" if w.lower().rstrip("s") in ("cat", "dog") else "X", "n": "1" if w.isdigit() else ""} for w in words]
    corpus = corpus.tagged(tagger, "pos", "n").with_attribute("lemma", lambda w: F.lower(F.rtrim(w)))
    found = lambda q: sorted((r["doc_id"], r["m"]) for r in kwic.matches(corpus, q).collect())
    assert found('[pos="N"]') == [(0, 0), (0, 3), (0, 6), (1, 0)]
    assert found('[lemma="cats"] [pos!="N"]') == [(0, 0), (0, 6)]
    assert found("[n]") == [(0, 2)] and found("[!n & lemma=\"dogs\"]") == [(0, 3), (1, 0)]
    with pytest.raises(ValueError):
        kwic.matches(corpus, '[tag="x"]')
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("toks") / 2).cast("int")), lambda b: F.struct((b * 2).alias("start"), (b * 2 + 1).alias("end"), F.concat(F.lit("p"), b).alias("name")))
    corpus = corpus.with_spans("pair", pairs)
    assert corpus.span_kinds == ["s", "file", "pair"] and corpus.spans("pair").columns == ["doc_id", "start", "end", "name"]
    c = kwic.concordance(corpus, '[pos="N"]', 5, 5, "pair")
    assert [r["pair.name"] for r in c.metadata.orderBy("line_id").collect()] == ["p0", "p1", "p3", "p0"]
    assert [(r["word"], r["pos"], r["offset"]) for r in c.tokens.where("line_id = 1").orderBy("id_in_line").collect()] == [("3", "X", -1), ("dogs", "N", 0)]


@pytest.mark.parametrize("one_task", [2, 1000])
def test_ranks_of_nulls_and_ties(spark, one_task, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 2)
    values = [3, None, 1, 3, None, 2, 3, 9, 1]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = sorted((r["v"] is not None, r["v"] or 0, r["r"]) for r in ranking.globally(df, [F.col("v")], "r", one_task=one_task).collect())
    assert [r for *_, r in got] == [1, 1, 3, 3, 5, 6, 6, 6, 9]
