"""Hand-computed values on the golden concordance."""

import random

import pytest

from kwicloom import tree
from kwicloom.operators import annotate, cluster, label, partition, rank, select, sort
from kwicloom.plans.cqp import QueryError, parse

from .golden import golden


@pytest.fixture(scope="module")
def conc(spark):
    return golden(spark).persist()


def keys(result):
    return {r["line_id"]: r["key"] for r in result[0].collect()}


def ids(df):
    return sorted(r["line_id"] for r in df.collect())


def test_offsets(conc):
    rows = conc.tokens.where("line_id = 0").orderBy("id_in_line").collect()
    assert [r["offset"] for r in rows] == [-2, -1, 0, 1, 2]


def test_sorting(conc):
    view = conc.view()
    right = dict(sorting_scope="right")
    assert keys(sort.sort_by_token_attribute(view, **right)) == {0: 2, 1: 1, 2: 5, 3: 2, 4: 6, 5: 2}
    assert keys(sort.sort_by_token_attribute(view, reverse=True, **right)) == {0: 3, 1: 6, 2: 2, 3: 3, 4: 1, 5: 3}
    assert keys(sort.sort_by_token_attribute(view, sorting_scope="left")) == {0: 3, 1: 6, 2: 2, 3: 1, 4: 5, 5: 3}
    assert keys(sort.sort_random(view)) == {0: 4, 1: 1, 2: 5, 3: 3, 4: 6, 5: 2}
    assert keys(sort.sort_by_corpus_position(view)) == {i: i + 1 for i in range(6)}


def test_random_sort_is_stable_under_subsetting(conc):
    node = conc.root.add_subset_node(("Manual Line Selection", {"line_ids": [5, 0, 3]}))
    some = keys(sort.sort_random(node.subset()))
    assert sorted(some, key=some.get) == [5, 3, 0]


def test_ranking_and_combination(conc):
    grouper = ("KWIC Grouper Ranker", {"search_terms": ["cat", "dog"]})
    assert keys(rank.rank_kwic_grouper(conc.view(), ["cat", "dog"])) == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0, 5: 2}
    assert keys(rank.rank_kwic_grouper(conc.view(), ["cat|dog"], mode="regex")) == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0, 5: 2}
    assert keys(rank.rank_kwic_grouper(conc.view(), ['[word="c.*" & word!="cats"]'], mode="cqp")) == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    node = conc.root.add_arrangement_node([grouper, ("Sort by Token-Level Attribute", {"sorting_scope": "right"})])
    assert {r["line_id"]: r["rank"] for r in node.ordering.collect()} == {0: 2, 1: 1, 2: 4, 3: 5, 4: 6, 5: 2}
    assert node.differentiation_info() == {"algo_0": 2, "algo_1": 2}
    again = conc.root.add_arrangement_node([grouper, ("Sort by Token-Level Attribute", {"sorting_scope": "right"})])
    assert again is node
    sub = node.add_subset_node(("Select by Metadata Attribute", {"metadata_attribute": "g", "value": "y"}))
    assert {r["line_id"]: r["rank"] for r in sub.ordering.collect()} == {2: 1, 3: 2, 4: 3}
    ranked = node.add_subset_node(("Select by Rank", {"comparison_operator": ">=", "value": 2}))
    assert ids(ranked.lines()) == [0, 1, 2, 5]
    with pytest.raises(RuntimeError):
        conc.root.add_arrangement_node([("KWIC Grouper Ranker", {"search_terms": ['"a" "b"'], "mode": "cqp"})])


def test_selecting(conc):
    view = conc.view()
    assert ids(select.select_random(view, 3)[0]) == [0, 4, 5] == sorted(random.Random(42).sample(range(6), 3))
    at = dict(offset=1)
    assert ids(select.select_by_token_string(view, ["THE"], **at)[0]) == [2, 4]
    assert ids(select.select_by_token_string(view, ["the"], negative=True, **at)[0]) == [0, 1, 3, 5]
    assert ids(select.select_by_token_string(view, ["^t"], regex=True, offset=-2)[0]) == [0, 1, 4, 5]
    assert ids(select.select_by_token_string(view, [""], offset=9)[0]) == list(range(6))
    assert ids(select.select_by_metadata_attribute(view, "g", ["X", "z"])[0]) == [0, 1, 5]
    assert ids(select.select_by_metadata_attribute(view, "g", ["X"], case_sensitive=True)[0]) == []
    with pytest.raises(Exception, match="not a number"):
        select.select_by_metadata_attribute(view, "g", 3)[0].collect()
    sample = ids(select.select_weighted_sample_by_metadata(view, "g", 4)[0])
    assert len(sample) == 4
    assert select.quotas([("y", 3), ("x", 2), ("z", 1)], 4) == [2, 1, 1]


def test_empty_selection_stays_empty(conc):
    node = conc.root.add_subset_node(("Manual Line Selection", {"line_ids": []}))
    assert node.subset().tokens.count() == 0 and node.view()["selected_lines"] == []


def test_set_operations(conc):
    a = conc.root.add_subset_node(("Manual Line Selection", {"line_ids": [0, 1, 2]}))
    b = conc.root.add_subset_node(("Manual Line Selection", {"line_ids": [2, 3]}))
    want = {"union": [0, 1, 2, 3], "intersection": [2], "difference": [0, 1], "disjunctive union": [0, 1, 3], "complement": [4, 5]}
    for op, lines in want.items():
        assert ids(conc.root.add_subset_node(("Set Operation", {"operation": op, "node_ids": [a.id, b.id]})).lines()) == lines


def test_partitions(conc):
    view = conc.view()
    flat = lambda g: [(p["label"], p["line_ids"]) for p in g.to_dict()["partitions"]]
    assert flat(partition.partition_by_metadata_attribute(view, "g")) == [("y", [2, 3, 4]), ("x", [0, 1]), ("z", [5])]
    assert flat(partition.partition_by_metadata_attribute(view, "g", False, ["z", "x"])) == [("z", [5]), ("x", [0, 1])]
    want = [("('a', 'dog')", [0, 3, 5]), ("('a', 'cat')", [1]), ("('the', 'dog')", [2]), ("('the', 'fox')", [4])]
    assert flat(partition.partition_ngrams(view, [2, 1])) == want
    letters = label.label_sequential_letters(view, partition.partition_by_metadata_attribute(view, "g"))
    assert [r["new_label"] for r in letters.orderBy("id").collect()] == ["A", "B", "C"]
    node = conc.root.add_arrangement_node(grouping=("Partition by Metadata Attribute", {"metadata_attribute": "g"}), labelling=("LRC Keyword Labels", {}))
    assert all("(" in p["label"] for p in node.view()["grouping"]["partitions"])
    assert ids(node.add_subset_node(("Manual Line Selection", {"line_ids": [0], "groups": [0]})).lines()) == [0, 2, 3, 4]


def test_frequency_list(conc):
    _, data, _ = annotate.annotate_concordance_frequency_list(conc.view())
    assert {r["word"]: r["f"] for r in data.collect()} == {"the": 5, "dog": 5, "cat": 4, "a": 4, "A": 1, "one": 1, "bird": 1, "two": 1, "cats": 1, "fox": 1}


def test_association(spark, conc):
    c = golden(spark)
    c.add_annotation(("Annotate with Token-Level Frequency List", {}), ["list"])
    assert c.resources.info("frequency_list", "list")["sample_size"] == 24
    c.resources.register_frequency_list("corpus", spark.createDataFrame([("cat", 0.001), ("dog", 0.002), ("the", 0.06), ("fox", 0.0)], "word string, rel_f double"))
    c.add_annotation(("Annotate Association Scores", {"corpus_frequency_list": "corpus", "concordance_frequency_list": "list"}), ["scores"])
    got = {r["word"]: r for r in c.resources.get_scores("scores").collect()}
    want = {"cat": (4, 0.024, 7.380822, 11.380822, 3.418490, 25.664970, 1.988000, 32.975966), "dog": (5, 0.048, 6.702750, 11.346606, 3.541358, 22.602684, 2.214602, 36.555922), "the": (5, 1.44, 1.795859, 6.439715, 2.300513, 2.966667, 1.592080, 5.327948)}
    for word, values in want.items():
        assert [got[word][k] for k in ("O", "E", "MI", "MI3", "log_local_MI", "z_score", "t_score", "simple_ll")] == pytest.approx(values, abs=1e-5)
    assert got["fox"]["z_score"] == float("inf") and got["fox"]["MI"] == 0 and got["fox"]["simple_ll"] == -2
    scores = keys(rank.rank_by_collocations(c.view(), "scores", method="count", score_column="MI"))
    assert scores == {0: 3, 1: 3, 2: 3, 3: 1, 4: 1, 5: 3}


def test_rare_words(spark, conc):
    c = golden(spark)
    c.resources.register_frequency_list("corpus", spark.createDataFrame([("the", 50), ("a", 40), ("and", 30), ("cat", 2)], "word string, f long"))
    assert keys(rank.rank_number_of_rare_words(c.view(), "corpus", frequency_type="f", threshold=3)) == {0: -2, 1: -2, 2: -2, 3: -3, 4: -3, 5: -2}
    assert keys(rank.rank_number_of_rare_words(c.view(), "corpus", frequency_type="f", rank_threshold=1, positive=True, ignore_attrs={"word": ["and"]}))[0] == 3


def test_context_tree(conc):
    g = cluster.cluster_context_tree(conc.view(), max_depth=3)
    nodes = {r["label"]: r["id"] for r in g.groups.collect()}
    lines = {name: ids(g.members.where(f"id = {i}")) for name, i in nodes.items()}
    assert lines == {"root": list(range(6)), "a": [0, 1, 3, 5], "a dog": [0, 3, 5], "the": [2, 4]}
    own = {name: ids(g.members.where(f"id = {i} and own")) for name, i in nodes.items()}
    assert own == {"root": [], "a": [1], "a dog": [0, 3, 5], "the": [2, 4]}
    proto = {(r["id"], r["line_id"]): r["prototypicality"] for r in g.members.collect()}
    assert [proto[nodes["root"], k] for k in range(6)] == [1, 1, 0.5, 1, 0.5, 1]
    assert proto[nodes["a"], 1] == pytest.approx(1 / 3)
    tree_ = g.to_dict()["cluster"]
    assert [c.get("label") for c in tree_["children"]] == ["a", "the"]
    assert [nodes[k] for k in ("root", "a", "a dog", "the")] == [1, 2, 3, 4]


def test_slots(spark):
    c = golden(spark)
    more = spark.createDataFrame([(0, 0, 0, 1), (1, 4, 4, 1)], "line_id long, match_start long, match_end long, slot int")
    c.matches = c.matches.unionByName(more)
    node = c.root.add_subset_node(("Select Slot", {"slot_id": 1}))
    at = {(r["line_id"], r["id_in_line"]): r["offset"] for r in node.subset().tokens.collect()}
    assert at[0, 1] == 1 and at[1, 0] == -4 and at[2, 3] == 0  # no match in the slot: 0


def test_view_template_and_summary(spark, conc, tmp_path):
    c = golden(spark)
    node = c.root.add_arrangement_node([("KWIC Grouper Ranker", {"search_terms": ["cat"]})], ("Partition by Metadata Attribute", {"metadata_attribute": "g"}), ("Sequential Letter Labels", {}))
    view = node.view()
    assert view["node_type"] == "arrangement" and view["ordering"][:4] == [0, 1, 2, 5]
    assert view["line_info"]["data"][0]["Ranking: KWIC Grouper Ranker"] == 1
    assert [p["label"] for p in view["grouping"]["partitions"]] == ["A", "B", "C"]
    assert {s["category"] for s in view["token_spans"]} == {"A"}
    path = str(tmp_path / "t.json")
    tree.save_template(c, path)
    other = golden(spark)
    made = tree.apply_template(other, tree.load_template(path))
    assert made == {1: 1, 2: 2} and other.find_node(2).view()["grouping"] == view["grouping"]
    assert "arrangement" in node.summary("text") and "<table>" in node.summary("html")
    assert "Random Sort" in c.root.available_algorithms() and "Select Slot" not in c.root.available_algorithms()
    node.remove()
    assert c.find_node(2) is None


def test_arguments_are_checked(conc):
    with pytest.raises(ValueError, match="is needed"):
        conc.root.add_subset_node(("Random Sample", {}))
    with pytest.raises(ValueError, match="minimum"):
        conc.root.add_subset_node(("Random Sample", {"sample_size": 0}))
    with pytest.raises(ValueError, match="no argument"):
        conc.root.add_subset_node(("Random Sample", {"sample_size": 1, "x": 2}))
    assert conc.root.schema_for("Sort by Token-Level Attribute")["properties"]["tokens_attribute"]["enum"] == ["word"]


def test_tfidf(conc):
    out = annotate.annotate_tf_idf(conc.view()).collect()
    assert all(sum(x * x for x in r["tf_idf"]) == pytest.approx(1) for r in out)


def test_plugged_models(spark):
    c = golden(spark)
    annotate.ENCODERS["length"] = lambda texts: [[float(len(t)), 1.0] for t in texts]
    c.add_annotation(("Annotate with Sentence Transformers", {"model_name": "length"}), ["vec"])
    assert {r["line_id"]: r["vec"][0] for r in c.metadata.collect()}[0] == len("the cat and a dog")
    annotate.TAGGERS["caps"] = lambda words: [{"pos_": "UP" if w[0].isupper() else "LOW"} for w in words]
    c.add_annotation(("Annotate with spaCy POS tags", {"spacy_model": "caps"}), ["pos"])
    assert c.tokens.where("pos = 'UP'").count() == 1
    annotate.WORD_VECTORS["two"] = lambda: spark.createDataFrame([("the", [2.0, 0.0]), ("cat", [0.0, 4.0])], "word string, vector array<double>")
    c.add_annotation(("Annotate with SpaCy Embeddings", {"spacy_model": "two"}), ["mean"])
    assert {r["line_id"]: r["mean"] for r in c.metadata.collect()}[0] == pytest.approx([0.4, 0.8])
    with pytest.raises(ValueError, match="already"):
        c.add_annotation(("Annotate with Sentence Transformers", {"model_name": "length"}), ["vec"])
    assert partition.partition_by_embeddings(c.view(), "vec", 2).groups.count() == 2
    assert partition.partition_by_embeddings(c.view(), "vec", 2, method="agglomerative").groups.count() == 2


@pytest.mark.parametrize("query,n", [('"cat"', 1), ('"cat" %c', 1), ('[word="c.*" & pos!="NN"]', 1), ('[!(lemma="be"|lemma="have")]', 1), ("[]", 1), ("[same_s]", 1), ('a:[word="x"] @"y"', 2), ('"a" [] {0,2} "b"', 3), ("'it''s'", 1)])
def test_queries(query, n):
    assert len(parse(query)) == n


@pytest.mark.parametrize("query", ['"abc', "[word=]", "[", "", "]"])
def test_bad_queries(query):
    with pytest.raises(QueryError):
        parse(query)
