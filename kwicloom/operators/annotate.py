"""Annotation: new columns of lines or tokens, or new resources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..concordance import View, within
from ..functions.stats import association
from ..registry import algorithm, token_attributes
from .rank import WINDOW

#: Encoders and taggers by name: functions from a list of texts to a list of vectors, or of attribute dictionaries.
ENCODERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}
TAGGERS: dict[str, Callable[[list[str]], list[dict[str, str]]]] = {}
WORD_VECTORS: dict[str, Callable[[], DataFrame]] = {}


@algorithm("Annotate with Token-Level Frequency List", "annotation", scope="type", enrich={"token_attribute": token_attributes}, token_attribute={"type": "string", "required": True, "default": "word"}, window_start=WINDOW, window_end=WINDOW, include_node={"type": "boolean", "default": False})
def annotate_concordance_frequency_list(view: View, token_attribute: str = "word", window_start: int | None = None, window_end: int | None = None, include_node: bool = False):
    """How often each type stands in the windows, case kept."""
    tokens = view.window(window_start, window_end, include_node).where(F.col(token_attribute).isNotNull())
    return "frequency_list", tokens.groupBy(token_attribute).agg(F.count("*").alias("f")), {"complete": True}


@algorithm(
    "Annotate Association Scores", "annotation", scope="type", corpus_frequency_list={"type": "string", "required": True}, concordance_frequency_list={"type": "string", "required": True},
    token_attribute={"type": "string", "default": "word"}, ignore_case={"type": "boolean", "default": True},
)
def annotate_association_scores(view: View, corpus_frequency_list: str, concordance_frequency_list: str, token_attribute: str = "word", ignore_case: bool = True):
    """Association measures of the types of one list against their expectation by another."""
    r = view.resources
    observed = r.get_frequency_list(concordance_frequency_list, ignore_case, [token_attribute]).select(token_attribute, F.col("f").cast("double").alias("O"))
    expected = r.get_frequency_list(corpus_frequency_list, ignore_case, [token_attribute]).select(token_attribute, "rel_f")
    n = r.info("frequency_list", concordance_frequency_list).get("sample_size")
    n = float(n if n is not None else observed.agg(F.sum("O")).first()[0] or 0)
    return "scores", scores_of(observed.join(expected, token_attribute, "left"), token_attribute, n), {"ignore_case": ignore_case}


def scores_of(joined: DataFrame, attribute: str, n: float) -> DataFrame:
    """Measures of ``joined(attribute, O, rel_f)`` in a sample of ``n``; a missing expectation gives zeros."""
    e = F.col("rel_f") * F.lit(n)
    out = joined.withColumn("E", F.coalesce(e, F.lit(0.0)))
    known = F.col("rel_f").isNotNull()
    return out.select(attribute, *[F.when(known, c).otherwise(0.0).alias(k) for k, c in association(F.col("O"), F.col("E")).items()], "O", "E")


def line_texts(view: View, attribute: str, start: int | None, end: int | None, node: bool, exclude_attribute: str | None = None, exclude: list | None = None) -> DataFrame:
    def keep(t: Callable[[str], Column]) -> Column:
        cond = within(start, end, node)(t)
        return cond & ~F.coalesce(t(exclude_attribute).isin(list(exclude)), F.lit(False)) if exclude_attribute and exclude else cond

    return view.joined(keep, attribute, reads=(exclude_attribute,) if exclude_attribute and exclude else ())


EXCLUDE = {"exclude_values_attribute": {"type": "string"}, "exclude_values_list": {"type": "array"}}
AROUND = {"window_start": WINDOW | {"default": -5}, "window_end": WINDOW | {"default": 5}, "include_node": {"type": "boolean", "default": True}}


def tfidf_long(texts: DataFrame) -> DataFrame:
    """``(line_id, term, w)``: terms of two letters or more, smoothed inverse document frequency plus one, unit length."""
    words = texts.select("line_id", F.regexp_extract_all(F.lower("value"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("terms"))
    df = words.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))  # one row
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = words.select("line_id", F.explode("terms").alias("term")).groupBy("line_id", "term").agg(F.count("*").alias("tf"))
    raw = tf.join(idf, "term").select("line_id", F.struct("term", (F.col("tf") * F.col("idf")).alias("w")).alias("x"))
    lines = raw.groupBy("line_id").agg(F.collect_list("x").alias("x"), F.sqrt(F.sum(F.col("x.w") * F.col("x.w"))).alias("norm"))
    return lines.select("line_id", "norm", F.explode("x").alias("x")).select("line_id", F.col("x.term").alias("term"), (F.col("x.w") / F.col("norm")).alias("w"))


@algorithm("Annotate with TF-IDF", "annotation", scope="line", enrich={"tokens_attribute": token_attributes}, tokens_attribute={"type": "string", "default": "word"}, **EXCLUDE, **AROUND)
def annotate_tf_idf(view: View, tokens_attribute: str = "word", exclude_values_attribute: str | None = None, exclude_values_list: list | None = None, window_start: int = -5, window_end: int = 5, include_node: bool = True) -> DataFrame:
    """A dense vector per line over the alphabetical vocabulary; ``tfidf_long`` is the form for large vocabularies."""
    texts = line_texts(view, tokens_attribute, window_start, window_end, include_node, exclude_values_attribute, exclude_values_list)
    long = tfidf_long(texts)
    words = [r[0] for r in long.select("term").distinct().orderBy("term").limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("over 100,000 terms: use tfidf_long")
    number = view.metadata.sparkSession.createDataFrame(list(enumerate(words)), "i int, term string")
    sparse = long.join(number, "term").groupBy("line_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    empty = F.create_map().cast("map<int,double>")
    dense = F.transform(F.sequence(F.lit(0), F.lit(max(len(words) - 1, 0))), lambda i: F.coalesce(F.try_element_at(F.coalesce("m", empty), i), F.lit(0.0)))
    return texts.join(sparse, "line_id", "left").select("line_id", dense.alias("tf_idf"))


def encoded(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"line_id": pdf["line_id"], "embedding": encode(pdf["value"].tolist())})

    return texts.mapInPandas(run, "line_id long, embedding array<double>")


def sentence_transformer(name: str) -> Callable[[list[str]], list[list[float]]]:
    def encode(texts: list[str]) -> list[list[float]]:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name).encode(texts).tolist()

    return encode


@algorithm("Annotate with Sentence Transformers", "annotation", scope="line", enrich={"tokens_attribute": token_attributes}, tokens_attribute={"type": "string", "default": "word"}, window_start=WINDOW, window_end=WINDOW, model_name={"type": "string", "default": "all-MiniLM-L6-v2"})
def annotate_sentence_transformers(view: View, tokens_attribute: str = "word", window_start: int | None = None, window_end: int | None = None, model_name: str = "all-MiniLM-L6-v2") -> DataFrame:
    """A model's vector of each line; a registered encoder of the name, or the library's."""
    return encoded(line_texts(view, tokens_attribute, window_start, window_end, True), ENCODERS.get(model_name) or sentence_transformer(model_name))


@algorithm("Annotate with SpaCy Embeddings", "annotation", scope="line", enrich={"tokens_attribute": token_attributes}, spacy_model={"type": "string", "required": True, "default": "en_core_web_md"}, tokens_attribute={"type": "string", "default": "word"}, **EXCLUDE, **AROUND)
def annotate_spacy_embeddings(view: View, spacy_model: str = "en_core_web_md", tokens_attribute: str = "word", exclude_values_attribute: str | None = None, exclude_values_list: list | None = None, window_start: int = -5, window_end: int = 5, include_node: bool = True) -> DataFrame:
    """The mean of the word vectors of each line. A registered table ``(word, vector)`` is joined; else the library's model runs in the tasks."""
    texts = line_texts(view, tokens_attribute, window_start, window_end, include_node, exclude_values_attribute, exclude_values_list)
    if spacy_model in WORD_VECTORS:
        return mean_vectors(texts, WORD_VECTORS[spacy_model]())

    def encode(values: list[str]) -> list[list[float]]:
        import spacy

        return [d.vector.tolist() for d in spacy.load(spacy_model).pipe(values, batch_size=100)]

    return encoded(texts, encode)


def mean_vectors(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Element-wise means; words without a vector count as zeros, and so does a line without words."""
    size = vectors.select(F.size("vector")).first()[0]
    words = texts.select("line_id", F.explode(F.array_remove(F.split("value", " "), "")).alias("word"))
    n = words.groupBy("line_id").agg(F.count("*").alias("n"))
    sums = words.join(vectors, "word").select("line_id", F.posexplode("vector").alias("i", "x")).groupBy("line_id", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    zeros = F.array_repeat(F.lit(0.0), size)
    out = texts.select("line_id").join(n, "line_id", "left").join(sums, "line_id", "left")
    return out.select("line_id", F.coalesce(F.transform("v", lambda x: x / F.col("n")), zeros).alias("embedding"))


@algorithm(
    "Annotate with spaCy POS tags", "annotation", scope="token", enrich={"tokens_attribute": token_attributes}, spacy_model={"type": "string", "required": True, "default": "en_core_web_sm"}, tokens_attribute={"type": "string", "default": "word"},
    spacy_attributes={"type": "array", "items": {"type": "string", "enum": ["lemma_", "pos_", "tag_", "morph", "dep_", "ent_type_"]}, "required": True, "default": ["pos_"]},
)
def annotate_spacy_pos(view: View, spacy_model: str = "en_core_web_sm", tokens_attribute: str = "word", spacy_attributes: list[str] | None = None) -> DataFrame:
    """Tags of each token by itself. Each distinct word is tagged once, then joined back."""
    attributes = spacy_attributes or ["pos_"]
    tag = TAGGERS.get(spacy_model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tag is None:
            import spacy

            model = spacy.load(spacy_model)
        for pdf in batches:
            words = pdf["word"].tolist()
            rows = tag(words) if tag else [{a: str(getattr(d[0], a)) if len(d) else "" for a in attributes} for d in model.pipe(words, batch_size=100)]
            yield pd.DataFrame({"word": words} | {a: [r.get(a, "") for r in rows] for a in attributes})

    words = view.tokens.select(F.col(tokens_attribute).cast("string").alias("word")).where("word is not null").distinct()
    tagged = words.mapInPandas(run, ", ".join(["word string", *[f"{a} string" for a in attributes]]))
    keyed = view.tokens.select("line_id", "id_in_line", F.col(tokens_attribute).cast("string").alias("word"))
    return keyed.join(tagged, "word", "left").select("line_id", "id_in_line", *attributes)
