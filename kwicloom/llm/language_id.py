"""Language identification by a linear-chain conditional random field over words.

Emissions add the weights of a word's features (prefixes, suffixes, character bigrams and trigrams, and its
entry in a lexicon that is counted over all training documents); transitions are learned too. Forward-backward
gives each word's language distribution; a document's is their mean, so code-switched texts get the language
of most of their words. Training sequences are spliced from spans of documents, so that the transitions learn
both staying and switching.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import chunks
from .pieces import LETTER, classes, distinct, mix, pieces_of, span_hashes

#: Training documents of each language whose texts the weights are fitted on.
SAMPLE = 250
#: Words of the lexicon; the counts behind it cover all training documents.
LEXICON = 40_000
FEATURES = 1 << 17
SEED = 11


def words_in(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct letter runs, the number of each run in order, and the number of runs of each text."""
    texts = [t.lower() for t in texts]
    points, starts, ends, counts = pieces_of(texts, spaced=False)
    letter = classes()[points[starts]] == LETTER if len(starts) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(texts)), counts)[letter]
    names, which = distinct("".join(texts), points, starts[letter], ends[letter])
    return names, which, np.bincount(doc, minlength=len(texts))


def features(names: list[str], lexicon: tuple[np.ndarray, np.ndarray], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, concatenated, and where each word's begin."""
    marked = [f"\x02{w}\x03" for w in names]
    row = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in marked], np.int64)
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    owner, number = [np.arange(len(names))], [FEATURES + lexicon_feature(span_hashes(row, begin, end), lexicon, n_langs)]
    of = np.repeat(np.arange(len(names)), sizes)
    for k in (2, 3):
        at = np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :]) if len(of) >= k else np.zeros(0, np.int64)
        owner.append(of[at])
        number.append(hashed(row, at, at + k, k))
    for k in (2, 3, 4):  # one to three letters with the word's edge
        some = np.flatnonzero(sizes > k)
        owner += [some, some]
        number += [hashed(row, begin[some], begin[some] + k, 10 + k), hashed(row, end[some] - k, end[some], 20 + k)]
    owner, number = np.concatenate(owner), np.concatenate(number)
    order = np.argsort(owner, kind="stable")
    return number[order], np.searchsorted(owner[order], np.arange(len(names)))


def hashed(row: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    h = mix(span_hashes(row, starts, ends) + np.uint64(kind))
    return (h % np.uint64(FEATURES)).astype(np.int64)


def lexicon_feature(h: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], n_langs: int) -> np.ndarray:
    """The language that the lexicon gives a word, or ``n_langs`` if it is not there."""
    keys, langs = lexicon
    if not len(keys):
        return np.full(len(h), n_langs, np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, langs[at], n_langs)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (FEATURES + languages + 1) x languages
    transitions: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]

    def emissions(self, names: list[str]) -> np.ndarray:
        if not names:
            return np.zeros((0, len(self.langs)))
        number, begin = features(names, self.lexicon, len(self.langs))
        return np.add.reduceat(self.weights[number], begin).astype(np.float64)

    def documents(self, texts: list[str]) -> np.ndarray:
        """The mean language distribution of each text's words; zeros for a text without letters."""
        names, which, counts = words_in(texts)
        e = np.exp(normalised(self.emissions(names)))
        return marginals(e, which, counts, np.exp(self.transitions)) / np.maximum(counts, 1)[:, None]


def normalised(scores: np.ndarray) -> np.ndarray:
    return scores - scores.max(1, keepdims=True) if len(scores) else scores


def marginals(e: np.ndarray, which: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Per text, the sum of its words' distributions by forward-backward; all texts advance together, the longest first."""
    order = np.argsort(-counts, kind="stable")
    n, first = counts[order], (np.cumsum(counts) - counts)[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # texts that have a word t
    forward = np.empty((len(which), e.shape[1]))
    a = None
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        a = e[which[at]] if a is None else (a[:k] @ transitions) * e[which[at]]
        a /= a.sum(1, keepdims=True)
        forward[at] = a
    total = np.zeros((len(counts), e.shape[1]))
    b = np.ones((len(counts), e.shape[1]))
    back = transitions.T
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        g = forward[at] * b[:k]
        total[:k] += g / g.sum(1, keepdims=True)
        nb = (e[which[at]] * b[:k]) @ back
        b[:k] = nb / nb.sum(1, keepdims=True)
    out = np.zeros_like(total)
    out[order] = total
    return out


def fit(texts: list[str], labels: list[int], langs: list[str], lexicon: tuple[np.ndarray, np.ndarray], rounds: int = 40, length: int = 48) -> Model:
    """Maximum conditional likelihood by adaptive gradient steps over all sequences, with a quadratic penalty."""
    size = len(langs)
    weights, trans = np.zeros((FEATURES + size + 1, size)), np.zeros((size, size))
    model = Model(langs, weights, trans, lexicon)
    names, which, counts = words_in(texts)
    if size < 2 or len(which) < 2:
        return model
    gold = np.repeat(np.array(labels), counts)
    rng = np.random.default_rng(SEED)
    cuts = np.cumsum(rng.integers(4, 40, size=len(which)))
    cuts = np.concatenate([[0], cuts[cuts < len(which)], [len(which)]])
    spans = rng.permutation(len(cuts) - 1)
    spliced = np.concatenate([np.arange(cuts[s], cuts[s + 1]) for s in spans])
    spliced = np.resize(spliced, -(-len(spliced) // length) * length).reshape(-1, length).T  # step x sequence
    word, y = which[spliced], gold[spliced]
    number, begin = features(names, lexicon, size)
    owner = np.repeat(np.arange(len(names)), np.diff(np.append(begin, len(number))))
    truth = np.zeros((len(names), size))
    np.add.at(truth, (word.ravel(), y.ravel()), 1)
    pairs = np.zeros((size, size))
    np.add.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
    sw, st = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    total = word.size
    for step in range(rounds):
        e, p = np.exp(normalised(model.emissions(names))), np.exp(trans - trans.max())
        f = np.empty((*word.shape, size))
        a = e[word[0]]
        for t in range(length):
            if t:
                a = (a @ p) * e[word[t]]
            a = a / a.sum(1, keepdims=True)
            f[t] = a
        expected, moved, b = np.zeros((len(names), size)), np.zeros((size, size)), np.ones((word.shape[1], size))
        for t in range(length - 1, -1, -1):
            g = f[t] * b
            g /= g.sum(1, keepdims=True)
            for c in range(size):
                expected[:, c] += np.bincount(word[t], g[:, c], len(names))
            if t:
                right = e[word[t]] * b
                z = ((f[t - 1] @ p) * right).sum(1, keepdims=True)
                moved += p * ((f[t - 1] / z).T @ right)
                b = right @ p.T
                b /= b.sum(1, keepdims=True)
        gw = np.empty_like(weights)
        diff = (truth - expected)[owner]
        for c in range(size):
            gw[:, c] = np.bincount(number, diff[:, c], len(weights))
        gw = gw / total - 1e-6 * weights
        gt = (pairs - moved) / total - 1e-6 * trans
        sw += gw**2
        st += gt**2
        weights += 0.5 * gw / np.sqrt(sw)
        trans += 0.5 * gt / np.sqrt(st)
    model.weights = weights.astype(np.float32)
    return model


def lexicon_of(train: DataFrame, text_col: str, lang_col: str, size: int) -> list[tuple[str, str]]:
    """Words that mostly occur in one language, the commonest first, from counts over all of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(w, lang, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            columns = [*zip(*rows)] or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["word", "lang", "n"])

        for batch in batches:
            texts, langs = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                names, which, per = words_in(texts[lo:hi])
                lang_of = np.repeat(np.arange(lo, hi), per)
                for lang in set(langs[lo:hi]):
                    own = np.array([x == lang for x in langs])[lang_of] if len(lang_of) else np.zeros(0, bool)
                    n = np.bincount(which[own], minlength=len(names))
                    counts.setdefault(lang, Counter()).update({names[k]: int(n[k]) for k in np.flatnonzero(n)})
                if sum(map(len, counts.values())) > 300_000:
                    yield flushed()
        yield flushed()

    counted = train.select(text_col, lang_col).mapInArrow(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    best = counted.groupBy("word").agg(F.max(F.struct("n", "lang")).alias("top"), F.sum("n").alias("all")).where("top.n >= 5 and top.n >= 0.8 * all")
    rows = best.orderBy(F.col("top.n").desc(), "word").limit(size).select("word", "top.lang").collect()
    return [(r["word"], r["lang"]) for r in rows]


def train_model(train: DataFrame, text_col: str, lang_col: str, sample: int = SAMPLE, lexicon_size: int = LEXICON, order_col: str = "doc_id") -> Model:
    """``train``: texts with non-null languages. Driver memory is bounded by ``sample`` texts of each language and the lexicon."""
    lexicon = lexicon_of(train, text_col, lang_col, lexicon_size)
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(order_col), order_col))
    rows = train.where(F.length(text_col) > 0).withColumn("_rank", rank).where(F.col("_rank") <= sample).select(text_col, lang_col).collect()
    langs = sorted({r[lang_col] for r in rows} | {lang for _, lang in lexicon})
    number = {x: k for k, x in enumerate(langs)}
    if lexicon:
        marked = [f"\x02{w}\x03" for w, _ in lexicon]
        row = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([*map(len, marked)], np.int64)
        h = span_hashes(row, np.cumsum(sizes) - sizes, np.cumsum(sizes))
        order = np.argsort(h)
        keys, values = h[order], np.array([number[x] for _, x in lexicon], np.int64)[order]
    else:
        keys, values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return fit([r[text_col] for r in rows], [number[r[lang_col]] for r in rows], langs, (keys, values))


def predict(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; predictions read the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            langs, scores = [], []
            for lo, hi in chunks(texts):
                if not m.langs:
                    langs += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                p = m.documents(texts[lo:hi])
                best = p.argmax(1)
                has = p.sum(1) > 0
                langs += [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), has.tolist())]
                scores += [min(1.0, x) for x in p.max(1).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, lexicon_size: int = LEXICON) -> DataFrame:
    """One row per document: id, ``held_out, lang_pred, score``.

    Learns from text and non-null language of documents whose crc32 of the id, as text, modulo 4 is not 2;
    the others are held out. score is the mean probability of the predicted language over the words; ``und``
    and 0 for null texts, texts without a letter, and if there is nothing to learn from. Repeated rows are each
    predicted; no rows give no rows. Whole texts are read, in chunks of whole documents.
    """
    held = F.crc32(F.col(id_col).cast("string")) % 4 == 2
    train = docs.where(~held & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_order"), text_col, lang_col)
    model = train_model(train, text_col, lang_col, sample, lexicon_size, "_order")
    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col))
    return predict(rows, model, text_col)
