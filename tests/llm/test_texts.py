"""Encoding, packing, scoring, language, quality rules and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from kwicloom.llm import byte_bpe, language_id, lm_score, packing, quality_rules  # noqa: E402

from .conftest import make  # noqa: E402

RANKS, VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), str(public_tokenizers.path("word_bpe_49k.json"))
ALPHABET = "ab 's\n\t  é1²٣Ⅷ!?'ll're  ​　😀漢字 ΣÉİ́\x85\x1c<|"


def odd_texts():
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["", " " * 500, "a" * 3000, "\n" * 77 + "x", "ab" * 2000, "<|endoftext|>", "don't we'll"]


def tiktoken_ids(texts):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    return [own.encode_ordinary(t) for t in texts]


def test_encoder_equals_library():
    texts = odd_texts()
    got = byte_bpe.rank_encoder(RANKS)[0].encode_texts(texts, spaced=True)
    assert [g.tolist() for g in got] == tiktoken_ids(texts)


def test_encode_decode(docs, rows, nothing):
    got = {r["doc_id"]: r for r in byte_bpe.encode_decode(docs, RANKS, with_ids=True).collect()}
    for (i, text, _), ids in zip(rows, tiktoken_ids([t or "" for _, t, _ in rows])):
        r = got[i]
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert bytes(r["decoded"]) == (text or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert byte_bpe.encode_decode(nothing, RANKS).count() == 0


def library_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    return [e.ids for e in tokenizers.Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_word_ids_equal_library():
    texts = odd_texts()
    assert [g.tolist() for g in packing.word_ids(VOCABULARY, texts)] == library_ids(texts)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pack(docs, rows, capacity, nothing):
    got = packing.pack(docs, VOCABULARY, capacity=capacity, with_ids=True).collect()
    want = {i: [*ids, 1] for (i, _, _), ids in zip(rows, library_ids([t or "" for _, t, _ in rows]))}
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(want)
    for i, rs in pieces.items():
        rs.sort(key=lambda r: r["piece"])
        assert [x for r in rs for x in r["ids"]] == want[i]
        assert all(len(r["ids"]) == r["length"] == capacity for r in rs[:-1])
        for r in rs:
            assert want[i][r["start"] : r["start"] + r["length"]] == r["ids"]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = sum(map(len, want.values()))
    assert len(seqs) <= -(-total // capacity) + 1
    assert packing.pack(nothing, VOCABULARY).count() == 0


def test_scores(spark, docs, rows, nothing):
    zstandard = pytest.importorskip("zstandard")
    own = spark.createDataFrame([(i,) for i, _, lang in rows if lang == "en"], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.compression_scores(docs, own, size=2000).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i]["n_bytes"] == len((text or "").encode())
        if not text:
            assert got[i]["score"] == 0

    def size(raw, within):
        counts = Counter(w for t in within for w in (t or "").split())
        best = sorted((w for w in counts if counts[w] > 1 and 4 <= len(w.encode())), key=lambda w: (-counts[w] * (len(w.encode()) - 3), w))
        out, left = [], 2000
        for w in best[:400]:
            if len(w.encode()) + 1 > left:
                break
            out.append(w.encode() + b" ")
            left -= len(out[-1])
        data = b"".join(reversed(out))
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        return len(c.compress(raw)) if raw else 0

    for i, text, _ in rows:
        raw = (text or "").encode()
        a, b = size(raw, [t for _, t, _ in rows]), size(raw, [t for _, t, lang in rows if lang == "en"])
        assert (got[i]["general_bytes"], got[i]["domain_bytes"]) == (a, b), i
        assert got[i]["score"] == (8 * (a - b) / len(raw) if raw else 0)
    assert lm_score.compression_scores(nothing, own).count() == 0
    assert lm_score.compression_scores(docs, own.limit(0)).count() == len(rows)


WORDS = {"en": "the of and with that from this have were which their there".split(), "de": "der die und nicht eine wurde zwischen über für können".split(), "fr": "le la les des être où façon était pour dans".split()}


def test_dictionaries_grow_with_the_vocabulary(spark):
    words = [f"word{k:06d}" for k in range(20_000)] + ["漢" * 100]
    counts = spark.createDataFrame([(w, 2, 0) for w in words], "word string, n_general long, n_domain long")
    assert sorted(lm_score.dictionary(counts, "n_general").decode().split()) == sorted(words)  # 220 KB, and a word of 300 bytes
    assert lm_score.dictionary(counts, "n_domain") == b""


def test_language(spark, nothing):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 40))), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    odd = [(900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (903, " ".join(WORDS["en"] * 3 + WORDS["fr"]), None)]
    got = {r["doc_id"]: r for r in language_id.identify(make(spark, rows + odd), sample=60).collect()}
    assert len(got) == 304
    for i, _, _ in rows + odd:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1
    held = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert language_id.identify(nothing).count() == 0
    alone = make(spark, [(1, "abc", None)])
    assert language_id.identify(alone).first()["lang_pred"] == "und"


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, p = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1
    which, counts = np.array([0, 3, 5, 6, 2, 2, 1, 4]), np.array([3, 0, 5])
    got = language_id.marginals(e, which, counts, p)
    at = 0
    for row, n in enumerate(counts):
        want = np.zeros(3)
        weight = {}
        for path in np.ndindex(*[3] * n):
            w = 1.0
            for t, s in enumerate(path):
                w *= e[which[at + t], s] * (p[path[t - 1], s] if t else 1)
            weight[path] = w
        z = sum(weight.values())
        if n:
            for path, w in weight.items():
                for s in path:
                    want[s] += w / z
        assert np.allclose(got[row], want)
        at += n


def quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(grams)
    cover = {p for k, g in enumerate(grams) if n[g] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if re.sub("[\x20\x09-\x0d]+", "", x)]
    base = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), base


def test_quality(spark, docs, rows, nothing):
    rng = random.Random(8)
    good = "\n".join(" ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(9)).capitalize() + "." for _ in range(9))
    menu = "\n".join(["Home | News | Sport | Login"] * 2 + ["a &&& b *** c ### d $$$ e %%% " * 4] * 5 + [good.split("\n")[0]])
    extra = [(800, good, None), (801, menu, None), (802, good + "\nAll rights reserved.", None)]
    df = docs.unionByName(make(spark, extra))
    got = {r["doc_id"]: r for r in quality_rules.quality_report(df).collect()}
    for i, text, _ in rows + extra:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == quality(text), i
    assert got[800]["kept"] and got[802]["kept"] and not got[801]["kept"] and not got[500]["kept"]
    kept = {r["doc_id"]: r["text"] for r in quality_rules.quality_filter(df).collect()}
    assert set(kept) == {i for i, r in got.items() if r["kept"]}
    assert kept[800] == good and kept[802] == good
    assert quality_rules.quality_filter(df).columns == df.columns
    assert quality_rules.quality_report(nothing).count() == 0


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = docs
    sizes = []
    for name, stage in pipeline.STAGES:
        before = out.columns
        out = stage(spark, out, "").persist()
        sizes.append(out.count())
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == before
    assert sizes[-1] > 0
    empty = docs.where(F.lit(False))
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
