"""Exact, line, n-gram, substring and suffix deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kwicloom.llm import exact_dedup, line_dedup, ngram_join, substring_blocks, suffix_dedup, units

from .conftest import make

SPACE = "[\x20\x09-\x0d]+"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, rows, keep, weak):
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))) if weak else exact_dedup.sha256  # a weak digest collides
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    pick = min if keep == "smallest" else max
    expected = {i: (pick(groups[lower(t)]), len(groups[lower(t)]), i == pick(groups[lower(t)])) for i, t, _ in rows}
    got = exact_dedup.exact_dedup(docs, keep=keep, digest=digest).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == expected
    assert len(got) == len(rows)


def test_exact_repeated_rows_and_nothing(spark, nothing):
    df = make(spark, [(1, "a", None), (1, "a", None), (2, "A", None)])
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(1, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_merge_index(spark):
    batch = lambda *rows: spark.createDataFrame([(bytes([d]), k) for d, k in rows], "digest binary, key long")
    index = exact_dedup.MergeIndex()
    hit = lambda *rows: sorted(bytes(r["digest"])[0] for r in index.add(batch(*rows)).collect())
    assert hit((1, 5), (2, 6), (2, 7)) == [2] and [r.tier for r in index.runs] == [0]
    assert hit((1, 3), (3, 8)) == [1] and [r.tier for r in index.runs] == [1]
    assert hit((3, 1), (4, 9)) == [3] and [r.tier for r in index.runs] == [1, 0]
    assert hit() == [] and [r.tier for r in index.runs] == [2]
    assert sorted((bytes(r["digest"])[0], r["key"], r["n"]) for r in index.level().collect()) == [(1, 3, 2), (2, 6, 2), (3, 1, 2), (4, 9, 1)]


def removed_by_lines(rows, k=line_dedup.SHINGLE, t=line_dedup.THRESHOLD, least=line_dedup.MIN_CHARS):
    occ = [(i, n, line) for i, text, _ in rows for n, line in enumerate((text or "").split("\n")) if line_dedup.eligible(line, least)]
    names = list(dict.fromkeys(line for *_, line in occ))
    sets = [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    first, gone, index = {}, defaultdict(set), {x: i for i, x in enumerate(names)}
    for i, n, line in sorted(occ, key=lambda x: x[:2]):
        first.setdefault(find(index[line]), (i, n))
        if first[find(index[line])] != (i, n):
            gone[i].add(n)
    return gone


def test_lines(docs, rows):
    gone = removed_by_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        kept = "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in gone[i])
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone[i]), sha(kept)), i


def test_short_lines(spark):
    rows = [(i, f"All rights reserved.\n\nok\nThe text of document {i * 7919}, {'abcdefgh'[i] * 20}", None) for i in range(8)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(make(spark, rows)).collect()}
    assert got == {i: (4, 2 if i else 0) for i in range(8)}  # blank lines stay


def test_only_lines_that_meet_or_recur_travel(spark, monkeypatch):
    rng = np.random.default_rng(2)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 12)) for _ in range(300)]
    rows = [(i, f"{x}\nAll rights reserved.\n" + (f"{own[0]} {i}" if i < 3 else ""), None) for i, x in enumerate(own)]
    written, write = {}, line_dedup.materialise

    def counting(df, name, **options):
        out = write(df, name, **options)
        written[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counting)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(make(spark, rows)).collect()}
    assert got == {i: 1 if i > 2 or i == 0 else 2 for i in got} and len(got) == 300
    assert written["distinct-lines"] == 304 and written["met-lines"] == 5


def test_ids_beyond_32_bits(spark):
    rows = [(sign * (1 << 62) + i, f"same\n{i * 7919} and so on, {'abcd'[i] * 20}\nsame", None) for i in range(4) for sign in (-1, 1)]
    for part in (rows, [(i, t, x) for i, (_, t, x) in enumerate(rows)], [((-1) ** i * ((1 << 32) - 1 - i), t, x) for i, (_, t, x) in enumerate(rows)]):
        gone = removed_by_lines(part)
        assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(make(spark, part)).collect()} == {i: len(gone[i]) for i, *_ in part}


@pytest.mark.parametrize("edges,more,want", [([(1, 2), (5, 6), (8, 9)], [(2, 6), (6, 7), (3, 4)], {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 3: 3, 4: 3, 8: 8, 9: 8}), ([], [(3, 4), (4, 1)], {1: 1, 3: 1, 4: 1})])
def test_components_are_joined(spark, edges, more, want):
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    got = line_dedup.joined(line_dedup.components(frame(edges)), frame(more)).collect()
    assert {r["id"]: r["root"] for r in got} == want and len(got) == len(want)


def test_drop_lines_keeps_columns(docs, rows, nothing):
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    gone = removed_by_lines(rows)
    kept = {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i]) if gone[i] else t for i, t, _ in rows}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t for i, t in kept.items() if not gone[i] or t.split()}
    assert line_dedup.line_dedup(nothing).count() == 0


def test_ngram_join(spark, docs, rows, nothing):
    first, sets = {}, {}
    for i, text, _ in rows:
        w = words((text or "").lower())
        first.setdefault(" ".join(w), i)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    reps = sorted(first.values())
    links = {(a, b) for a in reps for b in reps if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    degree = Counter(x for p in links for x in p)
    root = {i: i for i in reps}
    for _ in reps:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs).collect()}
    for i, text, _ in rows:
        rep = first[" ".join(words((text or "").lower()))]
        assert (got[i]["copy_of"], got[i]["n_links"], got[i]["class_id"], got[i]["kept"]) == (rep, degree[rep], root[rep], root[rep] == i), i
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert kept == set(root.values())
    assert ngram_join.ngram_join(nothing).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]), None) for i in range(25)]
    got = ngram_join.ngram_join(make(spark, rows)).collect()
    assert all(r["n_links"] == 24 and r["class_id"] == 0 for r in got)


@pytest.mark.parametrize("words", [32, 1])
def test_crowds_of_similar_texts(spark, monkeypatch, words):
    """Pairs of near copies and of texts with a common line are counted, but few are written."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "SQUARE", 32, raising=False)
    monkeypatch.setattr(ngram_join, "WORDS", words, raising=False)  # one word of bits: most shingles are in the rest
    rng, texts = np.random.default_rng(5), []
    for c in range(2):
        base = [f"b{c}x{i}" for i in range(80)]
        texts += [[f"n{rng.integers(40)}" if rng.random() < r else w for w in base] for r in rng.uniform(0.02, 0.12, 150)]
    line = [f"l{i}" for i in range(14)]
    texts += [line + [f"o{k}x{i}" for i in range(rng.integers(4, 24))] for k in range(150)]
    texts = list(dict.fromkeys(map(tuple, texts)))
    rows = [(k, " ".join(w), None) for k, w in enumerate(texts)]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in texts]
    links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    degree, root = Counter(x for p in links for x in p), list(range(len(sets)))
    for _ in range(9):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    written, write = Counter(), ngram_join.materialise

    def counting(df, name, **options):
        out = write(df, name, **options)
        written[name] = max(written[name], out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counting)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.ngram_join(make(spark, rows)).collect()}
    assert {i: c for i, (_, c) in got.items()} == dict(enumerate(root))
    assert all(got[i][0] <= degree[i] for i in got) and sum(n for n, _ in got.values()) >= 0.99 * 2 * len(links)
    assert max(written[x] for x in ("candidates", "keyed-pairs", "links")) < len(links) / 4


def test_links_near_the_threshold(spark):
    n, pairs = 1500, []
    for k in range(n):
        own = [f"w{k}x{i}" for i in range(60)]
        pairs += [(2 * k, own), (2 * k + 1, own[:41] + [f"v{k}x{i}" for i in range(19)])]  # 39 of 77 trigrams are common
    docs = spark.createDataFrame(pairs, "id long, w array<string>").persist()
    links = ngram_join.similar_pairs(docs, docs.select("id"), 3, 0.5)
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(n)}
    assert len(got) >= 0.98 * n
    few = docs.where("id < 600")
    short = ngram_join.similar_pairs(few, few.select("id"), 3, 0.5, start=5)  # depth 5 finds few of these: it has to be shortened
    assert short.count() >= 0.97 * 300


def test_chance_of_the_real_prefixes():
    assert ngram_join.met_chances(3, 40)[500] < 1 - (1 - 0.5**3) ** 40  # prefixes share values
    assert ngram_join.met_chances(3, 40)[500] >= 0.98 and ngram_join.first_depth(0.5, 0.98, 40) == 3
    assert ngram_join.first_depth(0.3, 0.98, 40) == 2


def removed_words(rows, width):
    first = {}
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, text, _ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (w, gone)
    return out


@pytest.mark.parametrize("width", [50, 6])
def test_substrings(docs, rows, width, nothing):
    expected = removed_words(rows, width)
    got = {r["doc_id"]: r for r in substring_blocks.substring_dedup(docs, window=width).collect()}
    assert len(got) == len(rows)
    for i, (w, gone) in expected.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))), i
    assert substring_blocks.substring_dedup(nothing).count() == 0


def test_words_whose_hashes_could_be_confused(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]  # Thue-Morse words collide under polynomials modulo 2**64
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    head, tail = [f"h{i}" for i in range(24)], [f"t{i}" for i in range(25)]
    rows = [(k, " ".join([*head, mid, *tail]), None) for k, mid in ((1, a), (2, b), (3, a))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_blocks.substring_dedup(make(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = make(spark, [(None, text, None), (5, text, None), (None, text, None)])
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_blocks.substring_dedup(df).collect()) == [(0, 0), (0, 0), (5, 60)]
    assert sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in suffix_dedup.suffix_dedup(df).collect()) == [(0, False), (0, True), (5, True)]
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.line_dedup(df).collect()) == [(0, 0), (0, 0), (5, 1)]
    assert ngram_join.ngram_join(df).count() == exact_dedup.exact_dedup(df).count() == 3


def test_relays_lose_nothing(docs, rows, monkeypatch, spark):
    monkeypatch.setattr(units, "FAN", 3)
    monkeypatch.setattr(units, "UNIT_BYTES", 6000)
    removed = {i: sum(gone) for i, (_, gone) in removed_words(rows, 6).items()}
    assert {r["doc_id"]: r["n_removed"] for r in substring_blocks.substring_dedup(docs, window=6).collect()} == removed
    removed = {i: sum(gone) for i, (_, gone) in removed_bytes(rows, 20).items()}
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(docs, width=20, gram=10, hot=50).collect()} == removed


def test_blobs_of_a_sender_are_bounded():
    hashes = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (10, 1000, 100_000):
        blobs = sum(1 for _ in units.probe_mail(0, hashes, np.zeros(20_000, np.uint8), np.ones(20_000, np.uint8), units.Places.of(n)))
        assert blobs <= min(n, units.FAN)


def test_cut_repeats(docs, rows):
    out = substring_blocks.cut_repeats(docs, window=6)
    assert out.columns == docs.columns
    expected = removed_words(rows, 6)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, text, _ in rows:
        w, gone = expected[i]
        if not any(gone):
            assert texts[i] == text
        elif all(gone):
            assert i not in texts
        else:
            assert words(texts[i]) == [x for x, g in zip(w, gone) if not g]


def removed_bytes(rows, width):
    seen, out = set(), {}
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        out[i] = (b, gone)
    return out


@pytest.mark.parametrize("width,gram,hot", [(100, 50, 50_000), (20, 10, 50_000), (20, 10, 2)])
def test_suffixes(docs, rows, width, gram, hot, nothing):
    expected = removed_bytes(rows, width)
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, width=width, gram=gram, hot=hot).collect()}
    assert len(got) == len(rows)
    for i, (b, gone) in expected.items():
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))), i
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("width,gram", [(100, 50), (20, 10), (21, 4), (12, 12)])
def test_contexts_are_narrowed_without_loss(width, gram):
    rng = np.random.default_rng(width)
    passages = [rng.integers(97, 123, 4 * width).astype(np.uint8).tobytes() for _ in range(6)]
    texts = []
    for _ in range(60):
        own = rng.integers(97, 123, 2 * width).astype(np.uint8).tobytes()
        part = passages[rng.integers(6)][rng.integers(2 * width) :][: rng.integers(width // 2, 2 * width)]
        texts.append(own[: rng.integers(2 * width)] + part + own[rng.integers(2 * width) :])
    seen, want = set(), set()
    for d, text in enumerate(texts):
        for i in range(len(text) - width + 1):
            if text[i : i + width] in seen:
                want.add((d, i))
            seen.add(text[i : i + width])
    u = suffix_dedup.Unit(pa.table({"data": [units.dumps([*enumerate(texts)])]}), width, gram)
    contexts = []
    for lo, hi, at, h in zip(u.lo.tolist(), u.hi.tolist(), u.anchor.tolist(), u.hash.tolist()):
        d = int(u.doc(np.array([lo]))[0])
        i = lo - int(u.first[d])
        contexts.append(suffix_dedup.Context(u.raw[lo : hi + width], (d, 0, d, i), d, i, h, at - lo))
    n = Counter(x.hash for x in contexts)
    before = sum(len(x.text) for x in {x.text: x for x in contexts}.values() if n[x.hash] > 1)
    lost = {}
    left = suffix_dedup.undecided(contexts[::-1], width, gram, lost)
    got = {(d, i) for d, pairs in lost.items() for a, b in pairs for i in range(a, b + 1)}
    if left:
        for k, inner in suffix_dedup.later_windows([x.text for x in left], [x.own for x in left], width).items():
            got |= {(left[k].unit, left[k].lo + i) for i in inner.tolist()}
    assert got == want and want
    assert sum(len(x.text) for x in left) < 0.7 * before or gram == width
