"""The array algorithms alone."""

import random

import numpy as np
import pytest

from kwicloom.llm import suffix_array
from kwicloom.llm.packing import best_fit
from kwicloom.llm.suffix_dedup import leftmost_least


@pytest.mark.parametrize("per_name", [0, 64, 1 << 30])
def test_suffix_array(monkeypatch, per_name):
    monkeypatch.setattr(suffix_array, "PER_NAME", per_name)
    rng = random.Random(3)
    for it in range(300):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 3, 200])
        body = [rng.randint(1, k) for _ in range(n)]
        if it % 3 == 0 and n > 4:
            body = (body[: n // 3] * 5)[:n]
        s = np.array([*body, 0])
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        got = suffix_array.suffix_array(s)
        assert got.tolist() == want
        shared = suffix_array.permuted_common_prefixes(s, got)
        for a, b in zip(want[1:], want):
            x, y = s[a:].tolist(), s[b:].tolist()
            assert shared[a] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_suffix_array_of_a_long_text():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(35_000)).encode()
    s = np.append(np.frombuffer(text, np.uint8).astype(np.int64), 0)
    got = suffix_array.suffix_array(s)
    assert np.array_equal(np.sort(got), np.arange(len(s)))
    raw = text + b"\0"
    assert all(raw[a : a + 500] <= raw[b : b + 500] for a, b in zip(got[:-1].tolist(), got[1:].tolist()))


def test_leftmost_least():
    rng = np.random.default_rng(1)
    for _ in range(300):
        k = int(rng.integers(1, 20))
        v = rng.integers(0, rng.choice([2, 5, 1000]), rng.integers(0, 80)).astype(np.uint64)
        want = [s + int(np.argmin(v[s : s + k])) for s in range(max(0, len(v) - k + 1))]
        got = [0] * len(want)
        for lo, hi, at in zip(*leftmost_least(v, k)):
            got[lo : hi + 1] = [int(at)] * (hi - lo + 1)
        assert got == want


def test_best_fit_is_gapless():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {length: rng.randint(1, 9) for length in rng.sample(range(1, 101), 30)}
        runs, n = best_fit(histogram, 100)
        seqs: dict[int, list[tuple[int, int]]] = {}
        placed: dict[int, int] = {}
        for length, r0, r1, first, offset in runs:
            placed[length] = placed.get(length, 0) + r1 - r0
            for k in range(r1 - r0):
                seqs.setdefault(first + k, []).append((offset, length))
        assert placed == histogram and len(seqs) == n
        for items in seqs.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= 100
