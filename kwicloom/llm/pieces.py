"""Vectorised pre-tokenisation: the pieces of a batch of texts as code-point spans, grouped by content.

Two patterns are known: ``words`` (contractions, letter runs, single numbers, other runs; white space is
dropped) and ``spaced`` (as ``public_tokenizers.PATTERN``: runs take one leading space). Texts with an
apostrophe that could start a contraction are split by the pattern itself, piece by piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

#: Unicode White_Space, which is what Rust's and Oniguruma's ``\\s`` mean.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACED = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point; surrogates count as other."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, f"[{WHITE}]")):
        found = np.frombuffer("".join(regex.findall(f"{what}+", every)).encode("utf-32-le"), np.uint32)
        out[found] = kind
    return out


@lru_cache(2)
def pattern(spaced: bool) -> regex.Pattern:
    return regex.compile(SPACED if spaced else WORDS)


@lru_cache(1)
def powers(n: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (unsigned integers), by content and length only."""
    out = np.zeros(len(starts), np.uint64)
    pw, inv = powers()
    size = len(pw) - 1
    if len(values) <= size:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * pw[: len(values)], out=total[1:])
        out = (total[ends] - total[starts]) * inv[starts]
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):  # one text larger than the table: in pieces of it
        h = 0
        for c in range(a, b, size):
            part = values[c : min(b, c + size)].astype(np.uint64) + np.uint64(1)
            h = (h * 0x9E3779B97F4A7C15 + int((part * pw[: len(part)]).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def spans(points: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of one run of code points, for texts without contractions."""
    kind = classes()[points]
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    if not spaced:
        edge |= kind == NUMBER
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        solid = kind[starts] != SPACE
        return starts[solid], ends[solid]
    # the last white space before a solid run: joins the run if it is a blank, else is a piece of its own
    before = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    blank = points[before] == 32
    edge[before + 1] &= ~np.isin(before + 1, before[blank] + 1, assume_unique=True)
    edge[before] = True
    starts = np.flatnonzero(edge)
    return starts, np.append(starts[1:], n)


def pieces_of(texts: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, piece starts and ends in them, and the number of pieces of each text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    starts, ends, counts, at = [], [], np.zeros(len(texts), np.int64), 0
    for i, (t, p) in enumerate(zip(texts, points)):
        if CONTRACTION.search(t):
            found = [m.span() for m in pattern(spaced).finditer(t)]
            both = np.array(found, np.int64).reshape(-1, 2)
            s, e = both[:, 0], both[:, 1]
        else:
            s, e = spans(p, spaced)
        starts.append(s + at)
        ends.append(e + at)
        counts[i] = len(s)
        at += len(p)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(points, np.uint32), join(starts, np.int64), join(ends, np.int64), counts


def distinct(joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of ``joined``, whose code points are ``points``, and, for each piece, its place among them. Equal hashes are checked code point by code point."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    hashes = span_hashes(points, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    same = np.array_equal(lengths, lengths[first][which])
    if same:
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        same = np.array_equal(points[np.repeat(starts, lengths) + offset], points[np.repeat(starts[first][which], lengths) + offset])
    if same:
        return [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], which
    table: dict[str, int] = {}
    which = np.array([table.setdefault(joined[a:b], len(table)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    return list(table), which
