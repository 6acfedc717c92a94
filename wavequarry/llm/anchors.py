"""Locally minimal positions ("anchors") of symbol sequences.

A window of L symbols holds w = L-k+1 k-grams; its anchor is the leftmost k-gram with the
smallest hash. Two equal windows have the same anchor at the same place, so windows can be
compared by anchor instead of one by one. Consecutive windows with the same anchor form a run;
runs with the same anchor and the same text (context) hold the same windows.

Sequences are concatenated and hashed by numpy: prefix sums of symbol * B**i modulo 2**64 give
the hash of any substring in a few array operations.
"""

from __future__ import annotations

import numpy as np

from .common import worker_cache

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
POS_BITS = 24
#: Sequences longer than this are cut into segments that overlap by L-1 symbols.
SEGMENT = 1 << 22
#: Symbols hashed at a time; small enough for the CPU's cache.
CHUNK = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of BASE and of its inverse."""

    def make():
        up, down = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    size = max(1 << 19, 1 << int(n).bit_length())
    return worker_cache(f"powers-{size}", make)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(symbols: np.ndarray) -> np.ndarray:
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def substrings(pre: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = powers(len(pre))
    return (pre[stop] - pre[start]) * down[start]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i that has a whole window."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return BYTE_TABLE[data]


BYTE_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of words in bytes that end with a separator; only 0x09-0x0D and 0x20 separate."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def runs(symbols: np.ndarray, starts: np.ndarray, k: int, size: int):
    """Anchor runs of the sequences symbols[starts[d]:starts[d+1]].

    Returns arrays (sequence, first window, last window, anchor hash, context hash), positions
    counted in `symbols`, in order of position; a sequence of fewer than `size` symbols has none.
    """
    w, n = size - k + 1, len(symbols)
    if n < size:
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(U), e.astype(U)
    assert n < 1 << POS_BITS
    pre = prefix(symbols)
    _, down = powers(n + 1)
    grams = mix((pre[k:] - pre[:-k]) * down[: n - k + 1])
    tagged = (grams & ~U((1 << POS_BITS) - 1)) | np.arange(len(grams), dtype=U)
    least = (sliding_min(tagged, w) & U((1 << POS_BITS) - 1)).astype(np.int64)  # one for each window
    ok = np.ones(n - size + 1, bool)
    for s in starts[1:-1]:
        ok[max(0, s - size + 1) : s] = False
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    last = np.empty_like(first)
    valid = np.flatnonzero(ok)
    at = np.searchsorted(valid, first)
    last[:-1] = valid[at[1:] - 1]
    if len(first):
        last[-1] = valid[-1]
    anchor = least[first]
    context = substrings(pre, first, last + size)
    context = mix(context + (anchor - first).astype(U) * U(0xA24BAED4963EE407) + (last - first).astype(U) * U(0x9FB21C651E98DF25))
    return np.searchsorted(starts, first, side="right") - 1, first, last, grams[anchor], context


def document_runs(documents: list[np.ndarray], k: int, size: int):
    """(first, last, anchor hash, context hash, prefix hashes) of each symbol sequence, positions in it.

    Short sequences are hashed together; a long one is cut into overlapping segments, always at the
    same places, so that a later pass finds the same runs.
    """
    begin = 0
    while begin < len(documents):
        stop, total = begin, 0
        while stop < len(documents) and (stop == begin or total + len(documents[stop]) <= CHUNK):
            total += len(documents[stop])
            stop += 1
        if total > SEGMENT:
            parts = [[], [], [], []]
            whole = documents[begin]
            for at in range(0, max(1, len(whole) - size + 1), SEGMENT):
                piece = whole[at : at + SEGMENT + size - 1]
                _, first, last, a, c = runs(piece, np.array([0, len(piece)]), k, size)
                for out, x in zip(parts, (first + at, last + at, a, c), strict=True):
                    out.append(x)
            yield tuple(map(np.concatenate, parts))
        else:
            symbols = np.concatenate(documents[begin:stop]) if stop > begin + 1 else documents[begin]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in documents[begin:stop]])))
            which, first, last, a, c = runs(symbols, starts, k, size)
            cut = np.searchsorted(which, np.arange(stop - begin + 1))
            for d, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                yield first[i:j] - starts[d], last[i:j] - starts[d], a[i:j], c[i:j]
        begin = stop


def word_symbols(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    padded = np.frombuffer(data + b" ", np.uint8)
    start, stop = word_bounds(padded)
    if len(padded) <= SEGMENT:
        return mix(substrings(prefix(byte_symbols(padded)), start, stop) + (stop - start).astype(U))
    out = []
    for i in range(0, len(start), 1 << 16):  # a very long text: some words at a time
        a, b = start[i : i + (1 << 16)], stop[i : i + (1 << 16)]
        out.append(mix(substrings(prefix(byte_symbols(padded[a[0] : b[-1]])), a - a[0], b - a[0]) + (b - a).astype(U)))
    return np.concatenate(out or [np.empty(0, U)])
