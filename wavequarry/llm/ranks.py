"""Prefix doubling over the blocks of a task: ranks of byte strings from pairs of shorter strings' ranks."""

from __future__ import annotations

import numpy as np

UNIT = 8


def units_of(data: bytes) -> np.ndarray:
    """The 8 bytes that begin at each position, as a number; zeros follow the end."""
    padded = data + bytes(UNIT)
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def rank_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rank of each pair among all of them, from 0; equal pairs share one."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return out


def rank(units: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rank of the `size` bytes at each position: of the pair of ranks at the offsets 0 and size - half, half a power of two."""
    if size <= UNIT:
        return units[at] & np.uint64((1 << 8 * size) - 1)
    half = 1 << (size - 1).bit_length() - 1
    both = rank(units, np.concatenate([at, at + (size - half)]), half)
    return rank_pairs(both[: len(at)], both[len(at) :])


def ranked(units: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions' numbers, ranks) of those `size`-byte strings that occur more than once.

    Ranks at lengths 8, 16, 32, ...: positions whose rank is unique drop out, the others are ranked again
    at twice the length, until it reaches `size`.
    """
    left, length = np.arange(len(at)), min(UNIT, size)
    while True:
        _, names, counts = np.unique(rank(units, at[left], length), return_inverse=True, return_counts=True)
        keep = counts[names] > 1
        left, names = left[keep], names[keep]
        if length == size or not len(left):
            return left, names
        length = min(2 * length, size)


def later_windows(rows: list[tuple], size: int) -> list[tuple]:
    """(key, tag, part) of each run of windows that also start in a block with a smaller key; rows are (a, key, tag, bytes)."""
    data = b"".join(r[3] for r in rows)
    starts = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows])))
    counts = np.diff(starts) - size + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    block = np.repeat(np.arange(len(rows)), counts)
    at = np.arange(first[-1]) - first[block] + starts[block]
    left, names = ranked(units_of(data), at, size)
    later = np.zeros(len(at) + 1, bool)
    if len(left):
        key = np.array([r[1] for r in rows], np.int64)[block[left]]
        order = np.lexsort((key, names))
        new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
        least = key[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later[left[order[key[order] > least]]] = True
    # runs of such windows, cut at the blocks' borders
    edge = np.zeros(len(at) + 1, bool)
    edge[first[:-1]] = True
    begin = np.flatnonzero(later & (edge | ~np.concatenate(([False], later[:-1]))))
    stop = np.flatnonzero(later[:-1] & (edge[1:] | ~later[1:])) + 1
    return [(rows[i][1], rows[i][2], a << 8 | n) for i, a, n in zip(block[begin].tolist(), (begin - first[block[begin]]).tolist(), (stop - begin).tolist(), strict=True)]
