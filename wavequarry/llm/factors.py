"""Greedy relative Lempel-Ziv factoring of blocks against each other.

A block is a run of symbols around one seed. The blocks of a group share the seed; each is factored
against the index of all blocks of its group, which are the only ones that a factor of the least
length through this seed can come from. The index is a sorted array of the suffixes that start at
the blocks' windows: the longest match of a suffix in any other block is with one of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .anchors import mix, prefix, substrings

#: Blocks of one group that are indexed in memory; a larger group's blocks are told to go another way.
MOST = 1 << 15
#: Bytes of whole groups that are indexed together.
HELD = 1 << 23


def longest_matches(symbols: np.ndarray, starts: np.ndarray, groups: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, first): of the longest factor at each window of each block, 0 where it is under `size`; where a block's windows begin.

    Block i is symbols[starts[i]:starts[i + 1]], at least `size` long, and of group groups[i].
    """
    sizes = np.diff(starts)
    counts = sizes - size + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    block = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(first[-1]) - first[block] + starts[block]
    pre = prefix(symbols)
    names = mix(substrings(pre, at, at + size) + mix(groups.astype(np.uint64) + np.uint64(1))[block])
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    length = np.zeros(len(at), np.int64)
    some = np.flatnonzero(again)
    if not len(some):
        return length, first
    # suffixes in order: by the first `size` symbols' name, then by each symbol after them to the block's end
    reach = int(sizes.max()) - size
    stop = starts[block[some] + 1]
    tail = np.zeros((reach, len(some)), np.uint64)
    for j in range(reach):
        inside = at[some] + size + j < stop
        tail[j, inside] = symbols[at[some][inside] + size + j]
    order = np.lexsort((*tail[::-1], names[some]))
    tail, some = tail[:, order], some[order]
    equal = names[some][1:] == names[some][:-1]
    more = np.zeros(len(equal), np.int64)
    going = equal.copy()
    for j in range(reach):  # symbols in common with the suffix before; 0 is a block's end
        going &= (tail[j, 1:] == tail[j, :-1]) & (tail[j, 1:] != 0)
        more += going
    match = np.where(equal, size + more, 0)
    length[some] = np.maximum(np.append(match, 0), np.concatenate(([0], match)))
    return length, first


def parse(length: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(first window, windows) of each factor: from the left the longest match, then on from where it ends.

    A window across a factor's end may still be repeated as a whole, in another block: the search
    goes on with the first window that sticks out, not with the first symbol after the factor.
    """
    i = 0
    while i < len(length):
        if length[i]:
            yield i, length[i] - size + 1
            i += length[i] - size + 1
        else:
            i += 1


def factored(rows: list[tuple], size: int) -> list[tuple]:
    """(key, tag, part) of each factor; rows are (a, key, tag, symbols as bytes)."""
    symbols = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(r[3]) // 8 for r in rows])))
    _, groups = np.unique([r[0] for r in rows], return_inverse=True)
    length, first = longest_matches(symbols, starts, groups, size)
    length, first = length.tolist(), first.tolist()
    return [(r[1], r[2], at << 8 | n) for i, r in enumerate(rows) for at, n in parse(length[first[i] : first[i + 1]], size)]


class Blocks:
    """Takes rows (a, key, tag, bytes) in the order of a, whole groups of them at a time to `settle`; part -1: the row's group is too large."""

    def __init__(self, size: int, most: int, settle) -> None:
        self.size, self.most, self.settle = size, most, settle
        self.rows: list[tuple] = []
        self.held, self.last, self.group, self.too_large = 0, None, 0, None

    def push(self, rows) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in rows:
            a, key, tag, block = row
            if a == self.too_large:
                out.append((key, tag, -1))
                continue
            if a != self.last:
                if self.held >= HELD:
                    yield from self.end()
                self.last, self.group = a, len(self.rows)
            self.rows.append(row)
            self.held += len(block)
            if len(self.rows) - self.group > self.most:
                out += [(key, tag, -1) for _, key, tag, _ in self.rows[self.group :]]
                self.held -= sum(len(r[3]) for r in self.rows[self.group :])
                del self.rows[self.group :]
                self.too_large, self.last = a, None
        if out:
            yield self.made(out)

    def end(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows, self.held = self.rows, [], 0
        if rows and (out := self.settle(rows, self.size)):
            yield self.made(out)

    @staticmethod
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "tag", "part"])
