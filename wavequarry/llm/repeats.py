"""Exact repeated windows over a whole corpus, by anchors; shared by the substring operators.

Round one sorts every document's anchor runs by (anchor hash, context hash): anchors that occur
once drop out, and runs whose whole context occurs more than once are settled together. Round two
settles the single windows of what is left, anchors that occur in different contexts. Where they are
sorted by Spark it is by the pair of hashes of their first and their last part. Rows are labelled in one streaming pass over sorted
partitions that remembers one row, so a window in a third of all documents needs no more memory
than a rare one.

Frequent text doesn't meet in one task. Within a document only the first run of a context is sent;
among some hundred thousand rows of a task only one of a context is, the others' verdicts being
known. Anchors that are frequent in a sample of documents are dealt out by context, and all their
contexts are expanded: the sample decides where rows go, never what becomes of them.

Round two sends whole contexts, as blocks, and a task settles all blocks of an anchor together:
words by factoring them against each other (factors.py), bytes by prefix doubling (ranks.py). The
pairs of windows remain the way for anchors too frequent for one task: those in the list, and any
whose group turns out to be.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import factors, ranks
from .anchors import SEGMENT, byte_symbols, document_runs, mix, prefix, substrings, word_symbols
from .common import materialize

FULL, EXPAND, HOT = 1, 2, 4
LAST_KEY = (1 << 63) - 1
BATCH = 256
#: Rows of a task that are combined before they are sent.
COMBINED = 1 << 19
#: One document in SAMPLE is looked at for frequent anchors: those in FREQUENT of the sampled ones, or in 4.
#: A document has some hundreds of anchors, so the list has at most some hundreds / FREQUENT entries.
SAMPLE, FREQUENT = 64, 0.002


def symbols_of(kind: str, data: bytes) -> np.ndarray:
    return byte_symbols(np.frombuffer(data, np.uint8)) if kind == "bytes" else word_symbols(data)


def tags(data: list[bytes], counts: list[int], numbers: np.ndarray) -> np.ndarray:
    """The text's CRC-32 above a number in it: tells rows apart that share a key."""
    sums = np.array([zlib.crc32(d) for d in data], np.uint64) << np.uint64(32)
    return (np.repeat(sums, counts) | numbers.astype(np.uint64)).view(np.int64)


ROWS = "a long, b long, key long, tag long"
#: Bits of the second names that are given up: a context's keeps 62, so that its sign can tell frequent
#: anchors and none is DONE, a window's 63.
CONTEXT_SHIFT, WINDOW_SHIFT = 2, 1
#: part of a row that is a single window, whose tag holds its start and not a run's number; factors have smaller ones.
WINDOW = 1 << 16
#: b of a row whose verdict, FULL, is known; a says where it goes.
DONE = -(1 << 63)


class Sent:
    """Rows gathered until there are enough of them to be combined, then sent as Arrow batches."""

    def __init__(self, by_order: bool, once: bool) -> None:
        """once: a document's first row of an (a, b) stands for its others."""
        self.by_order, self.once, self.parts, self.size = by_order, once, [], 0

    def add(self, *columns: np.ndarray) -> pa.RecordBatch | None:
        """a, b, key, tag and the number of the physical row, in order of position within it."""
        self.parts.append(columns)
        self.size += len(columns[0])
        return self.flush() if self.size >= COMBINED else None

    def flush(self) -> pa.RecordBatch:
        whole = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        if not len(whole[0]):
            return self.batch(*whole[:4])
        order = np.argsort(mix(whole[0].view(np.uint64) + mix(whole[1].view(np.uint64))), kind="stable")
        a, b, key, _, row = (c[order] for c in whole)
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        own = new | np.concatenate(([True], row[1:] != row[:-1])) if self.once else np.ones(len(a), bool)
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if self.by_order:
            least = np.minimum.reduceat(key, start)[group]
            # each physical row with the smallest key needs a verdict of its own: rows may share a key
            done, send = own & (key > least), np.flatnonzero(own & (key == least))
        else:
            done, send = own & (np.diff(np.append(start, len(a))) > 1)[group], start
        # in the order of the documents again, whose keys then compress well
        a, b, key, tag = (c[np.sort(order[send])] for c in whole[:4])
        told = np.sort(order[done])
        k, t = whole[2][told], whole[3][told]
        anywhere = mix(k.view(np.uint64) + t.view(np.uint64)).view(np.int64)
        return self.batch(*(np.concatenate(c) for c in ((a, anywhere), (b, np.full(len(told), DONE)), (key, k), (tag, t))))

    @staticmethod
    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "key", "tag"])


def runs_of(batch: pa.RecordBatch, i: int, kind: str, k: int, size: int):
    keys = batch.column(0)[i : i + BATCH].to_numpy()
    data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1)[i : i + BATCH].to_pylist()]
    return keys, data, list(document_runs([symbols_of(kind, d) for d in data], k, size))


def runs_for(kind: str, k: int, size: int, by_order: bool, hot: np.ndarray):
    """Rows of runs; b is negative where the anchor is a frequent one."""

    def find(batches):
        sent, row = Sent(by_order, True), 0
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                keys, data, found = runs_of(batch, i, kind, k, size)
                counts = [len(f[0]) for f in found]
                numbers = np.concatenate([np.arange(n) for n in counts])
                anchor, context = (np.concatenate([f[c] for f in found]) for c in (2, 3))
                frequent = np.isin(anchor, hot)
                b = (context >> np.uint64(CONTEXT_SHIFT)).astype(np.int64)
                rows = np.repeat(np.arange(row, row + len(data)), counts)
                row += len(data)
                if out := sent.add(anchor.view(np.int64), np.where(frequent, -1 - b, b), np.repeat(keys, counts), tags(data, counts, numbers), rows):
                    yield out
        if sent.parts:
            yield sent.flush()

    return find


def anchors_for(kind: str, k: int, size: int):
    """Distinct anchors of each document."""

    def find(batches):
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                found = [np.unique(f[2]) for f in runs_of(batch, i, kind, k, size)[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["a"])

    return find


class Labels:
    """From columns a, b, key, tag sorted by them to (key, tag, kind); rows that are DONE only pass through.

    FULL: the row's (a, b) occurs with a smaller key (by_order), or more than once. EXPAND: the
    row stands for its (a, b), and others with the same a differ in b (and, by_order, in key).
    HOT: its anchor is a frequent one, whose other contexts are elsewhere.
    """

    def __init__(self, by_order: bool) -> None:
        self.by_order, self.held, self.multi_before, self.more_before = by_order, None, False, False

    def push(self, columns: list[np.ndarray]):
        done = columns[1] == DONE
        if done.any():
            yield self.made(columns[2][done], columns[3][done], np.full(int(done.sum()), FULL, np.int8))
            columns = [c[~done] for c in columns]
        held = self.held
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        a, b, key, tag = columns
        if not len(a):
            return
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        many = np.diff(np.append(start, len(a))) > 1
        many[0] |= self.more_before
        same = a[start[1:]] == a[start[:-1]]
        before = np.concatenate(([self.multi_before], same))
        multi = before | np.append(same, False)
        if self.by_order:
            full = key > key[start][group]
            # an anchor of one document only can't remove anything; at a batch's ends that isn't known
            top = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            several = np.minimum.reduceat(key, top) != np.maximum.reduceat(key, top)
            several[-1] = True
            several[0] |= held is not None
            sure = multi.copy()
            sure[-1] = True
            expand = ~full & sure[group] & several[np.searchsorted(top, np.arange(len(a)), side="right") - 1]
            expand |= ~full & (b < 0)
        else:
            full = many[group]
            expand = new & (multi[group] | (b < 0))
        kind = (full * FULL + expand * EXPAND + (expand & (b < 0)) * HOT).astype(np.int8)
        last = start[-1]
        self.held, self.multi_before, self.more_before = [c[last : last + 1] for c in columns], bool(before[-1]), bool(many[-1])
        kind[last] = 0
        out = np.flatnonzero(kind)
        yield self.made(key[out], tag[out], kind[out])

    def end(self):
        if self.held is not None:
            hot = bool(self.held[1][0] < 0)
            kind = EXPAND * (self.multi_before or hot) + HOT * hot + FULL * (self.more_before and not self.by_order)
            if kind:
                yield self.made(self.held[2], self.held[3], np.array([kind], np.int8))

    @staticmethod
    def made(key, tag, kind):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(tag), pa.array(kind)], names=["key", "tag", "kind"])


def label_for(by_order: bool):
    def label(batches):
        labels = Labels(by_order)
        for batch in batches:
            yield from labels.push([batch.column(i).to_numpy() for i in range(4)])
        yield from labels.end()

    return label


#: What becomes of the blocks of an anchor.
SETTLE = {("words", False): factors.factored, ("bytes", True): ranks.later_windows}


def settle_for(kind: str, size: int, by_order: bool, most: int):
    """(key, tag, part): WINDOW for each repeated window, and what factors.Blocks gives for each block (a row with symbols)."""

    def settled(found):
        for batch in found:
            full = batch.filter(pa.array(batch.column(2).to_numpy() & FULL > 0))
            yield pa.RecordBatch.from_arrays([full.column(0), full.column(1), pa.array(np.full(len(full), WINDOW))], names=["key", "tag", "part"])

    def settle(batches):
        labels, blocks = Labels(by_order), factors.Blocks(size, most, SETTLE[kind, by_order])
        for batch in batches:
            block = batch.column(4).is_valid()
            windows, own = batch.filter(pa.compute.invert(block)), batch.filter(block)
            yield from settled(labels.push([windows.column(i).to_numpy() for i in range(4)]))
            if len(own):
                yield from blocks.push(zip(*(own.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True))
        yield from settled(labels.end())
        yield from blocks.end()

    return settle


def labelled(rows: DataFrame, by_order: bool) -> DataFrame:
    place = F.when((F.col("b") < 0) & (F.col("b") > DONE), F.xxhash64("a", "b")).otherwise(F.col("a"))  # frequent anchors by context
    rows = rows.repartition(place).sortWithinPartitions("a", "b", "key", "tag")
    return rows.mapInArrow(label_for(by_order), "key long, tag long, kind byte")


def lists(batch: pa.RecordBatch, i: int, column: int):
    """(values, offsets) of a list column's rows i to i+BATCH."""
    part = batch.column(column)[i : i + BATCH]
    offsets = part.offsets.to_numpy()
    return part.values.to_numpy(zero_copy_only=False), offsets


def windows_for(kind: str, k: int, size: int, by_order: bool):
    """Rows of the runs to be expanded, whose numbers come doubled, and one more for windows.

    Windows: hashes of the first and the last `half` symbols. Other runs give one row, a block: their
    anchor, and their bytes or their words' hashes.
    """
    half = size * 2 // 3

    def blocks_of(keys, data, found, values, offsets, symbols):
        parts: list[tuple] = []
        for d, (first, last, anchor, _) in enumerate(found):
            chosen = np.unique(values[offsets[d] : offsets[d + 1]])
            chosen = chosen[chosen & 1 == 0] >> 1
            if not len(chosen):
                continue
            tag = tags([data[d]], [len(chosen)], chosen).tolist()
            for n, t in zip(chosen.tolist(), tag, strict=True):
                block = data[d] if kind == "bytes" else symbols[d]
                parts.append((int(anchor[n].view(np.int64)), 0, int(keys[d]), t, bytes(block[first[n] : last[n] + size])))
        columns = zip(*parts, strict=True) if parts else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["a", "b", "key", "tag", "symbols"])

    def widened(batch):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(batch), pa.binary())], names=["a", "b", "key", "tag", "symbols"])

    def expand(batches):
        sent, row = Sent(by_order, False), 0
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                keys = batch.column(0)[i : i + BATCH].to_numpy()
                data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1)[i : i + BATCH].to_pylist()]
                symbols = [symbols_of(kind, d) for d in data]
                values, offsets = lists(batch, i, 2)
                parts, counts, numbers = [], [], []
                found = list(document_runs(symbols, k, size))
                yield blocks_of(keys, data, found, values, offsets, symbols)
                for d, (first, last, _, _) in enumerate(found):
                    chosen = np.unique(values[offsets[d] : offsets[d + 1]])
                    chosen = chosen[chosen & 1 == 1] >> 1
                    n = last[chosen] - first[chosen] + 1
                    at = np.repeat(first[chosen] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    pairs = []
                    for s in range(0, len(symbols[d]), SEGMENT):  # one segment but for very long texts
                        own = at[(at >= s) & (at < s + SEGMENT)] - s
                        pre = prefix(symbols[d][s : s + SEGMENT + size])
                        pairs.append((mix(substrings(pre, own, own + half)), mix(substrings(pre, own + size - half, own + size))))
                    parts.append(tuple(np.concatenate([p[c] for p in pairs]) if pairs else np.empty(0, np.uint64) for c in (0, 1)))
                    counts.append(len(at))
                    numbers.append(at)
                a, b = (np.concatenate([p[c] for p in parts]).view(np.int64) for c in (0, 1))
                rows = np.repeat(np.arange(row, row + len(data)), counts)
                row += len(data)
                if out := sent.add(a, (b.view(np.uint64) >> np.uint64(WINDOW_SHIFT)).astype(np.int64), np.repeat(keys, counts), tags(data, counts, np.concatenate(numbers)), rows):
                    yield widened(out)
        if sent.parts:
            yield widened(sent.flush())

    return expand


#: A result column of spans: Arrow must not guess it from a batch without any.
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def spread(marks: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, context: np.ndarray, size: int):
    """Starts and stops that a document's marks stand for: a verdict on one run holds for all with its anchor and context.

    A mark's last two bits tell what it is: 0 a FULL run's number, 1 a repeated window's start, 2 a factor of a
    run: the run's number, the first of its windows (8 bits) and their number (8 bits).
    """
    numbers, what = marks >> 2, marks & 3
    _, same = np.unique(mix(anchor + mix(context.copy())), return_inverse=True)
    full = np.zeros(same.max(initial=-1) + 1, bool)
    full[same[numbers[what == 0]]] = True
    whole = np.flatnonzero(full[same])
    yield first[whole], last[whole] + size
    at = np.unique(numbers[what == 1])
    run, reach = np.searchsorted(first, at, side="right") - 1, np.ones(len(at), np.int64)
    factor = numbers[what == 2]
    run, reach = np.concatenate([run, factor >> 16]), np.concatenate([reach, factor & 255])
    at = np.concatenate([at, first[factor >> 16] + (factor >> 8 & 255)])
    if len(at):
        order = np.argsort(same, kind="stable")
        begin = np.searchsorted(same[order], same[run])
        count = np.searchsorted(same[order], same[run], side="right") - begin
        which = order[np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        start = first[which] + np.repeat(at - first[run], count)
        yield start, start + np.repeat(reach, count) + size - 1


def cover_for(kind: str, k: int, size: int, finish, kinds: list[pa.DataType]):
    """Covered symbols of each document from its FULL runs and repeated windows; finish(data, covered) makes the result's columns, of `kinds`."""

    def cover(batches):
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1)[i : i + BATCH].to_pylist()]
                values, offsets = lists(batch, i, 2)
                marked = [values[offsets[d] : offsets[d + 1]] for d in range(len(data))]
                some = [d for d, m in enumerate(marked) if len(m)]
                symbols = [symbols_of(kind, data[d]) for d in some]
                covers: dict[int, np.ndarray] = {}
                for d, s, found in zip(some, symbols, document_runs(symbols, k, size), strict=True):
                    steps = np.zeros(len(s) + 1, np.int32)
                    for start, stop in spread(marked[d], *found, size):
                        np.add.at(steps, start, 1)
                        np.add.at(steps, stop, -1)
                    covers[d] = np.cumsum(steps)[:-1] > 0
                rows = [finish(x, covers.get(d)) for d, x in enumerate(data)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + BATCH], *columns], names=["key", *[f"c{c}" for c in range(len(kinds))]])

    return cover


def repeated(docs: DataFrame, key: str, text: str, kind: str, k: int, size: int, by_order: bool, finish, kinds: list[pa.DataType]) -> DataFrame:
    """Apply finish() to every row's text and the mask of its symbols that repeated windows of `size` symbols cover.

    by_order: a window counts where it starts in a document with a smaller key, else where it
    starts anywhere else. A null key is never smaller than another nor larger than a null one.
    At most 255 windows may share an anchor.
    """
    if size - k >= 255:
        raise ValueError("too many windows an anchor")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("sum", F.crc32(F.encode("text", "UTF-8")))
    number, is_ = F.col("tag").bitwiseAND(0xFFFFFFFF), lambda bit: F.col("kind").bitwiseAND(bit) > 0
    of = lambda df, what: df.select("key", F.shiftrightunsigned("tag", 32).alias("sum"), what.alias("number"))

    def frequent():
        chosen = rows.where(F.pmod(F.xxhash64(F.lit(5), "key", "sum"), F.lit(SAMPLE)) == 0).select("key", "text")
        least = max(4, int(FREQUENT * chosen.count()))
        counts = chosen.mapInArrow(anchors_for(kind, k, size), "a long").groupBy("a").count().where(F.col("count") >= least)
        return np.array([r["a"] for r in counts.select("a").collect()], np.int64).view(np.uint64)

    def first_round():
        found = rows.select("key", "text").mapInArrow(runs_for(kind, k, size, by_order, frequent()), ROWS)
        return materialize(labelled(found, by_order), "repeats-runs")

    def second_round(want):
        want = want.groupBy("key", "sum").agg(F.collect_list("number").alias("numbers"))
        chosen = rows.select("key", "sum", "text").join(want, ["key", "sum"]).select("key", "text", "numbers")
        found = chosen.mapInArrow(windows_for(kind, k, size, by_order), ROWS + ", symbols binary")
        found = found.repartition(F.col("a")).sortWithinPartitions("a", "b", "key", "tag")
        return materialize(found.mapInArrow(settle_for(kind, size, by_order, factors.MOST), "key long, tag long, part long"), "repeats-windows")

    runs = first_round()
    marks = of(runs.where(is_(FULL)), number * 4)
    rounds = [second_round(of(runs.where(is_(EXPAND)), number * 2 + is_(HOT).cast("long")))]
    again = rounds[0].where("part = -1")
    if not again.isEmpty():
        rounds.append(second_round(of(again, number * 2 + 1)))
    for found in rounds:
        marks = marks.union(of(found.where("part <> -1"), F.when(F.col("part") == WINDOW, number * 4 + 1).otherwise((F.shiftleft(number, 16) + F.col("part")) * 4 + 2)))
    marks = marks.groupBy("key", "sum").agg(F.collect_list("number").alias("numbers"))
    none = F.array().cast("array<bigint>")
    joined = rows.join(marks, ["key", "sum"], "left").select("id", "text", F.coalesce("numbers", none).alias("numbers"))
    schema = from_arrow_schema(pa.schema([("key", pa.int64()), *[(f"c{c}", t) for c, t in enumerate(kinds)]]))
    return joined.mapInArrow(cover_for(kind, k, size, finish, kinds), schema).withColumnRenamed("key", key)
