"""SimHash near-dedup: pigeonhole blocks, verified Hamming distance, connected components.

64-bit fingerprints are split into m blocks; two that differ in at most d bits agree in at least
m - d blocks, so every choice of m - d blocks is a key and close pairs share one. Fingerprints are
made distinct first: copies cost one row. Inside a key's group links are found by peeling: each
fingerprint reached is compared with those not yet reached only, and gives one edge for each that
it reaches, so a group of n gives at most n - 1 edges.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, fresh, materialize, read

BITS, DISTANCE, WORDS, SEED = 64, 4, 4, 42
#: Groups over this size are dealt out in blocks, each pair of blocks on its own.
BLOCK = 1 << 14
BATCH = 2048


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of all `words`-word shingles, repeats included; no word: 0."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(batches):
    for batch in batches:
        for i in range(0, len(batch), BATCH):
            marks = np.array([fingerprint(t) for t in batch.column(1)[i : i + BATCH].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + BATCH], pa.array(marks), batch.column(2)[i : i + BATCH]], names=["key", "mark", "text_hash"])


def block_masks(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the block choices for n fingerprints: so many blocks that a random key is met less than once."""
    blocks = distance + 2
    while (blocks - distance) * BITS / blocks < np.log2(max(n, 2)) and blocks < 12:
        blocks += 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]


def peel(marks: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a forest that spans the components of `marks` under links of at most `distance` bits."""
    edges, left = [], marks
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                edges += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return edges


def links_for(distance: int):
    """From rows (key, part, mark) sorted by key and part to edges (a, b)."""

    def linked(keys: np.ndarray, marks: np.ndarray):
        cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
        sizes = np.diff(cut)
        two = cut[:-1][sizes == 2]
        two = two[np.bitwise_count(marks[two] ^ marks[two + 1]) <= distance]
        edges = [np.stack([marks[two], marks[two + 1]], axis=1)]
        for s, n in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if found := peel(marks[s : s + n], distance):
                edges.append(np.array(found, np.uint64))
        return np.concatenate(edges).astype(np.uint64)

    def link(batches):
        keys, marks = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        for batch in chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)])
                marks = np.concatenate([marks, batch.column(2).to_numpy().view(np.uint64)])
                last = len(keys) - int((keys == keys[-1]).all(axis=1)[::-1].argmin()) if len(keys) and not (keys == keys[-1]).all() else 0
            else:
                last = len(keys)
            if last:
                edges = linked(keys[:last], marks[:last]).view(np.int64)
                keys, marks = keys[last:], marks[last:]
                for i in range(0, len(edges), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(edges[i : i + (1 << 16), 0]), pa.array(edges[i : i + (1 << 16), 1])], names=["a", "b"])

    return link


def dealt(keys: DataFrame, by: str) -> DataFrame:
    """keys with a column `part`: every pair of blocks of a hot key becomes a group of its own."""
    hot = materialize(keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "simhash-hot")
    keys = keys.withColumn("part", F.lit(0).cast("long"))
    if not hot.isEmpty():
        mine = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j).cast("long") * 2**31 + F.greatest(mine, j))
        parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)
        keys = keys.drop("part").join(hot, "key", "left").withColumn("part", F.explode(parts)).drop("blocks")
    return keys


def near_pairs(marks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `mark`: a forest over each key's group, so that every link's two ends are connected."""
    masks = block_masks(marks.count(), distance)
    keys = marks.select("mark", F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])).alias("i", "mask"))
    keys = keys.select(F.xxhash64("i", F.col("mark").bitwiseAND(F.col("mask"))).alias("key"), "mark")
    keys = dealt(keys, "mark")
    keys = keys.select("key", "part", "mark").repartition("key", "part").sortWithinPartitions("key", "part", "mark")
    return keys.mapInArrow(links_for(distance), "a long, b long")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is its component's smallest node.

    Alternates large-star and small-star steps until nothing changes; each writes its edges to the
    shared folder. Neighbours are reduced to their minimum, never gathered.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now u > v in every edge
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(star.select("u", F.col("m").alias("v")))
        old, edges = edges, materialize(small.distinct(), tag)
        drop_table(old)


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, more=None) -> DataFrame:
    """(key, mark, component, root, text_hash): SimHash of each row and the smallest key reachable by links.

    A null or empty text has fingerprint zero, linked like any other; a null key gets a component
    but never names one that has other keys. Repeated rows give a row each. Other columns are ignored.
    more(docs, text, rows, roots), if given, adds links to the fingerprints' roots.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(fingerprints, "key long, mark long, text_hash long")
    rows = materialize(rows, "simhash-marks")
    marks = materialize(rows.groupBy("mark").agg(F.min("key").alias("least")), "simhash-distinct")
    roots = components(near_pairs(marks.select("mark"), distance), "simhash-edges")
    if more is not None:
        roots = more(docs, text, rows, roots)
    rooted = marks.join(roots, F.col("mark") == F.col("node"), "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("mark", "component", "root")
    return rows.join(named, "mark").select(F.col("key").alias(key), "mark", "component", "root", "text_hash")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", more=None) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest key, of several with this key one.

    A null key comes last: such a row stays only where its component has no other.
    """
    found = cluster(docs, key, text, more=more)
    none, least, digest = on = fresh("none", "key", "hash")
    best = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias(none), F.coalesce(key, F.lit(0)).alias(least), F.col("text_hash").alias(digest))).alias("b"))
    kept = materialize(best.select("b.*"), "simhash-kept")
    rows = docs.withColumns({none: F.col(key).isNull(), least: F.coalesce(F.col(key).cast("long"), F.lit(0)), digest: F.xxhash64(text)})
    # repeated rows meet where the join has sent them: docs are shuffled once
    return rows.join(kept, on, "left_semi").dropDuplicates(on).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
