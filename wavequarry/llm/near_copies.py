"""Near copies by Jaccard similarity of word shingles, on top of SimHash links.

Documents are sets of five-word shingles; two are near copies from a similarity of 0.8 on. Pairs
are found by MinHash: 24 bands of 5 minima, one of which two documents at 0.8 share but for
(1 - 0.8^5)^24 = 7e-5 of all pairs, and decided by the sets themselves. Links are added to those
of simhash.py, so that one component holds what either joins.

A band's group is left alone once all its members are in one component. Of the others each member
is compared with one first, the same in all bands as far as may be, which settles groups of two
and most of the large ones with one pair a member; what still lies in several components is then
compared within its group, by peeling. Texts are sent for these pairs and groups only.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .anchors import mix, word_symbols
from .common import materialize

WORDS, BANDS, ROWS = 5, 24, 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
BATCH = 512
#: Shingles that are multiplied out at a time.
CHUNK = 1024
_RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
FACTORS, OFFSETS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1] * np.uint64(2)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different `WORDS`-word shingles, in lower case; a shorter text is one; no word: none."""
    words = word_symbols((text or "").encode("utf-8", "surrogatepass").lower())
    n = max(len(words) - WORDS + 1, min(len(words), 1))
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(words))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[i : i + CHUNK, None] * FACTORS + OFFSETS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * common >= OVER * (len(a) + len(b) - common)


def sketch(batches):
    """(id, keys) of texts with words."""
    for batch in batches:
        for i in range(0, len(batch), BATCH):
            found = [shingles(t) for t in batch.column(1)[i : i + BATCH].to_pylist()]
            some = pa.array([len(f) > 0 for f in found])
            ids = batch.column(0)[i : i + BATCH].filter(some)
            keys = pa.array([bands(f) for f in found if len(f)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, keys], names=["id", "keys"])


def peel(found: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a forest that spans the components of sets under similar()."""
    edges, left = [], list(range(len(found)))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and left:
            at = queue.pop()
            near = {x for x in left if similar(found[at], found[x])}
            edges += [(at, x) for x in sorted(near)]
            queue += sorted(near)
            left = [x for x in left if x not in near]
    return edges


def link(batches):
    """From rows (key, part, mark, text) sorted by key and part to edges (a, b) of marks."""
    group, marks, found = None, [], []
    for batch in chain(batches, [None]):
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True) if batch is not None else [(None, None, None, None)]
        for key, part, mark, text in rows:
            if (key, part) != group:
                out += [(marks[i], marks[j]) for i, j in peel(found)]
                group, marks, found = (key, part), [], []
            marks.append(mark)
            found.append(shingles(text))
        yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in out], pa.int64()) for c in (0, 1)], names=["a", "b"])


def verified(groups: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """Edges (a, b) between the marks of similar members of groups (key, part, id, mark); texts is (id, text)."""
    rows = groups.join(texts, "id").select("key", "part", "mark", "text").repartition("key", "part").sortWithinPartitions("key", "part")
    return materialize(rows.mapInArrow(link, "a long, b long").where("a <> b").distinct(), f"{tag}-edges")


def join_copies(docs: DataFrame, text: str, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (node, root) of fingerprints with the links of near copies added; rows is simhash's (key, mark, text_hash)."""
    texts = docs.select(F.xxhash64(text).alias("id"), F.col(text).alias("text"))
    sketches = texts.mapInArrow(sketch, "id long, keys array<long>").groupBy("id").agg(F.first("keys").alias("keys"))
    sketches = materialize(sketches.join(rows.select(F.col("text_hash").alias("id"), "mark").distinct(), "id"), "near-sketches")

    def rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
        return df.join(roots, F.col("mark") == F.col("node"), "left").withColumn("root", F.coalesce("root", "mark")).drop("node")

    def unsettled(found: DataFrame) -> DataFrame:
        """Keys of groups that lie in several components."""
        return found.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")

    def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
        return simhash.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges), "near-roots")

    # all that follows is about the members of these groups; their texts are fetched once
    found = rooted(sketches, roots).select("id", "mark", "root", F.explode("keys").alias("key"))
    found = materialize(found.join(unsettled(found), "key", "left_semi"), "near-members")
    # a task hashes its share of the ids, 8 bytes each, and texts need no sorting
    own = texts.join(found.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    texts = materialize(own.groupBy("id").agg(F.first("text").alias("text")), "near-texts")
    firsts = found.groupBy("key").agg(F.min(F.struct("id", "mark", "root")).alias("first"))
    pairs = found.join(firsts, "key").where("root <> first.root").select("id", "mark", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark")).distinct()
    ends = F.array(F.struct("id", "mark"), F.struct(F.col("first_id").alias("id"), F.col("first_mark").alias("mark")))
    groups = pairs.select(F.xxhash64("id", "first_id").alias("key"), F.lit(0).cast("long").alias("part"), F.explode(ends).alias("x")).select("key", "part", "x.id", "x.mark")
    roots = extended(roots, verified(materialize(groups, "near-pairs"), texts, "near-first"))

    # the first of a group has been compared with all others
    rest = rooted(found.drop("root"), roots).join(firsts, "key").where("id <> first.id").drop("first")
    rest = rest.join(unsettled(rest), "key", "left_semi").select("key", "id", "mark")
    groups = materialize(simhash.dealt(materialize(rest, "near-rest"), "id"), "near-groups")
    return extended(roots, verified(groups, texts, "near-rest"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """simhash.keep_one() over the components of both kinds of links."""
    return simhash.keep_one(docs, key, text, join_copies)
