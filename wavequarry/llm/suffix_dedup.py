"""Suffix-array dedup: prefix doubling over a thinned set of positions, distributed by anchors.

Ranking every byte position at offsets 1, 2, 4, ... by Spark would shuffle each position several
times. Positions are thinned first to locally minimal ones: every window of 50 bytes holds exactly
one anchor, at the same place wherever the window occurs, so equal windows meet at equal anchors.
Spark sorts the anchors by the pair (name of the first 20 bytes, name of the bytes around them):
positions that are unique drop out, those equal past the threshold are settled. The bytes around the
others are sent to their anchor's task, where the windows are ranked by pairs of ranks at growing
offsets (8, 16, 32 and then 18 bytes on) until they are unique or reach 50 bytes. Ranks come from the
bytes themselves; the names of anchors and of their surroundings are hashes of 64 and 62 bits, as are
the names (64 and 63 bits) by which Spark sorts the windows of anchors too frequent for one task.
See ranks.py and repeats.py.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .repeats import SPANS, repeated

LENGTH, GRAM = 50, 20


def bounds(covered: np.ndarray | None) -> np.ndarray:
    """Starts and stops of maximal covered spans."""
    if covered is None:
        return np.empty((0, 2), np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def finish(data: bytes, covered: np.ndarray | None) -> tuple:
    spans = bounds(covered)
    kept = data if covered is None else np.frombuffer(data, np.uint8)[~covered].tobytes()
    return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in spans.tolist()]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row.

    A byte is removed if a `length`-byte string that covers it also starts in a row with a smaller
    key, judged on the input. A null text is empty; texts under `length` bytes lose nothing; rows
    with equal keys count as one document; a null key counts as the largest. Other columns are ignored.
    """
    found = repeated(docs, key, text, "bytes", gram, length, True, finish, [pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS])
    return found.toDF(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
