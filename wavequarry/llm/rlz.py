"""Substring dedup of words by relative Lempel-Ziv factoring.

The reference is the corpus itself, cut into blocks: the words around each anchor, a position that
every window of 35 words has at the same place wherever it occurs. A window can only be a copy of
one in a block with the same anchor, so blocks are indexed by it, and every document is factored
against every such block: greedily from the left the longest match in any of them. Factors of 35
words and more are duplicate spans; the windows across a factor's end are looked up before the
parse goes on. Blocks that occur twice as a whole are settled by their names beforehand, and need
no index. See factors.py and repeats.py.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .repeats import SPANS, repeated
from .suffix_dedup import bounds

LENGTH, GRAM = 35, 12


def finish(data: bytes, covered: np.ndarray | None) -> tuple:
    words = data.split()
    kept = words if covered is None else list(compress(words, (~covered).tolist()))
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "stop": b} for a, b in bounds(covered).tolist()]


def factor(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, factors) of each row; factors are maximal spans of words that factors cover.

    A word is removed if a window of `length` words that covers it also starts anywhere else, in
    the same row or another, judged on the input; so every copy of a repeated passage goes. `key`
    must be an integer. A null text is empty; texts under `length` words lose nothing. Repeated rows
    are copies of each other; other columns are ignored.
    """
    found = repeated(docs, key, text, "words", gram, length, False, finish, [pa.int64(), pa.int64(), pa.string(), SPANS])
    return found.toDF(key, "n_words", "n_removed", "kept_sha256", "factors")


def op10_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("factors")
