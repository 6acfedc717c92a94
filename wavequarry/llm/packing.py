"""Packing: concatenate and cut.

Pass one tokenizes each partition and writes the ids with every document's offset inside its
partition; a prefix sum over the partitions' token totals turns these into global offsets. Pass
two cuts each document at multiples of the window and records the pieces; a document that crosses
a boundary gives one record on each side. No row is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read, worker_cache

WINDOW, END = 2048, 1
VOCABULARY = "byte_bpe_50k.json"
#: Documents in a batch that pass one or two sends back.
BATCH = 512


#: Characters whose Unicode classes have not changed since both libraries' tables were made: on
#: these alone the two split a text alike, and the faster one is used where it has the vocabulary; texts with an added token's string go to the first.
SETTLED = r"[\x00-\u0377\u0384-\u038a\u0391-\u03a1\u03a3-\u0523\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]*"


class Ids:
    """ids of a text: by tokenizers, or by tiktoken with the same vocabulary as ranks where that gives the same ids."""

    def __init__(self, path: str) -> None:
        import base64
        import os
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.settled, self.fast = re.compile(SETTLED).fullmatch, None
        # strings that the vocabulary takes for single tokens wherever they stand
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)").search
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        if self.fast and self.settled(text) and not self.added(text):
            return self.fast(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def tokenizer(vocabulary: str) -> Ids:
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    return worker_cache(f"ids-{path}", lambda: Ids(path))


def tokenize_for(vocabulary: str):
    def tokenize(batches):
        ids_of, part, at = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for i in range(0, len(text), BATCH):
                ids = [ids_of(t or "") for t in text[i : i + BATCH].to_pylist()]
                counts = np.array([len(x) + 1 for x in ids], np.int64)
                starts = at + np.concatenate(([0], np.cumsum(counts)[:-1]))
                at += int(counts.sum())
                blobs = [np.array([*x, END], "<u4") for x in ids]
                small = [b.astype("<u2") if b.max() < 1 << 16 else b for b in blobs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts), key[i : i + BATCH].cast(pa.int64()), pa.array(counts), pa.array([b.itemsize for b in small], pa.int8()), pa.array([b.tobytes() for b in small], pa.binary())],
                    names=["part", "local", "key", "n", "width", "ids"],
                )

    return tokenize


def cut_for(window: int):
    def cut(batches):
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                out: list[tuple] = []
                for key, begin, width, blob in zip(*(batch.column(c)[i : i + BATCH].to_pylist() for c in range(4)), strict=True):
                    ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                    at = 0
                    while at < len(ids):
                        sequence, offset = divmod(begin + at, window)
                        n = min(len(ids) - at, window - offset)
                        out.append((key, at, n, len(ids), sequence, offset, ids[at : at + n].tobytes()))
                        at += n
                kinds = [pa.int64()] * 6 + [pa.binary()]
                names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return cut


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces (key, start, length, doc_tokens, sequence_id, offset, ids) of every row, in sequences of `window` tokens.

    `key` must be an integer. ids is binary, little-endian unsigned 32-bit. A null text is empty and gives the end token
    alone; a null or repeated key is kept as it is; an empty table gives no pieces. Only the last
    sequence is short. Other columns are ignored.
    """
    tokens = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tokens = materialize(tokens.mapInArrow(tokenize_for(vocabulary), "part int, local long, key long, n long, width byte, ids binary"), "packing-ids")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each partition
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(totals.select("part", before.alias("base")))  # as many rows as the scan has partitions
    placed = tokens.join(bases, "part").select("key", (F.col("base") + F.col("local")).alias("begin"), "width", "ids")
    schema = "key long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(cut_for(window), schema).withColumnRenamed("key", key)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, tokens, input_ids): each sequence's ids in order, padded to `window` unless the count is a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    hexes = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    power = F.bit_count(tokens) == 1
    filled = F.when(power, hexes).otherwise(F.concat(hexes, F.repeat(F.lit(int(pad).to_bytes(4, "little").hex().upper()), (window - tokens).cast("int"))))
    return rows.select("sequence_id", tokens.alias("tokens"), F.unhex(filled).alias("input_ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
