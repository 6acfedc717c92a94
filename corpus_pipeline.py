"""A corpus pipeline of training-data operators, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; run()
writes each stage's rows to the shared folder as Parquet and reads them again for the next, and
deletes what no later stage reads. All stages leave an empty table empty and columns that they do
not name as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.llm import language_id, mixing, near_copies, packing, secrets
from wavequarry.llm.common import drop_table, materialize, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no learned language accepts.

    Null and empty texts and texts without a letter go; repeated rows share a verdict. Rows without a
    language are judged, but nothing is learned from them; where nothing is learned at all, texts with a letter stay.
    """
    return language_id.keep_known(docs, language_id.fit(docs.where(language_id.fold(F.col("doc_id")) != 0)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: fingerprints within 4 bits, or 0.8 of their five-word shingles in common.

    Texts without a word, null ones too, are one group. A null id comes last; of rows with equal ids and texts one stays.
    """
    return near_copies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets, of the base kinds all but widely copied ones; n_chars, if there is one, follows where the text changed.

    Every row stays; a null text stays null; a null source is one more owner.
    """
    masked = secrets.mask(docs, base_owners=secrets.EXAMPLE_OWNERS)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").contains("[secret]"), F.length("text")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it, up to three times.

    A null text has no words; a null source is one more source. Rows that agree in id, source and number of words share a decision.
    """
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.struct(*docs.columns).alias("row"))
    mixed = mixing.mix(rows, F.array("source"), F.col("words"), ["doc_id"]).where("passes > 0")
    return mixed.select(F.explode(F.sequence(F.lit(1), F.col("passes"))), "row").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids' CRC-32. A null text gives the end token alone; repeated rows give pieces each."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("mixing", mixture),
    ("packing", packed),
]

#: Language models, fingerprints and tokens can't be expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
