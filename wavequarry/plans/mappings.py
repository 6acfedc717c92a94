"""Driver tables as audio: the documented mappings M1 to M7, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: events as mono streams at 10 frames a second: asset = user, sample = (value - 250) / 250."""
    w = Window.partitionBy("asset").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), "ts", "event_id", ((F.col("value") - 250) / 250).alias("sample"))
    rows = rows.withColumn("frame", (F.row_number().over(w) - 1).cast("long"))
    return rows.select("asset", "frame", "sample", (F.col("sample") * F.col("sample")).alias("energy"))


STREAM_SQL = """s AS (SELECT user_id AS asset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, (value - 250) / 250 AS sample FROM events),
f AS (SELECT *, sample * sample AS energy FROM s)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: embeddings as 64-frame mono assets."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


VECTOR_SQL = "v AS (SELECT vec_id AS asset, label, list_transform(embedding, lambda x: x::DOUBLE) AS samples FROM embeddings)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: stereo pairs (2k, 2k+1)."""
    v = vectors(spark, sf_dir)
    left = v.where("asset % 2 = 0").select((F.col("asset") / 2).cast("long").alias("pair"), F.col("samples").alias("l"))
    right = v.where("asset % 2 = 1").select(((F.col("asset") - 1) / 2).cast("long").alias("pair"), F.col("samples").alias("r"))
    return left.join(right, "pair")


PAIR_SQL = VECTOR_SQL + ", p AS (SELECT a.asset // 2 AS pair, a.samples AS l, b.samples AS r FROM v a JOIN v b ON a.asset % 2 = 0 AND b.asset = a.asset + 1)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: orders as measured assets: loudness, peak, range and dialogue figures derived from price and key."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("asset"),
        (F.col("o_custkey") % 50).alias("album"),
        (F.lit(-30) + F.col("o_totalprice") % 1600 / 100).alias("integrated_lufs"),
        (F.lit(-6) + F.col("o_totalprice") % 700 / 100).alias("true_peak_dbtp"),
        (F.lit(-28) + F.col("o_totalprice") % 1300 / 100).alias("max_short_term_lufs"),
        (F.col("o_totalprice") % 1900 / 100).alias("lra"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.lit(-31) + F.col("o_totalprice") % 1700 / 100).alias("dialogue_lufs"),
        (F.lit(20) + F.col("o_orderkey") % 200).cast("double").alias("duration_seconds"),
        (F.lit(1) + F.col("o_orderkey") % 2).alias("channels"),
    )


MEASURE_SQL = """m AS (SELECT o_orderkey AS asset, o_custkey % 50 AS album, -30 + (o_totalprice % 1600) / 100 AS integrated_lufs, -6 + (o_totalprice % 700) / 100 AS true_peak_dbtp,
  -28 + (o_totalprice % 1300) / 100 AS max_short_term_lufs, (o_totalprice % 1900) / 100 AS lra,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE -31 + (o_totalprice % 1700) / 100 END AS dialogue_lufs, (20 + o_orderkey % 200)::DOUBLE AS duration_seconds, 1 + o_orderkey % 2 AS channels FROM orders)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: events as RTP packets of one sender per user: sequence and timestamp follow the event id."""
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("ssrc"), (F.col("event_id") % 65536).cast("int").alias("seq"), (F.col("event_id") * 48).alias("rtp_ts"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"), F.sha2(F.col("props"), 256).alias("digest"),
    )


PACKET_SQL = """k AS (SELECT event_id, user_id AS ssrc, event_id % 65536 AS seq, event_id * 48 AS rtp_ts, epoch_us(ts) / 1e6 AS arrival, sha256(props) AS digest FROM events)"""
