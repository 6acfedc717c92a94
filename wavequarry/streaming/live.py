"""Live metering: a stateful operator over micro-batches that equals the batch result."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "frames long, ring array<double>, peak double, momentary double, short double"
OUTPUT = "asset long, frames long, sample_peak double, max_momentary double, max_short_term double, momentary double, short_term double"
MOMENTARY, SHORT = 4, 30


def level(ms: float) -> float:
    return -0.691 + 10 * math.log10(ms) if ms > 0 else float("-inf")


def meter(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Ring of the last 30 energies, maxima and counters per asset; minus infinity until a window is full."""
    frames, ring, peak, best_m, best_s = state.get if state.exists else (0, [], 0.0, 0.0, 0.0)
    ring = list(ring)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for x in rows["sample"].tolist():
        ring = [*ring[-SHORT + 1 :], x * x]
        frames, peak = frames + 1, max(peak, abs(x))
        if frames >= MOMENTARY:
            best_m = max(best_m, sum(ring[-MOMENTARY:]) / MOMENTARY)
        if frames >= SHORT:
            best_s = max(best_s, sum(ring) / SHORT)
    state.update((frames, ring, peak, best_m, best_s))
    now_m = level(sum(ring[-MOMENTARY:]) / MOMENTARY) if frames >= MOMENTARY else float("-inf")
    now_s = level(sum(ring) / SHORT) if frames >= SHORT else float("-inf")
    yield pd.DataFrame([(key[0], frames, peak, level(best_m), level(best_s), now_m, now_s)], columns=[x.split()[0] for x in OUTPUT.split(", ")])


def live_meter(events: DataFrame) -> DataFrame:
    """A report of each asset that a micro-batch brings frames of. events (streaming): asset, ts, event_id, sample."""
    return events.groupBy("asset").applyInPandasWithState(meter, OUTPUT, STATE, "update", "NoTimeout")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_end(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Run a streaming query over all that is there; each micro-batch is one idempotent write under its number."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_no={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/rows").drop("batch_no")


def windowed_levels(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling event-time windows with a watermark; late events beyond it are dropped by Spark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "asset").agg(F.count("*").alias("n"), F.max(F.abs("sample")).alias("peak")).select(F.col("w.start").alias("start"), "asset", "n", "peak")


def dedup_packets(packets: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """A packet once, however many legs and retries bring it within the watermark."""
    return packets.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["ssrc", "seq", "rtp_ts"])
