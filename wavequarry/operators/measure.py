"""Loudness measurement over hop or frame tables: gating, range, maxima, timeline, peaks, dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import ABSOLUTE_GATE, amplitude_db, lufs

MOMENTARY, SHORT_TERM = 4, 30


def window_energy(hops: DataFrame, n: int, name: str = "block", key: str = "asset", order: str = "frame", energy: str = "energy") -> DataFrame:
    """Mean energy of each whole window of n hops, at its last hop; incomplete ones are dropped."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    return hops.withColumn(name, F.avg(energy).over(w)).withColumn("whole", F.count("*").over(w)).where(F.col("whole") == n).drop("whole")


def gated(blocks: DataFrame, keys: list[str], block: str = "block", clustered: bool = False) -> DataFrame:
    """A1: two-stage gated loudness of the blocks of each key.

    The relative gate is a tenth of the mean of blocks at or above the absolute gate; the result is
    the mean of all blocks at or above the larger gate, or that first mean where none is.
    clustered: a window over the keys already holds the blocks together, as the one that made them
    did, so both passes run over the same partitions without a join; else two aggregations meet.
    """
    if clustered:
        w = Window.partitionBy(*keys)
        with_mean = blocks.withColumn("first_mean", F.avg(F.when(F.col(block) >= ABSOLUTE_GATE, F.col(block))).over(w))
        over = F.col(block) >= F.greatest(F.lit(ABSOLUTE_GATE), F.col("first_mean") / 10)
        out = with_mean.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.count_if(over).alias("n_gated"), F.avg(F.when(over, F.col(block))).alias("mean"), F.first("first_mean").alias("first_mean"))
        return out.select(*keys, "n_blocks", "n_gated", lufs(F.coalesce("mean", "first_mean", F.lit(0.0))).alias("integrated_lufs"))
    first = blocks.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.avg(F.when(F.col(block) >= ABSOLUTE_GATE, F.col(block))).alias("first_mean"))
    first = first.withColumn("gate", F.greatest(F.lit(ABSOLUTE_GATE), F.col("first_mean") / 10))
    above = blocks.join(first, keys).groupBy(*keys, "n_blocks", "first_mean").agg(
        F.avg(F.when(F.col(block) >= F.col("gate"), F.col(block))).alias("mean"), F.count(F.when(F.col(block) >= F.col("gate"), 1)).alias("n_gated")
    )
    return above.select(*keys, "n_blocks", "n_gated", lufs(F.coalesce("mean", "first_mean", F.lit(0.0))).alias("integrated_lufs"))


def loudness_range(blocks: DataFrame, keys: list[str], block: str = "block", clustered: bool = False) -> DataFrame:
    """A3: P95 - P10 of short-term loudness above both gates, linear interpolation; under two blocks: 0."""
    if clustered:
        above = F.col(block) >= ABSOLUTE_GATE
        gate = F.avg(F.when(above, F.col(block))).over(Window.partitionBy(*keys)) / 100
        rows = blocks.withColumn("gate", gate).withColumn("l", F.when(above & (F.col(block) >= F.col("gate")), lufs(F.col(block))))
        found = rows.groupBy(*keys).agg(F.count("l").alias("n_used"), F.percentile("l", F.lit(0.95)).alias("p95"), F.percentile("l", F.lit(0.10)).alias("p10"))
        return found.select(*keys, F.when(F.col("n_used") >= 2, F.col("p95") - F.col("p10")).otherwise(F.lit(0.0)).alias("lra"), "n_used")
    kept = blocks.where(F.col(block) >= ABSOLUTE_GATE)
    mean = kept.groupBy(*keys).agg((F.avg(block) / 100).alias("gate"))
    kept = kept.join(mean, keys).withColumn("l", F.when(F.col(block) >= F.col("gate"), lufs(F.col(block))))
    spread = F.when(F.count("l") >= 2, F.percentile("l", F.lit(0.95)) - F.percentile("l", F.lit(0.10))).otherwise(F.lit(0.0))
    all_ = blocks.select(*keys).distinct()
    return all_.join(kept.groupBy(*keys).agg(spread.alias("lra"), F.count("l").alias("n_used")), keys, "left").select(*keys, F.coalesce("lra", F.lit(0.0)).alias("lra"), F.coalesce("n_used", F.lit(0)).alias("n_used"))


def sliding_maxima(frames: DataFrame, key: str = "asset") -> DataFrame:
    """A4: the largest momentary and short-term mean, over every position of the window."""
    out = frames
    for n, name in ((MOMENTARY, "m"), (SHORT_TERM, "s")):
        w = Window.partitionBy(key).orderBy("frame").rowsBetween(1 - n, 0)
        out = out.withColumn(name, F.when(F.count("*").over(w) == n, F.avg("energy").over(w)))
    top = out.groupBy(key).agg(F.max("m").alias("m"), F.max("s").alias("s"))
    return top.select(key, lufs(F.coalesce("m", F.lit(0.0))).alias("max_momentary"), lufs(F.coalesce("s", F.lit(0.0))).alias("max_short_term"))


def timeline(frames: DataFrame, interval: int, key: str = "asset") -> DataFrame:
    """Tumbling intervals with the momentary and short-term state at their end; the last, partial one is kept."""
    out = frames
    for n, name in ((MOMENTARY, "m"), (SHORT_TERM, "s")):
        w = Window.partitionBy(key).orderBy("frame").rowsBetween(1 - n, 0)
        out = out.withColumn(name, F.when(F.count("*").over(w) == n, F.avg("energy").over(w)))
    level = lambda c: F.when(F.col(c) > 0, lufs(F.col(c)))
    out = out.withColumn("interval", F.floor(F.col("frame") / interval).cast("long")).groupBy(key, "interval").agg(
        F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.max_by("m", "frame").alias("m"), F.max_by("s", "frame").alias("s"), F.max(F.abs("sample")).alias("peak")
    )
    return out.select(key, "interval", "start_frame", "end_frame", level("m").alias("momentary_lufs"), level("s").alias("short_term_lufs"), amplitude_db(F.col("peak")).alias("sample_peak_dbfs"))


def violations(points: DataFrame, momentary: float, short_term: float, peak: float) -> DataFrame:
    """C4: names of the strictly exceeded limits; a null never violates."""
    over = [(F.col("momentary_lufs") > momentary, "momentary"), (F.col("short_term_lufs") > short_term, "short-term"), (F.col("sample_peak_dbfs") > peak, "peak")]
    return points.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in over])))


def peaks(frames: DataFrame, key: str = "asset") -> DataFrame:
    """A5: RMS and sample peak of each asset in dBFS."""
    out = frames.groupBy(key).agg(F.count("*").alias("frames"), F.sqrt(F.avg(F.col("sample") * F.col("sample"))).alias("rms"), F.max(F.abs("sample")).alias("peak"))
    return out.select(key, "frames", amplitude_db(F.col("rms")).alias("rms_dbfs"), amplitude_db(F.col("peak")).alias("peak_dbfs"))


def overlapping(frames: DataFrame, ranges: DataFrame, key: str = "asset") -> DataFrame:
    """Frames of each range, by equality of the asset and interval containment."""
    r = ranges.withColumnRenamed(key, "range_key")
    return frames.join(r, (F.col(key) == F.col("range_key")) & (F.col("frame") >= F.col("start_frame")) & (F.col("frame") < F.col("end_frame"))).drop("range_key")


def ungated(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Duration-weighted loudness without gates."""
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg("energy").alias("ms")).select(*keys, "frames", lufs(F.col("ms")).alias("dialogue_lufs"))


def nearest_rank_up(values: Column, p: float) -> Column:
    """A10: element ceil((n-1)*p) of an ascending array."""
    return F.element_at(F.array_sort(values), (F.ceil((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def noise_floor(levels: Column) -> Column:
    """Element (n-1) div 5 of the ascending levels, at most -45."""
    at = F.floor((F.size(levels) - 1) / 5) + 1
    return F.least(F.element_at(F.array_sort(levels), at.cast("int")), F.lit(-45.0))
