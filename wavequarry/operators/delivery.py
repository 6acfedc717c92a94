"""Delivery checks of rendered presentations and downmixes, normalisation evidence, profile validation, retries, detectors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import compliance, pcm, render

METRICS = ["integrated_lufs", "true_peak_dbtp", "sample_peak_dbfs", "lra"]


def delta(a: Column, b: Column) -> Column:
    """Difference; equal infinities differ by nothing, other non-finite ones have no difference."""
    d = a - b
    return F.when(a.eqNullSafe(b), 0.0).when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


def presentation_qc(rendered: DataFrame, reference: DataFrame, verdicts: DataFrame, tolerance: float) -> DataFrame:
    """2.11: drift of each presentation against its reference, if it has one, and its compliance, if asked for.

    rendered, reference: id, integrated_lufs, true_peak_dbtp, frames, sample_rate; verdicts: id, compliant.
    """
    r = reference.select("id", *[F.col(c).alias(f"ref_{c}") for c in ("integrated_lufs", "true_peak_dbtp", "frames")])
    x = rendered.join(r, "id", "left").join(verdicts, "id", "left")
    drift = {f"{c}_drift": delta(F.col(c), F.col(f"ref_{c}")) for c in ("integrated_lufs", "true_peak_dbtp")}
    near = [F.coalesce(F.abs(d) <= tolerance, F.lit(False)) for d in drift.values()]
    same = near[0] & near[1] & F.coalesce(F.abs(F.col("frames") - F.col("ref_frames")) <= 1, F.lit(False))
    matched = F.when(F.col("ref_frames").isNotNull(), same)
    return x.withColumns(drift).withColumns({"reference_passed": matched, "passed": F.coalesce(matched, F.lit(True)) & F.coalesce("compliant", F.lit(True))})


def downmix_qc(source: DataFrame, mixed: DataFrame, clipped: DataFrame, ceiling: float, max_clipped: int = 0, max_loudness_delta: float | None = None) -> DataFrame:
    """2.11: headroom, change of level and clip risk of each rendered downmix. Measurements by asset_id, and profile in mixed and clipped."""
    s = source.select("asset_id", *[F.col(m).alias(f"source_{m}") for m in METRICS])
    x = mixed.join(s, "asset_id").join(clipped, ["asset_id", "profile"], "left").withColumn("clipped", F.coalesce("clipped", F.lit(0)))
    over = ~F.isnan("true_peak_dbtp") & (F.col("true_peak_dbtp") > ceiling)
    risk = F.when(F.col("clipped") > 0, "sample-clipping").when(over, "true-peak-ceiling").otherwise("none")
    change = delta(F.col("integrated_lufs"), F.col("source_integrated_lufs"))
    level = F.lit(True) if max_loudness_delta is None else F.coalesce(F.abs(change) <= max_loudness_delta, F.lit(False))
    return x.withColumns({"loudness_delta": change, "headroom_db": F.when(F.col("true_peak_dbtp") > float("-inf"), F.lit(ceiling) - F.col("true_peak_dbtp")), "clip_risk": risk, "passed": (F.col("clipped") <= max_clipped) & ~over & level})


def binaural_qc(source: DataFrame, rendered: DataFrame, reference: DataFrame, clipped: DataFrame, ceiling: float = -1.0, max_clipped: int = 0, max_duration_delta: float = 0.001, max_loudness_delta: float = 1.0, max_peak_delta: float = 1.0) -> DataFrame:
    """2.11: length, clip risk and drift of each binaural rendering, against its source and, where there is one, a reference.

    source, rendered, reference: id, channels, frames, sample_rate, integrated_lufs, true_peak_dbtp; clipped: id, clipped.
    A rendering or reference that isn't stereo fails.
    """
    side = lambda df, k: df.select("id", F.col("channels").alias(f"{k}_channels"), (F.col("frames") / F.col("sample_rate")).alias(f"{k}_seconds"), F.col("integrated_lufs").alias(f"{k}_lufs"), F.col("true_peak_dbtp").alias(f"{k}_peak"))
    c = F.col
    x = side(rendered, "rendered").join(side(source, "source"), "id").join(side(reference, "reference"), "id", "left").join(clipped.select("id", "clipped"), "id", "left").withColumn("clipped", F.coalesce("clipped", F.lit(0)))
    over = F.coalesce((F.abs("rendered_peak") < float("inf")) & (c("rendered_peak") > ceiling), F.lit(False))
    # a difference exists between finite values only; without one the reference's rule fails
    finite = lambda a, b: F.when((F.abs(a) < float("inf")) & (F.abs(b) < float("inf")), a - b)
    within = lambda d, most: F.coalesce(F.abs(d) <= most, F.lit(False))
    compared = c("reference_channels").isNotNull()
    x = x.withColumns({
        "duration_delta": c("rendered_seconds") - c("source_seconds"), "reference_duration_delta": c("rendered_seconds") - c("reference_seconds"),
        "loudness_delta": finite(c("rendered_lufs"), c("reference_lufs")), "peak_delta": finite(c("rendered_peak"), c("reference_peak")),
        "clip_risk": F.when(c("clipped") > 0, "sample-clipping").when(over, "true-peak-ceiling").otherwise("none"), "clip_risk_passed": (c("clipped") <= max_clipped) & ~over,
    })
    near = (c("reference_channels") == 2) & within(c("loudness_delta"), max_loudness_delta) & within(c("peak_delta"), max_peak_delta) & within(c("reference_duration_delta"), max_duration_delta)
    x = x.withColumns({"duration_passed": within(c("duration_delta"), max_duration_delta), "reference_passed": F.when(compared, near)})
    return x.withColumn("passed", F.coalesce(c("rendered_channels") == 2, F.lit(False)) & c("duration_passed") & c("clip_risk_passed") & F.coalesce("reference_passed", F.lit(True)))


def normalization_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row of evidence for each metric of each asset in both; what isn't finite is null."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    long = lambda df, name: df.select("asset_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in METRICS])).alias("x")).select("asset_id", "x.*")
    j = long(before, "before").join(long(after, "after"), ["asset_id", "metric"])
    return j.select("asset_id", "metric", finite(F.col("before")).alias("before"), finite(F.col("after")).alias("after"), delta(F.col("after"), F.col("before")).alias("change"))


def invalid_profiles(profiles: DataFrame) -> DataFrame:
    """Names of what is wrong with a profile."""
    c = F.col
    wrong = [
        ("name", c("profile").isNull() | (F.trim("profile") == "")),
        ("basis", ~F.coalesce(c("basis").isin("programme", "dialogue"), F.lit(False))),
        ("no-loudness-rule", c("target").isNull() & c("max_loudness").isNull()),
        ("tolerance-without-target", c("target").isNull() & (c("lower_tol").isNotNull() | c("upper_tol").isNotNull())),
        ("negative-tolerance", (F.coalesce("lower_tol", F.lit(0.0)) < 0) | (F.coalesce("upper_tol", F.lit(0.0)) < 0)),
        ("true-peak-over-zero", c("max_true_peak") > 0),
        ("not-finite", F.greatest(*[F.coalesce(F.abs(x), F.lit(0.0)) for x in ("target", "max_loudness", "max_true_peak", "max_short_term", "max_ldr", "plr_below")]) == float("inf")),
    ]
    return profiles.withColumn("problems", F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in wrong]))).where(F.size("problems") > 0)


def normalize(chunks: DataFrame, roles: DataFrame, target: float, ceiling_db: float, tolerance: float = 0.1, max_gain_db: float = 60.0, attempts: int = 3, limiter: bool = False) -> tuple[DataFrame, DataFrame]:
    """Render each asset to a target from its original, measure again, and correct the gain of those that miss it.

    Returns the rendered chunks and (asset_id, gain_db, verified). Each attempt renders from the
    original; only a row per asset passes between attempts.
    """
    m = pcm.analyze(chunks, roles)
    room = F.lit(max_gain_db) if limiter else F.lit(ceiling_db) - F.col("true_peak_dbtp")
    gain = F.least(F.lit(target) - F.col("integrated_lufs"), room, F.lit(max_gain_db))
    plan = m.select("asset_id", F.when(F.abs(gain) < float("inf"), gain).otherwise(0.0).alias("gain_db"))
    for attempt in range(attempts):
        plan = chunks.sparkSession.createDataFrame(plan.collect(), "asset_id string, gain_db double")  # a row per asset
        out = render.gain(chunks, plan.withColumn("gain", F.pow(F.lit(10.0), F.col("gain_db") / 20)).drop("gain_db"), 1e9 if limiter else 1.0)
        out = render.limit(out, float(10 ** (ceiling_db / 20))) if limiter else out
        now = pcm.analyze(out, roles).join(plan, "asset_id")
        ok = compliance.verified(F.col("integrated_lufs"), target, tolerance, F.col("true_peak_dbtp"), ceiling_db, 0.1)
        result = now.select("asset_id", "gain_db", ok.alias("verified"))
        miss = F.lit(target) - F.col("integrated_lufs")
        better = F.when(ok | (F.abs(miss) == float("inf")), F.col("gain_db")).otherwise(F.least(F.col("gain_db") + miss, F.lit(max_gain_db)) if limiter else F.col("gain_db"))
        if not limiter or attempt == attempts - 1:
            return out, result
        plan = now.select("asset_id", better.alias("gain_db"))
    raise AssertionError("unreachable")


DETECTORS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}
EVENTS = "asset_id string, kind string, start_seconds double, end_seconds double, confidence double, severity double"


def register_detector(name: str, detect: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    """2.15: add a detector: from one asset's chunk rows to event rows."""
    DETECTORS[name] = detect


def run_detector(chunks: DataFrame, name: str, threshold: float = 0.0) -> DataFrame:
    """2.15, C17: events of a registered detector that reach the threshold, in order and within bounds; others raise."""
    detect = DETECTORS[name]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = detect(rows)
        length = (rows["frame_start"] + rows["samples"].map(len)).max() / rows["sample_rate"].iloc[0]
        bad = found[(found["start_seconds"] < 0) | (found["end_seconds"] > length + 1e-9) | (found["end_seconds"] <= found["start_seconds"]) | ~found["confidence"].between(0, 1)]
        if len(bad):
            raise ValueError(f"detector {name} gave {len(bad)} events out of bounds")
        return found[[x.split()[0] for x in EVENTS.split(", ")]]

    return chunks.groupBy("asset_id").applyInPandas(run, EVENTS).where(F.col("confidence") >= threshold)
