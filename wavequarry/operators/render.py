"""Rendering and comparison of PCM: gain, downmix, resampling, limiting, segment envelopes, alignment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

CHUNK = "asset_id string, sample_rate int, channels int, channel int, chunk_no int, frame_start long, samples array<float>"


def gain(chunks: DataFrame, gains: DataFrame, ceiling: float = 1.0) -> DataFrame:
    """Static gain per asset (asset_id, gain) with a hard clip; no Python, no shuffle of samples beyond the join."""
    y = F.transform("samples", lambda x: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), x * F.col("gain"))).cast("float"))
    return chunks.join(gains, "asset_id").withColumn("samples", y).drop("gain")


def downmix(chunks: DataFrame, labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """F8: sum of coefficient times input per output channel, array by array.

    labels: asset_id, channel, label; matrix: out_channel, in_label, coef (a few rows).
    """
    routed = chunks.join(labels, ["asset_id", "channel"]).join(F.broadcast(matrix), F.col("label") == F.col("in_label"))
    scaled = routed.withColumn("part", F.transform("samples", lambda x: x * F.col("coef")))
    # as many arrays as the asset has channels meet in a group, and are added in the order of channels
    parts = F.transform(F.array_sort(F.collect_list(F.struct("channel", "part"))), lambda p: p["part"])
    summed = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    out = scaled.groupBy("asset_id", "sample_rate", F.col("out_channel").alias("channel"), "chunk_no", "frame_start").agg(summed.alias("samples"))
    return out.withColumn("samples", F.transform("samples", lambda x: x.cast("float")))


def per_asset(chunks: DataFrame, make) -> DataFrame:
    """Apply make(x, fs) -> (y, fs) to each asset's channels x frames: for kernels that run through it from start to end."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["channel", "chunk_no"])
        x = np.stack([np.concatenate([np.asarray(s, np.float64) for s in own["samples"]]) for _, own in rows.groupby("channel")])
        step = max(1, max(len(s) for s in rows["samples"]))
        y, fs = make(x, int(rows["sample_rate"].iloc[0]))
        asset = rows["asset_id"].iloc[0]
        out = [(asset, fs, len(y), c, i // step, i, y[c, i : i + step].astype(np.float32).tolist()) for c in range(len(y)) for i in range(0, y.shape[1], step)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])

    return chunks.groupBy("asset_id").applyInPandas(run, CHUNK)


def limit(chunks: DataFrame, ceiling: float, lookahead_ms: float = 5.0, release_ms: float = 50.0) -> DataFrame:
    """F5."""
    return per_asset(chunks, lambda x, fs: (kernels.limiter(x, fs, ceiling, lookahead_ms, release_ms), fs))


def convert_rate(chunks: DataFrame, target: int) -> DataFrame:
    """F7."""
    return per_asset(chunks, lambda x, fs: (np.stack([kernels.resample(c, fs, target) for c in x]), target))


def segment_envelope(chunks: DataFrame, segments: list[tuple[float, float, float]], ramp: float = 0.05) -> DataFrame:
    """(start, stop, gain in dB) segments with smoothstep ramps at their boundaries, chunk by chunk."""

    def apply(batches):
        for rows in batches:
            out = rows.copy()
            done = []
            for r in rows.itertuples(index=False):
                t = (r.frame_start + np.arange(len(r.samples))) / r.sample_rate
                db = np.zeros(len(t))
                for i, (a, b, g) in enumerate(segments):
                    inside = (t >= a) & (t < b)
                    db[inside] = g
                    if i:
                        edge = (g + segments[i - 1][2]) / 2
                        for lo, hi, x, y in ((a - ramp, a, segments[i - 1][2], edge), (a, a + ramp, edge, g)):
                            k = (t >= lo) & (t < hi)
                            u = (t[k] - lo) / ramp
                            db[k] = x + (y - x) * u * u * (3 - 2 * u)
                done.append(np.clip(np.asarray(r.samples) * 10 ** (db / 20), -1, 1).astype(np.float32).tolist())
            out["samples"] = done
            yield out

    return chunks.mapInPandas(apply, chunks.schema)


COMPARE = (
    "asset_id string, reference_rate int, candidate_rate int, reference_channels int, candidate_channels int, reference_non_finite long, candidate_non_finite long, duration_delta long, "
    "lag long, lag_cosine double, overlap long, channel int, matched int, correlation double, signed_correlation double, reference_energy double, residual_energy double, corrected_energy double, "
    "residual_peak double, corrected_peak double, spectral_error_db double, residual_db double, null_depth_db double, exact_ratio double, gain_db double"
)
#: Seconds from which the lag is estimated, from the first sample that isn't zero in either input.
PROBE_SECONDS = 10


def correlated(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson's correlation; of constant signals 1 if they are equal, else 0."""
    x, y = x - x.mean(), y - y.mean()
    d = math.sqrt(float((x * x).sum()) * float((y * y).sum()))
    return float((x * y).sum()) / d if d > 0 else float(np.array_equal(x, y))


def best_lag(reference: np.ndarray, candidate: np.ndarray, reach: int) -> int:
    """The lag of the largest absolute normalised correlation of any two channels, the smallest of equal ones.

    Neither the order of channels nor their polarity matters.
    """
    size = 1 << int(reference.shape[1] + candidate.shape[1]).bit_length()
    lags = np.array(sorted(range(-reach, reach + 1), key=lambda t: (abs(t), t)))
    ours, theirs = np.conj(np.fft.rfft(reference, size)), np.fft.rfft(candidate, size)
    most = np.zeros(len(lags))
    for i, x in enumerate(ours):
        for j, y in enumerate(theirs):
            norm = math.sqrt(float(np.square(reference[i]).sum()) * float(np.square(candidate[j]).sum()))
            if norm > 0:
                most = np.maximum(most, np.abs(np.fft.irfft(x * y, size)[lags]) / norm)
    return int(lags[np.argmax(most.round(9))])


def compare_signals(reference: np.ndarray, candidate: np.ndarray, reach: int, fs: int = 48000) -> list[tuple]:
    """Lag, then a row for each reference channel and the one matched to it; one row without channels where nothing overlaps."""
    heard = [np.flatnonzero(x.any(axis=0)) for x in (reference, candidate)]
    start = min((int(h[0]) for h in heard if len(h)), default=0)
    probe = slice(start, start + PROBE_SECONDS * fs + reach)
    lag = best_lag(reference[:, probe], candidate[:, probe], reach)
    n = min(reference.shape[1] - max(0, -lag), candidate.shape[1] - max(0, lag))
    if n <= 0:
        return [(lag, 0.0, 0, *[None] * 14)]
    r, c = reference[:, max(0, -lag) :][:, :n], candidate[:, max(0, lag) :][:, :n]
    signed = np.array([[correlated(x, y) for y in c] for x in r])
    out = []
    for i, j in enumerate(kernels.assign_channels(np.abs(signed))):
        turn = -1.0 if signed[i, j] < 0 else 1.0
        rest, fixed = r[i] - c[j], r[i] - turn * c[j]
        ref, own, left = (float(np.square(x).sum()) for x in (r[i], c[j], rest))
        null = 300.0 if left <= 1e-30 else 0.0 if ref <= 1e-30 else max(-300.0, min(300.0, 10 * math.log10(ref / left)))
        out.append((
            lag, float(np.abs(signed).max()), n, i, j, float(abs(signed[i, j])), float(signed[i, j]), ref, left, float(np.square(fixed).sum()), float(np.abs(rest).max()), float(np.abs(fixed).max()),
            kernels.spectral_error(r[i], c[j], fs), 10 * math.log10(max(left / n, 1e-30)), null, float((r[i] == c[j]).mean()), 10 * math.log10(max(own, 1e-30) / max(ref, 1e-30)),
        ))
    return out


def compare_audio(reference: DataFrame, candidate: DataFrame, reach: int = 2048) -> DataFrame:
    """Matched channels of each asset in both tables.

    Inputs that differ in rate or number of channels, or have samples that are not finite, give one
    row without a comparison.
    """
    names = [x.split()[0] for x in COMPARE.split(", ")]

    def stacked(rows: pd.DataFrame) -> np.ndarray:
        return np.stack([np.concatenate([np.asarray(s, np.float64) for s in own["samples"]]) for _, own in rows.sort_values(["channel", "chunk_no"]).groupby("channel")])

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame([], columns=names)
        r, c = stacked(left), stacked(right)
        fs, other = int(left["sample_rate"].iloc[0]), int(right["sample_rate"].iloc[0])
        odd = [int((~np.isfinite(x)).sum()) for x in (r, c)]
        facts = (key[0], fs, other, len(r), len(c), *odd, abs(r.shape[1] - c.shape[1]))
        same = fs == other and len(r) == len(c) and not any(odd)
        rows = compare_signals(r, c, reach, fs) if same else [(None,) * (len(names) - len(facts))]
        return pd.DataFrame([(*facts, *x) for x in rows], columns=names, dtype=object)

    return reference.groupBy("asset_id").cogroup(candidate.groupBy("asset_id")).applyInPandas(run, COMPARE)


def comparison_gates(
    rows: DataFrame, max_lag: int = 0, duration_tolerance: int = 0, min_alignment: float = 0.9, min_correlation: float = 0.999, min_null_db: float = 60.0, max_peak_db: float = -60.0,
    max_spectral_db: float = 0.1, allow_permutation: bool = False, allow_inversion: bool = False,
) -> DataFrame:
    """(asset_id, channel, rule_id, level, passed), channel null for rules on whole assets.

    Rules that need an earlier one to hold give no row where that one fails. Allowed permutations and
    inversions are still found, as notes.
    """
    first = lambda c: F.first(c).alias(c)
    residual, peak = ("corrected_energy", "corrected_peak") if allow_inversion else ("residual_energy", "residual_peak")
    facts = ("reference_rate", "candidate_rate", "reference_channels", "candidate_channels", "reference_non_finite", "candidate_non_finite", "duration_delta", "lag", "lag_cosine", "overlap")
    whole = rows.groupBy("asset_id").agg(
        *[first(c) for c in facts], F.bool_and(F.col("channel") == F.col("matched")).alias("in_order"), F.sum("reference_energy").alias("energy"), F.sum(residual).alias("rest"), F.max(peak).alias("peak")
    )
    energy, rest = F.col("energy"), F.col("rest")
    null = F.when(rest <= 1e-30, 300.0).when(energy <= 1e-30, 0.0).otherwise(10 * F.log10(energy / rest))
    level = lambda allowed: "note" if allowed else "error"
    assets = [
        ("NON-FINITE", "error", (F.col("reference_non_finite") == 0) & (F.col("candidate_non_finite") == 0)), ("SAMPLE-RATE", "error", F.col("reference_rate") == F.col("candidate_rate")),
        ("CHANNEL-COUNT", "error", F.col("reference_channels") == F.col("candidate_channels")), ("OFFSET", "error", F.abs("lag") <= max_lag), ("DURATION", "error", F.when(F.col("lag").isNotNull(), F.col("duration_delta") <= duration_tolerance)),
        ("ALIGNMENT-CONFIDENCE", "error", F.col("lag_cosine") >= min_alignment), ("OVERLAP", "error", F.col("overlap") > 0), ("CHANNEL-PERMUTATION", level(allow_permutation), F.col("in_order")),
        ("NULL-DEPTH", "error", null >= min_null_db), ("RESIDUAL-PEAK", "error", F.when(F.col("peak").isNotNull(), 20 * F.log10(F.greatest("peak", F.lit(1e-15))) <= max_peak_db)),
    ]
    channels = [
        ("POLARITY", level(allow_inversion), F.col("signed_correlation") >= 0), ("CORRELATION", "error", F.col("correlation") >= min_correlation), ("SPECTRAL-ERROR", "error", F.col("spectral_error_db") <= max_spectral_db),
    ]
    each = lambda rules: F.explode(F.array(*[F.struct(F.lit(f"AQ-AUDIO-COMPARE-{n}").alias("rule_id"), F.lit(how).alias("level"), c.alias("passed")) for n, how, c in rules])).alias("g")
    found = whole.select("asset_id", F.lit(None).cast("int").alias("channel"), each(assets)).union(rows.select("asset_id", "channel", each(channels)))
    return found.select("asset_id", "channel", "g.*").where("passed IS NOT NULL")


SPEECH = "asset_id string, frame long, start_seconds double, rms double, focus double, zcr double, band double, modulation double, periodicity double"


def speech_features(chunks: DataFrame) -> DataFrame:
    """Quarter-second features of centre, mid or mono; chunks must begin at whole quarters."""
    from .health import one_pole_band

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("channel")
        fs, base = int(rows["sample_rate"].iloc[0]), int(rows["frame_start"].iloc[0])
        x = np.stack([np.asarray(s, np.float64) for s in rows["samples"]])
        mid = x[2] if len(x) >= 6 else x[:2].mean(axis=0)
        n, out = max(1, fs // 4), []
        for s in range(0, x.shape[1], n):
            y = mid[s : s + n]
            if len(y) < n // 2:
                continue
            energy = float(np.square(y).mean())
            rest = float(np.square(x[:2, s : s + n] - y).mean()) if len(x) > 1 else 0.0
            band = one_pole_band(y, fs, 80, 4000)
            sub = [10 * math.log10(max(float(np.square(y[i : i + fs // 50]).mean()), 1e-12)) for i in range(0, len(y) - fs // 100 + 1, max(1, fs // 50))]
            best, thin = 0.0, float(np.square(y[::4]).sum())
            for f in (80, 100, 125, 160, 200, 250, 300):
                lag = fs // f
                if thin > 2e-16 and lag < len(y):
                    now, then = y[lag::4], y[: len(y) - lag : 4]
                    best = max(best, float((now * then).sum() / max(math.sqrt(thin * float(np.square(then).sum())), 2e-16)))
            out.append((rows["asset_id"].iloc[0], (base + s) // n, (base + s) / fs, 10 * math.log10(energy) if energy > 0 else -120.0, energy / (energy + rest) if energy + rest > 0 else 0.0,
                        float((np.signbit(y[1:]) != np.signbit(y[:-1])).sum() / len(y)), min(1.0, float(np.square(band).sum() / (np.square(y).sum() + 2e-16))), float(np.std(sub)) if len(sub) > 1 else 0.0, min(1.0, best)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SPEECH.split(", ")])

    return chunks.groupBy("asset_id", "chunk_no").applyInPandas(run, SPEECH)


def detect_dialogue(chunks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Ranges whose confidence passes the threshold, with hysteresis and one frame of grace."""
    from . import evidence, measure, sequence

    f = speech_features(chunks)
    floor = f.groupBy("asset_id").agg(measure.noise_floor(F.collect_list("rms")).alias("floor"))
    scored = f.join(floor, "asset_id").withColumn("confidence", evidence.dialogue_confidence(*[F.col(c) for c in ("rms", "floor", "focus", "zcr", "band", "modulation", "periodicity")]))
    state = sequence.hysteresis(scored.select("asset_id", "frame", "confidence"), ["asset_id"], "frame", "confidence", threshold, 0.12)
    chosen = scored.join(state, ["asset_id", "frame"]).select(F.col("asset_id").alias("asset"), "frame", "confidence", F.col("active").alias("selected"))
    return evidence.merged_selection(chosen, 0.25)
