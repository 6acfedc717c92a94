"""Live gain: smoothed gain and a look-ahead limiter as a stateful operator over chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STATE = "gain double, envelope double, hold long, tail array<array<double>>, next long"
OUTPUT = "asset_id string, frame_start long, samples array<array<float>>, max_reduction_db double"


def smoothing(fs: int, ms: float) -> float:
    return 1 - math.exp(-1 / (fs * ms / 1000))


def process(target_db: float, ceiling_db: float, attack_ms: float = 10.0, release_ms: float = 100.0):
    """Gain moves to its target by one-pole smoothing, then a limiter that looks five milliseconds ahead."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame_start")
        fs = int(rows["sample_rate"].iloc[0])
        ahead, target, ceiling = max(16, fs * 5 // 1000), 10 ** (target_db / 20), 10 ** (ceiling_db / 20)
        attack, release, keep = smoothing(fs, attack_ms), smoothing(fs, release_ms), math.exp(-1 / (fs * release_ms / 1000))
        gain, envelope, hold, tail, at = state.get if state.exists else (1.0, 1.0, 0, [], int(rows["frame_start"].iloc[0]))
        delay = np.array([list(x) for x in tail]) if len(tail) else None
        out, most = [], 0.0
        for r in rows.itertuples(index=False):
            x = np.array([list(c) for c in r.samples], np.float64)
            y = np.empty_like(x)
            for i in range(x.shape[1]):
                gain += (target - gain) * (attack if target < gain else release)
                y[:, i] = x[:, i] * gain
            line = y if delay is None else np.concatenate([delay, y], axis=1)
            n = max(0, line.shape[1] - ahead)
            made, level = np.empty((len(x), n)), np.abs(line).max(axis=0)
            for i in range(n):
                peak = level[i + ahead]
                want = min(1.0, ceiling / peak * 0.99) if peak > ceiling else 1.0
                if want < envelope:
                    envelope, hold = want, ahead
                elif hold:
                    hold -= 1
                else:
                    envelope = min(1.0, 1 - (1 - envelope) * keep)
                g = min(envelope, ceiling / level[i]) if level[i] > 0 else envelope
                most = max(most, -20 * math.log10(g))
                made[:, i] = line[:, i] * g
            delay = line[:, n:]
            if n:
                out.append((key[0], at, made.astype(np.float32).tolist(), most))
                at += n
        state.update((gain, envelope, hold, delay.tolist() if delay is not None else [], at))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return step


def live_gain(chunks: DataFrame, target_db: float, ceiling_db: float) -> DataFrame:
    """chunks (streaming): asset_id, sample_rate, frame_start, samples array<array<float>> (channels x frames)."""
    return chunks.groupBy("asset_id").applyInPandasWithState(process(target_db, ceiling_db), OUTPUT, STATE, "append", "NoTimeout")
