"""Loudness of PCM chunks, in parallel over chunks as well as assets.

K-weighting is linear: the state that enters a chunk is the earlier chunks' end states, advanced.
One pass computes what each chunk adds to the state, a fold over these four-vectors (a row per
chunk) gives start states, and a second pass filters every chunk on its own and reduces it to
100 ms energies. The true-peak filter's history travels the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KWeighting, true_peak
from ..functions.units import amplitude_db, channel_weight, lufs
from . import measure

HISTORY = 15


def chunk_states(batches):
    made: dict[int, KWeighting] = {}
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            k = made.setdefault(r.sample_rate, KWeighting(r.sample_rate))
            x = np.asarray(r.samples, np.float64)
            out.append((r.asset_id, r.channel, r.chunk_no, r.sample_rate, len(x), k.end_state(x).tolist(), x[-HISTORY:].tolist()))
        yield pd.DataFrame(out, columns=["asset_id", "channel", "chunk_no", "sample_rate", "n", "added", "tail"])


def fold_states(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("chunk_no")
    k = KWeighting(int(rows["sample_rate"].iloc[0]))
    state, tail, out = np.zeros(4), [], []
    for r in rows.itertuples(index=False):
        out.append((r.asset_id, r.channel, r.chunk_no, state.tolist(), list(tail)))
        state = k.advance(state, r.n) + np.asarray(r.added)
        tail = (list(tail) + list(r.tail))[-HISTORY:]
    return pd.DataFrame(out, columns=["asset_id", "channel", "chunk_no", "state", "history"])


def filter_chunks(batches):
    made: dict[int, KWeighting] = {}
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            k = made.setdefault(r.sample_rate, KWeighting(r.sample_rate))
            x = np.asarray(r.samples, np.float64)
            y, _ = k.run(x, np.asarray(r.state))
            hop = r.sample_rate // 10
            whole = len(y) // hop
            history = np.asarray(r.history, np.float64)
            if len(history) and len(history) < HISTORY:
                history = np.concatenate([np.full(HISTORY - len(history), history[0]), history])
            peak = true_peak(x, history if len(history) else None)
            out.append((r.asset_id, r.channel, r.frame_start // hop, np.square(y[: whole * hop]).reshape(whole, hop).mean(axis=1).tolist(), float(np.square(x).sum()), len(x), float(np.abs(x).max(initial=0.0)), peak))
        yield pd.DataFrame(out, columns=["asset_id", "channel", "hop_start", "energies", "square_sum", "n", "sample_peak", "true_peak"])


def features(chunks: DataFrame) -> DataFrame:
    """Hop energies and peaks of each chunk. Chunks must hold whole 100 ms hops, all but an asset's last."""
    states = chunks.select("asset_id", "channel", "chunk_no", "sample_rate", "samples").mapInPandas(chunk_states, "asset_id string, channel int, chunk_no int, sample_rate int, n int, added array<double>, tail array<double>")
    start = states.groupBy("asset_id", "channel").applyInPandas(fold_states, "asset_id string, channel int, chunk_no int, state array<double>, history array<double>")
    ready = chunks.join(start, ["asset_id", "channel", "chunk_no"]).select("asset_id", "channel", "sample_rate", "frame_start", "samples", "state", "history")
    return ready.mapInPandas(filter_chunks, "asset_id string, channel int, hop_start long, energies array<double>, square_sum double, n long, sample_peak double, true_peak double")


def analyze(chunks: DataFrame, roles: DataFrame) -> DataFrame:
    """Measurements of each asset. roles: (asset_id, channel, role, azimuth, elevation); a channel without one counts as main."""
    found = features(chunks).join(roles, ["asset_id", "channel"], "left")
    weight = F.coalesce(channel_weight(F.col("role"), F.col("azimuth"), F.col("elevation")), F.lit(1.0))
    hops = found.select("asset_id", weight.alias("w"), "hop_start", F.posexplode("energies").alias("i", "e")).groupBy(F.col("asset_id").alias("asset"), (F.col("hop_start") + F.col("i")).alias("frame")).agg(F.sum(F.col("w") * F.col("e")).alias("energy"))
    momentary, short = measure.window_energy(hops, measure.MOMENTARY), measure.window_energy(hops, measure.SHORT_TERM)
    top = found.groupBy(F.col("asset_id").alias("asset")).agg(
        amplitude_db(F.sqrt(F.sum("square_sum") / F.sum("n"))).alias("rms_dbfs"), amplitude_db(F.max("sample_peak")).alias("sample_peak_dbfs"), amplitude_db(F.max("true_peak")).alias("true_peak_dbtp")
    )
    peak = lambda df, name: df.groupBy("asset").agg(lufs(F.max("block")).alias(name))
    out = top.join(measure.gated(momentary, ["asset"], clustered=True), "asset", "left").join(measure.loudness_range(short, ["asset"], clustered=True).drop("n_used"), "asset", "left")
    out = out.join(peak(momentary, "max_momentary_lufs"), "asset", "left").join(peak(short, "max_short_term_lufs"), "asset", "left")
    silent = F.lit("-Infinity").cast("double")
    return out.select(
        F.col("asset").alias("asset_id"), F.coalesce("integrated_lufs", silent).alias("integrated_lufs"), F.coalesce("max_momentary_lufs", silent).alias("max_momentary_lufs"),
        F.coalesce("max_short_term_lufs", silent).alias("max_short_term_lufs"), F.coalesce("lra", F.lit(0.0)).alias("lra"), "rms_dbfs", "sample_peak_dbfs", "true_peak_dbtp",
    )


def analyze_range(chunks: DataFrame, start_frame: int, stop_frame: int) -> DataFrame:
    """The chunks' part inside a frame range; whole chunks outside are pruned before samples are read."""
    n = F.size("samples")
    kept = chunks.where((F.col("frame_start") < stop_frame) & (F.col("frame_start") + n > start_frame))
    lead = F.greatest(F.lit(start_frame) - F.col("frame_start"), F.lit(0)).cast("int")
    length = F.least(F.lit(stop_frame) - F.col("frame_start"), n.cast("long")).cast("int") - lead
    return kept.withColumn("samples", F.slice("samples", lead + 1, length)).withColumn("frame_start", F.col("frame_start") + lead - start_frame)
