"""Signal-health rules over PCM chunks.

The samples are shuffled once, all channels of a chunk together, and reduced to three small
tables: sample-level segments, per-window features and per-chunk sums. Everything after that is
relational: segments that touch across chunks are merged, windows become runs, sums become
programme figures. Results don't depend on the length of chunks. A threshold can be changed without reading the samples again as long as the
segment predicates stay the same. Chunks must begin at whole seconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dims import LAYOUTS
from ..functions.shared import written
from . import sequence


@dataclass(frozen=True)
class Options:
    """Default thresholds; levels in dBFS, times in seconds."""

    silence: float = -60.0
    silence_seconds: float = 1.0
    half_lsb: float = 0.0
    clip_samples: int = 3
    tones: tuple = (1000.0,)
    tone_level: float = -30.0
    tone_ratio: float = 0.8
    tone_windows: int = 5
    dropout: float = -70.0
    dropout_seconds: tuple = (0.002, 0.1)
    phase: float = -0.5
    click: float = 0.5
    low_level: float = -50.0
    hum_level: float = -50.0
    hum_ratio: float = 0.5
    noise_programme: float = -35.0
    noise_band: float = -60.0
    noise_flatness: float = 0.5
    noise_windows: int = 4
    talk_loud: float = -35.0
    talk_quiet: float = -60.0
    talk_delta: float = 18.0
    talk_coherence: float = 0.95
    talk_windows: int = 4
    pan_loud: float = -35.0
    pan_imbalance: float = 18.0
    pan_windows: int = 8
    lfe_hz: float = 120.0
    lfe_ratio: float = 0.25
    expect_mono: bool = False
    dc: float = -40.0
    delay_samples: int = 1
    delay_cosine: float = 0.8
    stuck_seconds: float = 0.05
    jump: float = 0.75
    lfe_channels: tuple = field(default=())
    #: Pairs of channels for phase, panning and delay; None: those of the usual layout with so many channels.
    stereo_pairs: tuple | None = None


FEATURES = "asset_id string, sample_rate int, kind string, channel int, related int, at long, stop long, a double, b double, c double, d double"


#: Bands (Hz) of the spectral part of cross-talk.
TALK_BANDS = (250.0, 375.0, 500.0, 750.0, 1000.0, 2000.0, 4000.0, 8000.0)
#: Seconds before a chunk that its filters are run over first: their memory of anything older is below 1e-8.
WARM_UP = 0.05


def stereo_pairs(channels: int) -> list[tuple[int, int]]:
    """The first two channels, and channels that mirror each other, of the usual layout of so many channels."""
    layout = next((x for x in LAYOUTS.values() if len(x) == channels), [])
    found = [(i, j) for i, a in enumerate(layout) for j, b in enumerate(layout) if i < j and a[1] == b[1] and a[2] == -b[2] != 0 and a[3] == b[3]]
    return found or [(0, 1)][: channels // 2]


def spectral_match(a: np.ndarray, b: np.ndarray, fs: float) -> np.ndarray:
    """Cosine of the amplitudes of each row's bands."""
    bands = [hz for hz in TALK_BANDS if hz < 0.49 * fs]
    x, y = (np.stack([goertzel(s, hz, fs) for hz in bands], axis=-1) if bands else np.zeros((len(s), 1)) for s in (a, b))
    return np.clip(cosine(x, y), 0, 1)


def runs_of(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).reshape(-1, 2)


def one_pole_band(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """one-pole high-pass, then one-pole low-pass, as impulse responses long enough to have died away."""
    dt = 1 / fs
    rc = 1 / (2 * np.pi * low)
    a = rc / (rc + dt)
    rc = 1 / (2 * np.pi * min(high, 0.49 * fs))
    b = dt / (rc + dt)
    n = int(min(len(x), max(64, np.ceil(np.log(1e-8) / np.log(min(a, 1 - 1e-9))))))
    decay = a ** np.arange(n)
    first = np.concatenate(([a], -decay[1:] * (1 - a)))
    second = b * (1 - b) ** np.arange(min(n, 4096))
    size = 1 << int(len(x) + len(first) + len(second)).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(first, size) * np.fft.rfft(second, size), size)[: len(x)]


def level(ms) -> np.ndarray:
    return 10 * np.log10(np.maximum(ms, 1e-30))


def goertzel(x: np.ndarray, hz: float, fs: float) -> np.ndarray:
    """amplitude of a frequency in each row."""
    t = np.exp(-2j * np.pi * hz / fs * np.arange(x.shape[1]))
    return 2 * np.abs(x @ t) / x.shape[1]


def windows(x: np.ndarray, n: int) -> np.ndarray:
    k = x.shape[-1] // n
    return x[..., : k * n].reshape(*x.shape[:-1], k, n)


def cosine(a, b, axis=-1):
    d = np.sqrt((a * a).sum(axis) * (b * b).sum(axis))
    return np.where(d > 0, (a * b).sum(axis) / np.where(d > 0, d, 1), 0.0)


def reduce_for(o: Options):
    names = [x.split()[0] for x in FEATURES.split(", ")]
    amp = lambda db: np.float32(10 ** (db / 20))

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("channel")
        before = {r.channel: np.asarray(r.samples, np.float64) for r in rows[rows["tail"]].itertuples(index=False)}
        rows = rows[~rows["tail"]]
        if rows.empty:
            return pd.DataFrame([], columns=names)
        asset, fs, base = rows["asset_id"].iloc[0], int(rows["sample_rate"].iloc[0]), int(rows["frame_start"].iloc[0])
        channels, x = rows["channel"].tolist(), np.stack([np.asarray(s, np.float32) for s in rows["samples"]])
        y, out = x.astype(np.float64), []
        add = lambda kind, ch, rel, at, stop, a=None, b=None, c=None, d=None: out.append((asset, fs, kind, ch, rel, at, stop, a, b, c, d))
        chosen = set(stereo_pairs(len(channels)) if o.stereo_pairs is None else o.stereo_pairs)
        for i, ch in enumerate(channels):
            s = y[i]
            lead = before.get(ch, s[:0])
            band_of = lambda low, high, s=s, lead=lead: one_pole_band(np.concatenate([lead, s]), fs, low, high)[len(lead) :]
            for kind, mask in (("silence", np.abs(x[i]) <= amp(o.silence)), ("clip", (x[i] >= 1 - o.half_lsb) | (x[i] <= -1)), ("drop", np.abs(x[i]) <= amp(o.dropout))):
                for p, q in runs_of(mask):
                    add(kind, ch, None, base + p, base + q, float(np.square(s[p:q]).sum()))
            edge = np.flatnonzero(np.concatenate(([True], x[i][1:].view(np.int32) != x[i][:-1].view(np.int32), [True])))
            longest = np.diff(edge)
            for k in np.flatnonzero((longest >= 2) | (edge[:-1] == 0) | (edge[1:] == len(s))):
                if abs(s[edge[k]]) > amp(o.silence):
                    add("stuck", ch, None, base + edge[k], base + edge[k + 1], float(s[edge[k]]))
            residual = s[1:-1] - (s[:-2] + s[2:]) / 2
            for p in np.flatnonzero((np.abs(residual) >= o.click) & ((s[1:-1] - s[:-2]) * (s[2:] - s[1:-1]) < 0)) + 1:
                add("click", ch, None, base + p, base + p + 1, float(abs(residual[p - 1])))
            for p in np.flatnonzero(np.abs(np.diff(s)) >= o.jump) + 1:
                add("jump", ch, None, base + p, base + p + 1, float(s[p] - s[p - 1]))
            pad = lambda v: [*v.tolist(), *[None] * (2 - len(v))]
            add("edge", ch, None, base, base + len(s), *pad(s[:2]), *pad(s[-2:]))
            high = s - band_of(1e-6, o.lfe_hz) if ch in o.lfe_channels else s[:0]
            add("sum", ch, None, base, base + len(s), float(np.square(s).sum()), float(s.sum()), float(np.square(high).sum()))
            w = windows(s, max(fs // 10, 32))
            energy = np.square(w).mean(axis=1)
            for hz in o.tones:
                a = goertzel(w, hz, fs)
                for k in np.flatnonzero((20 * np.log10(np.maximum(a, 1e-15)) >= o.tone_level) & (a * a / 2 >= o.tone_ratio * energy)):
                    add("tone", ch, None, base // w.shape[1] + k, None, hz)
            w = windows(s, fs)
            energy = np.square(w).mean(axis=1)
            best = np.stack([sum(np.square(goertzel(w, f * h, fs)) / 2 for h in (1, 2, 3, 4)) for f in (50, 60)])
            for k in np.flatnonzero((level(best.max(axis=0)) >= o.hum_level) & (best.max(axis=0) >= o.hum_ratio * np.maximum(energy, 1e-30))):
                add("hum", ch, None, base // fs + k, None, 50.0 if best[0, k] >= best[1, k] else 60.0)
            quarter = windows(s, max(fs // 4, 1))
            flat = 1 - np.abs(cosine(quarter[:, :-1], quarter[:, 1:]))
            band = level(np.square(windows(band_of(200, 15000), max(fs // 4, 1))).mean(axis=1))
            whole = level(np.square(quarter).mean(axis=1))
            for k in np.flatnonzero((whole <= o.noise_programme) & (band >= o.noise_band) & (flat >= o.noise_flatness)):
                add("noise", ch, None, base // quarter.shape[1] + k, None, float(band[k]))
        for i, ch in enumerate(channels):
            for j in range(i + 1, len(channels)):
                if ch in o.lfe_channels or channels[j] in o.lfe_channels:
                    continue
                stereo = (i, j) in chosen
                half = windows(y[[i, j]], max(fs // 2, 1))
                cos, loud = cosine(half[0], half[1]), np.sqrt(np.square(half).mean(axis=2)).max(axis=0)
                for k in np.flatnonzero((loud >= amp(o.silence)) & (cos <= o.phase) & stereo):
                    add("phase", ch, channels[j], base // half.shape[2] + k, None, float(cos[k]))
                q = windows(y[[i, j]], max(fs // 4, 1))
                db = level(np.square(q).mean(axis=2))
                coherence, delta = np.abs(cosine(q[0], q[1])) * spectral_match(q[0], q[1], fs), np.abs(db[0] - db[1])
                for k in range(q.shape[1]):
                    top, low = (ch, channels[j]) if db[0, k] >= db[1, k] else (channels[j], ch)
                    if db[:, k].max() >= o.talk_loud and db[:, k].min() >= o.talk_quiet and delta[k] >= o.talk_delta and coherence[k] >= o.talk_coherence:
                        add("talk", low, top, base // q.shape[2] + k, None, float(coherence[k]))
                    if stereo and db[:, k].max() >= o.pan_loud and delta[k] >= o.pan_imbalance:
                        add("pan", top, low, base // q.shape[2] + k, None, float(delta[k]))
                add("pair", ch, channels[j], base, base + x.shape[1], float(np.abs(y[i] - y[j]).max(initial=0.0)))
                reach = min(o.delay_samples + 8, 64)
                for p in range(0, x.shape[1] - 2048 - 2 * reach + 1 if stereo else 0, fs):
                    a = y[i, p + reach : p + reach + 2048]
                    cos = np.array([abs(float(cosine(a, y[j, p + reach + t : p + reach + t + 2048]))) for t in range(-reach, reach + 1)])
                    best = len(cos) - 1 - int(cos[::-1].argmax())
                    if cos[best] >= o.delay_cosine and abs(best - reach) > o.delay_samples:
                        add("delay", ch, channels[j], base + p, None, float(best - reach), float(cos[best]))
        return pd.DataFrame(out, columns=names)

    return reduce


def features(chunks: DataFrame, options: Options) -> DataFrame:
    """FEATURES of each chunk. The last WARM_UP of a chunk travels to the next one as well, whose filters start with it."""
    own = chunks.select("asset_id", "sample_rate", "channel", "chunk_no", "frame_start", "samples", F.lit(False).alias("tail"))
    short = F.greatest(F.lit(1), F.ceil(F.col("sample_rate") * WARM_UP)).cast("int")
    last = F.when(F.size("samples") > short, F.slice("samples", F.size("samples") - short + 1, short)).otherwise(F.col("samples"))
    ends = own.withColumns({"chunk_no": F.col("chunk_no") + 1, "samples": last, "tail": F.lit(True)})
    return own.unionByName(ends).groupBy("asset_id", "chunk_no").applyInPandas(reduce_for(options), FEATURES)


def findings(found: DataFrame, o: Options) -> DataFrame:
    """Events (asset_id, rule_id, channel, related, start_seconds, end_seconds, measured) from the features."""
    who = ["asset_id", "sample_rate", "channel"]
    none = F.lit(None).cast("int")

    def event(rows: DataFrame, rule: str, start: Column, end: Column, measured: Column, related: Column = none) -> DataFrame:
        return rows.select("asset_id", F.lit(rule).alias("rule_id"), "channel", related.alias("related"), start.cast("double").alias("start_seconds"), end.cast("double").alias("end_seconds"), measured.cast("double").alias("measured"))

    fs, seconds = F.col("sample_rate"), lambda c: F.col(c) / F.col("sample_rate")
    kind = lambda k: found.where(F.col("kind") == k)
    db = lambda c: 10 * F.log10(F.greatest(c, F.lit(1e-30)))
    ends = kind("sum").groupBy(*who).agg(F.min("at").alias("first"), F.max("stop").alias("last"), F.sum("a").alias("energy"), F.sum("b").alias("total"), F.sum("c").alias("high")).withColumn("n", F.col("last") - F.col("first"))
    length = F.col("range_end") - F.col("range_start")
    merged = lambda k: sequence.merge_ranges(kind(k), who, "at", "stop", 0, F.sum("a").alias("sum"), F.first("a").alias("value"))

    def window_runs(k: str, least: int, seconds_each: float, measure: Column, related: bool = False, by: tuple = ()) -> DataFrame:
        keys = [*who, *(["related"] if related else []), *by]
        w = Window.partitionBy(*keys).orderBy("at")
        rows = kind(k).withColumn("run", F.col("at") - F.row_number().over(w)).groupBy(*keys, "run")
        return rows.agg(F.min("at").alias("w0"), (F.max("at") + 1).alias("w1"), F.count("*").alias("k"), measure.alias("m")).where(F.col("k") >= least).withColumns({"s": F.col("w0") * seconds_each, "e": F.col("w1") * seconds_each})

    out = [
        event(merged("silence").where(length >= F.ceil(fs * o.silence_seconds)), "0078B", seconds("range_start"), seconds("range_end"), db(F.col("sum") / length)),
        event(merged("clip").where(length >= o.clip_samples), "0005B", seconds("range_start"), seconds("range_end"), length),
    ]
    drop = merged("drop").join(ends, who).where((length >= F.ceil(fs * o.dropout_seconds[0])) & (length <= F.ceil(fs * o.dropout_seconds[1])) & (F.col("range_start") > F.col("first")) & (F.col("range_end") < F.col("last")))
    out.append(event(drop, "0008B", seconds("range_start"), seconds("range_end"), length / fs))
    # runs of bit-equal samples that touch across chunks count together if their values are equal
    stuck = sequence.merge_ranges(kind("stuck"), [*who, "a"], "at", "stop", 0).where(length >= F.ceil(fs * o.stuck_seconds))
    out.append(event(stuck, "AQ-STUCK-SAMPLES", seconds("range_start"), seconds("range_end"), F.col("a")))
    w = Window.partitionBy(*who).orderBy("at")
    border = kind("edge").select(*who, "at", "stop", "c", "d", F.lead("a").over(w).alias("n0"), F.lead("b").over(w).alias("n1"), F.lag("d").over(w).alias("p")).where("n0 IS NOT NULL")
    jumps = kind("jump").select(*who, "at", "a").union(border.where(F.abs(F.col("n0") - F.col("d")) >= o.jump).select(*who, F.col("stop").alias("at"), (F.col("n0") - F.col("d")).alias("a")))
    spike = lambda p, x, n: (F.abs(x - (p + n) / 2) >= o.click) & ((x - p) * (n - x) < 0)
    clicks = kind("click").select(*who, "at", "a")
    for p, x, n, at in (("c", "d", "n0", F.col("stop") - 1), ("d", "n0", "n1", F.col("stop"))):
        p, x, n = F.col(p), F.col(x), F.col(n)
        clicks = clicks.union(border.where(spike(p, x, n)).select(*who, at.alias("at"), F.abs(x - (p + n) / 2).alias("a")))
    for rows, rule in ((clicks, "0057B"), (jumps, "AQ-DISCONTINUITY")):
        # the gap is a thousandth of a second: assets are coalesced by sample rate
        gap = F.greatest(F.lit(1), F.floor(fs / 1000))
        cluster = F.sum(F.when(F.col("at") - F.lag("at").over(w) < gap, 0).otherwise(1)).over(w)
        grouped = rows.withColumn("cluster", cluster).groupBy(*who, "cluster").agg(F.array_sort(F.collect_list(F.struct("at", "a"))).alias("xs"))
        step = lambda acc, e, g=gap: F.when((F.size(acc) == 0) | (e["at"] - F.element_at(F.concat(F.array(F.lit(-(2**62)).cast("bigint")), F.transform(acc, lambda z: z["at"])), -1) >= g), F.concat(acc, F.array(e))).otherwise(acc)
        fold = (lambda g: lambda acc, e: step(acc, e, g))(gap)
        kept = grouped.select(*who, F.explode(F.aggregate("xs", F.array().cast("array<struct<at:bigint,a:double>>"), fold)).alias("e")).select(*who, "e.at", "e.a")
        out.append(event(kept, rule, seconds("at"), (F.col("at") + 1) / fs, F.col("a")))
    out.append(event(window_runs("tone", o.tone_windows, 0.1, F.first("a"), by=("a",)), "0014B", F.col("s"), F.col("e"), F.col("m")))
    out.append(event(window_runs("hum", 1, 1.0, F.max_by("a", "at")), "0088B", F.col("s"), F.col("e"), F.col("m")))
    out.append(event(window_runs("noise", o.noise_windows, 0.25, F.max("a")), "0086B", F.col("s"), F.col("e"), F.col("m")))
    out.append(event(window_runs("phase", 1, 0.5, F.min("a"), True), "0012B", F.col("s"), F.col("e"), F.col("m"), F.col("related")))
    out.append(event(window_runs("talk", o.talk_windows, 0.25, F.max("a"), True), "0170B", F.col("s"), F.col("e"), F.col("m"), F.col("related")))
    out.append(event(window_runs("pan", o.pan_windows, 0.25, F.max("a"), True), "0230B", F.col("s"), F.col("e"), F.col("m"), F.col("related")))
    out.append(event(kind("delay").groupBy(*who, "related").agg(F.max_by("a", "b").alias("a"), F.min("at").alias("at"), F.max("at").alias("to")), "AQ-INTERCHANNEL-DELAY", seconds("at"), seconds("to"), F.col("a"), F.col("related")))
    whole = lambda rows, rule, measured: event(rows, rule, F.col("first") / fs, F.col("last") / fs, measured)
    out.append(whole(ends.where(db(F.col("energy") / F.col("n")) < o.low_level), "0077B", db(F.col("energy") / F.col("n"))))
    mean_db = 20 * F.log10(F.greatest(F.abs(F.col("total") / F.col("n")), F.lit(1e-15)))
    out.append(whole(ends.where(mean_db >= o.dc), "AQ-DC-OFFSET", mean_db))
    ratio = F.when(F.col("energy") > 0, F.col("high") / F.col("energy"))
    out.append(whole(ends.where(F.col("channel").isin(*o.lfe_channels) & (ratio >= o.lfe_ratio)), "0095B", ratio) if o.lfe_channels else whole(ends.where(F.lit(False)), "0095B", F.lit(0.0)))
    if o.expect_mono:
        pairs = kind("pair").groupBy(*who, "related").agg(F.max("a").alias("a"), F.min("at").alias("first"), F.max("stop").alias("last"))
        out.append(event(pairs.where(F.col("a") > 1 / 32768), "0124B", F.col("first") / fs, F.col("last") / fs, F.col("a"), F.col("related")))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.withColumns({"channel": F.col("channel") + 1, "related": F.col("related") + 1})


#: Rules in the order of a report; the last four of the table below need to be asked for or only inform.
RULES = [
    "0078B", "0005B", "0014B", "0009F", "0010B", "0084B", "0004F", "0008B", "0012B", "0057B", "0077B", "0088B", "0086B", "0170B", "0230B", "0095B", "0124B",
    "AQ-DC-OFFSET", "AQ-INTERCHANNEL-DELAY", "AQ-STUCK-SAMPLES", "AQ-DISCONTINUITY",
]


def report(chunks: DataFrame, options: Options = Options(), measured: DataFrame | None = None, expected_seconds: float | None = None, expected_channels: int | None = None, cap: int = 10_000) -> DataFrame:
    """One row per asset and rule: passed, calculated, events (at most `cap`, then events_truncated).

    measured: asset_id, integrated_lufs, true_peak_dbtp for the two rules that only inform.
    """
    spark = chunks.sparkSession
    found = written(features(chunks, options), "health-features")  # small; every rule reads it
    events = findings(found, options)
    size = found.where("kind = 'sum'").groupBy("asset_id").agg((F.max("stop") / F.first("sample_rate")).alias("seconds"), F.count_distinct("channel").alias("channels"))
    extra = []
    if expected_seconds is not None:
        extra.append(size.where(F.abs(F.col("seconds") - expected_seconds) > 0.01).select("asset_id", F.lit("0009F").alias("rule_id"), F.col("seconds").alias("measured")))
    if expected_channels is not None:
        extra.append(size.where(F.col("channels") != expected_channels).select("asset_id", F.lit("0004F").alias("rule_id"), F.col("channels").cast("double").alias("measured")))
    informs = []
    if measured is not None:
        informs = [measured.select("asset_id", F.lit(r).alias("rule_id"), F.col(c).alias("measured")) for r, c in (("0010B", "integrated_lufs"), ("0084B", "true_peak_dbtp"))]
    for x in [*extra, *informs]:
        events = events.unionByName(x, allowMissingColumns=True)
    order = Window.partitionBy("asset_id", "rule_id").orderBy("start_seconds", "channel", "related")
    ranked = events.withColumn("no", F.row_number().over(order)).where(F.col("no") <= cap + 1)
    packed = ranked.groupBy("asset_id", "rule_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("no", "channel", "related", "start_seconds", "end_seconds", "measured"))), 1, cap).alias("events"), (F.max("no") > cap).alias("events_truncated")
    )
    off = [*(["0009F"] if expected_seconds is None else []), *(["0004F"] if expected_channels is None else []), *(["0010B", "0084B"] if measured is None else []), *([] if options.expect_mono else ["0124B"]), *([] if options.lfe_channels else ["0095B"])]
    rules = spark.createDataFrame([(i, r, r not in off, r in ("0010B", "0084B")) for i, r in enumerate(RULES)], "position int, rule_id string, calculated boolean, informs boolean")
    grid = size.select("asset_id").crossJoin(F.broadcast(rules))  # 21 rows for each asset
    joined = grid.join(packed, ["asset_id", "rule_id"], "left")
    passed = F.when(F.col("calculated"), F.col("informs") | F.col("events").isNull())
    return joined.select("asset_id", "position", "rule_id", "calculated", passed.alias("passed"), F.coalesce("events_truncated", F.lit(False)).alias("events_truncated"), F.coalesce("events", F.array()).alias("events"))
