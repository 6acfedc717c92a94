"""Array kernels and signal-health rules over the mapped vectors and streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..functions.units import amplitude_db, gain_clip, power_db, rounded
from ..operators import sequence
from .mappings import PAIR_SQL, STREAM_SQL, VECTOR_SQL, pairs, stream, vectors
from .registry import query

dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def numbers(xs) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in xs) + "]"


@query(f"WITH {VECTOR_SQL}, g AS (SELECT asset, list_transform(samples, lambda x: greatest(-0.2::DOUBLE, least(0.2::DOUBLE, x * 1.5::DOUBLE))) AS y FROM v) SELECT asset, round(list_sum(y), 6) AS total, round(list_max(y), 6) AS top, CAST(len(list_filter(y, lambda x: abs(x) >= 0.2)) AS INT) AS clipped FROM g")
def apply_gain_clip(spark, sf_dir):
    """Gain and hard clip."""
    y = vectors(spark, sf_dir).select("asset", gain_clip(F.col("samples"), F.lit(1.5), 0.2).alias("y"))
    return y.select("asset", rounded(total("y")).alias("total"), rounded(F.array_max("y")).alias("top"), F.size(F.filter("y", lambda x: F.abs(x) >= 0.2)).alias("clipped"))


@query(
    f"""WITH {VECTOR_SQL}, e AS (SELECT asset, list_transform(range(64), lambda i: samples[i + 1] * pow(10, (CASE WHEN i < 16 THEN -6 + 6 * (i / 16) * (i / 16) * (3 - 2 * (i / 16))
WHEN i >= 48 THEN -4 * ((i - 48) / 16) * ((i - 48) / 16) * (3 - 2 * ((i - 48) / 16)) ELSE 0 END) / 20)) AS y FROM v WHERE len(samples) = 64)
SELECT asset, round(list_sum(y), 6) AS total, round(y[1], 6) AS first_sample, round(y[64], 6) AS last_sample FROM e"""
)
def smoothstep_ramp(spark, sf_dir):
    """Gain envelope that ramps at both ends."""
    t0, t1 = (lambda i: i / 16), (lambda i: (i - 48) / 16)
    db = lambda i: F.when(i < 16, -6 + 6 * t0(i) * t0(i) * (3 - 2 * t0(i))).when(i >= 48, -4 * t1(i) * t1(i) * (3 - 2 * t1(i))).otherwise(0.0)
    y = vectors(spark, sf_dir).where(F.size("samples") == 64).select("asset", F.transform("samples", lambda x, i: x * F.pow(F.lit(10.0), db(i) / 20)).alias("y"))
    return y.select("asset", rounded(total("y")).alias("total"), rounded(F.col("y")[0]).alias("first_sample"), rounded(F.col("y")[63]).alias("last_sample"))


BANDS = (2, 5, 11, 23)


@query(
    f"WITH {VECTOR_SQL}, k AS (SELECT asset, samples, unnest({list(BANDS)}) AS bin FROM v WHERE len(samples) = 64), d AS (SELECT asset, bin, list_sum(list_transform(range(64), lambda i: samples[i + 1] * cos(2 * pi() * bin * i / 64))) AS re, list_sum(list_transform(range(64), lambda i: samples[i + 1] * sin(2 * pi() * bin * i / 64))) AS im FROM k) SELECT asset, bin, round(2 * sqrt(re * re + im * im) / 64, 6) AS amplitude FROM d"
)
def goertzel_bands(spark, sf_dir):
    """Goertzel amplitude of a few bins by a fold over the samples."""

    def amplitude(k):
        c = 2 * math.cos(2 * math.pi * k / 64)
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
        step = lambda s, x: F.struct((x + c * s["a"] - s["b"]).alias("a"), s["a"].alias("b"))
        return F.aggregate("samples", start, step, lambda s: 2 * F.sqrt(F.greatest(s["a"] * s["a"] + s["b"] * s["b"] - c * s["a"] * s["b"], F.lit(0.0))) / 64)

    rows = vectors(spark, sf_dir).where(F.size("samples") == 64)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("bin"), amplitude(k).alias("a")) for k in BANDS])).alias("x")
    return rows.select("asset", each).select("asset", "x.bin", rounded(F.col("x.a")).alias("amplitude"))


PHASES = kernels.true_peak_taps().reshape(-1, 4)


@query(
    f"WITH {VECTOR_SQL}, h AS (SELECT asset, samples, list_concat(list_transform(range(15), lambda i: samples[1]), samples) AS x FROM v),\n"
    + "y AS (SELECT asset, greatest(list_max(list_transform(samples, lambda s: abs(s))), "
    + ", ".join(f"list_max(list_transform(range(1, len(samples) + 1), lambda i: abs(list_dot_product(x[i:i + 15], {numbers(PHASES[::-1, p])}))))" for p in range(4))
    + ") AS peak FROM h) SELECT asset, round(peak, 6) AS true_peak, round(20 * log10(peak), 6) AS true_peak_dbtp FROM y WHERE peak > 0"
)
def true_peak(spark, sf_dir):
    """Four-phase interpolation; history is the first sample repeated. Arrow batches: a convolution per phase."""

    def peaks(batches):
        import pandas as pd

        for rows in batches:
            yield pd.DataFrame({"asset": rows["asset"], "peak": [kernels.true_peak(np.asarray(x)) for x in rows["samples"]]})

    found = vectors(spark, sf_dir).select("asset", "samples").mapInPandas(peaks, "asset long, peak double").where("peak > 0")
    return found.select("asset", rounded(F.col("peak")).alias("true_peak"), rounded(amplitude_db(F.col("peak"))).alias("true_peak_dbtp"))


RESPONSE = kernels.impulse_response(48000, 64)


@query(
    f"WITH {VECTOR_SQL}, y AS (SELECT asset, list_transform(range(1, 65), lambda i: list_dot_product(list_reverse(samples[1:i]), {numbers(RESPONSE)}[1:i])) AS y FROM v WHERE len(samples) = 64) SELECT asset, round({DOT.format('y', 'y')} / 64, 6) AS k_energy FROM y"
)
def kweighted_energy(spark, sf_dir):
    """K-weighted mean square, by block state space in Arrow batches."""

    def weigh(batches):
        import pandas as pd

        k = kernels.KWeighting(48000, 64)
        for rows in batches:
            yield pd.DataFrame({"asset": rows["asset"], "k_energy": [float(np.square(k.run(np.asarray(x))[0]).mean()) for x in rows["samples"]]})

    rows = vectors(spark, sf_dir).where(F.size("samples") == 64).select("asset", "samples")
    return rows.mapInPandas(weigh, "asset long, k_energy double").select("asset", rounded(F.col("k_energy")).alias("k_energy"))


RUN_SQL = STREAM_SQL + """,
h AS (SELECT asset, frame, sample, {holds} AS holds FROM f),
i AS (SELECT asset, frame, sample, frame - row_number() OVER (PARTITION BY asset ORDER BY frame) AS run FROM h WHERE holds),
u AS (SELECT asset, min(frame) AS start_frame, max(frame) + 1 AS end_frame, count(*) AS length, avg(sample * sample) AS ms, max(abs(sample)) AS top FROM i GROUP BY asset, run)"""


@query(f"WITH {RUN_SQL.format(holds='abs(sample) <= 0.3')} SELECT asset, start_frame, end_frame, length, round(10 * log10(greatest(ms, 1e-30)), 6) AS level FROM u WHERE length >= 2")
def silence_runs(spark, sf_dir):
    """0078B, W5: runs at or below a threshold, the last one included."""
    found = sequence.runs(stream(spark, sf_dir), ["asset"], "frame", F.abs("sample") <= 0.3, 2, F.avg("energy").alias("ms"))
    return found.select("asset", "start_frame", "end_frame", "length", rounded(power_db(F.col("ms"))).alias("level"))


@query(f"WITH {RUN_SQL.format(holds='sample >= 0.7 OR sample <= -0.7')} SELECT asset, start_frame, length, round(top, 6) AS top FROM u WHERE length >= 2")
def clipping_runs(spark, sf_dir):
    """0005B, W5: runs at full scale (here +-0.7)."""
    found = sequence.runs(stream(spark, sf_dir), ["asset"], "frame", (F.col("sample") >= 0.7) | (F.col("sample") <= -0.7), 2, F.max(F.abs("sample")).alias("top"))
    return found.select("asset", "start_frame", "length", rounded(F.col("top")).alias("top"))


@query(
    f"""WITH {RUN_SQL.format(holds='abs(sample) <= 0.4')}, e AS (SELECT asset, min(frame) AS lo, max(frame) + 1 AS hi FROM f GROUP BY asset)
SELECT asset, start_frame, length FROM u JOIN e USING (asset) WHERE length BETWEEN 2 AND 5 AND start_frame > lo AND end_frame < hi"""
)
def dropouts(spark, sf_dir):
    """0008B: short silent runs inside the programme only."""
    return sequence.interior_runs(stream(spark, sf_dir), ["asset"], "frame", F.abs("sample") <= 0.4, 2, 5).select("asset", "start_frame", "length")


@query(
    f"""WITH {STREAM_SQL}, q AS (SELECT asset, frame, floor((sample + 1) * 4)::INT AS value FROM f),
n AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY asset ORDER BY frame) THEN 0 ELSE 1 END AS new FROM q),
r AS (SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT asset, min(frame) AS start_frame, count(*) AS length, any_value(value) AS value FROM r GROUP BY asset, run HAVING count(*) >= 3"""
)
def stuck_samples(spark, sf_dir):
    """Stuck samples, W7: runs of equal (coarsely quantised) values."""
    q = stream(spark, sf_dir).withColumn("value", F.floor((F.col("sample") + 1) * 4).cast("int"))
    return sequence.equal_runs(q, ["asset"], "frame", "value", 3)


CLICK_SQL = f"""{STREAM_SQL},
n AS (SELECT asset, frame, sample AS x, lag(sample) OVER w AS p, lead(sample) OVER w AS q FROM f WINDOW w AS (PARTITION BY asset ORDER BY frame)),
c AS (SELECT asset, frame, abs(x - (p + q) / 2) AS residual FROM n WHERE abs(x - (p + q) / 2) >= 0.5 AND (x - p) * (q - x) < 0)"""


def clicks(spark, sf_dir):
    w = Window.partitionBy("asset").orderBy("frame")
    n = stream(spark, sf_dir).select("asset", "frame", F.col("sample").alias("x"), F.lag("sample").over(w).alias("p"), F.lead("sample").over(w).alias("q"))
    n = n.withColumn("residual", F.abs(F.col("x") - (F.col("p") + F.col("q")) / 2))
    return n.where((F.col("residual") >= 0.5) & ((F.col("x") - F.col("p")) * (F.col("q") - F.col("x")) < 0)).select("asset", "frame", "residual")


@query(f"WITH {CLICK_SQL} SELECT asset, frame, round(residual, 6) AS residual FROM c")
def click_candidates(spark, sf_dir):
    """0057B, W8: three-point impulse test."""
    return clicks(spark, sf_dir).select("asset", "frame", rounded(F.col("residual")).alias("residual"))


GREEDY = """o AS (SELECT asset, frame, row_number() OVER (PARTITION BY asset ORDER BY frame) AS n FROM c),
g AS (SELECT asset, n, frame, frame AS last, true AS keep FROM o WHERE n = 1
      UNION ALL SELECT o.asset, o.n, o.frame, CASE WHEN o.frame - g.last >= {gap} THEN o.frame ELSE g.last END, o.frame - g.last >= {gap} FROM g JOIN o ON o.asset = g.asset AND o.n = g.n + 1)
SELECT asset, frame FROM g WHERE keep"""


@query(f"WITH RECURSIVE {CLICK_SQL}, {GREEDY.format(gap=4)}")
def clicks_coalesced(spark, sf_dir):
    """0057B, W9: a click suppresses those within four frames of the last one kept."""
    return sequence.coalesce_greedy(clicks(spark, sf_dir), ["asset"], "frame", 4)


JUMP_SQL = f"{STREAM_SQL}, n AS (SELECT asset, frame, sample - lag(sample) OVER (PARTITION BY asset ORDER BY frame) AS delta FROM f), c AS (SELECT asset, frame FROM n WHERE abs(delta) >= 0.75)"


@query(f"WITH RECURSIVE {JUMP_SQL}, {GREEDY.format(gap=3)}")
def discontinuities(spark, sf_dir):
    """Discontinuity rule: jumps of 0.75 of full scale, coalesced."""
    w = Window.partitionBy("asset").orderBy("frame")
    jumps = stream(spark, sf_dir).withColumn("delta", F.col("sample") - F.lag("sample").over(w)).where(F.abs("delta") >= 0.75)
    return sequence.coalesce_greedy(jumps.select("asset", "frame"), ["asset"], "frame", 3)


@query(f"WITH {STREAM_SQL} SELECT asset, round(avg(sample), 6) AS dc, round(20 * log10(greatest(abs(avg(sample)), 1e-15)), 6) AS dc_dbfs, 20 * log10(greatest(abs(avg(sample)), 1e-15)) >= -40 AS failed FROM f GROUP BY asset")
def dc_offset(spark, sf_dir):
    """DC offset rule, A15."""
    m = stream(spark, sf_dir).groupBy("asset").agg(F.avg("sample").alias("m"))
    db = 20 * F.log10(F.greatest(F.abs("m"), F.lit(1e-15)))
    return m.select("asset", rounded(F.col("m")).alias("dc"), rounded(db).alias("dc_dbfs"), (db >= -40).alias("failed"))


@query(f"WITH {STREAM_SQL} SELECT asset, round(10 * log10(greatest(avg(energy), 1e-30)), 6) AS level FROM f GROUP BY asset HAVING 10 * log10(greatest(avg(energy), 1e-30)) < -1.8")
def low_level(spark, sf_dir):
    """0077B, A15: channels whose RMS stays under a limit."""
    m = stream(spark, sf_dir).groupBy("asset").agg(F.avg("energy").alias("e")).withColumn("db", power_db(F.col("e")))
    return m.where("db < -1.8").select("asset", rounded(F.col("db")).alias("level"))


@query(f"WITH {PAIR_SQL} SELECT pair, round(list_max(list_transform(range(1, len(l) + 1), lambda i: abs(l[i] - r[i]))), 6) AS difference FROM p")
def mono_difference(spark, sf_dir):
    """0124B, A15: largest left-right difference."""
    return pairs(spark, sf_dir).select("pair", rounded(F.array_max(F.zip_with("l", "r", lambda a, b: F.abs(a - b)))).alias("difference"))


WINDOW_SQL = PAIR_SQL + """, w AS (SELECT pair, k AS win, l[k * 8 + 1:k * 8 + 8] AS l, r[k * 8 + 1:k * 8 + 8] AS r FROM p, range(8) x(k) WHERE len(l) = 64),
a AS (SELECT pair, win, list_sum(list_transform(range(1, 9), lambda i: l[i] * r[i])) AS lr, list_sum(list_transform(range(1, 9), lambda i: l[i] * l[i])) AS ll, list_sum(list_transform(range(1, 9), lambda i: r[i] * r[i])) AS rr FROM w)"""


def pair_windows(spark, sf_dir):
    p = pairs(spark, sf_dir).where(F.size("l") == 64).select("pair", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("win"), "l", "r")
    p = p.select("pair", "win", F.slice("l", F.col("win") * 8 + 1, 8).alias("l"), F.slice("r", F.col("win") * 8 + 1, 8).alias("r"))
    return p.select("pair", "win", dot("l", "r").alias("lr"), dot("l", "l").alias("ll"), dot("r", "r").alias("rr"))


@query(
    WINDOW_SQL.join(["WITH ", """, c AS (SELECT pair, win, CASE WHEN ll * rr > 0 THEN lr / sqrt(ll * rr) ELSE 0 END AS cor FROM a),
i AS (SELECT pair, win, cor, win - row_number() OVER (PARTITION BY pair ORDER BY win) AS run FROM c WHERE cor <= -0.5)
SELECT pair, min(win) AS first_window, count(*) AS windows, round(min(cor), 6) AS correlation FROM i GROUP BY pair, run"""])
)
def phase_reversal(spark, sf_dir):
    """0012B, A12, W6: runs of windows whose channels are in opposite phase."""
    c = pair_windows(spark, sf_dir).withColumn("cor", F.when(F.col("ll") * F.col("rr") > 0, F.col("lr") / F.sqrt(F.col("ll") * F.col("rr"))).otherwise(0.0))
    found = sequence.runs(c, ["pair"], "win", F.col("cor") <= -0.5, 1, F.min("cor").alias("cor"))
    return found.select("pair", F.col("start_frame").cast("long").alias("first_window"), F.col("length").alias("windows"), rounded(F.col("cor")).alias("correlation"))


BALANCE_SQL = WINDOW_SQL + ", c AS (SELECT pair, win, lr, ll, rr, 10 * log10(greatest(greatest(ll, rr) / 8, 1e-30)) AS loud, abs(10 * log10(greatest(ll / 8, 1e-30)) - 10 * log10(greatest(rr / 8, 1e-30))) AS imbalance FROM a)"


def balance(spark, sf_dir):
    level = lambda c: power_db(F.col(c) / 8)
    return pair_windows(spark, sf_dir).withColumns({"loud": F.greatest(level("ll"), level("rr")), "imbalance": F.abs(level("ll") - level("rr"))})


@query(f"WITH {BALANCE_SQL}, i AS (SELECT *, win - row_number() OVER (PARTITION BY pair ORDER BY win) AS run FROM c WHERE loud >= -35 AND imbalance >= 4) SELECT pair, min(win) AS first_window, count(*) AS windows, round(max(imbalance), 6) AS imbalance FROM i GROUP BY pair, run HAVING count(*) >= 2")
def panning(spark, sf_dir):
    """0230B, W6: runs of windows with one channel much louder."""
    found = sequence.runs(balance(spark, sf_dir), ["pair"], "win", (F.col("loud") >= -35) & (F.col("imbalance") >= 4), 2, F.max("imbalance").alias("imbalance"))
    return found.select("pair", F.col("start_frame").cast("long").alias("first_window"), F.col("length").alias("windows"), rounded(F.col("imbalance")).alias("imbalance"))


@query(f"WITH {BALANCE_SQL} SELECT pair, count(*) AS windows, round(max(abs(lr) / sqrt(ll * rr)), 6) AS coherence FROM c WHERE ll * rr > 0 AND imbalance >= 3 AND abs(lr) / sqrt(ll * rr) >= 0.5 GROUP BY pair")
def crosstalk(spark, sf_dir):
    """0170B, J6: windows where the quieter channel follows the louder one."""
    c = balance(spark, sf_dir).where(F.col("ll") * F.col("rr") > 0).withColumn("coherence", F.abs("lr") / F.sqrt(F.col("ll") * F.col("rr")))
    return c.where("imbalance >= 3 AND coherence >= 0.5").groupBy("pair").agg(F.count("*").alias("windows"), rounded(F.max("coherence")).alias("coherence"))


@query(
    f"""WITH {PAIR_SQL}, g AS (SELECT pair, l, r, k - 8 AS lag FROM p, range(17) x(k) WHERE len(l) = 64),
c AS (SELECT pair, lag, list_sum(list_transform(range(9, 57), lambda i: l[i] * r[i + lag])) AS lr, list_sum(list_transform(range(9, 57), lambda i: l[i] * l[i])) AS ll, list_sum(list_transform(range(9, 57), lambda i: r[i + lag] * r[i + lag])) AS rr FROM g),
d AS (SELECT pair, lag, CASE WHEN ll * rr > 0 THEN round(abs(lr) / sqrt(ll * rr), 9) ELSE 0 END AS cosine FROM c)
SELECT pair, lag, round(cosine, 6) AS cosine FROM d QUALIFY row_number() OVER (PARTITION BY pair ORDER BY cosine DESC, lag DESC) = 1"""
)
def interchannel_delay(spark, sf_dir):
    """Inter-channel delay, J9: the lag of the largest cosine; the last of equal ones."""
    g = pairs(spark, sf_dir).where(F.size("l") == 64).select("pair", "l", "r", F.explode(F.sequence(F.lit(-8), F.lit(8))).alias("lag"))
    g = g.select("pair", "lag", F.slice("l", 9, 48).alias("x"), F.slice("r", F.col("lag") + 9, 48).alias("y"))
    c = g.select("pair", "lag", dot("x", "y").alias("xy"), dot("x", "x").alias("xx"), dot("y", "y").alias("yy"))
    cosine = F.when(F.col("xx") * F.col("yy") > 0, F.round(F.abs("xy") / F.sqrt(F.col("xx") * F.col("yy")), 9)).otherwise(0.0)
    best = c.select("pair", "lag", cosine.alias("cosine")).groupBy("pair").agg(F.max(F.struct("cosine", "lag")).alias("b"))
    return best.select("pair", F.col("b.lag").cast("long").alias("lag"), rounded(F.col("b.cosine")).alias("cosine"))


@query(
    f"""WITH {PAIR_SQL}, e AS (SELECT pair, unnest(l) AS x, unnest(r) AS y FROM p)
SELECT pair, round(CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) WHEN var_pop(x) = 0 AND var_pop(y) = 0 THEN 1 ELSE 0 END, 6) AS correlation FROM e GROUP BY pair"""
)
def centred_correlation(spark, sf_dir):
    """Centred correlation with rules for constant channels."""
    e = pairs(spark, sf_dir).select("pair", F.explode(F.arrays_zip("l", "r")).alias("z")).select("pair", "z.l", "z.r")
    s = e.groupBy("pair").agg(F.var_pop("l").alias("a"), F.var_pop("r").alias("b"), F.covar_pop("l", "r").alias("c"))
    value = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / F.sqrt(F.col("a") * F.col("b"))).when((F.col("a") == 0) & (F.col("b") == 0), 1.0).otherwise(0.0)
    return s.select("pair", rounded(value).alias("correlation"))


@query(
    f"""WITH {PAIR_SQL}, e AS (SELECT pair, unnest(l) AS x, unnest(r) AS y FROM p), s AS (SELECT pair, avg(x * x) AS ref, avg((x - y) * (x - y)) AS res, count(*) FILTER (x = y) / count(*) AS exact FROM e GROUP BY pair)
SELECT pair, round(sqrt(res), 6) AS residual_rms, round(CASE WHEN res <= 1e-30 THEN 300 ELSE 10 * log10(greatest(ref, 1e-30) / res) END, 6) AS null_depth_db, round(exact, 6) AS exact_ratio FROM s"""
)
def residual_null_depth(spark, sf_dir):
    """Residual, null depth and share of equal samples."""
    e = pairs(spark, sf_dir).select("pair", F.explode(F.arrays_zip("l", "r")).alias("z")).select("pair", F.col("z.l").alias("x"), F.col("z.r").alias("y"))
    d = F.col("x") - F.col("y")
    s = e.groupBy("pair").agg(F.avg(F.col("x") * F.col("x")).alias("ref"), F.avg(d * d).alias("res"), (F.count_if(F.col("x") == F.col("y")) / F.count("*")).alias("exact"))
    depth = F.when(F.col("res") <= 1e-30, 300.0).otherwise(10 * F.log10(F.greatest("ref", F.lit(1e-30)) / F.greatest("res", F.lit(1e-30))))
    return s.select("pair", rounded(F.sqrt("res")).alias("residual_rms"), rounded(depth).alias("null_depth_db"), rounded(F.col("exact")).alias("exact_ratio"))


@query(
    f"""WITH RECURSIVE {STREAM_SQL}, o AS (SELECT asset, frame, (sample + 1) / 2 AS score FROM f),
h AS (SELECT asset, frame, score >= 0.7 AS on_, false AS grace FROM o WHERE frame = 0
  UNION ALL SELECT o.asset, o.frame, CASE WHEN h.on_ THEN score >= 0.58 OR NOT h.grace ELSE score >= 0.7 END, h.on_ AND score < 0.58 AND NOT h.grace
  FROM h JOIN o ON o.asset = h.asset AND o.frame = h.frame + 1),
i AS (SELECT asset, frame, frame - row_number() OVER (PARTITION BY asset ORDER BY frame) AS run FROM h WHERE on_)
SELECT asset, min(frame) AS start_frame, max(frame) + 1 AS end_frame, count(*) AS length FROM i GROUP BY asset, run"""
)
def hysteresis_ranges(spark, sf_dir):
    """Ranges of a score that enters at 0.7, stays at 0.58 and forgives one low frame."""
    scored = stream(spark, sf_dir).select("asset", "frame", ((F.col("sample") + 1) / 2).alias("score"))
    state = sequence.hysteresis(scored, ["asset"], "frame", "score", 0.7, 0.12)
    return sequence.runs(state, ["asset"], "frame", F.col("active"), 1)


@query(f"WITH {STREAM_SQL} SELECT le, count(*) FILTER (le IS NULL OR abs(sample) <= le) AS n FROM f, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (1.0), (NULL)) b(le) GROUP BY le")
def latency_histogram(spark, sf_dir):
    """Cumulative buckets in one pass."""
    rows = stream(spark, sf_dir).select(F.abs("sample").alias("x"))
    return sequence.histogram(rows, "x", [0.1, 0.25, 0.5, 0.75, 1.0])


@query(
    f"WITH {CLICK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY frame) AS k, count(*) OVER (PARTITION BY asset) AS n FROM c) SELECT asset, frame, CAST(k AS INT) AS rank_no, n > 5 AS truncated FROM r WHERE k <= 5"
)
def top_findings_capped(spark, sf_dir):
    """O1, O2: the first five findings of an asset, and whether there were more."""
    found = sequence.capped(clicks(spark, sf_dir), ["asset"], ["frame"], 5)
    return found.select("asset", "frame", F.col("rank_no").cast("int").alias("rank_no"), "truncated")
