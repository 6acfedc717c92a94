"""Signal-health rules: each constructed fault is found by its own rule, clean signals by none."""

import math

import numpy as np
import pytest

from wavequarry.operators import health

FS = 48000
N = 2 * FS
T = np.arange(N) / FS


def tone(f, amp=0.2):
    return amp * np.sin(2 * math.pi * f * T)


def noise(amp, seed=1):
    return amp * (2 * np.random.default_rng(seed).random(N) - 1)


def music(seed):
    return sum(0.04 * np.sin(2 * math.pi * f * T + p) * (0.6 + 0.4 * np.sin(2 * math.pi * r * T)) for f, p, r in zip((220, 277, 331, 415, 554, 659), range(6), (0.7, 1.1, 1.3, 0.9, 1.7, 0.5), strict=True)) + noise(0.002, seed)


def stepped(at, size):
    x = music(3).copy()
    x[at] += size
    return x


def chunks(spark, channels, step=FS):
    rows = [("a", FS, len(channels), c, i // step, i, x[i : i + step].astype(np.float32).tolist()) for c, x in enumerate(channels) for i in range(0, N, step)]
    return spark.createDataFrame(rows, "asset_id string, sample_rate int, channels int, channel int, chunk_no int, frame_start long, samples array<float>")


def failed(spark, channels, **options):
    rows = health.report(chunks(spark, channels), health.Options(**options)).collect()
    assert [r.rule_id for r in sorted(rows, key=lambda r: r.position)] == health.RULES
    return {r.rule_id for r in rows if r.passed is False}


def silent_gap(start, stop):
    x = music(3).copy()
    x[start:stop] = 0
    return x


CASES = {
    "noise": ([noise(0.008)], {}, {"0086B"}),
    "cross-talk": ([music(1), 0.1 * music(1)], {}, {"0170B", "0230B"}),
    "panning": ([tone(440), tone(3000, 0.01)], {}, {"0230B"}),
    "mono": ([tone(440), tone(554.37)], {"expect_mono": True}, {"0124B"}),
    "dc": ([music(1) + 0.02], {}, {"AQ-DC-OFFSET"}),
    "test tone": ([tone(1000)], {}, {"0014B"}),
    "hum": ([0.1 * np.sin(2 * math.pi * 50 * T)], {}, {"0088B"}),
    "clipping": ([np.clip(tone(440, 3.0), -1, 1)], {}, {"0005B"}),
    "silence across chunks": ([silent_gap(20000, 75000)], {}, {"0078B"}),
    "dropout across chunks": ([silent_gap(47000, 49500)], {}, {"0008B"}),
    "phase": ([music(1), -music(1)], {}, {"0012B"}),
    "click at a chunk's first sample": ([stepped(48000, 0.7)], {}, {"0057B"}),
    "low level": ([tone(3000, 0.003)], {}, {"0077B"}),
    "clean": ([music(1), music(2)], {}, set()),
}


@pytest.mark.parametrize("name", CASES)
def test_only_the_target_rule_fails(spark, name):
    channels, options, want = CASES[name]
    assert failed(spark, channels, **options) == want


def test_stuck_and_delayed(spark):
    x = music(1).copy()
    x[46000:50000] = 0.1  # across the chunks' border
    assert "AQ-STUCK-SAMPLES" in failed(spark, [x])
    n = noise(0.3)
    assert "AQ-INTERCHANNEL-DELAY" in failed(spark, [n, np.roll(n, 6)])


def test_lfe_with_high_frequencies(spark):
    assert "0095B" in failed(spark, [music(1), tone(1000)], lfe_channels=(1,))
    assert "0095B" not in failed(spark, [music(1), tone(40)], lfe_channels=(1,))


def test_events_are_capped_and_say_so(spark):
    x = music(1).copy()
    x[1000:90000:2000] += 0.7
    rows = {r.rule_id: r for r in health.report(chunks(spark, [x]), cap=10).collect()}
    assert len(rows["0057B"].events) == 10 and rows["0057B"].events_truncated
    assert rows["0009F"].calculated is False and rows["0009F"].passed is None


def test_only_stereo_pairs_are_compared(spark):
    left, right, centre = music(1), music(2), -music(1)
    assert "0012B" not in failed(spark, [left, right, centre])
    five = [left, right, music(4), 0.1 * music(5), music(6), -music(6)]
    rows = {r.rule_id: r for r in health.report(chunks(spark, five)).collect()}
    assert [(e.channel, e.related) for e in rows["0012B"].events] == [(5, 6)]
    assert health.stereo_pairs(8) == [(0, 1), (4, 5), (6, 7)] and health.stereo_pairs(1) == [] and health.stereo_pairs(3) == [(0, 1)]


def test_cross_talk_needs_the_same_spectrum(spark):
    assert health.spectral_match(tone(500)[None], tone(500, 0.01)[None], FS)[0] == pytest.approx(1)
    assert health.spectral_match(tone(500)[None], tone(4000, 0.01)[None], FS)[0] == pytest.approx(0, abs=1e-6)


def test_features_do_not_depend_on_chunks(spark):
    x = [noise(0.008), tone(60) + noise(0.001, 4)]
    options = health.Options(lfe_channels=(1,), lfe_ratio=0.0)
    of = lambda step: sorted((r.rule_id, r.passed, *[(e.channel, round(e.start_seconds, 6), round(e.end_seconds, 6), round(e.measured, 5)) for e in r.events]) for r in health.report(chunks(spark, x, step), options).collect() if r.calculated)
    assert of(N) == of(FS) and {r[0] for r in of(FS) if not r[1]} >= {"0086B", "0095B"}
