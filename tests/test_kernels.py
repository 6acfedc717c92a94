"""Signal kernels against closed forms and literal recurrences."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavequarry.functions import kernels


def tone(f, amp, fs, n):
    return amp * np.sin(2 * math.pi * f * np.arange(n) / fs)


def test_published_coefficients_at_48k():
    shelf, high = kernels.k_coefficients(48000)
    assert np.allclose(shelf, [1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585], atol=1e-9)
    assert np.allclose(high, [1, -2, 1, -1.99004745483398, 0.99007225036621], atol=1e-9)


def literal(x, fs):
    for c in kernels.k_coefficients(fs):
        x, _ = kernels.biquad(x, c)
    return x


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=6), st.sampled_from([16, 256]))
def test_state_space_equals_the_recurrence_however_it_is_cut(cuts, block):
    x = np.random.default_rng(sum(cuts)).normal(size=sum(cuts)) * 0.1
    k, state, parts = kernels.KWeighting(48000, block), None, []
    for piece in np.split(x, np.cumsum(cuts)[:-1]):
        y, state = k.run(piece, state)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), literal(x, 48000), atol=1e-9)


def test_chunk_states_add_up():
    x = np.random.default_rng(1).normal(size=3000)
    k = kernels.KWeighting(48000)
    a, b = x[:1300], x[1300:]
    _, end = k.run(x)
    assert np.allclose(k.advance(k.end_state(a), len(b)) + k.end_state(b), end)


def test_true_peak_finds_the_peak_between_samples():
    fs = 48000
    x = np.sin(2 * math.pi * fs / 4 * np.arange(4800) / fs + math.pi / 4) * 0.5
    assert np.abs(x).max() == pytest.approx(0.5 / math.sqrt(2), abs=1e-6)
    assert kernels.true_peak(x[200:]) == pytest.approx(0.5, rel=0.02)


def test_true_peak_of_a_constant_has_no_onset():
    assert kernels.true_peak(np.full(1000, 0.25)) == pytest.approx(0.25, rel=1e-3)


def test_limiter_holds_the_ceiling_and_leaves_quiet_signals_alone():
    loud, quiet = tone(500, 0.9, 48000, 9600), tone(500, 0.2, 48000, 9600)
    out = kernels.limiter(np.stack([loud, quiet]), 48000, 0.5)
    assert np.abs(out).max() <= 0.5
    assert np.allclose(kernels.limiter(np.stack([quiet, quiet]), 48000, 0.5), np.stack([quiet, quiet]))


@pytest.mark.parametrize(("source", "target"), [(48000, 44100), (44100, 48000), (48000, 16000)])
def test_resample_keeps_length_level_and_delay(source, target):
    x = tone(997, 0.5, source, source)
    y = kernels.resample(x, source, target)
    assert len(y) == round(len(x) * target / source)
    middle = slice(len(y) // 4, 3 * len(y) // 4)
    assert np.abs(y - tone(997, 0.5, target, len(y)))[middle].max() < 2e-3


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_the_best_of_all(n, seed):
    from itertools import permutations

    w = np.random.default_rng(seed).random((n, n))
    found = kernels.assign_channels(w)
    assert sorted(found) == list(range(n))
    assert sum(w[i, j] for i, j in enumerate(found)) == pytest.approx(max(sum(w[i, p[i]] for i in range(n)) for p in permutations(range(n))))
