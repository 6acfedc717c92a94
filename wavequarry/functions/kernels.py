"""Signal kernels: filter designs and numpy loops, pure functions without Spark."""

from __future__ import annotations

import math

import numpy as np


def k_coefficients(fs: float) -> list[tuple]:
    """(b0, b1, b2, a1, a2) of the two K-weighting stages. Fixed values of ITU-R BS.1770's analogue prototypes."""
    f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, vh = math.tan(math.pi * f0 / fs), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
    f0, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f0 / fs)
    a0 = 1 + k / q + k * k
    return [shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)]


def biquad(x: np.ndarray, c: tuple, state: tuple[float, float] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """Transposed direct form II, the literal recurrence."""
    b0, b1, b2, a1, a2 = c
    z1, z2 = state
    out = np.empty(len(x))
    for i, u in enumerate(x.tolist()):
        y = b0 * u + z1
        z1, z2 = b1 * u - a1 * y + z2, b2 * u - a2 * y
        out[i] = y
    return out, (z1, z2)


def state_space(c: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    b0, b1, b2, a1, a2 = c
    return np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0


class KWeighting:
    """F1 as one four-state linear system, filtered block by block.

    Within a block the output is a Toeplitz product plus what the incoming state adds; between
    blocks only four numbers pass, so chunks can be filtered on their own from their start state.
    """

    def __init__(self, fs: float, block: int = 256) -> None:
        (a1, b1, c1, d1), (a2, b2, c2, d2) = map(state_space, k_coefficients(fs))
        self.a = np.block([[a1, np.zeros((2, 2))], [np.outer(b2, c1), a2]])
        self.b = np.concatenate([b1, b2 * d1])
        self.c = np.concatenate([d2 * c1, c2])
        self.d, self.block = d2 * d1, block
        powers = [np.eye(4)]
        for _ in range(block):
            powers.append(powers[-1] @ self.a)
        self.powers = powers
        impulse = np.array([self.d, *[self.c @ p @ self.b for p in powers[: block - 1]]])
        i = np.arange(block)
        self.toeplitz = np.where(i[:, None] >= i, impulse[np.abs(i[:, None] - i)], 0.0)
        self.observe = np.array([self.c @ p for p in powers[:block]])
        self.drive = np.array([p @ self.b for p in powers[:block]])[::-1]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        state = np.zeros(4) if state is None else state
        x = np.asarray(x, np.float64)
        out = np.empty(len(x))
        for s in range(0, len(x), self.block):
            u = x[s : s + self.block]
            n = len(u)
            out[s : s + n] = self.toeplitz[:n, :n] @ u + self.observe[:n] @ state
            state = self.powers[n] @ state + self.drive[self.block - n :].T @ u
        return out, state

    def end_state(self, x: np.ndarray) -> np.ndarray:
        """State after x from rest: what a chunk adds to the state that enters it."""
        state = np.zeros(4)
        for s in range(0, len(x), self.block):
            u = x[s : s + self.block]
            state = self.powers[len(u)] @ state + self.drive[self.block - len(u) :].T @ u
        return state

    def advance(self, state: np.ndarray, n: int) -> np.ndarray:
        """State after n silent samples."""
        return np.linalg.matrix_power(self.a, n) @ state


def impulse_response(fs: float, n: int) -> list[float]:
    x = np.zeros(n)
    x[0] = 1.0
    for c in k_coefficients(fs):
        x, _ = biquad(x, c)
    return x.tolist()


def bessel_i0(x: float) -> float:
    total = term = 1.0
    for k in range(1, 60):
        term *= (x / (2 * k)) ** 2
        total += term
    return total


_TAPS: dict = {}


def true_peak_taps(taps: int = 64, factor: int = 4, beta: float = 8.5, cutoff: float = 0.125) -> np.ndarray:
    """Kaiser-windowed sinc whose sum is `factor`."""
    if (taps, factor, beta, cutoff) in _TAPS:
        return _TAPS[taps, factor, beta, cutoff]
    m = taps - 1
    n = np.arange(taps) - m / 2
    window = np.array([bessel_i0(beta * math.sqrt(max(0.0, 1 - (2 * i / m - 1) ** 2))) for i in range(taps)]) / bessel_i0(beta)
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * window
    _TAPS[taps, factor, beta, cutoff] = h = h * (factor / h.sum())
    return h


def true_peak(x: np.ndarray, history: np.ndarray | None = None) -> float:
    """largest of the samples and the four interpolated phases; history: the 15 samples before x, or else its first one repeated."""
    if not len(x):
        return 0.0
    phases = true_peak_taps().reshape(-1, 4)  # row k, column p: h[p + 4k]
    reach = len(phases) - 1
    padded = np.concatenate([np.full(reach, x[0]) if history is None else history, x])
    return max(float(np.abs(x).max()), *(float(np.abs(np.convolve(padded, phases[:, p], "valid")).max()) for p in range(4)))


def limiter(x: np.ndarray, fs: float, ceiling: float, lookahead_ms: float = 5.0, release_ms: float = 50.0) -> np.ndarray:
    """linked look-ahead limiter over channels x frames: instant attack, hold for the look-ahead, exponential release."""
    ahead = max(16, math.ceil(fs * lookahead_ms / 1000))
    keep = math.exp(-1 / max(1.0, fs * release_ms / 1000))
    level = np.abs(x).max(axis=0)
    padded = np.concatenate([level, np.full(ahead, level[-1] if len(level) else 0.0)])
    gain, hold, out = 1.0, 0, np.empty(x.shape[1])
    for i in range(x.shape[1]):
        detected = padded[i + ahead]
        want = min(1.0, ceiling / detected * 0.9999) if detected > ceiling else 1.0
        if want < gain:
            gain, hold = want, ahead
        elif hold:
            hold -= 1
        else:
            gain = min(1.0, 1 - (1 - gain) * keep)
        out[i] = min(gain, ceiling / level[i] if level[i] > ceiling else gain)
    return x * out


def resample(x: np.ndarray, source: int, target: int, half: int = 32) -> np.ndarray:
    """windowed-sinc conversion to round(n * target / source) samples."""
    n = int(round(len(x) * target / source))
    scale = min(1.0, target / source)
    at = np.arange(n) * (source / target)
    base = np.floor(at).astype(int)
    width = int(math.ceil(half / scale))
    offsets = np.arange(-width + 1, width + 1)
    out = np.zeros(n)
    for o in offsets:
        i = base + o
        t = (at - i) * scale
        w = np.where(np.abs(t) < half, np.cos(np.pi * t / (2 * half)) ** 2, 0.0)
        out += np.where((i >= 0) & (i < len(x)), x[np.clip(i, 0, max(0, len(x) - 1))], 0.0) * np.sinc(t) * w * scale
    return out


def band_amplitudes(x: np.ndarray, fs: int, bands: np.ndarray) -> np.ndarray:
    """amplitude over the window's sum at each frequency, under a Hann window."""
    n = np.arange(len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / max(1, len(x) - 1))
    return np.abs(np.exp(-2j * np.pi * np.outer(bands / fs, n)) @ (x * window)) / max(float(window.sum()), 1e-30)


def spectral_error(reference: np.ndarray, candidate: np.ndarray, fs: int, windows: int = 8, length: int = 4096) -> float:
    """Root mean square of level differences in dB, over third octaves from 31.5 Hz in evenly spread windows; bands that are silent in both don't count."""
    n = min(len(reference), len(candidate))
    if n < 32:
        return 0.0
    length = min(length, n)
    count = min(windows, -(-n // length))
    bands = 31.5 * 2.0 ** (np.arange(64) / 3)
    bands = bands[bands < 0.49 * fs]
    starts = [(n - length) * k // (count - 1) for k in range(count)] if count > 1 else [(n - length) // 2]
    a, b = (np.concatenate([band_amplitudes(x[s : s + length], fs, bands) for s in starts]) for x in (reference, candidate))
    heard = np.maximum(a, b) >= 1e-8
    if not heard.any():
        return 0.0
    difference = 20 * np.log10(np.maximum(b[heard], 1e-15)) - 20 * np.log10(np.maximum(a[heard], 1e-15))
    return min(300.0, math.sqrt(float(np.square(difference).mean())))


def assign_channels(weight: np.ndarray) -> list[int]:
    """Hungarian assignment of largest total weight; column of each row."""
    n = len(weight)
    cost = weight.max(initial=0.0) - weight
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    d = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if d < least[j]:
                        least[j], way[j] = d, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out
