"""One-bit files made by a sigma-delta loop."""

import math
import struct

import numpy as np
import pytest

from wavequarry.sources import dsd

RATE = 2_822_400


def dsf(channels):
    n = len(channels[0])
    pads = [np.concatenate([c, np.zeros(-n % (4096 * 8), np.uint8)]) for c in channels]
    blocks = np.stack([np.packbits(p, bitorder="little").reshape(-1, 4096) for p in pads], axis=1).tobytes()
    fmt = b"fmt " + struct.pack("<QIIIIIIQII", 52, 1, 0, 2, len(channels), RATE, 1, n, 4096, 0)
    data = b"data" + struct.pack("<Q", 12 + len(blocks)) + blocks
    return b"DSD " + struct.pack("<QQQ", 28, 28 + len(fmt) + len(data), 0) + fmt + data


def one_bit(x):
    a = b = 0.0
    out = np.empty(len(x), np.uint8)
    for i, v in enumerate(x.tolist()):  # second order
        y = 1.0 if b >= 0 else -1.0
        a += v - y
        b += a - 2 * y
        out[i] = y > 0
    return out


def test_a_tone_comes_back(spark, tmp_path):
    t = np.arange(RATE // 10) / RATE
    x = 0.3 * np.sin(2 * math.pi * 1000 * t)
    (tmp_path / "a.dsf").write_bytes(dsf([one_bit(x)] * 2))
    r = dsd.read_dsf(spark, str(tmp_path)).orderBy("channel").first()
    y = np.asarray(r.samples)
    assert r.sample_rate == 88_200 and len(y) == 8820
    want = 0.3 * np.sin(2 * math.pi * 1000 * np.arange(8820) / 88_200)
    assert np.abs(y - want)[200:-200].max() < 0.02


@pytest.mark.parametrize("cut", [0, 50, 91, 100])
def test_broken_files_are_refused(cut):
    with pytest.raises(dsd.DsdError):
        dsd.probe(dsf([np.zeros(4096 * 8, np.uint8)])[:cut])
