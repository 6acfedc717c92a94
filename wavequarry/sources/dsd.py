"""One-bit audio: DSF files to PCM chunks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.render import CHUNK

HALF_TAPS, FINAL_TAPS, FINAL_HZ = 31, 127, 21_000.0


class DsdError(ValueError):
    pass


def probe(data: bytes) -> dict:
    """Header of a DSF file; compressed forms and odd geometries are refused."""
    if data[:4] != b"DSD " or len(data) < 92 or data[28:32] != b"fmt " or data[80:84] != b"data":
        raise DsdError("not a DSF file")
    version, form, _, channels, rate, bits, samples, block = struct.unpack_from("<IIIIIIQI", data, 40)
    if version != 1 or form != 0 or bits not in (1, 8) or not 1 <= channels <= 6 or block != 4096 or rate % 44_100 or rate < 2_822_400:
        raise DsdError("unsupported DSF format")
    size = struct.unpack_from("<Q", data, 84)[0] - 12
    if 92 + size > len(data) or size * 8 < samples * channels:
        raise DsdError("the data chunk is short")
    return {"channels": channels, "rate": rate, "msb": bits == 8, "samples": samples, "block": block}


def windowed_sinc(taps: int, cutoff: float) -> np.ndarray:
    """Unit gain at 0 Hz; cutoff as a share of the sample rate."""
    n = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * np.blackman(taps)
    return h / h.sum()


def half(x: np.ndarray) -> np.ndarray:
    return np.convolve(x, windowed_sinc(HALF_TAPS, 0.25), "same")[::2]


def decode(data: bytes, target: int = 88_200) -> tuple[np.ndarray, int]:
    """Bits as +-1, halved until the target rate is reached, then low-passed to the audible band."""
    info = probe(data)
    body = np.frombuffer(data, np.uint8, offset=92)
    blocks = len(body) // (info["block"] * info["channels"])
    body = body[: blocks * info["block"] * info["channels"]].reshape(blocks, info["channels"], info["block"])
    out = []
    for c in range(info["channels"]):
        bits = np.unpackbits(body[:, c].ravel(), bitorder="big" if info["msb"] else "little")[: info["samples"]]
        x, rate = bits.astype(np.float64) * 2 - 1, info["rate"]
        while rate >= 2 * target:
            x, rate = half(x), rate // 2
        out.append(np.convolve(x, windowed_sinc(FINAL_TAPS, FINAL_HZ / rate), "same"))
    return np.stack(out), rate


def read_dsf(spark: SparkSession, path: str, chunk: int = 88_200) -> DataFrame:
    """Chunks of every DSF file under a path."""
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def parse(batches):
        for rows in batches:
            for p, content in zip(rows["path"], rows["content"], strict=True):
                x, rate = decode(bytes(content))
                yield pd.DataFrame([(p, rate, len(x), c, i // chunk, i, x[c, i : i + chunk].astype(np.float32).tolist()) for c in range(len(x)) for i in range(0, x.shape[1], chunk)], columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dsf").load(path).select("path", "content")
    return files.mapInPandas(parse, CHUNK)
