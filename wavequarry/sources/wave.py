"""PCM in WAVE, RF64 and BW64: header probe, decoding, a ranged data source and a writer."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Sample kinds: bytes, full scale, numpy type.
KINDS = {"u8": (1, 128.0, "u1"), "s16": (2, 32768.0, "<i2"), "s24": (3, 8388608.0, None), "s32": (4, 2147483648.0, "<i4"), "f32": (4, 1.0, "<f4"), "f64": (8, 1.0, "<f8")}
NONE = 0xFFFFFFFF
#: Bits of the WAVE channel mask in order, as (role, azimuth, elevation). Fixed values of the format.
MASK_ROLES = [
    ("main", 30, 0), ("main", -30, 0), ("main", 0, 0), ("lfe", 0, -30), ("surround", 110, 0), ("surround", -110, 0), ("positioned", 15, 0), ("positioned", -15, 0),
    ("positioned", 180, 0), ("positioned", 90, 0), ("positioned", -90, 0), ("positioned", 0, 90), ("positioned", 45, 45), ("positioned", 0, 45), ("positioned", -45, 45),
    ("positioned", 135, 45), ("positioned", 180, 45), ("positioned", -135, 45),
]


class WaveError(ValueError):
    pass


def probe(head: bytes, size: int | None = None) -> dict:
    """S3: header fields from the file's beginning, which must reach its data chunk. size: the file's length, if known."""
    if head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:12] != b"WAVE":
        raise WaveError("not a WAVE file")
    at, out, long_data = 12, {"container": head[:4].decode().lower()}, None
    while at + 8 <= len(head):
        name, n = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"ds64":
            long_data = struct.unpack_from("<Q", head, at + 16)[0]
        elif name == b"fmt ":
            if n < 16 or at + 8 + n > len(head):
                raise WaveError("short fmt chunk")
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            mask = 0
            if tag == 0xFFFE and n >= 40:
                mask, tag = struct.unpack_from("<I", head, at + 28)[0], struct.unpack_from("<H", head, at + 32)[0]
            kind = {(1, 8): "u8", (1, 16): "s16", (1, 24): "s24", (1, 32): "s32", (3, 32): "f32", (3, 64): "f64"}.get((tag, bits))
            if kind is None or not channels or not rate or align != channels * KINDS[kind][0]:
                raise WaveError(f"unsupported format {tag}/{bits}")
            out |= {"kind": kind, "sample_rate": rate, "channels": channels, "mask": mask}
        elif name == b"data":
            if "kind" not in out:
                raise WaveError("data before fmt")
            n = long_data if n == NONE and long_data is not None else n
            n = min(n, size - at - 8) if size is not None else n
            width = KINDS[out["kind"]][0] * out["channels"]
            return out | {"data_offset": at + 8, "frames": n // width, "frame_bytes": width}
        at += 8 + n + n % 2
    raise WaveError("no data chunk")


def roles(channels: int, mask: int = 0) -> list[dict]:
    """Roles by mask, or by the channel count's default layout; more than six channels without a mask are ambiguous."""
    from ..functions.dims import LAYOUTS

    found = [MASK_ROLES[i] for i in range(len(MASK_ROLES)) if mask >> i & 1]
    if len(found) != channels:
        name = {1: "mono", 2: "stereo", 6: "5.1"}.get(channels)
        found = [x[1:] for x in LAYOUTS[name]] if name else [("main", 0, 0)] * channels
    return [{"role": r, "azimuth": a, "elevation": e} for r, a, e in found]


def decode(data: bytes, kind: str, channels: int) -> np.ndarray:
    """Interleaved bytes to channels x frames of float32; a trailing partial frame is dropped."""
    width, scale, dtype = KINDS[kind]
    n = len(data) // (width * channels) * channels
    if kind == "s24":
        raw = np.zeros((n, 4), np.uint8)
        raw[:, 1:] = np.frombuffer(data, np.uint8, n * 3).reshape(-1, 3)
        x = (raw.view("<i4").ravel() >> 8).astype(np.float32) / np.float32(scale)
    else:
        x = np.frombuffer(data, dtype, n).astype(np.float32 if kind != "s32" else np.float64)
        x = ((x - 128) / 128 if kind == "u8" else x / scale).astype(np.float32)
    return x.reshape(-1, channels).T


def encode(x: np.ndarray, kind: str, dither: bool = False) -> bytes:
    """K9: channels x frames to interleaved bytes; integer kinds are rounded and clipped, with TPDF dither on request."""
    width, scale, dtype = KINDS[kind]
    y = np.asarray(x, np.float64)
    if kind in ("f32", "f64"):
        return y.T.astype(dtype).tobytes()
    y = y * scale
    if dither:
        noise = np.random.default_rng(0x9E3779B9).random((2, *y.shape))
        y = y + noise[0] - noise[1]
    y = np.clip(np.round(y), -scale, scale - 1).T
    if kind == "u8":
        return (y + 128).astype(np.uint8).tobytes()
    if kind == "s24":
        return np.ascontiguousarray(y).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return y.astype(dtype).tobytes()


def wave_bytes(x: np.ndarray, rate: int, kind: str = "s16", dither: bool = False) -> bytes:
    """A whole WAVE file."""
    data, width = encode(x, kind, dither), KINDS[kind][0]
    channels = len(x)
    fmt = struct.pack("<HHIIHH", 3 if kind[0] == "f" else 1, channels, rate, rate * channels * width, channels * width, width * 8)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class FrameRange(InputPartition):
    def __init__(self, path: str, asset: str, info: dict, start: int, stop: int) -> None:
        self.path, self.asset, self.info, self.start, self.stop = path, asset, info, start, stop


class WaveReader(DataSourceReader):
    """Partitions are frame ranges, so that a long file is read by many tasks, each seeking to its own."""

    def __init__(self, options) -> None:
        self.paths, self.chunk = options["path"].split(","), int(options.get("chunkframes", "480000"))
        self.per_partition = int(options.get("chunksperpartition", "16"))
        self.limit = int(options.get("maxsamples", "0"))

    @staticmethod
    def open(path: str):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return system, inner

    def files(self):
        from pyarrow import fs

        for path in self.paths:
            system, inner = self.open(path)
            info = system.get_file_info(inner)
            for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]:
                if f.type == fs.FileType.File and f.extension.lower() in ("wav", "wave", "bwf", "rf64", "bw64"):
                    yield system, f

    def partitions(self):
        out = []
        for system, f in self.files():
            with system.open_input_file(f.path) as file:
                info = probe(file.read(min(f.size, 1 << 20)), f.size)
            if self.limit and info["frames"] * info["channels"] > self.limit:
                raise WaveError(f"{f.path} has more than {self.limit} samples")
            step = self.chunk * self.per_partition
            for start in range(0, info["frames"], step):
                out.append(FrameRange(f.path, f.path, info, start, min(info["frames"], start + step)))
        return out

    def read(self, partition):
        system, inner = self.open(partition.path)
        info, width = partition.info, partition.info["frame_bytes"]
        with system.open_input_file(inner) as file:
            for start in range(partition.start, partition.stop, self.chunk):
                n = min(self.chunk, partition.stop - start)
                file.seek(info["data_offset"] + start * width)
                for c, x in enumerate(decode(file.read(n * width), info["kind"], info["channels"])):
                    yield partition.asset, info["sample_rate"], info["channels"], c, start // self.chunk, start, x.tolist()


class PcmWave(DataSource):
    """spark.read.format("pcm_wave").load(path): one row per channel and chunk."""

    @classmethod
    def name(cls) -> str:
        return "pcm_wave"

    def schema(self) -> str:
        return "asset_id string, sample_rate int, channels int, channel int, chunk_no int, frame_start long, samples array<float>"

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PcmWave)
