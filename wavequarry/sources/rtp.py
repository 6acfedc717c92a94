"""Packet captures and session descriptions."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_SCHEMA = "path string, capture_no long, arrival double, src string, dst string, sport int, dport int, payload_type int, marker boolean, seq int, rtp_ts long, ssrc long, payload binary"


def frames(data: bytes):
    """(arrival seconds, link frame) of classic and next-generation captures."""
    if data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        order = "<" if data[0] in (0xD4, 0x4D) else ">"
        scale = 1e9 if b"\x3c" in data[1:3] else 1e6
        at = 24
        while at + 16 <= len(data):
            sec, part, n, _ = struct.unpack_from(order + "IIII", data, at)
            if at + 16 + n > len(data):
                return
            yield sec + part / scale, data[at + 16 : at + 16 + n]
            at += 16 + n
    elif data[:4] == b"\x0a\x0d\x0d\x0a":
        order, at, scales = "<", 0, []
        while at + 12 <= len(data):
            if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
                order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                scales = []
            kind, n = struct.unpack_from(order + "II", data, at)
            if n < 12 or at + n > len(data):
                return
            if kind == 1:
                scale, p = 1e6, at + 16
                while p + 4 <= at + n - 4:
                    code, size = struct.unpack_from(order + "HH", data, p)
                    if code == 9 and size:
                        r = data[p + 4]
                        scale = float(2 ** (r & 0x7F)) if r & 0x80 else 10.0**r
                    if code == 0:
                        break
                    p += 4 + size + -size % 4
                scales.append(scale)
            elif kind == 6 and scales:
                port, hi, lo, size, _ = struct.unpack_from(order + "IIIII", data, at + 8)
                yield ((hi << 32) | lo) / scales[min(port, len(scales) - 1)], data[at + 28 : at + 28 + size]
            at += n


def udp(frame: bytes):
    """(src, dst, sport, dport, payload) of an Ethernet frame with UDP over IPv4 or IPv6, or None."""
    at, kind = 14, frame[12:14]
    while kind in (b"\x81\x00", b"\x88\xa8"):
        kind, at = frame[at + 2 : at + 4], at + 4
    if kind == b"\x08\x00" and len(frame) >= at + 20:
        head = (frame[at] & 15) * 4
        if frame[at + 9] != 17 or struct.unpack_from(">H", frame, at + 6)[0] & 0x3FFF:
            return None
        src, dst = (".".join(map(str, frame[at + i : at + i + 4])) for i in (12, 16))
        at += head
    elif kind == b"\x86\xdd" and len(frame) >= at + 40 and frame[at + 6] == 17:
        src, dst = (":".join(f"{x:x}" for x in struct.unpack_from(">8H", frame, at + i)) for i in (8, 24))
        at += 40
    else:
        return None
    if len(frame) < at + 8:
        return None
    sport, dport, n, _ = struct.unpack_from(">HHHH", frame, at)
    return src, dst, sport, dport, frame[at + 8 : at + n]


def rtp(payload: bytes):
    """(payload type, marker, sequence, timestamp, sender, samples), or None."""
    if len(payload) < 12 or payload[0] >> 6 != 2:
        return None
    head = 12 + 4 * (payload[0] & 15)
    if payload[0] & 0x10:
        if len(payload) < head + 4:
            return None
        head += 4 + 4 * struct.unpack_from(">H", payload, head + 2)[0]
    pad = payload[-1] if payload[0] & 0x20 else 0
    if head + pad > len(payload):
        return None
    seq, ts, ssrc = struct.unpack_from(">HII", payload, 2)
    return payload[1] & 0x7F, bool(payload[1] & 0x80), seq, ts, ssrc, payload[head : len(payload) - pad]


def packets_of(batches):
    names = [x.split()[0] for x in PACKET_SCHEMA.split(", ")]
    for rows in batches:
        for path, data in zip(rows["path"], rows["content"], strict=True):
            out = []
            for i, (arrival, frame) in enumerate(frames(bytes(data))):
                if (u := udp(frame)) and (r := rtp(u[4])):
                    out.append((path, i, arrival, *u[:4], *r))
            yield pd.DataFrame(out, columns=names)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Packets of every capture file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(packets_of, PACKET_SCHEMA)


def read_sdp(spark: SparkSession, path: str) -> DataFrame:
    """One row per session description: media, format, clock and timing fields by regular expression."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("t"))
    field = lambda pattern, i=1: F.nullif(F.regexp_extract("t", "(?m)" + pattern, i), F.lit(""))
    rtpmap = r"^a=rtpmap:(\d+) ([A-Za-z0-9]+)/(\d+)(?:/(\d+))?"
    return text.select(
        "path", field(r"^s=(.*)$").alias("session"), field(r"^m=audio (\d+)").cast("int").alias("port"), field(r"^c=IN IP[46] ([^\s/]+)").alias("address"), field(rtpmap).cast("int").alias("payload_type"),
        field(rtpmap, 2).alias("encoding"), field(rtpmap, 3).cast("int").alias("sample_rate"), F.coalesce(field(rtpmap, 4).cast("int"), F.lit(1)).alias("channels"), field(r"^a=ptime:([0-9.]+)").cast("double").alias("ptime_ms"),
        field(r"^a=ts-refclk:(\S+)").alias("refclk"), field(r"^a=mediaclk:(\S+)").alias("mediaclk"), field(r"^a=source-filter: incl IN IP[46] \S+ (\S+)").alias("source"), field(r"channel-order=([^\s;]+)").alias("channel_order"),
    )


def session_findings(sessions: DataFrame) -> DataFrame:
    """2.11: rule rows of AES67 / ST 2110-30 session descriptions; errors fail, warnings only count."""
    rule = lambda name, severity, ok: F.struct(F.lit(f"AQ-RTP-{name}").alias("rule_id"), F.lit(severity).alias("severity"), F.coalesce(ok, F.lit(False)).alias("passed"))
    count = F.aggregate(
        F.split(F.regexp_extract("channel_order", r"^SMPTE2110\.\(([^)]*)\)", 1), ","), F.lit(0),
        lambda a, g: a + F.when(g.isin("M"), 1).when(g.isin("DM", "ST", "LtRt"), 2).when(g == "51", 6).when(g == "71", 8).when(g == "222", 24).when(g == "SGRP", 4).when(g.rlike(r"^U\d\d$"), F.substring(g, 2, 2).cast("int")).otherwise(0),
    )
    rules = F.array(
        rule("ENCODING", "error", F.col("encoding").isin("L16", "L24")),
        rule("PAYLOAD-TYPE", "error", F.col("payload_type").between(96, 127)),
        rule("SAMPLE-RATE", "error", F.col("sample_rate").isin(44100, 48000, 96000)),
        rule("CHANNELS", "error", F.col("channels").between(1, 64)),
        rule("REFERENCE-CLOCK", "error", F.col("refclk").rlike("^(ptp=IEEE1588-2008|localmac=)")),
        rule("MEDIA-CLOCK", "error", F.col("mediaclk").rlike("^(direct=|sender)")),
        rule("CHANNEL-ORDER-PRESENT", "warning", F.col("channel_order").isNotNull()),
        rule("CHANNEL-ORDER", "error", F.col("channel_order").isNull() | (count == F.col("channels"))),
    )
    return sessions.select("path", F.explode(rules).alias("r")).select("path", "r.*")


def continuity_of(rows: pd.DataFrame) -> pd.DataFrame:
    """W13 exactly: reordered packets do not advance the state, duplicates are skipped."""
    rows = rows.sort_values(["arrival", "capture_no"])
    seen, last, expected = set(), None, None
    gaps = lost = reordered = duplicates = wrong_time = 0
    for r in rows.itertuples(index=False):
        key = (r.seq, r.rtp_ts)
        if key in seen:
            duplicates += 1
            continue
        seen.add(key)
        if last is not None:
            delta = (r.seq - last) % 65536
            if delta == 1:
                wrong_time += expected is not None and (r.rtp_ts - last_ts) % 2**32 != expected
            elif 0 < delta < 0x8000:
                gaps, lost = gaps + 1, lost + delta - 1
            else:
                reordered += 1
                continue
        if r.samples > 0:
            last, last_ts, expected = r.seq, r.rtp_ts, r.samples
    return pd.DataFrame([(rows["ssrc"].iloc[0], len(rows), gaps, lost, reordered, duplicates, wrong_time)], columns=["ssrc", "packets", "gaps", "lost", "reordered", "duplicates", "timestamp_errors"])


def continuity(packets: DataFrame) -> DataFrame:
    """Per sender: gaps, losses, reorders, duplicates and timestamp errors. packets: ssrc, capture_no, arrival, seq, rtp_ts, samples."""
    return packets.groupBy("ssrc").applyInPandas(continuity_of, "ssrc long, packets long, gaps long, lost long, reordered long, duplicates long, timestamp_errors long")
