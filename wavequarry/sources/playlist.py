"""HLS playlists as tag and segment rows, with the rules that need only them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENTS = "path string, ordinal int, uri string, duration double, discontinuity boolean, byterange string, map_uri string, sequence long, target double, version int, endlist boolean, playlist_type string, error string"


def attributes(text: str) -> dict[str, str]:
    """NAME=value and NAME="value" pairs."""
    out, at = {}, 0
    while at < len(text):
        name, _, rest = text[at:].partition("=")
        if rest.startswith('"'):
            value, _, after = rest[1:].partition('"')
            at = len(text) - len(after) + after.startswith(",")
        else:
            value, _, after = rest.partition(",")
            at = len(text) - len(after)
        out[name.strip()] = value
    return out


def parse(path: str, text: str) -> list[tuple]:
    """One row per media segment; a playlist that can't be read gives one row with an error."""
    lines = [x.strip() for x in text.replace("\r\n", "\n").split("\n")]
    if not lines or lines[0] != "#EXTM3U":
        return [(path, None, None, None, None, None, None, None, None, None, None, None, "EXTM3U is missing")]
    head = {"target": None, "version": 1, "end": False, "type": None, "first": 0}
    rows, duration, gap, span, init = [], None, False, None, None
    for line in lines[1:]:
        tag, _, value = line.partition(":")
        try:
            if tag == "#EXTINF":
                duration = float(value.split(",")[0])
            elif tag == "#EXT-X-TARGETDURATION":
                head["target"] = float(value)
            elif tag == "#EXT-X-VERSION":
                head["version"] = int(value)
            elif tag == "#EXT-X-MEDIA-SEQUENCE":
                head["first"] = int(value)
            elif tag == "#EXT-X-PLAYLIST-TYPE":
                head["type"] = value
            elif tag == "#EXT-X-ENDLIST":
                head["end"] = True
            elif tag == "#EXT-X-DISCONTINUITY":
                gap = True
            elif tag == "#EXT-X-BYTERANGE":
                span = value
            elif tag == "#EXT-X-MAP":
                init = attributes(value).get("URI")
            elif line and not line.startswith("#"):
                rows.append((len(rows), line, duration, gap, span, init, None if duration is not None else "EXTINF is missing"))
                duration, gap, span = None, False, None
        except ValueError:
            rows.append((len(rows), None, None, None, None, None, f"bad value in {tag}"))
    return [(path, n, uri, d, g, b, m, head["first"] + n, head["target"], head["version"], head["end"], head["type"], e) for n, uri, d, g, b, m, e in rows] or [
        (path, None, None, None, None, None, None, None, head["target"], head["version"], head["end"], head["type"], "no segments")
    ]


def parse_batches(batches):
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    for rows in batches:
        out = [r for path, text in zip(rows["path"], rows["text"], strict=True) for r in parse(path, text)]
        frame = pd.DataFrame(out, columns=names, dtype=object)
        yield frame


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """Segments of every playlist under a path."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).mapInPandas(parse_batches, SEGMENTS)


def findings(segments: DataFrame) -> DataFrame:
    """2.11: one row per playlist and rule."""
    per = segments.groupBy("path").agg(
        F.count("error").alias("errors"), F.max(F.round("duration")).alias("longest"), F.first("target").alias("target"), F.first("version").alias("version"), F.bool_or("endlist").alias("ended"),
        F.first("playlist_type").alias("kind"), F.bool_or(F.col("uri").rlike(r"\.(m4s|mp4|cmfa)$")).alias("fragmented"), F.bool_and(F.col("map_uri").isNotNull()).alias("mapped"), F.count("byterange").alias("ranges"),
    )
    ok = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("AQ-HLS-SYNTAX", F.col("errors") == 0),
        ("AQ-HLS-TARGET-PRESENT", F.col("target").isNotNull()),
        ("AQ-HLS-TARGET-DURATION", F.col("target").isNull() | (F.col("longest") <= F.col("target"))),
        ("AQ-HLS-VOD-ENDLIST", ok(F.col("kind") != "VOD") | F.col("kind").isNull() | ok(F.col("ended"))),
        ("AQ-HLS-FMP4-MAP", ~ok(F.col("fragmented")) | (ok(F.col("mapped")) & (F.col("version") >= 6))),
        ("AQ-HLS-BYTERANGE-VERSION", (F.col("ranges") == 0) | (F.col("version") >= 4)),
    ]
    return per.select("path", F.explode(F.array(*[F.struct(F.lit(n).alias("rule_id"), ok(c).alias("passed")) for n, c in rules])).alias("r")).select("path", "r.*")


def discontinuity_sequence(segments: DataFrame, base: int = 0) -> DataFrame:
    """Start time and discontinuity sequence of each segment."""
    w = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("discontinuity_sequence", F.sum(F.col("discontinuity").cast("int")).over(w) + base).withColumn("start", F.sum("duration").over(w) - F.col("duration"))
