"""Request documents in JSON or TOML and stream probes as rows."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest document that is read, in characters.
MOST = 16 * 1024 * 1024
STREAM = "struct<index: int, codec_type: string, codec_name: string, profile: string, sample_rate: string, channels: int, channel_layout: string, bits_per_raw_sample: string, bit_rate: string, duration: string>"
PROBE = f"struct<format: struct<format_name: string, duration: string, bit_rate: string>, streams: array<{STREAM}>>"


def as_json(documents: DataFrame) -> DataFrame:
    """(path, text, error) of documents (path, text): those named .toml as JSON, dates as text."""

    def convert(batches):
        for rows in batches:
            out = []
            for path, text in zip(rows["path"], rows["text"], strict=True):
                try:
                    out.append((path, json.dumps(tomllib.loads(text), default=str), None))
                except tomllib.TOMLDecodeError as e:
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "text", "error"], dtype=object)

    schema = "path string, text string, error string"
    is_toml = F.coalesce(F.lower("path").endswith(".toml"), F.lit(False))
    long, missing = F.length("text") > MOST, F.col("text").isNull()
    fine = documents.select("path", F.when(~long, F.col("text")).alias("text"), F.when(long, "too long").when(missing, "missing").alias("error"))
    toml = fine.where(is_toml & F.col("error").isNull()).select("path", "text").mapInPandas(convert, schema)
    return fine.where(~is_toml | F.col("error").isNotNull()).union(toml)


def read_specs(documents: DataFrame, schema: str) -> DataFrame:
    """(path, spec, error) of request documents (path, text) in JSON or TOML. Null, too long, broken, or not of the schema: an error and no spec.

    Fields that the schema doesn't name are ignored; missing ones are null.
    """
    parsed = F.from_json("text", f"struct<value: {schema}, broken: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = as_json(documents).withColumn("text", F.concat(F.lit('{"value":'), "text", F.lit("}"))).withColumn("found", parsed)
    bad = F.col("error").isNull() & (F.col("found.broken").isNotNull() | F.col("found.value").isNull())
    error = F.when(bad, "not of the schema").otherwise(F.col("error"))
    return rows.select("path", F.when(error.isNull(), F.col("found.value")).alias("spec"), error.alias("error"))


def probed_streams(documents: DataFrame) -> DataFrame:
    """Audio streams of probe reports (path, text) that were made elsewhere, a row each; a report without one gives a row with an error."""
    spec, e = F.col("spec"), F.col("s")
    number = lambda c, kind: c.try_cast(kind)
    streams: Column = F.filter(F.coalesce(spec["streams"], F.array().cast(f"array<{STREAM}>")), lambda s: s["codec_type"] == "audio")
    rows = read_specs(documents, PROBE).select("path", "error", spec["format"].alias("format"), F.explode_outer(streams).alias("s"))
    return rows.select(
        "path", e["index"].alias("stream"), e["codec_name"].alias("codec"), e["profile"].alias("profile"), number(e["sample_rate"], "int").alias("sample_rate"), e["channels"].alias("channels"),
        e["channel_layout"].alias("layout"), number(e["bits_per_raw_sample"], "int").alias("bits"), number(F.coalesce(e["bit_rate"], F.col("format.bit_rate")), "bigint").alias("bit_rate"),
        number(F.coalesce(e["duration"], F.col("format.duration")), "double").alias("seconds"), F.col("format.format_name").alias("container"), F.coalesce("error", F.when(e.isNull(), "no audio stream")).alias("error"),
    )
