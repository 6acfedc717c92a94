"""Device graphs (NMOS snapshots) and serial metadata frames (S-ADM) as rows, and their integrity rules."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import is_tai_version, is_uuid

COMMON = "id: string, version: string, label: string, description: string"
NMOS = (
    f"nodes array<struct<{COMMON}, clocks: array<struct<name: string>>, interfaces: array<struct<name: string>>>>, devices array<struct<{COMMON}, node_id: string, senders: array<string>, receivers: array<string>>>, "
    f"sources array<struct<{COMMON}, device_id: string, parents: array<string>, clock_name: string, format: string, channels: array<struct<label: string>>>>, "
    f"flows array<struct<{COMMON}, source_id: string, device_id: string, parents: array<string>, format: string, media_type: string, bit_depth: int>>, "
    f"senders array<struct<{COMMON}, device_id: string, flow_id: string, interface_bindings: array<string>>>, receivers array<struct<{COMMON}, device_id: string, interface_bindings: array<string>>>"
)
#: Child kind, its column, parent kind.
EDGES = [("devices", "node_id", "nodes"), ("sources", "device_id", "devices"), ("flows", "source_id", "sources"), ("flows", "device_id", "devices"), ("senders", "device_id", "devices"), ("senders", "flow_id", "flows"), ("receivers", "device_id", "devices")]
KINDS = ["nodes", "devices", "sources", "flows", "senders", "receivers"]
BIT_DEPTH = {"audio/L16": 16, "audio/L24": 24}


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A DataFrame per resource kind."""
    doc = spark.read.schema(NMOS).option("multiLine", "true").json(path)
    return {k: doc.select(F.explode(k).alias("r")).select("r.*") for k in KINDS}


def graph_findings(g: dict[str, DataFrame]) -> DataFrame:
    """2.11: (subject, rule_id, severity, detail) of what fails."""
    row = lambda df, subject, rule, severity, detail: df.select(F.col(subject).alias("subject"), F.lit(f"AQ-NMOS-{rule}").alias("rule_id"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    out = []
    for kind in KINDS:
        out.append(row(g[kind].where(~F.coalesce(is_uuid(F.col("id")), F.lit(False))), "id", "ID", "error", F.lit(kind)))
        out.append(row(g[kind].where(~F.coalesce(is_tai_version(F.col("version")), F.lit(False))), "id", "VERSION", "error", F.col("version")))
        out.append(row(g[kind].groupBy("id").count().where("count > 1"), "id", "DUPLICATE-ID", "error", F.lit(kind)))
    for child, column, parent in EDGES:
        need = g[child].where(F.col(column).isNotNull() | F.lit(column != "flow_id"))  # a sender may have no flow
        out.append(row(need.join(g[parent].select(F.col("id").alias("p")).distinct(), F.col(column).eqNullSafe(F.col("p")), "left_anti"), "id", "RESOURCE-GRAPH", "error", F.concat(F.lit(f"{column}="), F.coalesce(F.col(column), F.lit("")))))
    listed = g["devices"].select("id", "senders", "receivers")
    for kind in ("senders", "receivers"):
        each = listed.select("id", F.explode(kind).alias("ref"))
        out.append(row(each.join(g[kind].select(F.col("id").alias("p")), F.col("ref") == F.col("p"), "left_anti"), "id", "RESOURCE-GRAPH", "error", F.col("ref")))
        own = g[kind].select("id", "device_id").join(listed.select(F.col("id").alias("d"), kind), F.col("device_id") == F.col("d"))
        out.append(row(own.where(~F.coalesce(F.array_contains(kind, F.col("id")), F.lit(False))), "id", "DEVICE-MEMBERSHIP", "error", F.col("device_id")))
    for kind in ("sources", "flows"):
        each = g[kind].select("id", F.explode("parents").alias("ref"))
        out.append(row(each.where(~is_uuid(F.col("ref"))), "id", "PARENT-ID", "error", F.col("ref")))
        out.append(row(each.join(g[kind].select(F.col("id").alias("p")), F.col("ref") == F.col("p"), "left_anti"), "id", "PARENT-PRESENT", "warning", F.col("ref")))
    audio = g["sources"].where(F.col("format") == "urn:x-nmos:format:audio")
    out.append(row(audio.where(F.coalesce(F.size("channels"), F.lit(0)) < 1), "id", "AUDIO-SOURCE", "error", F.lit("channels")))
    clocks = g["devices"].select(F.col("id").alias("d"), "node_id").join(g["nodes"].select(F.col("id").alias("n"), F.explode_outer("clocks.name").alias("clock")), F.col("node_id") == F.col("n")).select("d", "clock")
    named = audio.where("clock_name IS NOT NULL")
    out.append(row(named.join(clocks, (F.col("device_id") == F.col("d")) & (F.col("clock_name") == F.col("clock")), "left_anti"), "id", "AUDIO-SOURCE", "error", F.col("clock_name")))
    depth = F.create_map(*[F.lit(x) for kv in BIT_DEPTH.items() for x in kv])
    flows = g["flows"].where(F.col("format") == "urn:x-nmos:format:audio")
    out.append(row(flows.where(F.col("media_type").isin(*BIT_DEPTH) & ~F.coalesce(depth[F.col("media_type")] == F.col("bit_depth"), F.lit(False))), "id", "AUDIO-FLOW", "error", F.col("media_type")))
    out.append(row(flows.join(audio.select(F.col("id").alias("s")), F.col("source_id") == F.col("s"), "left_anti"), "id", "AUDIO-FLOW", "error", F.col("source_id")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.distinct()


SADM = "path string, ordinal int, kind string, flow_id string, frame_index long, start double, duration double, time_reference string, error string"


def clock_seconds(text: str | None) -> float | None:
    """HH:MM:SS.fraction, optionally with S<rate> after the fraction's numerator."""
    try:
        h, m, s = text.split(":")
        if "S" in s:
            whole, _, part = s.partition(".")
            top, _, rate = part.partition("S")
            return int(h) * 3600 + int(m) * 60 + int(whole) + int(top) / int(rate)
        return int(h) * 3600 + int(m) * 60 + float(s)
    except (AttributeError, ValueError, ZeroDivisionError):
        return None


def parse_frames(batches):
    names = [x.split()[0] for x in SADM.split(", ")]
    for rows in batches:
        out = []
        for path, n, text in zip(rows["path"], rows["ordinal"], rows["text"], strict=True):
            try:
                if "<!DOCTYPE" in text or "<!ENTITY" in text:
                    raise ET.ParseError("document types are not read")
                head = next((e for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == "frameFormat"), None)
                if head is None:
                    raise ET.ParseError("no frameFormat")
                digits = "".join(c for c in head.get("frameFormatID", "") if c in "0123456789abcdefABCDEF_").rpartition("_")[2]
                out.append((path, n, head.get("type"), head.get("flowID"), int(digits, 16) if digits else None, clock_seconds(head.get("start")), clock_seconds(head.get("duration")), head.get("timeReference"), None))
            except (ET.ParseError, ValueError) as e:
                out.append((path, n, None, None, None, None, None, None, str(e)))
        yield pd.DataFrame(out, columns=names, dtype=object)


def serial_frames(texts: DataFrame) -> DataFrame:
    """Frame headers of S-ADM documents. texts: path, ordinal, text."""
    return texts.select("path", "ordinal", "text").mapInPandas(parse_frames, SADM)


def flow_findings(frames: DataFrame) -> DataFrame:
    """2.11: flow identity, time reference, ordinals and contiguity to a nanosecond."""
    w = Window.partitionBy("path").orderBy("ordinal")
    f = frames.withColumn("next", F.lead("start").over(w)).withColumn("n", F.row_number().over(w)).withColumn("first_index", F.first("frame_index").over(w))
    per = f.groupBy("path").agg(
        F.count("error").alias("errors"), F.count_distinct("flow_id").alias("flows"), F.count_distinct("time_reference").alias("refs"), F.bool_and(F.col("frame_index") - F.col("first_index") == F.col("n") - 1).alias("ordered"),
        F.bool_and(F.col("next").isNull() | (F.abs(F.col("start") + F.col("duration") - F.col("next")) <= 1e-9)).alias("contiguous"), F.min_by("kind", "ordinal").alias("first_kind"),
    )
    rules = [("SYNTAX", F.col("errors") == 0), ("FLOW-ID", F.col("flows") <= 1), ("TIME-REFERENCE", F.col("refs") <= 1), ("FRAME-INDEX", F.coalesce("ordered", F.lit(False))), ("CONTIGUITY", F.coalesce("contiguous", F.lit(False))), ("FIRST-FRAME", F.coalesce(F.col("first_kind").isin("header", "full"), F.lit(False)))]
    return per.select("path", F.explode(F.array(*[F.struct(F.lit(f"AQ-SADM-{n}").alias("rule_id"), c.alias("passed")) for n, c in rules])).alias("r")).select("path", "r.*")
