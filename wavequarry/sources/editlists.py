"""Text and XML production documents as rows: AES31 edit lists and audio definition models."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .manifests import local, safe_xml

ADL = "path string, section string, keyword string, ordinal int, fields array<string>, problem string"
CORE = ["VERSION", "PROJECT", "SEQUENCE", "SOURCE_INDEX", "EVENT_LIST"]


def read_adl(path: str, text: str) -> list[tuple]:
    """A row per record: (keyword) values; problems are rows too."""
    out, open_, n = [], [], 0
    if not text.isascii():
        out.append((path, None, None, 0, None, "ASCII"))
    for line in text.replace("\r", "\n").split("\n"):
        line = line.strip()
        if not line:
            continue
        n += 1
        if m := re.fullmatch(r"<(/?)([A-Z_0-9]+)>", line):
            if not m[1]:
                open_.append(m[2])
                out.append((path, m[2], "<>", n, None, None))
            elif not open_ or open_.pop() != m[2]:
                out.append((path, None, None, n, None, "SYNTAX"))
        elif m := re.match(r"\((\w+)\)\s*(.*)$", line):
            values = [a or b for a, b in re.findall(r'"([^"]*)"|(\S+)', m[2])]
            out.append((path, open_[-1] if open_ else None, m[1], n, values, "SYNTAX" if m[2].count('"') % 2 else None))
        else:
            out.append((path, None, None, n, None, "SYNTAX"))
    if open_:
        out.append((path, None, None, n, None, "SYNTAX"))
    return out


def edit_lists(docs: DataFrame) -> DataFrame:
    """Records of edit lists (path, text)."""
    names = [x.split()[0] for x in ADL.split(", ")]

    def parse(batches):
        for rows in batches:
            yield pd.DataFrame([r for p, t in zip(rows["path"], rows["text"], strict=True) for r in read_adl(p, t)], columns=names, dtype=object)

    return docs.select("path", "text").mapInPandas(parse, ADL)


def edits(records: DataFrame) -> DataFrame:
    """Cuts with their source, tracks and times in samples."""
    w = Window.partitionBy("path").orderBy("ordinal")
    entry = F.last(F.when(F.col("keyword") == "Entry", F.element_at("fields", 1).cast("int")), True).over(w)
    rate = F.max(F.when(F.col("keyword") == "SEQ_SAMPLE_RATE", F.regexp_extract(F.element_at("fields", 1), r"(\d+)", 1).cast("int"))).over(Window.partitionBy("path"))
    frames = F.max(F.when(F.col("keyword") == "SEQ_FRAME_RATE", F.regexp_extract(F.element_at("fields", 1), r"([0-9.]+)", 1).cast("double"))).over(Window.partitionBy("path"))
    cuts = records.withColumns({"entry": entry, "rate": rate, "fps": frames}).where("keyword = 'Cut'")

    def samples(i):
        t = F.get("fields", F.lit(i))
        part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d+):(\d+):(\d+):(\d+)/(\d+)$", k), F.lit("")).cast("double"), F.lit(None).cast("double"))
        return ((part(1) * 3600 + part(2) * 60 + part(3)) * F.col("rate") + part(4) * F.col("rate") / F.col("fps") + part(5)).cast("long")

    span = lambda i: F.get("fields", F.lit(i))
    return cuts.select("path", "entry", span(1).cast("int").alias("source"), span(2).alias("from_tracks"), span(3).alias("to_tracks"), samples(4).alias("source_in"), samples(5).alias("start"), samples(6).alias("stop"))


def width(c):
    """Channels of a track designation: 1 or 1-4."""
    a, b = (F.nullif(F.regexp_extract(c, r"^(\d+)(?:[-~](\d+))?$", i), F.lit("")).cast("int") for i in (1, 2))
    return F.coalesce(b, a) - a + 1


def edit_findings(records: DataFrame) -> DataFrame:
    """2.11: rows of (path, rule_id, severity, subject) of what fails in edit lists."""
    out = lambda df, rule, subject, severity="error": df.select("path", F.lit(f"AQ-AES31-{rule}").alias("rule_id"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))
    e = edits(records)
    sections = records.where("keyword = '<>'").groupBy("path", "section").agg(F.count("*").alias("n"), F.min("ordinal").alias("at"))
    wanted = records.select("path").distinct().withColumn("section", F.explode(F.array(*[F.lit(x) for x in CORE])))
    place = F.array_position(F.array(*[F.lit(x) for x in CORE]), F.col("section"))
    order = sections.where(F.col("section").isin(*CORE)).withColumn("place", place).withColumn("before", F.lag("place").over(Window.partitionBy("path").orderBy("at")))
    sources = records.where("section = 'SOURCE_INDEX' AND keyword = 'Index'").select("path", F.element_at("fields", 1).cast("int").alias("source"))
    tracks = records.where("keyword = 'Track'").select("path", F.element_at("fields", 1).cast("int").alias("track"))
    first, last = (F.nullif(F.regexp_extract("to_tracks", r"^(\d+)(?:[-~](\d+))?$", i), F.lit("")).cast("int") for i in (1, 2))
    used = e.select("path", "entry", F.explode(F.sequence(first, F.coalesce(last, first))).alias("track"))
    n = e.withColumn("no", F.row_number().over(Window.partitionBy("path").orderBy("entry")))
    a = e.select("path", "entry", F.explode(F.sequence(first, F.coalesce(last, first))).alias("track"), "start", "stop")
    b = a.select("path", "track", F.col("entry").alias("other"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
    found = [
        out(records.where("problem = 'ASCII'"), "ASCII", F.col("ordinal")), out(records.where("problem = 'SYNTAX'"), "SYNTAX", F.col("ordinal")),
        out(wanted.join(sections.where("n = 1"), ["path", "section"], "left_anti"), "SECTIONS", F.col("section")), out(order.where("place < before"), "SECTION-ORDER", F.col("section")),
        out(n.where("entry <> no"), "EVENT-LIST", F.col("entry")), out(e.join(sources, ["path", "source"], "left_anti"), "EVENT-SOURCE-REFERENCE", F.col("entry")),
        out(used.join(tracks, ["path", "track"], "left_anti"), "EVENT-TRACK-REFERENCE", F.col("entry")), out(e.where(width(F.col("from_tracks")) != width(F.col("to_tracks"))), "EVENT-TRACK-REFERENCE", F.col("entry")),
        out(e.where("start IS NULL OR stop IS NULL OR stop <= start"), "EVENT-TIMING", F.col("entry")),
        out(a.join(b, ["path", "track"]).where("entry < other AND start < e2 AND s2 < stop"), "OVERLAPS", F.concat_ws("-", "entry", "other"), "warning"),
    ]
    rows = found[0]
    for x in found[1:]:
        rows = rows.union(x)
    return rows.distinct()


MODEL = "path string, kind string, id string, name string, reference string, target string, problem string"
#: Element kinds and the prefix of their identifiers. Fixed values of ITU-R BS.2076.
PREFIX = {
    "audioProgramme": "APR_", "audioContent": "ACO_", "audioObject": "AO_", "audioPackFormat": "AP_", "audioChannelFormat": "AC_", "audioStreamFormat": "AS_", "audioTrackFormat": "AT_", "audioTrackUID": "ATU_",
}


def read_model(path: str, text: str) -> list[tuple]:
    try:
        root = safe_xml(text)
    except ET.ParseError as e:
        return [(path, None, None, None, None, None, str(e))]
    out = []
    for e in root.iter():
        kind = local(e)
        if kind in PREFIX and (own := e.get(f"{kind}ID") or e.get("UID")):
            out.append((path, kind, own, e.get(f"{kind}Name"), None, None, None))
            for c in e:
                if local(c).endswith(("IDRef", "UIDRef")) and c.text:
                    out.append((path, kind, own, None, local(c).removesuffix("IDRef").removesuffix("UIDRef") + ("UID" if "UID" in local(c) else ""), c.text.strip(), None))
    return out


def models(docs: DataFrame) -> DataFrame:
    """Elements of audio definition models (path, text) and their references."""
    names = [x.split()[0] for x in MODEL.split(", ")]

    def parse(batches):
        for rows in batches:
            yield pd.DataFrame([r for p, t in zip(rows["path"], rows["text"], strict=True) for r in read_model(p, t)], columns=names, dtype=object)

    return docs.select("path", "text").mapInPandas(parse, MODEL)


def model_findings(rows: DataFrame) -> DataFrame:
    """Identifiers that clash, have the wrong form or are referred to without being there; objects in a cycle of two."""
    out = lambda df, rule, subject: df.select("path", F.lit(f"AQ-ADM-{rule}").alias("rule_id"), subject.cast("string").alias("subject"))
    elements = rows.where("reference IS NULL AND problem IS NULL")
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    common = F.col("target").rlike(r"^(AP|AC|AS|AT)_000[1-5]0[0-9a-fA-F]{3}")  # common definitions need not be repeated
    refs = rows.where("reference IS NOT NULL")
    loops = refs.where("kind = 'audioObject' AND reference = 'audioObject'")
    back = loops.select("path", F.col("target").alias("id"), F.col("id").alias("target"))
    found = [
        out(rows.where("problem IS NOT NULL"), "XML", F.col("problem")),
        out(elements.groupBy("path", "id").count().where("count > 1"), "UNIQUE-ID", F.col("id")),
        out(elements.where(~F.col("id").startswith(prefix[F.col("kind")])), "ID-FORM", F.col("id")),
        out(refs.where(~common & (F.col("target") != "ATU_00000000")).join(elements.select("path", F.col("id").alias("target")), ["path", "target"], "left_anti"), "REFERENCE", F.col("target")),
        out(loops.join(back, ["path", "id", "target"], "left_semi"), "OBJECT-LOOP", F.col("id")),
    ]
    result = found[0]
    for x in found[1:]:
        result = result.union(x)
    return result.distinct()
