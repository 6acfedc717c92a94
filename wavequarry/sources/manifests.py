"""XML delivery documents as rows: streaming manifests with updates and patches, and IMF packages."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from base64 import b64encode
from fractions import Fraction
from hashlib import sha1, sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENTS = "path string, period string, period_start double, adaptation int, representation string, bandwidth long, content string, number long, time long, duration long, timescale long, uri string"
FACTS = "path string, name string, value string"
#: A timeline that would give more segments is an error, not a truncated list.
MOST_SEGMENTS = 1_000_000


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def safe_xml(text: str) -> ET.Element:
    """Document types and entities are refused."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        raise ET.ParseError("document types are not read")
    return ET.fromstring(text)


def child(e: ET.Element | None, name: str) -> ET.Element | None:
    return next((c for c in e if local(c) == name), None) if e is not None else None


def children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e if local(c) == name] if e is not None else []


def iso_seconds(text: str | None) -> float | None:
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text or "")
    return sum(float(x or 0) * k for x, k in zip(m.groups(), (86400, 3600, 60, 1), strict=True)) if m else None


def template(text: str, values: dict[str, int | str]) -> str:
    """$Name$, $Name%0Nd$ and $$."""

    def put(m):
        if not m[1]:
            return "$"
        value = values.get(m[1], m[0])
        return f"{int(value):0{int(m[2])}d}" if m[2] else str(value)

    return re.sub(r"\$(?:(\w+)(?:%0(\d+)d)?)?\$", put, text)


def inherited(chain: list[ET.Element], name: str) -> tuple[dict, ET.Element | None]:
    """Attributes of an element merged from period to representation, and the innermost timeline."""
    found, line = {}, None
    for e in chain:
        if (t := child(e, name)) is not None:
            found |= t.attrib
            inner = child(t, "SegmentTimeline")
            line = inner if inner is not None else line
    return found, line


def expand(line: ET.Element, until: float | None) -> list[tuple[int, int]]:
    """(time, duration) of a timeline; a repeat of -1 runs to the next entry or the period's end."""
    entries, out, at = children(line, "S"), [], 0
    for i, s in enumerate(entries):
        at = int(s.get("t", at))
        d, r = int(s.get("d", 0)), int(s.get("r", 0))
        if d <= 0:
            raise ValueError("a timeline entry without a duration")
        if r < 0:
            stop = int(entries[i + 1].get("t", at)) if i + 1 < len(entries) else until
            if stop is None:
                raise ValueError("an open repeat without an end")
            r = max(0, -(-(int(stop) - at) // d) - 1)
        if len(out) + r + 1 > MOST_SEGMENTS:
            raise ValueError("too many segments")
        out += [(at + k * d, d) for k in range(r + 1)]
        at += (r + 1) * d
    return out


def read_mpd(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Segment rows and document facts."""
    root = safe_xml(text)
    if local(root) != "MPD":
        raise ValueError("not a media presentation")
    facts = [(path, k, root.get(k)) for k in ("type", "id", "profiles", "minBufferTime", "availabilityStartTime", "publishTime", "minimumUpdatePeriod", "mediaPresentationDuration", "timeShiftBufferDepth")]
    rows, begin = [], 0.0
    periods = children(root, "Period")
    for n, p in enumerate(periods):
        begin = iso_seconds(p.get("start")) if p.get("start") else begin
        length = iso_seconds(p.get("duration"))
        if length is None:
            end = iso_seconds(periods[n + 1].get("start")) if n + 1 < len(periods) else iso_seconds(root.get("mediaPresentationDuration"))
            length = end - begin if end is not None else None
        for i, a in enumerate(children(p, "AdaptationSet")):
            kind = a.get("contentType") or (a.get("mimeType") or "").partition("/")[0]
            for r in children(a, "Representation"):
                at, line = inherited([p, a, r], "SegmentTemplate")
                scale, number, offset = int(at.get("timescale", 1)), int(at.get("startNumber", 1)), int(at.get("presentationTimeOffset", 0))
                common = (path, p.get("id"), begin, i, r.get("id"), int(r.get("bandwidth", 0)), kind)
                if line is not None:
                    parts = expand(line, length * scale + offset if length is not None else None)
                elif "duration" in at and length is not None:
                    d = int(at["duration"])
                    parts = [(offset + k * d, d) for k in range(min(MOST_SEGMENTS, -(-round(length * scale) // d)))]
                else:
                    parts = []
                for k, (t, d) in enumerate(parts):
                    names = {"RepresentationID": r.get("id", ""), "Bandwidth": r.get("bandwidth", 0), "Number": number + k, "Time": t}
                    rows.append((*common, number + k, t, d, scale, template(at.get("media", ""), names)))
                if not parts:
                    rows.append((*common, None, None, None, scale, None))
        begin += length or 0.0
    return rows, facts


def mpd_batches(which: int):
    schema = (SEGMENTS, FACTS)[which]
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches):
        for rows in batches:
            out = []
            for path, text in zip(rows["path"], rows["text"], strict=True):
                try:
                    out += read_mpd(path, text)[which]
                except (ET.ParseError, ValueError) as e:
                    out += [(path, "error", str(e))] if which else []
            yield pd.DataFrame(out, columns=names, dtype=object)

    return parse


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def segments(docs: DataFrame) -> DataFrame:
    """Segments of manifests (path, text)."""
    return docs.select("path", "text").mapInPandas(mpd_batches(0), SEGMENTS)


def facts(docs: DataFrame) -> DataFrame:
    """Root attributes and errors of manifests (path, text), a row each."""
    return docs.select("path", "text").mapInPandas(mpd_batches(1), FACTS)


def manifest_findings(docs: DataFrame) -> DataFrame:
    """2.11: rules of a single manifest."""
    f = facts(docs).groupBy("path").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("error", "type", "minBufferTime", "availabilityStartTime", "minimumUpdatePeriod", "mediaPresentationDuration", "profiles")])
    w = Window.partitionBy("path", "period", "adaptation", "representation").orderBy("time")
    s = segments(docs).withColumn("gap", F.col("time") - F.lag(F.col("time") + F.col("duration")).over(w))
    per = s.groupBy("path").agg(F.count_if(F.coalesce(F.col("gap") != 0, F.lit(False))).alias("gaps"), F.count_if(F.col("number").isNull()).alias("empty"), F.count_if(F.col("representation").isNull()).alias("unnamed"))
    bounds = s.where("time IS NOT NULL").groupBy("path", "period", "adaptation", "time").agg(F.count_distinct("representation").alias("n"))
    sizes = s.groupBy("path", "period", "adaptation").agg(F.count_distinct("representation").alias("all"))
    odd = bounds.join(sizes, ["path", "period", "adaptation"]).where("n <> all").groupBy("path").agg(F.count("*").alias("unaligned"))
    twice = s.select("path", "period", "adaptation", "representation").distinct().groupBy("path", "period", "representation").count().where("count > 1").groupBy("path").agg(F.count("*").alias("repeated"))
    j = f.join(per, "path", "left").join(odd, "path", "left").join(twice, "path", "left")
    dynamic, zero = F.col("type") == "dynamic", lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    rules = [
        ("SYNTAX", F.col("error").isNull()), ("MIN-BUFFER", F.col("minBufferTime").isNotNull()), ("PROFILES", F.col("profiles").isNotNull()), ("LIVE-AVAILABILITY-ANCHOR", ~F.coalesce(dynamic, F.lit(False)) | F.col("availabilityStartTime").isNotNull()),
        ("STATIC-DURATION", F.coalesce(dynamic, F.lit(False)) | F.col("mediaPresentationDuration").isNotNull()), ("TIMELINE-CONTINUITY", zero("gaps")), ("SEGMENT-ADDRESSING", zero("empty")), ("REPRESENTATION-ID", zero("repeated") & zero("unnamed")), ("SEGMENT-ALIGNMENT", zero("unaligned")),
    ]
    return j.select("path", F.explode(F.array(*[F.struct(F.lit(f"AQ-DASH-{n}").alias("rule_id"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules])).alias("r")).select("path", "r.*")


def patch(document: str, operations: str) -> str:
    """Add, replace and remove operations of an XML patch; selectors are child paths with [n] and [@name='value'], optionally ending in @name."""
    root, changes = safe_xml(document), safe_xml(operations)

    def walk(selector: str) -> tuple[list[ET.Element], str | None]:
        steps = [s for s in re.split(r"/(?![^\[]*\])", selector) if s]
        attribute = steps.pop()[1:] if steps and steps[-1].startswith("@") else None
        if not steps:
            raise ValueError(f"bad selector {selector}")
        path = []
        for i, step in enumerate(steps):
            m = re.fullmatch(r"(?:\w+:)?([\w-]+)((?:\[[^\]]+\])*)", step)
            if not m:
                raise ValueError(f"bad selector {selector}")
            found = [root] if i == 0 and local(root) == m[1] else [] if i == 0 else children(path[-1], m[1])
            for test in re.findall(r"\[([^\]]+)\]", m[2]):
                if test.isdigit():
                    found = found[int(test) - 1 : int(test)]
                elif k := re.fullmatch(r"@([\w:-]+)=(['\"])(.*)\2", test):
                    found = [e for e in found if e.get(k[1]) == k[3]]
                else:
                    raise ValueError(f"bad test {test}")
            if len(found) != 1:
                raise ValueError(f"{selector} selects {len(found)} elements")
            path.append(found[0])
        return path, attribute

    for op in changes:
        path, attribute = walk(op.get("sel", ""))
        target = path[-1]
        action = local(op)
        if action == "add" and op.get("type", "").startswith("@"):
            target.set(op.get("type")[1:], op.text or "")
        elif action == "add":
            where = op.get("pos", "append")
            if where in ("before", "after"):
                at = list(path[-2]).index(target) + (where == "after")
                for k, e in enumerate(list(op)):
                    path[-2].insert(at + k, e)
            else:
                for k, e in enumerate(list(op)):
                    target.insert(k if where == "prepend" else len(target), e)
        elif action == "replace" and attribute:
            if attribute not in target.attrib:
                raise ValueError(f"no attribute {attribute}")
            target.set(attribute, op.text or "")
        elif action == "replace":
            new = list(op)
            if len(new) != 1 or len(path) < 2:
                raise ValueError("a replacement needs one element below the root")
            at = list(path[-2]).index(target)
            path[-2].remove(target)
            path[-2].insert(at, new[0])
        elif action == "remove" and attribute:
            if target.attrib.pop(attribute, None) is None:
                raise ValueError(f"no attribute {attribute}")
        elif action == "remove" and len(path) > 1:
            path[-2].remove(target)
        else:
            raise ValueError(f"unknown operation {action}")
    return ET.tostring(root, encoding="unicode")


# IMF packages

IMF = "kind string, document string, id string, path string, size long, hash string, algorithm string, segment int, track string, edit_rate string, duration string, message string"


def imf_rows(path: str, content: bytes) -> list[tuple]:
    """Rows of an asset map, packing list or composition; other files give their size and digests."""
    none = (None,) * 12
    made = lambda **x: tuple(x.get(n.split()[0], v) for n, v in zip(IMF.split(", "), none, strict=True))
    name = path.rsplit("/", 1)[-1]
    rows = [made(kind="file", document=name, path=name, size=len(content), hash=b64encode(sha1(content).digest()).decode(), algorithm=b64encode(sha256(content).digest()).decode())]
    if not content.lstrip()[:1] == b"<":
        return rows
    try:
        root = safe_xml(content.decode("utf-8"))
    except (ET.ParseError, UnicodeDecodeError) as e:
        return [*rows, made(kind="error", document=name, message=str(e))]
    text = lambda e, n: (c.text or "").strip() if (c := child(e, n)) is not None else None
    if local(root) == "AssetMap":
        for a in children(child(root, "AssetList"), "Asset"):
            for c in children(child(a, "ChunkList"), "Chunk"):
                rows.append(made(kind="map", document=name, id=text(a, "Id"), path=text(c, "Path"), message="packing" if (text(a, "PackingList") or "") == "true" else None))
    elif local(root) == "PackingList":
        rows.append(made(kind="pkl", document=name, id=text(root, "Id")))
        for a in children(child(root, "AssetList"), "Asset"):
            method = child(a, "HashAlgorithm")
            rows.append(made(kind="packed", document=name, id=text(a, "Id"), size=int(text(a, "Size") or -1), hash=text(a, "Hash"), algorithm="sha256" if method is not None and "sha256" in method.get("Algorithm", "") else "sha1"))
    elif local(root) == "CompositionPlaylist":
        rows.append(made(kind="cpl", document=name, id=text(root, "Id")))
        rate = text(root, "EditRate")
        for n, seg in enumerate(children(child(root, "SegmentList"), "Segment")):
            for seq in child(seg, "SequenceList") if child(seg, "SequenceList") is not None else []:
                for r in children(child(seq, "ResourceList"), "Resource"):
                    used = text(r, "EditRate") or rate
                    length = int(text(r, "SourceDuration") or int(text(r, "IntrinsicDuration") or 0) - int(text(r, "EntryPoint") or 0)) * int(text(r, "RepeatCount") or 1)
                    top, bottom = (int(x) for x in (used or "1 1").split())
                    seconds = Fraction(length * bottom, top)
                    rows.append(made(kind="resource", document=name, id=text(r, "TrackFileId"), segment=n, track=text(seq, "TrackId"), edit_rate=used, duration=f"{seconds.numerator}/{seconds.denominator}"))
    return rows


def read_imf(spark: SparkSession, folder: str) -> DataFrame:
    names = [x.split()[0] for x in IMF.split(", ")]

    def parse(batches):
        for rows in batches:
            out = [r for p, c in zip(rows["path"], rows["content"], strict=True) for r in imf_rows(p, bytes(c))]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(parse, IMF)


def imf_findings(rows: DataFrame) -> DataFrame:
    """Rows of (rule_id, subject) of what fails in a package."""
    of = lambda k: rows.where(F.col("kind") == k)
    out = lambda df, rule, subject: df.select(F.lit(f"AQ-IMF-{rule}").alias("rule_id"), subject.cast("string").alias("subject"))
    entries, packed, files = of("map"), of("packed"), of("file")
    placed = packed.select(F.col("id").alias("pid"), F.col("size").alias("want"), F.col("hash").alias("want_hash"), "algorithm").join(entries.select("id", "path"), F.col("pid") == F.col("id")).join(files.select(F.col("path").alias("file"), F.col("size").alias("have"), F.col("hash").alias("h1"), F.col("algorithm").alias("h256")), F.col("path") == F.col("file"), "left")
    digest = F.when(F.col("algorithm") == "sha256", F.col("h256")).otherwise(F.col("h1"))
    lengths = of("resource").groupBy("document", "segment", "track").agg(F.sum(F.split("duration", "/")[0].cast("decimal(38,0)")).alias("n"), F.max("duration").alias("d"), F.count("*").alias("k"))
    found = [
        out(of("error"), "XML-PARSE", F.col("document")),
        out(entries.groupBy("id").count().where("count > 1"), "ASSETMAP-UNIQUE-ID", F.col("id")),
        out(entries.where(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|^[A-Za-z][A-Za-z0-9+.-]*:")), "ASSETMAP-LOCAL-PATH", F.col("path")),
        out(packed.join(entries.select("id").distinct(), "id", "left_anti"), "PKL-ASSETMAP-REFERENCES", F.col("id")),
        out(placed.where("file IS NULL"), "PKL-FILE", F.col("path")),
        out(placed.where("have <> want"), "PKL-SIZE", F.col("path")),
        out(placed.where(digest != F.col("want_hash")), "PKL-HASH", F.col("path")),
        out(packed.where("algorithm = 'sha1'").limit(1), "SHA1-SECURITY", F.col("document")),
        out(of("resource").join(entries.select("id").distinct(), "id", "left_anti"), "CPL-ASSETMAP-REFERENCES", F.col("id")),
        out(of("resource").join(packed.select("id").distinct(), "id", "left_anti"), "CPL-PKL-REFERENCES", F.col("id")),
        out(of("map").where("message = 'packing'").select(F.col("id").alias("x")).join(of("pkl").select("id"), F.col("x") == F.col("id"), "left_anti"), "PKL-IDENTITY", F.col("x")),
        out(lengths.where("k = 1").groupBy("document", "segment").agg(F.count_distinct("d").alias("n")).where("n > 1"), "CPL-SEGMENT-DURATION", F.concat_ws("#", "document", "segment")),
    ]
    rows_ = found[0]
    for x in found[1:]:
        rows_ = rows_.union(x)
    return rows_.distinct()
