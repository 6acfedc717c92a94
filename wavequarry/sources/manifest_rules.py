"""Streaming manifests as rows of XML elements, with the rules about their attributes, order and inheritance.

A parser gives each element a row with its attributes, those that it inherits and what its segment
addressing comes to; windows over the rows of one manifest give order and repetition, and rules are
predicates on these rows.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from base64 import b64decode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import manifests as m

ELEMENTS = "path string, node int, parent int, period int, name string, namespace string, attrs map<string,string>, inherited map<string,string>, kids map<string,int>, numbers map<string,double>, text string"
PROFILES = ("dash", "dash-if", "live")
DATE_TIME = r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"
ZONED = r"(Z|[+-]\d\d:\d\d)$"
UUID = "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Fixed values of the public formats.
NAMESPACE = "urn:mpeg:dash:schema:mpd:2011"
CLOCKS = ["urn:mpeg:dash:utc:http-xsdate:2014", "urn:mpeg:dash:utc:http-iso:2014", "urn:mpeg:dash:utc:http-head:2014", "urn:mpeg:dash:utc:direct:2014"]
MP4_PROTECTION = "urn:mpeg:dash:mp4protection:2011"
ENCRYPTION = ["cenc", "cens", "cbc1", "cbcs"]
ADDRESSING = ("SegmentTemplate", "SegmentList", "SegmentBase")
DURATIONS = ("start", "duration", "mediaPresentationDuration", "minBufferTime", "minimumUpdatePeriod", "timeShiftBufferDepth", "suggestedPresentationDelay")


def whole_box(text: str) -> bool:
    try:
        box = b64decode("".join(text.split()), validate=True)
    except ValueError:
        return False
    return len(box) >= 32 and box[4:8] == b"pssh" and int.from_bytes(box[:4], "big") == len(box)


def plain_attributes(e: ET.Element) -> dict[str, str]:
    return {k.rpartition("}")[2]: v for k, v in e.attrib.items()}


def addressing(chain: list[ET.Element], seconds: float | None) -> tuple[dict[str, str], dict[str, float]]:
    """Attributes and measures of a representation's segment addressing; chain runs from the root to it."""
    declared = next(([k for k in ADDRESSING if m.child(e, k) is not None] for e in reversed(chain) if any(m.child(e, k) is not None for k in ADDRESSING)), [])
    numbers: dict[str, float] = {"kinds": len(declared)}
    if len(declared) != 1:
        return {}, numbers
    kind = declared[0]
    found, line = m.inherited(chain, kind)
    found = dict(found) | {"kind": kind}
    holders = [c for e in chain if (c := m.child(e, kind)) is not None]
    urls = next((u for c in reversed(holders) if (u := m.children(c, "SegmentURL"))), [])
    start = next((i for c in reversed(holders) if (i := m.child(c, "Initialization")) is not None), None)
    found |= {f"init@{k}": v for k, v in start.attrib.items()} if start is not None else {}
    bases = [b for e in chain if (b := m.child(e, "BaseURL")) is not None]
    offsets = [found.get("availabilityTimeOffset", "0"), *(b.get("availabilityTimeOffset", "0") for b in bases)]
    if "availabilityTimeComplete" not in found:
        found |= next(({"availabilityTimeComplete": b.attrib["availabilityTimeComplete"]} for b in reversed(bases) if "availabilityTimeComplete" in b.attrib), {})

    def number(text: str | None, other: float) -> float:
        try:
            return float(text) if text is not None else other
        except ValueError:
            return float("nan")

    scale, length = number(found.get("timescale"), 1.0), number(found.get("duration"), 0.0)
    entries = m.children(line, "S")
    spans = [number(s.get("d"), 0.0) for s in entries]
    longest = length or max(spans, default=0.0)
    numbers |= {
        "timescale": scale, "duration": length, "entries": len(entries), "urls": len(urls), "nameless": sum(not u.get("media") for u in urls), "offset": sum(number(x, 0.0) for x in offsets),
        "bad": sum(not d > 0 or not number(s.get("r"), 0.0) >= -1 for s, d in zip(entries, spans, strict=True)), "seconds": longest / scale if scale > 0 and longest > 0 else float("nan"),
    }
    until = seconds * scale + number(found.get("presentationTimeOffset"), 0.0) if seconds is not None else None
    try:
        times = m.expand(line, until) if entries else []
        numbers["increasing"] = float(all(a[0] < b[0] for a, b in zip(times, times[1:], strict=False)))
        numbers["count"] = len(times) if entries else -(-(seconds or 0.0) * scale // length) if length > 0 and seconds is not None else len(urls) if length > 0 else -1
    except (ValueError, TypeError):
        numbers |= {"increasing": 0.0, "count": -1}
    return found, numbers


def read_elements(path: str, text: str | None) -> list[tuple]:
    """Rows of one manifest in document order; one row named by the error where it can't be read."""
    try:
        root = m.safe_xml(text or "")
    except ET.ParseError as e:
        return [(path, 0, -1, None, "error", "", {}, {}, {}, {}, str(e))]
    out: list[tuple] = []
    total = m.iso_seconds(root.get("mediaPresentationDuration"))
    periods, starts, at = m.children(root, "Period"), [], 0.0
    for n, p in enumerate(periods):  # a start is stated, or follows from the one before and its duration
        at = m.iso_seconds(p.get("start")) if p.get("start") is not None else at
        starts.append(at)
        length = m.iso_seconds(p.get("duration"))
        at = at + length if at is not None and length is not None else None

    def seconds(n: int) -> float | None:
        end = m.iso_seconds(periods[n].get("duration"))
        if end is not None or starts[n] is None:
            return end
        stop = starts[n + 1] if n + 1 < len(periods) else total
        return stop - starts[n] if stop is not None and stop >= starts[n] else None

    stack = [(root, -1, [], None)]
    while stack:
        e, parent, chain, period = stack.pop()
        name, node = m.local(e), len(out)
        period = periods.index(e) if name == "Period" and parent == 0 else period
        kids: dict[str, int] = {}
        for c in e:
            kids[m.local(c)] = kids.get(m.local(c), 0) + 1
        attrs = plain_attributes(e)
        numbers = {k: s for k in DURATIONS if name in ("MPD", "Period") and (s := m.iso_seconds(attrs.get(k))) is not None}
        if name == "Period" and period is not None and starts[period] is not None:
            numbers["resolved"] = starts[period]
        if name == "pssh":
            numbers["whole"] = float(whole_box(e.text or ""))
        up: dict[str, str] = {}
        for a in chain[2:]:
            up |= plain_attributes(a)
        up |= {f"@{m.local(a)}": a.get("id", "") for a in chain[1:]}
        kids["ancestors_protected"] = sum(c.get("schemeIdUri") == MP4_PROTECTION for a in [*chain[2:], e] for c in m.children(a, "ContentProtection"))
        kids["drm"] = sum((c.get("schemeIdUri") or "").startswith("urn:uuid:") for c in m.children(e, "ContentProtection"))
        kids["mp4protection"] = sum(c.get("schemeIdUri") == MP4_PROTECTION for c in m.children(e, "ContentProtection"))
        if name == "Representation" and period is not None:
            found, more = addressing([*chain, e], seconds(period))
            up |= {f"segment@{k}": v for k, v in found.items()}
            numbers |= more
            config = next((c for a in (e, *reversed(chain)) if (c := m.child(a, "AudioChannelConfiguration")) is not None), None)
            up |= {f"channels@{k}": v for k, v in config.attrib.items()} if config is not None else {}
        out.append((path, node, parent, period, name, e.tag.rpartition("}")[0].lstrip("{"), attrs, up, kids, numbers, (e.text or "").strip()))
        stack += [(c, node, [*chain, e], period) for c in reversed(e)]
    return out


def elements(docs: DataFrame) -> DataFrame:
    """Elements of manifests (path, text), a row each."""
    names = [x.split()[0] for x in ELEMENTS.split(", ")]

    def parse(batches):
        for rows in batches:
            for path, text in zip(rows["path"], rows["text"], strict=True):
                yield pd.DataFrame(read_elements(path, text), columns=names, dtype=object)

    return docs.select("path", "text").mapInPandas(parse, ELEMENTS)


def rules(profile: str) -> list[tuple[str, str, Column, Column]]:
    """(identifier, severity, the rows it is about, predicate); null counts as failed."""
    a = lambda k: F.col("attrs")[k]
    either = lambda k: F.coalesce(a(k), F.col("inherited")[k])
    seg, num = (lambda k: F.col("inherited")[f"segment@{k}"]), (lambda k: F.col("numbers")[k])
    kid = lambda k: F.coalesce(F.col("kids")[k], F.lit(0))
    whole = lambda k: a(k).try_cast("bigint")
    real = lambda k: a(k).try_cast("double")
    filled = lambda c: F.trim(c) != ""
    name = F.col("name")
    mpd, period, adaptation, rep = (name == n for n in ("MPD", "Period", "AdaptationSet", "Representation"))
    mpd &= F.col("parent") == -1
    dynamic, static = mpd & (a("type") == "dynamic"), mpd & (F.coalesce(a("type"), F.lit("static")) == "static")
    stamp = lambda c: c.rlike(DATE_TIME) & c.rlike(ZONED)
    audio = (F.coalesce(either("contentType"), F.lit("")) == "audio") | F.coalesce(either("mimeType"), F.lit("")).startswith("audio/")
    template, listed, based = (rep & (seg("kind") == k) for k in ADDRESSING)
    scheme = F.coalesce(a("schemeIdUri"), F.lit(""))
    protection = name == "ContentProtection"
    unique = F.col("twins") == 1
    basic = [
        ("DASH-MPD-ROOT", "error", F.col("parent") == -1, name == "MPD"), ("DASH-NAMESPACE", "error", mpd, F.col("namespace") == NAMESPACE), ("DASH-TYPE", "error", mpd, F.coalesce(a("type"), F.lit("static")).isin("static", "dynamic")),
        ("DASH-PERIOD", "error", mpd, kid("Period") > 0), ("DASH-STATIC-DURATION", "error", static, num("mediaPresentationDuration").isNotNull() | F.col("bounded")), ("DASH-DYNAMIC-TIMING", "error", dynamic, a("availabilityStartTime").rlike(DATE_TIME)),
        ("DASH-UPDATE-PERIOD", "warning", dynamic, num("minimumUpdatePeriod").isNotNull()), ("DASH-MIN-BUFFER-TIME", "error", mpd, num("minBufferTime") > 0),
        ("DASH-PERIOD-TIMELINE", "error", period & num("start").isNotNull() & F.col("before").isNotNull(), num("start") >= F.coalesce(F.col("before_numbers")["start"], F.lit(0.0)) + F.coalesce(F.col("before_numbers")["duration"], F.lit(0.0))),
        ("DASH-UNIQUE-PERIOD-ID", "error", period & a("id").isNotNull(), unique), ("DASH-ADAPTATION-SET", "error", period, kid("AdaptationSet") > 0), ("DASH-UNIQUE-ADAPTATION-ID", "error", adaptation & a("id").isNotNull(), unique),
        ("DASH-REPRESENTATION", "error", adaptation, kid("Representation") > 0), ("DASH-REPRESENTATION-ID", "error", rep, filled(a("id")) & unique), ("DASH-BANDWIDTH", "error", rep, whole("bandwidth") > 0),
        ("DASH-CONTENT-TYPE", "error", rep, either("mimeType").isNotNull() | either("contentType").isNotNull()), ("DASH-AUDIO-CODEC", "error", rep & audio, filled(either("codecs"))),
        ("DASH-AUDIO-SAMPLE-RATE", "warning", rep & audio, either("audioSamplingRate").try_cast("bigint") > 0), ("DASH-AUDIO-CHANNEL-CONFIG", "warning", rep & audio, filled(F.col("inherited")["channels@schemeIdUri"]) & filled(F.col("inherited")["channels@value"])),
        ("DASH-SEGMENT-ADDRESSING", "error", rep, num("kinds") == 1), ("DASH-TIMESCALE", "error", rep & (num("kinds") == 1), num("timescale") > 0), ("DASH-MEDIA-TEMPLATE", "error", template, filled(seg("media"))),
        ("DASH-SEGMENT-DURATION", "error", template | listed, (num("duration") > 0) | (num("entries") > 0)), ("DASH-TIMELINE-ENTRY", "error", (template | listed) & (num("entries") > 0), num("bad") == 0),
        ("DASH-TIMELINE-EXPANSION", "error", template & (num("entries") > 0), num("increasing") == 1), ("DASH-SEGMENT-LIST", "error", listed, num("urls") > 0), ("DASH-SEGMENT-LIST-COUNT", "error", listed, num("count") == num("urls")),
        ("DASH-SEGMENT-URL", "error", listed & (num("urls") > 0), num("nameless") == 0), ("DASH-SEGMENT-BASE-INDEX", "warning" if profile == "dash" else "error", based, seg("indexRange").rlike(r"^\d+-\d+$")),
        ("DASH-SEGMENT-BASE-INITIALIZATION", "warning" if profile == "dash" else "error", based, seg("init@range").rlike(r"^\d+-\d+$")),
    ]
    interop = [
        ("DASHIF-PROFILE-DECLARATION", "warning", mpd, a("profiles").contains("dashif.org/")), ("DASHIF-AUDIO-LANGUAGE", "warning", adaptation & audio, filled(a("lang"))),
        ("DASHIF-SEGMENT-BASE-INITIALIZATION", "error", based, seg("init@sourceURL").isNull()),
    ]
    delay, depth, early = num("suggestedPresentationDelay"), num("timeShiftBufferDepth"), rep & (seg("availabilityTimeComplete") == "false")
    target = F.col("latency") / 1000
    live = [
        ("DASH-LIVE-TYPE", "error", mpd, a("type") == "dynamic"), ("DASH-LIVE-AVAILABILITY-ANCHOR", "error", mpd, stamp(a("availabilityStartTime"))), ("DASH-LIVE-PUBLISH-TIME", "warning", mpd, stamp(a("publishTime"))),
        ("DASH-LIVE-UPDATE-PERIOD", "error", mpd, num("minimumUpdatePeriod") > 0), ("DASH-LIVE-BUFFER-DEPTH", "error", mpd, a("timeShiftBufferDepth").isNull() | (depth > 0)), ("DASHIF-AVAILABILITY-WINDOW", "warning", mpd, depth.isNotNull()),
        ("DASHIF-PRESENTATION-DELAY", "error", mpd & delay.isNotNull(), (delay > 0) & (depth.isNull() | (delay < depth))), ("DASHIF-PRESENTATION-DELAY", "warning", mpd, delay.isNotNull()),
        ("DASH-LIVE-UTC-TIMING", "error", mpd, kid("UTCTiming") > 0), ("DASH-LIVE-UTC-TIMING", "error", name == "UTCTiming", unique & scheme.isin(CLOCKS) & F.when(scheme == CLOCKS[3], stamp(a("value"))).otherwise(a("value").rlike("^https?://"))),
        ("DASH-LIVE-PERIOD-RESOLUTION", "error", period, num("resolved").isNotNull() & F.coalesce(num("resolved") + 1e-9 >= F.col("before_numbers")["resolved"] + F.coalesce(F.col("before_numbers")["duration"], F.lit(0.0)), F.lit(True))),
        ("DASH-LIVE-PRODUCER-REFERENCE-TIME", "error", name == "ProducerReferenceTime", whole("id").isNotNull() & unique & F.coalesce(a("type"), F.lit("encoder")).isin("encoder", "captured") & (a("wallClockTime").isNull() | stamp(a("wallClockTime"))) & (a("wallClockTime").isNull() == a("presentationTime").isNull()) & ((F.coalesce(a("inband"), F.lit("")) == "true") | a("wallClockTime").isNotNull())),
        ("DASH-LIVE-SERVICE-DESCRIPTION", "error", (name == "ServiceDescription") & a("id").isNotNull(), unique),
        ("DASH-LIVE-SERVICE-DESCRIPTION", "error", name == "Latency", (whole("target") > 0) & (a("min").isNull() | (whole("min") <= whole("target"))) & (a("max").isNull() | (whole("target") <= whole("max"))) & (a("referenceId").isNull() | F.array_contains("producers", a("referenceId")))),
        ("DASH-LIVE-SERVICE-DESCRIPTION", "error", name == "PlaybackRate", (a("min").isNull() | ((real("min") > 0) & (real("min") <= 1))) & (a("max").isNull() | (real("max") >= 1))),
        ("DASH-LL-SERVICE-DESCRIPTION", "error", mpd & F.col("incomplete"), F.col("latency") > 0), ("DASHIF-LL-PRODUCER-REFERENCE-TIME", "warning", mpd & F.col("incomplete"), F.size("producers") > 0),
        ("DASH-EVENT-STREAM", "error", name == "EventStream", filled(scheme) & (F.coalesce(whole("timescale"), F.when(a("timescale").isNull(), 1)) > 0)),
        ("DASH-EVENT-ORDER", "error", (name == "Event") & F.col("before").isNotNull(), F.coalesce(F.col("before")["presentationTime"].try_cast("bigint"), F.lit(0)) <= F.coalesce(whole("presentationTime"), F.lit(0))),
        ("DASH-EVENT-ID", "error", name == "Event", (a("id").isNull() | unique) & (F.coalesce(whole("presentationTime"), F.lit(0)).cast("decimal(38,0)") + F.coalesce(whole("duration"), F.lit(0)) < F.lit(2**63 - 1).cast("decimal(38,0)"))),
        ("DASH-CONTENT-PROTECTION-SET", "error", adaptation | rep, (kid("mp4protection") <= 1) & ((kid("drm") == 0) | (kid("ancestors_protected") > 0))),
        ("DASH-CONTENT-PROTECTION-SCHEME", "error", protection, unique & scheme.contains(":") & (~scheme.startswith("urn:uuid:") | scheme.rlike(f"^urn:uuid:{UUID}$"))),
        ("DASH-CENC-DEFAULT-KID", "error", protection, F.when(scheme == MP4_PROTECTION, a("value").isin(ENCRYPTION) & (a("default_KID").isNull() | a("default_KID").rlike(rf"^\s*{UUID}(\s+{UUID})*\s*$"))).otherwise(a("default_KID").isNull())),
        ("DASHIF-CENC-DEFAULT-KID", "warning", protection & (scheme == MP4_PROTECTION), a("default_KID").isNotNull()), ("DASH-CENC-PSSH", "error", name == "pssh", num("whole") == 1),
        ("DASH-LIVE-AVAILABILITY-OFFSET", "error", rep & (num("kinds") == 1), (num("offset") >= 0) & ~F.isnan(num("offset"))), ("DASH-LIVE-SEGMENT-BASE-COMPLETE", "error", based, F.coalesce(seg("availabilityTimeComplete"), F.lit("true")) != "false"),
        ("DASH-LL-AVAILABILITY", "error", early, (num("offset") > 0) & ~F.isnan(num("seconds")) & (num("offset") < num("seconds"))), ("DASH-LL-MEDIA-TEMPLATE", "error", early & template, seg("media").contains("$Number") != seg("media").contains("$Time")),
        ("DASH-LL-LATENCY-GEOMETRY", "error", early, ~F.isnan(num("seconds")) & (num("seconds") < target) & (num("seconds") - num("offset") < target)), ("DASHIF-LL-SEGMENT-DURATION", "warning", early, (num("seconds") <= target / 2 + 1e-9) & (num("seconds") >= 0.96)),
    ]
    return basic + (interop if profile != "dash" else []) + (live if profile == "live" else [])


def element_findings(docs: DataFrame, profile: str = "dash") -> DataFrame:
    """2.11: (path, node, element, rule_id, severity, passed) of manifests (path, text). A null, empty or broken text fails the rule of the root."""
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}")
    name, attrs, numbers = F.col("name"), F.col("attrs"), F.col("numbers")
    of_path, siblings = Window.partitionBy("path"), Window.partitionBy("path", "parent", "name").orderBy("node")
    whole_document = name.isin("Period", "UTCTiming", "ProducerReferenceTime", "ServiceDescription")
    within = F.when(whole_document, F.lit(-1)).when(name == "Representation", F.col("period")).otherwise(F.col("parent"))
    identity = F.when(name == "ContentProtection", F.lower(attrs["schemeIdUri"])).when(name == "UTCTiming", F.concat_ws("\n", attrs["schemeIdUri"], attrs["value"])).otherwise(attrs["id"])
    rows = elements(docs).withColumn("within", within).withColumn("identity", identity)
    last = F.max(F.when(name == "Period", F.struct("node", numbers["duration"].alias("duration")))).over(of_path)["duration"]
    unstarted = F.sum(F.when((name == "Period") & (F.col("before").isNotNull()) & numbers["start"].isNull(), 1).otherwise(0)).over(of_path)
    rows = rows.withColumn("twins", F.count("*").over(Window.partitionBy("path", "name", "within", "identity"))).withColumns({"before": F.lag("attrs").over(siblings), "before_numbers": F.lag("numbers").over(siblings)})
    rows = rows.withColumns({
        "bounded": F.coalesce(last.isNotNull() & (unstarted == 0), F.lit(False)), "latency": F.min(F.when(name == "Latency", attrs["target"].try_cast("bigint"))).over(of_path),
        "producers": F.collect_set(F.when(name == "ProducerReferenceTime", attrs["id"])).over(of_path), "incomplete": F.coalesce(F.bool_or(F.col("inherited")["segment@availabilityTimeComplete"] == "false").over(of_path), F.lit(False)),
    })
    each = [F.when(about, F.struct(F.lit(f"AQ-{rule}").alias("rule_id"), F.lit(severity).alias("severity"), F.coalesce(ok, F.lit(False)).alias("passed"))) for rule, severity, about, ok in rules(profile)]
    return rows.select("path", "node", F.col("name").alias("element"), F.explode(F.array_compact(F.array(*each))).alias("r")).select("path", "node", "element", "r.*")


KEPT = ("Period", "AdaptationSet", "Representation")
UPDATES = ("TYPE", "ID", "AVAILABILITY-START", "PUBLISH-TIME", "IDENTITY", "PERIOD-ORDER", "PERIOD-TIMING", "ADAPTATION-ORDER", "REPRESENTATION-SET", "FUNCTIONAL-EQUIVALENCE", "SEGMENT-EQUIVALENCE")


def moment(c: Column) -> Column:
    return F.when(c.rlike(DATE_TIME), c.try_cast("timestamp"))


def kept_elements(found: DataFrame) -> DataFrame:
    """Elements that have an identity in their parent: their place among its children, and what may not change."""
    attrs, up = F.col("attrs"), F.col("inherited")
    either = lambda k: F.coalesce(attrs[k], up[k]).alias(k)
    same = F.when(F.col("name") == "AdaptationSet", F.array(attrs["contentType"], attrs["lang"])).when(
        F.col("name") == "Representation", F.array(attrs["bandwidth"], either("mimeType"), either("codecs"), either("audioSamplingRate"), up["channels@schemeIdUri"], up["channels@value"])
    )
    rows = found.where(F.col("name").isin(*KEPT)).withColumn("scope", F.concat_ws("\n", up["@Period"], up["@AdaptationSet"]))
    place = F.row_number().over(Window.partitionBy("path", "name", "scope").orderBy("node"))
    return rows.select("path", "name", "scope", attrs["id"].alias("id"), place.alias("place"), F.col("numbers")["resolved"].alias("start"), same.alias("same"))


def update_findings(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, rule_id, passed): what may not change between two snapshots (path, text) of each presentation, matched by path.

    A path that only one table has gives no rows; where a document can't be read, the rules of the root fail.
    """
    old, new = elements(previous), elements(current)
    root = lambda df, k: df.where("parent = -1").select("path", *[F.col("attrs")[x].alias(f"{k}_{x}") for x in ("id", "availabilityStartTime", "publishTime")], F.when(F.col("name") == "MPD", F.coalesce(F.col("attrs")["type"], F.lit("static"))).alias(f"{k}_type"))
    roots = root(old, "a").join(root(new, "b"), "path")
    checks = [
        ("TYPE", (F.col("a_type") == "dynamic") & F.col("b_type").isin("dynamic", "static")), ("ID", F.col("a_id").isNull() | (F.col("a_id") == F.col("b_id"))),
        ("AVAILABILITY-START", F.col("a_availabilityStartTime").eqNullSafe(F.col("b_availabilityStartTime"))), ("PUBLISH-TIME", moment(F.col("b_publishTime")) > moment(F.col("a_publishTime"))),
        *[(rule, F.lit(True)) for rule in UPDATES[4:]],
    ]
    found = roots.select("path", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks])).alias("r")).select("path", "r.*")
    keys = ["path", "name", "scope", "id"]
    before, after = kept_elements(old), kept_elements(new)
    for side in (before, after):
        found = found.union(side.groupBy(*keys).count().select("path", F.lit("IDENTITY"), F.coalesce((F.col("id") != "") & (F.col("count") == 1), F.lit(False))))
    both = before.join(after.select(*keys, F.col("place").alias("place2"), F.col("start").alias("start2"), F.col("same").alias("same2")), keys)
    ordered = F.coalesce(F.lag("place2").over(Window.partitionBy("path", "name", "scope").orderBy("place", "place2")) <= F.col("place2"), F.lit(True))
    for n, rule in (("Period", "PERIOD-ORDER"), ("AdaptationSet", "ADAPTATION-ORDER")):
        found = found.union(both.where(F.col("name") == n).select("path", F.lit(rule), ordered))
    found = found.union(both.where("name = 'Period'").select("path", F.lit("PERIOD-TIMING"), F.coalesce(F.abs(F.col("start") - F.col("start2")) < 1e-6, F.col("start").eqNullSafe(F.col("start2")))))
    found = found.union(both.where("name <> 'Period'").select("path", F.lit("FUNCTIONAL-EQUIVALENCE"), F.col("same").eqNullSafe(F.col("same2"))))
    # the representations of one adaptation set, in order
    listed = lambda df, k: df.where("name = 'Representation'").groupBy("path", "scope").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias(k))
    sets = both.where("name = 'AdaptationSet'").select("path", F.concat_ws("\n", "scope", "id").alias("scope")).join(listed(before, "x"), ["path", "scope"], "left").join(listed(after, "y"), ["path", "scope"], "left")
    found = found.union(sets.select("path", F.lit("REPRESENTATION-SET"), F.col("x").eqNullSafe(F.col("y"))))
    at = ["path", "period", "representation", "number"]
    segments = m.segments(previous).where("number IS NOT NULL").join(m.segments(current).select(*at, F.col("time").alias("time2"), F.col("duration").alias("duration2"), F.col("uri").alias("uri2")), at)
    found = found.union(segments.select("path", F.lit("SEGMENT-EQUIVALENCE"), (F.col("time") == F.col("time2")) & (F.col("duration") == F.col("duration2")) & F.col("uri").eqNullSafe(F.col("uri2"))))
    known = found.join(roots.select("path"), "path", "left_semi")
    return known.groupBy("path", F.concat(F.lit("AQ-DASH-UPDATE-"), "rule").alias("rule_id")).agg(F.bool_and("passed").alias("passed"))


def successive_findings(snapshots: DataFrame) -> DataFrame:
    """update_findings() of each snapshot (path, presentation, taken, text) against the one before it of the same presentation."""
    pairs = snapshots.withColumn("previous", F.lag("text").over(Window.partitionBy("presentation").orderBy("taken", "path")))
    first = F.row_number().over(Window.partitionBy("presentation").orderBy("taken", "path"))
    pairs = pairs.withColumn("nth", first).where("nth > 1")
    return update_findings(pairs.select("path", F.col("previous").alias("text")), pairs.select("path", "text"))


PATCHED = "path string, text string, error string, base map<string,string>, patch map<string,string>, result map<string,string>"


def patched(pairs: DataFrame) -> DataFrame:
    """Documents (path, text) with their patches (operations) applied; text is null and error set where one doesn't apply."""
    names = [x.split()[0] for x in PATCHED.split(", ")]

    def apply(batches):
        for rows in batches:
            out = []
            for path, text, operations in zip(rows["path"], rows["text"], rows["operations"], strict=True):
                try:
                    base, change = (plain_attributes(m.safe_xml(x or "")) for x in (text, operations))
                    done = m.patch(text, operations)
                    out.append((path, done, None, base, change, plain_attributes(m.safe_xml(done))))
                except (ET.ParseError, ValueError) as e:
                    out.append((path, None, str(e), {}, {}, {}))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return pairs.select("path", "text", "operations").mapInPandas(apply, PATCHED)


def patch_findings(pairs: DataFrame) -> DataFrame:
    """2.11: whether patches (path, text, operations) apply, belong to their documents, and move their time on."""
    base, patch, result = F.col("base"), F.col("patch"), F.col("result")
    first, then = moment(patch["originalPublishTime"]), moment(patch["publishTime"])
    checks = [
        ("APPLIES", F.col("error").isNull()), ("MPD-ID", base["id"] == patch["mpdId"]), ("ORIGINAL-PUBLISH-TIME", moment(base["publishTime"]) == first), ("PUBLISH-TIME", then > first), ("RESULT-PUBLISH-TIME", moment(result["publishTime"]) == then),
    ]
    return patched(pairs).select("path", F.explode(F.array(*[F.struct(F.lit(f"AQ-DASH-PATCH-{n}").alias("rule_id"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks])).alias("r")).select("path", "r.*")
