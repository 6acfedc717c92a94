"""HLS playlists as rows of lines, with the rules about tags, their order and their attributes.

Everything is native: a playlist's text is split into numbered lines, windows over the lines give each
its context (the segment it belongs to, the tag that waits for a URI, the parts before it), and rules are predicates on
these rows. A window holds the lines of one playlist, never more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAGMENTED = r"\.(m4s|mp4|m4a|cmfa)$"
DATE_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?$"
PROFILES = ("hls", "apple", "low-latency")
#: Tags that a playlist has at most once. Fixed values of the public format.
SINGLE = ["EXT-X-VERSION", "EXT-X-MEDIA-SEQUENCE", "EXT-X-DISCONTINUITY-SEQUENCE", "EXT-X-TARGETDURATION", "EXT-X-PART-INF", "EXT-X-SERVER-CONTROL", "EXT-X-PLAYLIST-TYPE", "EXT-X-SKIP", "EXT-X-ENDLIST"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text, tag, value) of each line that isn't blank, from every playlist under a path; tag is null for a URI."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return lines_of(files.select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def lines_of(playlists: DataFrame) -> DataFrame:
    """read_lines() of a table (path, text). A null or blank text gives one row with an empty line, so that it fails as well."""
    text = F.coalesce("text", F.lit(""))
    rows = playlists.select("path", F.posexplode(F.split(F.when(F.trim(text) == "", F.lit("")).otherwise(text), "\r?\n")).alias("line", "text"))
    rows = rows.select("path", (F.col("line") + 1).alias("line"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("line = 1 OR text <> ''")
    tag = F.when(F.col("text").startswith("#"), F.regexp_extract("text", r"^#(EXT[A-Z0-9-]*)", 1)).when(F.col("text") == "", F.lit(""))
    return rows.select("path", "line", "text", tag.alias("tag"), F.regexp_extract("text", r"^#EXT[A-Z0-9-]*:(.*)$", 1).alias("value"))


def raw(name: str) -> Column:
    """An attribute as written; null if there is none."""
    return F.get(F.regexp_extract_all("value", F.lit(rf'^(?:(?:[^",]++|"[^"]*+")*+,)*?\s*{name}=("[^"]*+"|[^",]*+)'), 1), F.lit(0))


def attribute(name: str) -> Column:
    return F.regexp_replace(raw(name), '^"|"$', "")


def quoted(name: str) -> Column:
    """An attribute has text between quotes."""
    return F.coalesce(raw(name).rlike('^"[^"]+"$'), F.lit(False))


def positive(name: str) -> Column:
    """An attribute's number; null unless it is above zero."""
    number = attribute(name).try_cast("double")
    return F.when((number > 0) & (number < float("inf")), number)


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def absent_or(name: str, ok: Column) -> Column:
    return raw(name).isNull() | true(ok)


def whole(name: str) -> Column:
    return attribute(name).rlike(r"^\d{1,19}$")


def is_tag(*names: str) -> Column:
    return true(F.col("tag").isin(*["EXT" + n for n in names]))


def context(lines: DataFrame) -> DataFrame:
    """Lines with what comes before and after them in their playlist."""
    order = Window.partitionBy("path").orderBy("line")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    inside = Window.partitionBy("path", "segment").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("path")
    count = lambda c, w: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0))
    duration = F.split("value", ",")[0].try_cast("double")
    seconds = F.when(is_tag("INF") & (duration > 0) & (duration < float("inf")), duration)
    holder = F.when(F.col("tag").isNull(), "uri").when(is_tag("INF") & seconds.isNotNull(), "EXTINF").when(is_tag("-X-STREAM-INF"), "EXT-X-STREAM-INF")
    out = lines.select("*", seconds.alias("seconds"), holder.alias("holder"))
    out = out.select("*", F.last("holder", ignorenulls=True).over(before).alias("waiting"), count(is_tag("INF"), before).alias("segment"))
    part = F.struct("segment", attribute("URI").alias("uri"), raw("BYTERANGE").isNotNull().alias("range"))
    span, same = attribute("BYTERANGE"), F.last(F.when(is_tag("-X-PART"), part), ignorenulls=True).over(before)
    offset = span.contains("@") | ((same["segment"] == F.col("segment")) & (same["uri"] == attribute("URI")) & same["range"])
    good = (
        (true(F.col("waiting") != "EXTINF") | F.col("waiting").isNull()) & quoted("URI") & positive("DURATION").isNotNull()
        & absent_or("INDEPENDENT", attribute("INDEPENDENT") == "YES") & absent_or("GAP", attribute("GAP") == "YES")
        & absent_or("BYTERANGE", quoted("BYTERANGE") & span.rlike(r"^\d+(@\d+)?$") & offset)
    )
    out = out.select("*", (is_tag("-X-PART") & true(good)).alias("part"))
    follower = F.first(F.when(F.col("part"), F.struct("segment", true(attribute("GAP") == "YES").alias("gap"))), ignorenulls=True).over(after)
    return out.select(
        "*", count(F.col("part"), inside).alias("parts_before"), count(is_tag("-X-DISCONTINUITY"), inside).alias("breaks_before"), count(is_tag("-X-DISCONTINUITY"), before).alias("breaks"),
        count(F.col("tag").isNull() | F.col("part"), before).alias("media_before"), follower.alias("follower"), F.count("seconds").over(every).alias("segments"),
        F.max(F.when(is_tag("-X-PART-INF"), positive("PART-TARGET"))).over(every).alias("part_target"),
    )


def line_rules(profile: str) -> list[tuple[str, str, Column, Column]]:
    """(rule, severity, lines it is about, verdict)."""
    yes = lambda n: absent_or(n, attribute(n) == "YES")
    kind, seconds, target = attribute("TYPE"), positive("DURATION"), F.col("part_target")
    last = (F.col("segment") < F.col("segments")) & (F.col("follower").isNull() | (F.col("follower.segment") != F.col("segment")))
    gap_next = (F.col("follower.segment") == F.col("segment")) & F.col("follower.gap")
    short = true(attribute("INDEPENDENT") == "YES") | true(attribute("GAP") == "YES") | true(last) | true(gap_next)
    rendition = F.when(kind == "CLOSED-CAPTIONS", raw("URI").isNull()).when(kind == "SUBTITLES", raw("URI").isNotNull()).otherwise(kind.isin("AUDIO", "VIDEO"))
    relative = quoted("URI") & ~attribute("URI").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)")
    rules = [
        ("HLS-ORPHAN-URI", "error", F.col("tag").isNull(), F.col("waiting").isin("EXTINF", "EXT-X-STREAM-INF")),
        ("HLS-EXTINF", "error", is_tag("INF"), F.col("seconds").isNotNull()),
        ("HLS-DISCONTINUITY-SEQUENCE-ORDER", "error", is_tag("-X-DISCONTINUITY-SEQUENCE"), (F.col("media_before") == 0) & (F.col("breaks") == 0)),
        ("HLS-DISCONTINUITY-PLACEMENT", "error", is_tag("-X-DISCONTINUITY"), ~true(F.col("waiting") == "EXTINF") & (F.col("breaks_before") == 0) & (F.col("parts_before") == 0)),
        ("HLS-PART-INF", "error", is_tag("-X-PART-INF"), positive("PART-TARGET").isNotNull()),
        ("HLS-PART", "error", is_tag("-X-PART"), F.col("part")),
        ("HLS-PART-DURATION", "error", F.col("part"), (seconds <= target) & ((seconds >= 0.85 * target) | short)),
        ("HLS-PART-TAG-ORDER", "error", is_tag("-X-PROGRAM-DATE-TIME", "-X-KEY", "-X-MAP"), F.col("parts_before") == 0),
        ("HLS-SERVER-CONTROL", "error", is_tag("-X-SERVER-CONTROL"), yes("CAN-SKIP-DATERANGES") & yes("CAN-BLOCK-RELOAD") & absent_or("CAN-SKIP-UNTIL", positive("CAN-SKIP-UNTIL") > 0) & absent_or("HOLD-BACK", positive("HOLD-BACK") > 0) & absent_or("PART-HOLD-BACK", positive("PART-HOLD-BACK") > 0)),
        ("HLS-DELTA-UPDATE", "error", is_tag("-X-SKIP"), whole("SKIPPED-SEGMENTS") & absent_or("RECENTLY-REMOVED-DATERANGES", raw("RECENTLY-REMOVED-DATERANGES").startswith('"'))),
        ("HLS-PRELOAD-HINT", "error", is_tag("-X-PRELOAD-HINT"), (kind != "") & quoted("URI") & absent_or("BYTERANGE-START", whole("BYTERANGE-START")) & absent_or("BYTERANGE-LENGTH", whole("BYTERANGE-LENGTH") & ~attribute("BYTERANGE-LENGTH").rlike("^0+$"))),
        ("HLS-PRELOAD-HINT-TYPE", "warning", is_tag("-X-PRELOAD-HINT"), kind.isin("PART", "MAP")),
        ("HLS-RENDITION-REPORT", "error", is_tag("-X-RENDITION-REPORT"), relative & absent_or("LAST-MSN", whole("LAST-MSN")) & absent_or("LAST-PART", whole("LAST-PART"))),
        ("HLS-PROGRAM-DATE-TIME", "error", is_tag("-X-PROGRAM-DATE-TIME"), F.col("value").rlike(DATE_TIME) & F.try_to_timestamp("value").isNotNull()),
        ("HLS-PROGRAM-DATE-TIME-PRECISION", "warning", is_tag("-X-PROGRAM-DATE-TIME"), F.col("value").rlike(r"\.\d{3,}(Z|[+-]\d\d:?\d\d)$")),
        ("HLS-STREAM-INF", "error", is_tag("-X-STREAM-INF"), whole("BANDWIDTH") & ~attribute("BANDWIDTH").rlike("^0+$")),
        ("HLS-MEDIA-RENDITION", "error", is_tag("-X-MEDIA"), rendition & raw("GROUP-ID").isNotNull() & raw("NAME").isNotNull() & (~true(attribute("DEFAULT") == "YES") | true(attribute("AUTOSELECT") == "YES"))),
    ]
    if profile == "apple":
        rules.append(("APPLE-HLS-CODECS", "error", is_tag("-X-STREAM-INF"), raw("CODECS").isNotNull()))
    return rules


def playlist_rules(profile: str) -> list[tuple[str, str, Column, Column]]:
    """(rule, severity, playlists it is about, verdict) over summary()'s columns."""
    media, live = F.col("media"), (F.col("parts") > 0) & ~F.col("ended")
    target, part, skip, hold, part_hold = (F.col(c) for c in ("target", "part_target", "skip_until", "hold_back", "part_hold_back"))
    low = F.col("low_latency") | F.lit(profile == "low-latency")
    bounds = (skip.isNull() | target.isNull() | (skip >= 6 * target)) & (~F.col("skip_dates") | skip.isNotNull()) & (hold.isNull() | target.isNull() | (hold >= 3 * target)) & (part.isNull() | true(part_hold >= 2 * part))
    rules = [
        ("HLS-EXTM3U", "error", F.lit(True), F.col("header")),
        ("HLS-PLAYLIST-KIND", "error", F.lit(True), media != F.col("multivariant")),
        ("HLS-SINGLE-TAGS", "error", F.lit(True), ~F.col("repeated")),
        ("HLS-DANGLING-TAG", "error", F.lit(True), F.col("closed")),
        ("HLS-SEGMENTS", "error", media, F.col("segments") > 0),
        ("HLS-TARGET-DURATION", "error", media, (target > 0) & (F.coalesce("longest", F.lit(0.0)) <= target)),
        ("HLS-FMP4-MAP", "error", media, ~F.col("fragmented") | F.col("mapped")),
        ("HLS-PROTOCOL-VERSION", "error", media, ~F.col("fragmented") | (F.col("version") >= 6)),
        ("HLS-PLAYLIST-TYPE", "error", media, F.col("kind").isNull() | (F.col("kind") == "EVENT") | ((F.col("kind") == "VOD") & F.col("ended"))),
        ("HLS-PART-TARGET", "error", media & low, (F.col("parts") == 0) | part.isNotNull()),
        ("HLS-SERVER-CONTROL-RELATIONSHIPS", "error", media & low, bounds),
        ("HLS-PRELOAD-HINT-SET", "warning", media & low, F.col("hints") == F.col("hint_kinds")),
        ("HLS-PRELOAD-ENDLIST", "error", media & low, ~F.col("ended") | (F.col("hints") == 0)),
        ("HLS-DELTA-VERSION", "error", media & F.col("skipped"), F.col("version") >= F.when(F.col("removed"), 10).otherwise(9)),
    ]
    if profile == "apple":
        rules += [
            ("APPLE-HLS-SIX-SECOND-TARGET", "warning", media, target == 6),
            ("APPLE-HLS-SEGMENT-DURATION", "error", media, F.coalesce("longest_exact", F.lit(0.0)) <= target + 0.5),
        ]
    if profile == "low-latency":
        rules += [
            ("LL-HLS-PARTS", "error", media, (F.col("parts") > 0) & part.isNotNull()),
            ("LL-HLS-PRELOAD", "error", media, ~live | F.col("part_hint")),
            ("LL-HLS-PROGRAM-DATE-TIME", "error", media, F.col("dates") > 0),
            ("LL-HLS-BLOCKING-RELOAD", "error", media, F.col("blocking")),
            ("LL-HLS-PART-HOLD-BACK", "warning", media, part_hold >= 3 * part),
            ("LL-HLS-I-FRAMES", "warning", media, ~F.col("i_frames") | (F.col("parts") == 0)),
        ]
    return rules


def summary(lines: DataFrame) -> DataFrame:
    """One row a playlist from context()'s lines."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    of = lambda tag, c: F.max(F.when(is_tag(tag), c))
    hint = is_tag("-X-PRELOAD-HINT") & quoted("URI") & true(attribute("TYPE") != "")
    single = [(F.count_if(F.col("tag") == t) > 1) for t in SINGLE]
    repeated = single[0]
    for s in single[1:]:
        repeated |= s
    return lines.groupBy("path").agg(
        some((F.col("line") == 1) & (F.col("text") == "#EXTM3U")).alias("header"), some(is_tag("INF", "-X-TARGETDURATION", "-X-PART")).alias("media"), some(is_tag("-X-STREAM-INF", "-X-MEDIA")).alias("multivariant"), repeated.alias("repeated"),
        true(F.max_by("holder", F.when(F.col("holder").isNotNull(), F.col("line"))) == "uri").alias("closed_uri"), (F.count("holder") == 0).alias("no_holder"),
        (F.max(F.when(is_tag("-X-DISCONTINUITY"), F.col("line"))) > F.coalesce(F.max(F.when(F.col("tag").isNull(), F.col("line"))), F.lit(0))).alias("open_break"),
        F.count_if(F.col("tag").isNull() & (F.col("waiting") == "EXTINF")).alias("segments"), of("-X-TARGETDURATION", F.col("value").try_cast("double")).alias("target"), F.max(F.floor(F.col("seconds") + 0.5)).cast("double").alias("longest"), F.max("seconds").alias("longest_exact"),
        some(is_tag("-X-MAP") | (F.col("tag").isNull() & F.col("text").rlike(FRAGMENTED))).alias("fragmented"), some(is_tag("-X-MAP") & raw("URI").isNotNull()).alias("mapped"), of("-X-VERSION", F.col("value").try_cast("int")).alias("version"),
        of("-X-PLAYLIST-TYPE", F.col("value")).alias("kind"), some(is_tag("-X-ENDLIST")).alias("ended"), F.count_if("part").alias("parts"), F.max("part_target").alias("part_target"),
        some(is_tag("-X-PART", "-X-PART-INF", "-X-SERVER-CONTROL", "-X-SKIP", "-X-PRELOAD-HINT", "-X-RENDITION-REPORT")).alias("low_latency"),
        of("-X-SERVER-CONTROL", positive("CAN-SKIP-UNTIL")).alias("skip_until"), of("-X-SERVER-CONTROL", positive("HOLD-BACK")).alias("hold_back"), of("-X-SERVER-CONTROL", positive("PART-HOLD-BACK")).alias("part_hold_back"),
        some(is_tag("-X-SERVER-CONTROL") & (attribute("CAN-SKIP-DATERANGES") == "YES")).alias("skip_dates"), some(is_tag("-X-SERVER-CONTROL") & (attribute("CAN-BLOCK-RELOAD") == "YES")).alias("blocking"),
        F.count_if(hint).alias("hints"), F.count_distinct(F.when(hint, attribute("TYPE"))).alias("hint_kinds"), some(hint & (attribute("TYPE") == "PART")).alias("part_hint"),
        some(is_tag("-X-SKIP") & whole("SKIPPED-SEGMENTS")).alias("skipped"), some(is_tag("-X-SKIP") & raw("RECENTLY-REMOVED-DATERANGES").isNotNull()).alias("removed"),
        F.count_if(is_tag("-X-PROGRAM-DATE-TIME") & F.col("value").rlike(DATE_TIME)).alias("dates"), some(is_tag("-X-I-FRAMES-ONLY")).alias("i_frames"),
    ).withColumn("closed", (F.col("closed_uri") | F.col("no_holder")) & ~true(F.col("open_break")))


def findings(lines: DataFrame, profile: str = "hls") -> DataFrame:
    """2.11: (path, line, rule_id, severity, passed), a row for each rule and what it is about; line is null for rules on a whole playlist.

    profile is one of `PROFILES`; the last two add their own rules. A part whose byte range has no offset
    is held against the part line before it, valid or not.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile {profile!r} is none of {PROFILES}")
    verdict = lambda rules: F.explode(F.array_compact(F.array(*[F.when(about, F.struct(F.lit(f"AQ-{n}").alias("rule_id"), F.lit(s).alias("severity"), true(ok).alias("passed"))) for n, s, about, ok in rules]))).alias("r")
    rows = context(lines)
    single = rows.select("path", "line", verdict(line_rules(profile))).select("path", "line", "r.*")
    per = summary(rows).select("path", F.lit(None).cast("int").alias("line"), verdict(playlist_rules(profile))).select("path", "line", "r.*")
    return single.unionByName(per)
