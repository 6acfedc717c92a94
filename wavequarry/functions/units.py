"""Scalar signal and unit functions as Column expressions; silence is minus infinity, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of ITU-R BS.1770 and EBU Tech 3341/3342.
LOUDNESS_OFFSET = -0.691
ABSOLUTE_GATE = 10 ** ((-70 + 0.691) / 10)
HALF_POWER = 0.7071067811865476


def minus_infinity() -> Column:
    return F.lit("-Infinity").cast("double")


def lufs(ms: Column) -> Column:
    """Mean square to LUFS, minus infinity for none."""
    return F.when(ms > 0, F.lit(LOUDNESS_OFFSET) + 10 * F.log10(ms)).otherwise(minus_infinity())


def mean_square(loudness: Column) -> Column:
    return F.pow(F.lit(10.0), (loudness - LOUDNESS_OFFSET) / 10)


def amplitude_db(a: Column) -> Column:
    """Amplitude to dB."""
    return F.when(a > 0, 20 * F.log10(a)).otherwise(minus_infinity())


def power_db(p: Column, floor: float = 1e-30) -> Column:
    """Power to dB with a floor."""
    return 10 * F.log10(F.greatest(p, F.lit(floor)))


def compare_db(a: Column) -> Column:
    """P4, comparison form: floor 1e-15, clamped to +-300."""
    return F.greatest(F.lit(-300.0), F.least(F.lit(300.0), 20 * F.log10(F.greatest(a, F.lit(1e-15)))))


def db_to_linear(db: Column) -> Column:
    """P5: null where the result is not a positive finite float."""
    x = F.pow(F.lit(10.0), db / 20)
    return F.when((x > 0) & (x <= 3.4028234663852886e38), x)


def channel_weight(role: Column, azimuth: Column, elevation: Column) -> Column:
    """BS.1770 weights; a positioned channel counts as surround between 60 and 120 degrees near the ear's height."""
    side = (F.abs(elevation) < 30) & F.abs(azimuth).between(60, 120)
    return (
        F.when(role == "main", 1.0).when(role == "surround", 1.41).when(role == "dual_mono", 2.0).when(role == "lfe", 0.0)
        .when((role == "positioned") & side, 1.41).when(role == "positioned", 1.0)
    )


def smoothstep(t: Column, a: Column, b: Column) -> Column:
    """A to b in dB as t goes from 0 to 1."""
    return a + (b - a) * t * t * (3 - 2 * t)


def gain_clip(samples: Column, gain: Column, ceiling: float = 1.0) -> Column:
    """X * gain, clipped, over an array."""
    return F.transform(samples, lambda x: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), x.cast("double") * gain)))


def finite(x: Column) -> Column:
    """Evidence tables hold null for what is not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(finite(x.cast("double")), digits) + F.lit(0.0)  # no negative zero


def wrap16(delta: Column) -> Column:
    """Distance modulo 2**16."""
    return F.pmod(delta, F.lit(65536))


def replay_gain(loudness: Column) -> Column:
    """ReplayGain 2 tag text."""
    return F.format_string("%+.2f dB", F.lit(-18.0) - loudness)


def r128_gain(loudness: Column, reference: float = -23.0) -> Column:
    """R128_TRACK_GAIN, Q7.8."""
    return F.round((F.lit(reference) - loudness) * 256).cast("int")


def redact_uri(uri: Column) -> Column:
    """Drop user information, query and fragment."""
    return F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"://[^/@]*@", "://")


def iso_duration_seconds(text: Column) -> Column:
    """PnDTnHnMnS to seconds; null where it isn't one."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i, scale: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double"), F.lit(0.0)) * scale
    return F.when(text.rlike(pattern) & ~text.rlike(r"(^P|T)$"), part(1, 86400) + part(2, 3600) + part(3, 60) + part(4, 1))


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_tai_version(text: Column) -> Column:
    """Seconds:nanoseconds."""
    return text.rlike(r"^[0-9]+:[0-9]+$")


def expand_template(template: Column, values: dict[str, Column]) -> Column:
    """DASH $Name$ and $Name%0Nd$ identifiers; $$ is a dollar sign."""
    out = F.replace(template, F.lit("$$"), F.lit("\x00"))
    for name, value in values.items():
        width = F.regexp_extract(out, rf"\${name}%0(\d+)d\$", 1)
        padded = F.when(width == "", value.cast("string")).otherwise(F.lpad(value.cast("string"), F.coalesce(F.nullif(width, F.lit("")).cast("int"), F.lit(1)), F.lit("0")))
        out = F.replace(F.regexp_replace(out, F.lit(rf"\${name}%0\d+d\$"), padded), F.lit(f"${name}$"), value.cast("string"))
    return F.replace(out, F.lit("\x00"), F.lit("$"))
