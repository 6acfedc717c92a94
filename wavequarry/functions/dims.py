"""Dimension tables: layouts, downmix matrices, delivery profiles, presets and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .units import HALF_POWER

#: Channel labels and roles of the named layouts, in order: label, role, azimuth, elevation.
LAYOUTS = {
    "mono": [("M", "main", 0, 0)],
    "stereo": [("L", "main", 30, 0), ("R", "main", -30, 0)],
    "5.1": [("L", "main", 30, 0), ("R", "main", -30, 0), ("C", "main", 0, 0), ("LFE", "lfe", 0, -30), ("Ls", "surround", 110, 0), ("Rs", "surround", -110, 0)],
    "7.1": [
        ("L", "main", 30, 0), ("R", "main", -30, 0), ("C", "main", 0, 0), ("LFE", "lfe", 0, -30),
        ("Lss", "positioned", 90, 0), ("Rss", "positioned", -90, 0), ("Lrs", "positioned", 135, 0), ("Rrs", "positioned", -135, 0),
    ],
    "7.1.4": [
        ("L", "main", 30, 0), ("R", "main", -30, 0), ("C", "main", 0, 0), ("LFE", "lfe", 0, -30),
        ("Lss", "positioned", 90, 0), ("Rss", "positioned", -90, 0), ("Lrs", "positioned", 135, 0), ("Rrs", "positioned", -135, 0),
        ("Ltf", "positioned", 45, 45), ("Rtf", "positioned", -45, 45), ("Ltb", "positioned", 135, 45), ("Rtb", "positioned", -135, 45),
    ],
}

#: Downmix coefficients by output and input label. Half power for centre and surrounds.
DOWNMIX = {
    "stereo": {
        "L": {"L": 1.0, "C": HALF_POWER, "Ls": HALF_POWER, "Lss": HALF_POWER, "Lrs": HALF_POWER, "Ltf": HALF_POWER, "Ltb": HALF_POWER},
        "R": {"R": 1.0, "C": HALF_POWER, "Rs": HALF_POWER, "Rss": HALF_POWER, "Rrs": HALF_POWER, "Rtf": HALF_POWER, "Rtb": HALF_POWER},
    },
    "5.1": {
        "L": {"L": 1.0, "Ltf": HALF_POWER},
        "R": {"R": 1.0, "Rtf": HALF_POWER},
        "C": {"C": 1.0},
        "LFE": {"LFE": 1.0},
        "Ls": {"Ls": 1.0, "Lss": HALF_POWER, "Lrs": HALF_POWER, "Ltb": HALF_POWER},
        "Rs": {"Rs": 1.0, "Rss": HALF_POWER, "Rrs": HALF_POWER, "Rtb": HALF_POWER},
    },
}

#: Fixed values of published delivery specifications: name, basis, target, lower and upper tolerance,
#: maximum loudness, maximum true peak, maximum short-term, maximum loudness-to-dialogue ratio, exclusive maximum PLR.
PROFILES = [
    ("ebu-r128", "programme", -23.0, 0.2, 0.2, None, -1.0, None, None, None),
    ("ebu-r128-live", "programme", -23.0, 1.0, 1.0, None, -1.0, None, None, None),
    ("ebu-r128-creative", "programme", None, None, None, -22.8, -1.0, None, None, None),
    ("ebu-r128-s3-radio", "programme", -23.0, 0.2, 0.2, None, -1.0, None, None, None),
    ("ebu-r128-s2-streaming", "programme", -23.0, 0.2, 0.2, None, -1.0, None, None, None),
    ("ebu-r128-s2-streaming-adapted", "programme", -18.0, 0.2, 0.2, None, -1.0, None, None, None),
    ("ebu-r128-s2-music-low-plr", "programme", -16.0, 0.2, 0.2, None, -1.0, None, None, 15.0),
    ("streaming-music", "programme", -14.0, 1.0, 1.0, None, -1.0, None, None, None),
    ("streaming-speech-stereo", "programme", -16.0, 1.0, 1.0, None, -1.0, None, None, None),
    ("streaming-speech-mono", "programme", -19.0, 1.0, 1.0, None, -1.0, None, None, None),
    ("ebu-r128-short", "programme", -23.0, 0.2, 0.2, None, -1.0, -18.0, None, None),
    ("ebu-r128-cinematic", "programme", -23.0, 0.2, 0.2, None, -1.0, None, 5.0, None),
    ("atsc-a85-short", "programme", -24.0, 2.0, 2.0, None, -2.0, None, None, None),
    ("atsc-a85-long", "dialogue", -24.0, 2.0, 2.0, None, -2.0, None, None, None),
    ("arib-tr-b32", "programme", -24.0, 1.0, 1.0, None, -1.0, None, None, None),
    ("arib-tr-b32-creative", "programme", None, None, None, -23.0, -1.0, None, None, None),
    ("aes77-assorted", "programme", -18.0, None, 2.0, None, -1.0, None, None, None),
    ("aes77-music-track", "programme", -16.0, 0.2, 0.2, None, -1.0, None, None, None),
    ("aes77-interstitial", "programme", -18.0, 0.2, 0.2, None, -1.0, None, None, None),
]
PROFILE_COLUMNS = ["profile", "basis", "target", "lower_tol", "upper_tol", "max_loudness", "max_true_peak", "max_short_term", "max_ldr", "plr_below"]
PROFILE_SCHEMA = "profile string, basis string, " + ", ".join(f"{c} double" for c in PROFILE_COLUMNS[2:])

#: Fixed values of published or customary presets: name, target, ceiling.
PRESETS = [
    ("spotify", -14.0, -1.0), ("apple-music", -16.0, -1.0), ("youtube", -14.0, -1.0), ("podcast-stereo", -16.0, -1.0),
    ("podcast-mono", -19.0, -1.0), ("ebu-r128", -23.0, -1.0), ("atsc-a85", -24.0, -2.0), ("arib-tr-b32", -24.0, -1.0),
]

#: What a failed metric asks for, in our own words.
REMEDIES = {
    "integrated_lufs": "Change the static gain so that the programme lies in the target range.",
    "max_loudness": "Lower the static gain until the programme is at or below the limit.",
    "true_peak_dbtp": "Lower the gain or limit peaks with a true-peak limiter.",
    "max_short_term_lufs": "Reduce the loudest passages.",
    "plr": "Restore dynamics: peaks lie too close to the programme loudness or too far from it.",
    "ldr": "Raise the dialogue or lower what surrounds it.",
}


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def layout(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(LAYOUTS[name])], "channel int, label string, role string, azimuth int, elevation int")


def downmix(spark: SparkSession, name: str) -> DataFrame:
    rows = [(o, i, c) for o, own in DOWNMIX[name].items() for i, c in own.items()]
    return spark.createDataFrame(rows, "out_label string, in_label string, coef double")


def values(rows, kinds: str = "") -> str:
    """Rows as a SQL VALUES list."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) if not isinstance(v, float) else f"{v!r}::DOUBLE"
    return "(VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows) + ")"
