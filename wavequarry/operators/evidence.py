"""Evidence over measurements: codec and normalisation drift, detector scores, provider audits, batches, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sequence


def codec_qc(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Dialnorm against dialogue or programme loudness; drift against a reference, duration to one sample."""
    basis = F.coalesce("dialogue_lufs", "integrated_lufs")
    deviation = basis - F.col("dialnorm")
    drift = F.col("integrated_lufs") - F.col("reference_lufs")
    near = lambda x, t: F.coalesce(F.abs(x) <= t, F.lit(False))
    trip = near(drift, tolerance) & near(F.col("true_peak_dbtp") - F.col("reference_peak"), tolerance) & near(F.col("duration_seconds") - F.col("reference_seconds"), 1 / F.col("sample_rate"))
    return rows.withColumns({
        "loudness_basis": F.when(F.col("dialogue_lufs").isNotNull(), "dialogue").otherwise("programme"), "dialnorm_deviation": deviation,
        "dialnorm_pass": F.abs(deviation) <= tolerance, "loudness_drift": drift, "roundtrip_pass": F.when(F.col("reference_lufs").isNotNull(), trip),
    })


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def dialogue_confidence(rms: Column, floor: Column, focus: Column, zcr: Column, band: Column, modulation: Column, periodicity: Column) -> Column:
    """Weighted speech evidence of a quarter-second frame. The breakpoints are fixed values."""
    energy = F.least(clamp((rms + 55.0) / 30.0) + clamp((rms - floor - 3.0) / 15.0), F.lit(1.0))
    crossings = clamp(zcr / 0.005) * clamp((0.30 - zcr) / 0.10)
    return 0.30 * energy + 0.20 * focus + 0.20 * clamp((band - 0.15) / 0.55) + 0.10 * crossings + 0.10 * clamp(modulation / 6.0) + 0.10 * clamp((periodicity - 0.10) / 0.65)


def score_events(scores: DataFrame, hop: float, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """Frames whose class score and severity reach the class's thresholds, merged while they follow each other.

    scores: asset, frame, scores (confidence and severity of each class in turn).
    """
    classes = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(2 * i).alias("at"), F.lit(c).alias("c"), F.lit(s).alias("s")) for i, (k, (c, s)) in enumerate(thresholds.items())])
    each = scores.select("asset", "frame", "scores", F.explode(classes).alias("k")).select("asset", "frame", "k.kind", F.get("scores", F.col("k.at")).alias("confidence"), F.get("scores", F.col("k.at") + 1).alias("severity"), "k.c", "k.s")
    w = Window.partitionBy("asset", "kind").orderBy("frame")
    hits = each.where("confidence >= c AND severity >= s").withColumn("run", F.col("frame") - F.row_number().over(w))
    out = hits.groupBy("asset", "kind", "run").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.max("confidence").alias("confidence"), F.max("severity").alias("severity"))
    return out.select("asset", "kind", (F.col("f0") * hop).alias("start_seconds"), ((F.col("f1") + 1) * hop).alias("end_seconds"), "confidence", "severity")


def provider_audit(events: DataFrame, threshold: float) -> DataFrame:
    """Per asset and kind what a provider found, what passes the threshold, and whether segments are in order."""
    w = Window.partitionBy("asset", "kind").orderBy("start_seconds", "end_seconds")
    e = events.withColumn("overlap", F.coalesce(F.lag("end_seconds").over(w) > F.col("start_seconds"), F.lit(False)))
    chosen = F.col("confidence") >= threshold
    return e.groupBy("asset", "kind").agg(
        F.count("*").alias("found"), F.count_if(chosen).alias("selected"), F.coalesce(F.sum(F.when(chosen, F.col("end_seconds") - F.col("start_seconds"))), F.lit(0.0)).alias("selected_seconds"), (~F.bool_or("overlap")).alias("in_order")
    )


def resume(state: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    """U4: what a resumed batch does with each asset: skip, run, or stop because an output changed."""
    joined = state.join(outputs.select("asset", F.col("sha256").alias("actual")), "asset", "left")
    changed = F.col("status").eqNullSafe("completed") & F.col("actual").isNotNull() & (F.col("actual") != F.col("output_sha256"))
    action = F.when(changed, F.lit("run" if overwrite else "error")).when((F.col("status") == "completed") & F.col("actual").isNotNull(), "skip").otherwise("run")
    return joined.select("asset", "status", action.alias("action"))


def lifecycle(results: DataFrame, job: str, order: str) -> DataFrame:
    """Numbered events of each job: started, one per asset, completed unless one failed."""
    w = Window.partitionBy(job).orderBy(order)
    assets = results.select(job, F.row_number().over(w).alias("sequence"), F.when(F.col("ok"), "asset_completed").otherwise("asset_failed").alias("event"), F.col("asset").cast("string").alias("asset"))
    per = results.groupBy(job).agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))
    none = F.lit(None).cast("string").alias("asset")
    started = per.select(job, F.lit(0).alias("sequence"), F.lit("job_started").alias("event"), none)
    done = per.where("ok").select(job, (F.col("n") + 1).cast("int").alias("sequence"), F.lit("job_completed").alias("event"), none)
    return assets.union(started).union(done)


def migrate(manifests: DataFrame, document: str = "document") -> DataFrame:
    """Version 1 and 2 documents to 3 without losing unknown fields; idempotent. document: JSON object as a map of texts."""
    m = F.from_json(document, "map<string,string>")
    version = F.coalesce(F.element_at(m, F.lit("version")).cast("int"), F.lit(1))
    defaults = F.create_map(F.lit("layer"), F.lit("baseband"), F.lit("calculated"), F.lit("true"), F.lit("events_truncated"), F.lit("false"))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(m, k))
    kept = F.map_filter(m, lambda k, v: k != "version")
    return manifests.withColumns({"from_version": version, "changed": version < 3, "migrated": F.when(version < 3, F.map_concat(kept, missing, F.create_map(F.lit("version"), F.lit("3")))).otherwise(m)})


def violated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Names of the constraints that a row breaks; null counts as broken."""
    return rows.withColumn("violated", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def changed_snapshots(snapshots: DataFrame, subject: str, order: str, digest: str) -> DataFrame:
    """Successive snapshots of a document that differ, or whose publication time does not advance."""
    w = Window.partitionBy(subject).orderBy(order)
    return snapshots.withColumns({"previous": F.lag(digest).over(w), "previous_at": F.lag("published").over(w)}).where("previous IS NOT NULL").select(
        subject, order, (F.col(digest) != F.col("previous")).alias("changed"), (F.col("published") > F.col("previous_at")).alias("advances")
    )


def limiter_intervals(gains: DataFrame, frames: int) -> DataFrame:
    """Mean and largest gain reduction per interval."""
    return gains.groupBy("asset", F.floor(F.col("frame") / frames).cast("long").alias("interval")).agg(F.avg("reduction").alias("mean_db"), F.max("reduction").alias("max_db"), F.count("*").alias("n"))


def merged_selection(frames: DataFrame, hop: float) -> DataFrame:
    """Selected frames to ranges with duration-weighted confidence."""
    rows = sequence.islands(frames, ["asset"], "frame", F.col("selected"))
    out = rows.groupBy("asset", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.avg("confidence").alias("confidence"))
    return out.select("asset", (F.col("a") * hop).alias("start_seconds"), ((F.col("b") - F.col("a") + 1) * hop).alias("duration_seconds"), "confidence")
