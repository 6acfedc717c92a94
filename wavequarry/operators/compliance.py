"""Compliance rules, verdict roll-ups, gain planning and remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import db_to_linear


def rules_of(profiles: DataFrame) -> DataFrame:
    """(profile, basis, metric, minimum, maximum, maximum_inclusive): a row for each bound that a profile has."""
    none = F.lit(None).cast("double")
    rule = lambda name, has, low, high, strict=False: F.when(F.col(has).isNotNull(), F.struct(F.lit(name).alias("metric"), low.alias("minimum"), high.alias("maximum"), F.lit(not strict).alias("maximum_inclusive")))
    rules = F.array_compact(
        F.array(
            rule("integrated_lufs", "target", F.col("target") - F.col("lower_tol"), F.col("target") + F.col("upper_tol")),
            rule("max_loudness", "max_loudness", none, F.col("max_loudness")),
            rule("true_peak_dbtp", "max_true_peak", none, F.col("max_true_peak")),
            rule("max_short_term_lufs", "max_short_term", none, F.col("max_short_term")),
            rule("ldr", "max_ldr", none, F.col("max_ldr")),
            rule("plr", "plr_below", none, F.col("plr_below"), True),
        )
    )
    return profiles.select("profile", "basis", F.explode(rules).alias("r")).select("profile", "basis", "r.*")


def evaluate(measured: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per asset, profile and rule that the profile has; a null bound is no rule.

    `profiles` is the profile dimension (a score of rows, some forty rules): it is crossed with the
    assets on purpose. The result has many times the input's rows, so a table of fewer partitions
    than there are cores is dealt out first.
    """
    cores = measured.sparkSession.sparkContext.defaultParallelism
    if measured.rdd.getNumPartitions() < cores:
        measured = measured.repartition(cores)
    loud, talk, peak = F.col("integrated_lufs"), F.col("dialogue_lufs"), F.col("true_peak_dbtp")
    basis = F.when(F.col("basis") == "dialogue", talk).otherwise(loud)
    metric = F.col("metric")
    value = F.when(metric == "true_peak_dbtp", peak).when(metric == "max_short_term_lufs", F.col("max_short_term_lufs")).when(metric == "ldr", loud - talk).when(metric == "plr", peak - loud).otherwise(basis)
    out = measured.crossJoin(F.broadcast(rules_of(profiles))).select("asset", "profile", "metric", value.alias("measured"), "minimum", "maximum", "maximum_inclusive")
    m = F.col("measured")
    upper = F.when(F.col("maximum_inclusive"), m <= F.col("maximum")).otherwise(m < F.col("maximum"))
    ok = F.coalesce((F.col("minimum").isNull() | (m >= F.col("minimum"))) & (F.col("maximum").isNull() | upper), F.lit(False))
    return out.withColumn("passed", ok & m.isNotNull() & ~F.isnan(F.coalesce(m, F.lit(0.0))))


def rule_id(metric: Column) -> Column:
    """Identifier of a compliance metric."""
    return F.concat(F.lit("AQ-COMPLIANCE-"), F.upper(F.replace(metric, F.lit("_"), F.lit("-"))))


def gain_plan(loudness: Column, peak_db: Column, target: float, ceiling_db: float, max_gain_db: float) -> Column:
    """Linear gain to a target, held under the true-peak ceiling and the largest gain; unity where it makes no sense."""
    want = F.least(F.lit(target) - loudness, F.lit(ceiling_db) - peak_db, F.lit(max_gain_db))
    return F.coalesce(F.when(F.isnan(want), F.lit(1.0)).otherwise(db_to_linear(want)), F.lit(1.0))


def verified(loudness: Column, target: float, tolerance: float, peak: Column, ceiling: float, slack: float) -> Column:
    """Within tolerance of the target and under the ceiling; equal infinities do not deviate."""
    deviation = F.when(loudness == F.lit(target), 0.0).otherwise(F.abs(loudness - target))
    return (deviation <= tolerance) & (peak <= ceiling + slack)


def shared_interval(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The gains that suit every row of a key, and the quietest feasible one; null where there is none."""
    out = rows.groupBy(*keys).agg(F.max(low).alias("lowest"), F.min(high).alias("highest"), F.count("*").alias("assets"))
    return out.withColumn("shared_gain", F.when(F.col("lowest") <= F.col("highest"), F.greatest("lowest", F.least(F.lit(0.0), "highest"))))


def boundary_gains(segments: DataFrame, key: str, order: list[str], desired: str, safe: str) -> DataFrame:
    """Gain at each boundary of neighbouring segments: the mean, as far as both can take it."""
    w = Window.partitionBy(key).orderBy(*order)
    n = segments.withColumn("next_desired", F.lead(desired).over(w)).withColumn("next_safe", F.lead(safe).over(w)).where("next_desired IS NOT NULL")
    return n.withColumn("boundary_gain", F.least((F.col(desired) + F.col("next_desired")) / 2, F.col(safe), F.col("next_safe")))


def remediation(measured: DataFrame, target: float, max_gain: float, ceiling: float, max_lra: float) -> DataFrame:
    """What would bring an asset to its target, and why it might not; ranges of short assets give no verdict."""
    gain = F.greatest(F.lit(-max_gain), F.least(F.lit(max_gain), F.lit(target) - F.col("integrated_lufs")))
    out = measured.withColumn("gain_db", gain).withColumn("peak_after", F.col("true_peak_dbtp") + F.col("gain_db"))
    stable = F.col("duration_seconds") >= 60
    actions = F.array_compact(
        F.array(
            F.when(F.abs("gain_db") > 0.05, F.lit("static-gain")), F.when(F.col("peak_after") > ceiling, F.lit("true-peak-limiter")), F.when(stable & (F.col("lra") > max_lra), F.lit("range-compressor"))
        )
    )
    reasons = F.array_compact(F.array(F.when(F.abs(target - F.col("integrated_lufs")) > max_gain, F.lit("gain-limit")), F.when(F.col("peak_after") > ceiling + 6, F.lit("limiting-over-6-db"))))
    return out.withColumns({"actions": actions, "reasons": reasons, "feasible": F.size(reasons) == 0, "lra_ok": F.when(stable, F.col("lra") <= max_lra)})
