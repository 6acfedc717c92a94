"""Ordered-sequence operators: runs, greedy coalescing, hysteresis, merging, contiguity, wrap-around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, keys: list[str], order: str, holds: Column) -> DataFrame:
    """Rows where `holds`, numbered by `run` within keys: consecutive rows share it."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("pos", F.row_number().over(w)).withColumn("holds", F.coalesce(holds, F.lit(False)))
    marked = marked.where("holds").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    return marked.drop("holds")


def runs(rows: DataFrame, keys: list[str], order: str, holds: Column, least: int, *measures: Column) -> DataFrame:
    """(keys, start_frame, end_frame, length, measures) of runs of at least `least` rows; the last one counts too."""
    found = islands(rows, keys, order, holds).groupBy(*keys, "run")
    return found.agg(F.min(order).alias("start_frame"), (F.max(order) + 1).alias("end_frame"), F.count("*").alias("length"), *measures).where(F.col("length") >= least).drop("run")


def equal_runs(rows: DataFrame, keys: list[str], order: str, value: str, least: int) -> DataFrame:
    """Runs of bit-identical values."""
    w = Window.partitionBy(*keys).orderBy(order)
    found = rows.withColumn("new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    found = found.groupBy(*keys, "run").agg(F.min(order).alias("start_frame"), F.count("*").alias("length"), F.first(value).alias("value"))
    return found.where(F.col("length") >= least).drop("run")


def interior_runs(rows: DataFrame, keys: list[str], order: str, holds: Column, least: int, most: int) -> DataFrame:
    """Dropouts: runs of least..most rows that neither start with the first row nor end with the last."""
    ends = rows.groupBy(*keys).agg(F.min(order).alias("first_row"), (F.max(order) + 1).alias("last_row"))
    found = runs(rows, keys, order, holds, least).where(F.col("length") <= most).join(ends, keys)
    return found.where("start_frame > first_row AND end_frame < last_row").drop("first_row", "last_row")


def coalesce_greedy(rows: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """Keep a candidate unless one kept before lies less than `gap` behind.

    A candidate `gap` or more behind its predecessor is always kept, so only the candidates of one
    dense cluster are gathered and folded.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cluster = F.sum(F.when(F.col(order) - F.lag(order).over(w) < gap, 0).otherwise(1)).over(w)
    grouped = rows.withColumn("cluster", cluster).groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(order)).alias("at"))

    def keep(acc, x):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (x - F.when(F.size(acc) > 0, last) >= gap), F.concat(acc, F.array(x))).otherwise(acc)

    kept = F.aggregate("at", F.array().cast("array<bigint>"), lambda acc, x: keep(acc, x.cast("bigint")))
    return grouped.select(*keys, F.explode(kept).alias(order))


def hysteresis(rows: DataFrame, keys: list[str], order: str, score: str, enter: float, slack: float) -> DataFrame:
    """(order, active): active from a score >= enter while scores stay >= enter - slack, one lower row forgiven.

    State can only start at a row >= enter and survives at most one low row, so two low rows in a
    row end any state: segments between such pairs are folded on their own.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    low = (F.col(score) < enter - slack).cast("int")
    cut = F.sum(F.when((low == 1) & (F.lag(low, 1, 1).over(w) == 1), 1).otherwise(0)).over(w)
    grouped = rows.withColumn("segment", cut).groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("rows"))

    def step(acc, x):
        high, mid = x[score] >= enter, x[score] >= enter - slack
        on = F.when(acc["on"], mid | ~acc["grace"]).otherwise(high)
        grace = acc["on"] & ~mid & ~acc["grace"]
        return F.struct(on.alias("on"), grace.alias("grace"), F.concat(acc["out"], F.array(on)).alias("out"))

    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("grace"), F.array().cast("array<boolean>").alias("out"))
    flags = F.aggregate("rows", start, step, lambda acc: acc["out"])
    return grouped.select(*keys, F.explode(F.arrays_zip(F.col("rows").alias("r"), flags.alias("a"))).alias("x")).select(*keys, F.col(f"x.r.{order}").alias(order), F.col("x.a").alias("active"))


def merge_ranges(rows: DataFrame, keys: list[str], start: str, end: str, gap: float, *measures: Column) -> DataFrame:
    """Ranges merged where the next one starts at most `gap` after the furthest end so far."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col(start) <= reach + gap, 0).otherwise(1)).withColumn("merged", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "merged").agg(F.min(start).alias("range_start"), F.max(end).alias("range_end"), F.count("*").alias("parts"), *measures).drop("merged")


def contiguity(rows: DataFrame, keys: list[str], order: str, step: int = 1) -> DataFrame:
    """(keys, n, first, last, breaks): rows whose value is not the one before plus `step`."""
    w = Window.partitionBy(*keys).orderBy(order)
    broken = F.col(order) - F.lag(order).over(w) != step
    return rows.withColumn("broken", F.coalesce(broken, F.lit(False))).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(order).alias("first_no"), F.max(order).alias("last_no"), F.count_if("broken").alias("breaks")
    )


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at or under each bound, in one pass without a row per bound."""
    counts = rows.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("total"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return counts.select(F.explode(pairs).alias("x")).select("x.le", "x.n")


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """O2: the first `most` events of each key and whether more were dropped; a bounded report, not a filter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= most + 1)
    return ranked.withColumn("truncated", F.max("rank_no").over(Window.partitionBy(*keys)) > most).where(F.col("rank_no") <= most)
