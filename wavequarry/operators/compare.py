"""Comparison of manifests, measurement sets and packet legs; referential integrity; keyed upserts and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import drop_written, written


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """Rows with an error raised, when run, for a key that occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def manifest_diff(base: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    """Assets missing from the candidate (error) and new in it (note)."""
    b, c = base.select(F.col(key).alias("b")), cand.select(F.col(key).alias("c"))
    out = b.join(c, F.col("b") == F.col("c"), "full_outer").where("b IS NULL OR c IS NULL")
    return out.select(F.coalesce("b", "c").alias(key), F.when(F.col("c").isNull(), "AQ-ASSET-MISSING").otherwise("AQ-ASSET-NEW").alias("rule_id"), F.when(F.col("c").isNull(), "error").otherwise("note").alias("severity"))


def metric_drift(base: DataFrame, cand: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """Metrics that differ by more than their tolerance or lost their evidence."""
    long = lambda df, name: df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name), F.lit(t).alias("tolerance")) for m, t in tolerances.items()])).alias("x")).select(key, "x.*")
    b, c = long(base, "base"), long(cand, "cand").drop("tolerance")
    both = b.join(c, [key, "metric"])
    gone = F.col("base").isNotNull() & F.col("cand").isNull()
    drift = F.abs(F.col("cand") - F.col("base")) > F.col("tolerance")
    return both.where(gone | drift).select(key, "metric", "base", "cand", F.when(gone, "AQ-EVIDENCE-MISSING").otherwise("AQ-METRIC-DRIFT").alias("rule_id"))


def field_changes(base: DataFrame, cand: DataFrame, key: str, exact: list[str], passes: list[str]) -> DataFrame:
    """Format fields that changed, verdicts that fail now and did not before, and either kind lost.

    exact are fields that must be equal, passes boolean ones. A field that the base lacks is no change;
    a verdict that the base lacks and the candidate fails is a new failure. Both sides are joined once, as wide rows.
    """
    fields = [*exact, *passes]
    both = base.select(key, F.struct(*fields).alias("b")).join(cand.select(key, F.struct(*fields).alias("c")), key)
    found = []
    for name in fields:
        b, c = F.col("b")[name], F.col("c")[name]
        new = F.when(b != c, "AQ-FORMAT-CHANGED") if name in exact else F.when(~c & F.coalesce(b, F.lit(True)), "AQ-NEW-FAILURE")
        rule = F.when(b.isNotNull() & c.isNull(), "AQ-EVIDENCE-MISSING").otherwise(new)
        found.append(F.when(rule.isNotNull(), F.struct(F.lit(name).alias("metric"), b.cast("string").alias("base"), c.cast("string").alias("cand"), rule.alias("rule_id"))))
    return both.select(key, F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.*")


def verdict_diff(base: DataFrame, cand: DataFrame, keys: list[str], kind: str = "QC") -> DataFrame:
    """Rules that pass in the base and fail or lack in the candidate; a null verdict in the base is none. kind is QC or CONTAINER-QC."""
    joined = base.where("passed").join(cand.withColumnRenamed("passed", "cand_passed").withColumn("there", F.lit(True)), keys, "left").where("there IS NULL OR NOT coalesce(cand_passed, false)")
    return joined.select(*keys, F.when(F.col("there").isNull(), f"AQ-{kind}-EVIDENCE-MISSING").otherwise(f"AQ-NEW-{kind}-FAILURE").alias("rule_id"))


def missing_references(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose reference is not null and has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(column) == F.col("_parent"), "left_anti")


def merge_legs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Packets of either leg, which of them had it, and the time between."""
    x = a.select(*keys, F.col("arrival").alias("arrival_a"))
    y = b.select(*keys, F.col("arrival").alias("arrival_b"))
    both = x.join(y, keys, "full_outer")
    leg = F.when(F.col("arrival_b").isNull(), "a").when(F.col("arrival_a").isNull(), "b").otherwise("both")
    return both.select(*keys, leg.alias("leg"), (F.col("arrival_b") - F.col("arrival_a")).alias("skew"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the latest of table and changes; the table's id stays."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    first_id = F.min(F.when(F.col("_new") == 0, F.col("id"))).over(w)
    latest = both.withColumn("_id", first_id).withColumn("_n", F.row_number().over(w.orderBy(F.desc("_new"), F.desc(order))))
    return latest.where("_n = 1").withColumn("id", F.coalesce("_id", "id")).drop("_n", "_new", "_id")


def probe_cache(requests: DataFrame, cache: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """Hit, repaired (entry there but not valid) or stored (none)."""
    c = cache.select(*keys, valid.alias("valid")).dropDuplicates(keys)
    out = requests.join(c, keys, "left")
    return out.withColumn("disposition", F.when(F.col("valid"), "hit").when(F.col("valid").isNotNull(), "repaired").otherwise("stored")).drop("valid")


def evict(entries: DataFrame, size: str, order: list[str], budget: int, protect: Column) -> DataFrame:
    """O3: entries dropped oldest first until what is left fits the budget; protected ones stay.

    The running sum is taken per day first and within the one day on which it passes the excess, so
    no single task orders the whole table.
    """
    total = entries.agg(F.sum(size).alias("total"))
    days = entries.where(~protect).groupBy(F.col(order[0]).alias("_day")).agg(F.sum(size).alias("_sum"))
    before = days.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    rows = entries.where(~protect).join(before, F.col(order[0]) == F.col("_day")).crossJoin(F.broadcast(total))
    own = F.coalesce(F.sum(size).over(Window.partitionBy(order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_ahead", F.col("_before") + own).where(F.col("total") - F.col("_ahead") > budget).drop("_day", "_before", "_ahead", "total")


def owners(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, depth, root, cyclic): the last owner above each node and the steps to it; null for nodes on or below a cycle.

    By doubling: after k joins each node knows its ancestor 2**k steps up, so the number of joins is the
    logarithm of the greatest depth. Each is written, or the plan would double as well. Of several
    owners of a node the smallest counts.
    """
    state = edges.groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("ancestor")).where("ancestor IS NOT NULL")
    state = written(state.select("node", "ancestor", F.lit(1).cast("long").alias("depth")), "owners")
    nodes, steps = state.count(), 1
    while True:
        up = state.select(F.col("node").alias("mid"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        joined = state.join(up, F.col("ancestor") == F.col("mid"), "left")
        before, state = state, written(joined.select("node", F.coalesce("next", "ancestor").alias("ancestor"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("open")), "owners")
        drop_written(before)
        steps *= 2
        # a chain without a cycle has no more steps than there are nodes: one join later only cycles still grow
        if steps > 2 * nodes or state.where("open").isEmpty():
            known = lambda c: F.when(~F.col("open"), F.col(c))
            return state.select(F.col("node").alias(child), known("depth").alias("depth"), known("ancestor").alias("root"), F.col("open").alias("cyclic"))
        state = state.drop("open")


def zip_audits(reports: DataFrame, audits: DataFrame, key: str, report_order: str, audit_order: str) -> DataFrame:
    """Reports with the audit at the same place of the same manifest: (reports' columns, position, audits' columns, mismatched).

    A manifest without audits has none; one whose numbers of reports and audits differ is mismatched, and gets none either.
    Manifests that have audits only give no rows.
    """
    order = lambda c: Window.partitionBy(key).orderBy(c)
    extra = [c for c in audits.columns if c != key]
    own = reports.withColumns({"position": F.row_number().over(order(report_order)), "_reports": F.count("*").over(Window.partitionBy(key))})
    theirs = audits.withColumn("position", F.row_number().over(order(audit_order)))
    sizes = audits.groupBy(key).agg(F.count("*").alias("_audits"))
    j = own.join(sizes, key, "left").join(theirs, [key, "position"], "left")
    equal = F.col("_audits") == F.col("_reports")
    return j.withColumns({**{c: F.when(equal, F.col(c)) for c in extra}, "mismatched": F.coalesce(~equal, F.lit(False))}).drop("_reports", "_audits")
