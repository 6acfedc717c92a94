"""Watch folders: files that have kept their fingerprint long enough, across listings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "size long, modified long, first_seen long, status string"
OUTPUT = "path string, size_bytes long, modified_ns long, first_seen_ms long, observed_ms long, status string"


def observe(stable_ms: int):
    """Observing until size and time have not changed for stable_ms; then completed, once."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        size, modified, first, status = state.get if state.exists else (None, None, None, "new")
        out = []
        for r in pd.concat(list(batches)).sort_values("observed_ms").itertuples(index=False):
            if (r.size_bytes, r.modified_ns) != (size, modified):
                size, modified, first, status = r.size_bytes, r.modified_ns, r.observed_ms, "observing"
                out.append((key[0], size, modified, first, r.observed_ms, status))
            elif status == "observing" and r.observed_ms - first >= stable_ms:
                status = "completed"
                out.append((key[0], size, modified, first, r.observed_ms, status))
        state.update((int(size), int(modified), int(first), status))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return step


def watch(listings: DataFrame, stable_ms: int) -> DataFrame:
    """Changes of status. listings (streaming): path, size_bytes, modified_ns, observed_ms."""
    return listings.groupBy("path").applyInPandasWithState(observe(stable_ms), OUTPUT, STATE, "append", "NoTimeout")


def stable_files(listings: DataFrame, stable_ms: int) -> DataFrame:
    """The same in batch: the first listing at which each run of an unchanged fingerprint is old enough."""
    w = Window.partitionBy("path").orderBy("observed_ms")
    same = (F.col("size_bytes") == F.lag("size_bytes").over(w)) & (F.col("modified_ns") == F.lag("modified_ns").over(w))
    rows = listings.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("first_seen_ms", F.min("observed_ms").over(Window.partitionBy("path", "run")))
    ready = rows.where(F.col("observed_ms") > F.col("first_seen_ms")).where(F.col("observed_ms") - F.col("first_seen_ms") >= stable_ms)
    return ready.groupBy("path", "run").agg(F.min_by(F.struct("size_bytes", "modified_ns", "first_seen_ms", "observed_ms"), "observed_ms").alias("r")).select("path", "r.*")
