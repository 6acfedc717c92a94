"""Ordered-sequence operators against literal loops."""

import random

from pyspark.sql import functions as F

from wavequarry.operators import compare, measure, sequence


def frame(spark, values, key="asset"):
    rows = [(a, i, float(v)) for a, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"{key} long, frame long, x double")


def test_runs_count_the_last_one_and_interior_runs_do_not(spark):
    df = frame(spark, {1: [0, 0, 5, 0, 0, 5, 5, 0, 0]})
    found = sequence.runs(df, ["asset"], "frame", F.col("x") == 0, 2)
    assert sorted((r.start_frame, r.length) for r in found.collect()) == [(0, 2), (3, 2), (7, 2)]
    assert [(r.start_frame, r.length) for r in sequence.interior_runs(df, ["asset"], "frame", F.col("x") == 0, 2, 5).collect()] == [(3, 2)]


def test_greedy_coalescing_is_not_islands(spark):
    at = {a: sorted(random.Random(a).sample(range(400), 120)) for a in range(5)}
    df = spark.createDataFrame([(a, t) for a, ts in at.items() for t in ts], "asset long, frame long")
    want = set()
    for a, ts in at.items():
        last = None
        for t in ts:
            if last is None or t - last >= 4:
                want.add((a, t))
                last = t
    assert {(r.asset, r.frame) for r in sequence.coalesce_greedy(df, ["asset"], "frame", 4).collect()} == want


def test_hysteresis_equals_its_state_machine(spark):
    values = {a: [random.Random(a * 7 + i).random() for i in range(300)] for a in range(6)}
    want = set()
    for a, xs in values.items():
        on = grace = False
        for i, x in enumerate(xs):
            high, mid = x >= 0.7, x >= 0.58
            on, grace = ((mid or not grace) if on else high), on and not mid and not grace
            if on:
                want.add((a, i))
    found = sequence.hysteresis(frame(spark, values), ["asset"], "frame", "x", 0.7, 0.12)
    assert {(r.asset, r.frame) for r in found.where("active").collect()} == want


def test_percentile_definitions_differ(spark):
    df = spark.createDataFrame([([5.0, 1.0, 2.0, 4.0, 3.0],)], "x array<double>")
    r = df.select(measure.nearest_rank_up(F.col("x"), 0.6).alias("a"), measure.noise_floor(F.col("x")).alias("b")).first()
    assert (r.a, r.b) == (4.0, -45.0)


def test_empty_tables_give_empty_results(spark):
    df = frame(spark, {})
    assert sequence.runs(df, ["asset"], "frame", F.col("x") == 0, 1).count() == 0
    assert sequence.coalesce_greedy(df.select("asset", "frame"), ["asset"], "frame", 4).count() == 0
    assert measure.gated(df.withColumn("block", F.col("x")), ["asset"]).count() == 0


def test_silence_is_minus_infinity_not_null(spark):
    df = frame(spark, {1: [0.0] * 8}).withColumn("energy", F.col("x"))
    r = measure.gated(measure.window_energy(df, 4), ["asset"]).first()
    assert r.integrated_lufs == float("-inf")


def test_duplicate_keys_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([(1,), (1,)], "path long")
    with pytest.raises(Exception, match="duplicate key"):
        compare.unique_or_fail(df, "path").collect()


def test_upsert_keeps_ids(spark):
    table = spark.createDataFrame([(1, "a", 5.0, 1), (2, "b", 6.0, 1)], "id long, k string, v double, at int")
    changes = spark.createDataFrame([(9, "a", 7.0, 2), (10, "c", 8.0, 2), (11, "c", 9.0, 3)], "id long, k string, v double, at int")
    assert sorted(map(tuple, compare.upsert(table, changes, ["k"], "at").collect())) == [(1, "a", 7.0, 2), (2, "b", 6.0, 1), (11, "c", 9.0, 3)]
