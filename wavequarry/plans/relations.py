"""Pairings, hops and alignments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dims
from ..functions.units import rounded
from ..operators import compare
from .loudness import LAYOUT_SQL, MULTI_SQL, multichannel
from .mappings import VECTOR_SQL, read, vectors
from .registry import query


@query(f"WITH {LAYOUT_SQL} SELECT a.label AS left_label, b.label AS right_label, a.channel AS left_channel, b.channel AS right_channel FROM lay a JOIN lay b ON b.azimuth = -a.azimuth AND b.elevation = a.elevation AND a.azimuth > 0 AND a.role = b.role")
def stereo_pair_derivation(spark, sf_dir):
    """Channels that mirror each other."""
    a = dims.layout(spark, "7.1.4")
    b = a.select(F.col("channel").alias("right_channel"), F.col("label").alias("right_label"), F.col("role").alias("r"), (-F.col("azimuth")).alias("mirror"), F.col("elevation").alias("e"))
    both = a.join(b, (F.col("azimuth") == F.col("mirror")) & (F.col("elevation") == F.col("e")) & (F.col("role") == F.col("r"))).where("azimuth > 0")
    return both.select(F.col("label").alias("left_label"), "right_label", F.col("channel").alias("left_channel"), "right_channel")


@query(
    f"""WITH {MULTI_SQL}, n AS (SELECT asset, channel, samples, list_sum(list_transform(samples, lambda x: x * x)) AS e FROM mc)
SELECT a.asset, a.channel AS first_channel, b.channel AS second_channel, round(list_sum(list_transform(range(1, len(a.samples) + 1), lambda i: a.samples[i] * b.samples[i])) / sqrt(a.e * b.e), 6) AS cosine
FROM n a JOIN n b ON a.asset = b.asset AND a.channel < b.channel WHERE a.e * b.e > 0"""
)
def channel_pair_matrix(spark, sf_dir):
    """Every pair of channels within an asset (twelve channels at most)."""
    energy = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)
    a = multichannel(spark, sf_dir).select("asset", F.col("channel").alias("first_channel"), F.col("samples").alias("x"), energy.alias("e1"))
    b = multichannel(spark, sf_dir).select("asset", F.col("channel").alias("second_channel"), F.col("samples").alias("y"), energy.alias("e2"))
    both = a.join(b, "asset").where("first_channel < second_channel AND e1 * e2 > 0")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return both.select("asset", "first_channel", "second_channel", rounded(dot / F.sqrt(F.col("e1") * F.col("e2"))).alias("cosine"))


@query(
    """WITH s AS (SELECT l_orderkey AS asset, l_linenumber AS n, l_quantity / 10 AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
a AS (SELECT asset, k, sum(d) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) AS boundary FROM s), b AS (SELECT asset, k, sum(d + CASE WHEN n % 4 = 0 THEN 0.07 ELSE 0 END) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) AS boundary FROM s)
SELECT asset, count(*) AS boundaries, count(*) FILTER (abs(round(a.boundary - b.boundary, 6)) <= 0.05) AS aligned FROM a JOIN b USING (asset, k) GROUP BY asset"""
)
def rendition_alignment(spark, sf_dir):
    """Cumulative boundaries of two renditions, compared by ordinal."""
    w = Window.partitionBy("asset").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    s = read(spark, sf_dir, "lineitem").withColumn("asset", F.col("l_orderkey")).withColumn("k", F.row_number().over(w)).withColumn("d", F.col("l_quantity") / 10)
    run = Window.partitionBy("asset").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    longer = F.col("d") + F.when(F.col("l_linenumber") % 4 == 0, 0.07).otherwise(0.0)
    a = s.select("asset", "k", F.sum("d").over(run).alias("x"))
    b = s.select("asset", "k", F.sum(longer).over(run).alias("y"))
    both = a.join(b, ["asset", "k"])
    return both.groupBy("asset").agg(F.count("*").alias("boundaries"), F.count_if(F.abs(F.round(F.col("x") - F.col("y"), 6)) <= 0.05).alias("aligned"))


@query(
    """SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > c_acctbal)"""
)
def owning_node_hops(spark, sf_dir):
    """2.11: a property of the node at the end of a chain of references, and a condition across it."""
    t = lambda n: read(spark, sf_dir, n)
    own = t("customer").where("c_acctbal > 0").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    most = t("supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("most"))
    j = own.join(most, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.where("most IS NULL OR most <= c_acctbal").select("c_custkey", "r_name")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS child, o_custkey // 3 AS parent FROM orders WHERE o_custkey > 0), g AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT g.node, e.parent, g.depth + 1 FROM g JOIN e ON g.ancestor = e.child)
SELECT node, max(depth) AS depth, arg_max(ancestor, depth) AS root FROM g GROUP BY node"""
)
def ownership_roots(spark, sf_dir):
    """Owner of owners, however deep."""
    edges = read(spark, sf_dir, "orders").where("o_custkey > 0").select(F.col("o_custkey").alias("node"), F.floor(F.col("o_custkey") / 3).alias("parent"))
    return compare.owners(edges, "node", "parent").select("node", "depth", "root")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS child, CASE WHEN o_custkey % 40 = 0 THEN o_custkey + 39 ELSE o_custkey - 1 END AS parent FROM orders),
g AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT g.node, e.parent, g.depth + 1 FROM g JOIN e ON g.ancestor = e.child WHERE g.depth < 100),
r AS (SELECT node, max(depth) AS depth, arg_max(ancestor, depth) AS root FROM g GROUP BY node)
SELECT node, CASE WHEN depth < 100 THEN depth ELSE 0 END AS depth, CASE WHEN depth < 100 THEN root ELSE node END AS root, depth = 100 AS cyclic FROM r"""
)
def ownership_chains(spark, sf_dir):
    """Chains of up to 39 steps, some of which close into cycles of 40; a node on a cycle counts as its own root."""
    key = F.col("o_custkey")
    edges = read(spark, sf_dir, "orders").select(key.alias("node"), F.when(key % 40 == 0, key + 39).otherwise(key - 1).alias("parent"))
    found = compare.owners(edges, "node", "parent")
    return found.select("node", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("root", "node").alias("root"), "cyclic")


LAGS = (2, 3, 5, 8)


@query(
    f"""WITH {VECTOR_SQL}, k AS (SELECT asset, samples, unnest({list(LAGS)}) AS lag FROM v WHERE len(samples) = 64),
c AS (SELECT asset, lag, list_sum(list_transform(range(lag + 1, 65), lambda i: samples[i] * samples[i - lag])) AS xy, list_sum(list_transform(samples, lambda x: x * x)) AS xx, list_sum(list_transform(range(lag + 1, 65), lambda i: samples[i - lag] * samples[i - lag])) AS yy FROM k)
SELECT asset, round(max(greatest(0, CASE WHEN xx * yy > 0 THEN xy / sqrt(xx * yy) ELSE 0 END)), 6) AS periodicity FROM c GROUP BY asset"""
)
def periodicity(spark, sf_dir):
    """Best normalised correlation over a few lags."""
    rows = vectors(spark, sf_dir).where(F.size("samples") == 64)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def at(lag):
        now, then = F.slice("samples", lag + 1, 64 - lag), F.slice("samples", 1, 64 - lag)
        xy, xx, yy = total(F.zip_with(now, then, lambda a, b: a * b)), total(F.transform("samples", lambda x: x * x)), total(F.transform(then, lambda x: x * x))
        return F.when(xx * yy > 0, F.greatest(F.lit(0.0), xy / F.sqrt(xx * yy))).otherwise(0.0)

    return rows.select("asset", rounded(F.greatest(*[at(k) for k in LAGS])).alias("periodicity"))
