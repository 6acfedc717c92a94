"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by the set of sources they belong to (their pattern). A flow network
routes each pattern's tokens to its sources' quotas; a pattern's first pass is free and each
repetition costs more than the one before, so the flow repeats as little as the quotas allow.
Documents are then chosen in the order of a seeded hash: bucket sums find the bucket in which a
pattern's last, partial pass ends, and only that bucket's documents are looked at one by one.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SPACE_CLASS, SPACES, materialize, read

#: Costs a token of a document's first, second and third pass.
PASS_COSTS = (0, 1, 3)
#: So many patterns at most are broadcast to the documents, a row of some dozens of bytes each; more are joined by shuffle.
BROADCAST_PATTERNS = 100_000
#: Documents a bucket holds on average; at most 2**MAX_BITS buckets a pattern.
BUCKET_DOCS, MAX_BITS = 256, 20


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than U+0009-000D and U+0020; null: 0."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, f"{SPACE_CLASS}+"))).cast("long")


def targets(sizes: dict, weights: dict, total: float, limit: float = 3.0) -> dict:
    """Share `total` by weight; a target stops at limit * size and its excess is reshared."""
    fixed: dict = {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        weight = sum(weights[s] for s in open_)
        left = total - sum(fixed.values())
        share = {s: left * weights[s] / weight for s in open_} if weight else {}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            return {s: fixed.get(s, share.get(s, 0.0)) for s in sizes}
        fixed |= {s: limit * sizes[s] for s in over}


def min_cost_flow(arcs: list[tuple], source, sink) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost) of a cheapest maximum flow; costs are not negative."""
    graph, to, cap, cost = defaultdict(list), [], [], []
    for u, v, c, w in arcs:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b), cap.append(x), cost.append(y)
    potential = defaultdict(int)
    while True:
        best, via, queue, n = {source: 0}, {}, [(0, 0, source)], 0
        while queue:
            d, _, u = heapq.heappop(queue)
            if d > best[u]:
                continue
            for e in graph[u]:
                if cap[e] > 0 and (x := d + cost[e] + potential[u] - potential[to[e]]) < best.get(to[e], float("inf")):
                    best[to[e]], via[to[e]] = x, e
                    heapq.heappush(queue, (x, n := n + 1, to[e]))
        if sink not in best:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for v, d in best.items():
            potential[v] += d
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: dict[tuple, int], quotas: dict) -> dict[tuple, int]:
    """Tokens to take from each pattern (a tuple of sources: its tokens), by connected part."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for p in patterns:
        for s in p:
            parent[find(("s", s))] = find(("p", p))
    parts = defaultdict(list)
    for p in patterns:
        parts[find(("p", p))].append(p)
    out = {}
    for members in parts.values():
        arcs = [("from", ("p", p), patterns[p], c) for p in members for c in PASS_COSTS]
        arcs += [(("p", p), ("s", s), len(PASS_COSTS) * patterns[p], 0) for p in members for s in p]
        arcs += [(("s", s), "to", round(quotas[s]), 0) for s in dict.fromkeys(s for p in members for s in p)]
        flow = min_cost_flow(arcs, "from", "to")
        for (u, v, _, _), f in zip(arcs, flow, strict=True):
            if u == "from":
                out[v[1]] = out.get(v[1], 0) + f
    return out


def mix(docs: DataFrame, members: Column, size: Column, key: list[str], seed: int = 7, limit: float = 3.0) -> DataFrame:
    """Choose how often each document is taken so that sources come near their targets.

    members: array<string> of a document's sources (a null source counts as one more); size: its
    tokens. Sources in order of code point, null last, weigh 1, 2, 3, repeating. `key` names the
    columns that tell documents apart; rows that agree in them, in members and size share one
    decision. Returns docs with size, source_size and target (of its first source, in that order)
    and passes (0 to 3). Names that start with `mix_` are reserved. An empty table gives an empty
    one. Documents of size 0 are taken as often as they fit, up to three times. Only pattern totals reach the driver: as many rows as there are distinct patterns.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("mix_size", size).withColumn("mix_of", F.sort_array(F.array_distinct(members), asc=True))
    docs = docs.withColumn("mix_hash", F.xxhash64(F.lit(seed), *key))
    light = materialize(docs.select(*key, "mix_size", "mix_of", "mix_hash"), "mix-light")
    order = lambda s: (s is None, s or "")
    counted = [(tuple(sorted(r["mix_of"], key=order)), r["n"], int(r["size"])) for r in light.groupBy("mix_of").agg(F.count("*").alias("n"), F.sum("mix_size").alias("size")).collect()]
    names = sorted({s for p, _, _ in counted for s in p}, key=order)
    source_size: dict = dict.fromkeys(names, 0)
    for p, _, x in counted:
        for s in p:
            source_size[s] += x
    quota = targets(source_size, {s: i % 3 + 1 for i, s in enumerate(names)}, float(sum(x for _, _, x in counted)), limit)
    taken = route({p: x for p, _, x in counted}, quota)
    plan = [
        (list(p), source_size[p[0]], quota[p[0]], taken[p] // x if x else 0, taken[p] % x if x else 0, min(MAX_BITS, max(0, (n // BUCKET_DOCS).bit_length() - 1)))
        for p, n, x in counted if p
    ]
    schema = "mix_names array<string>, source_size long, target double, mix_whole long, mix_rest long, mix_bits int"
    plan = spark.createDataFrame(plan, schema)
    # arrays with nulls don't join by equality in every engine: a text that tells null apart does
    text_of = lambda c: F.array_join(F.transform(F.sort_array(c), lambda s: F.coalesce(F.concat(F.lit("="), F.hex(F.encode(s, "UTF-8"))), F.lit("-"))), ",")
    plan = plan.withColumn("mix_pattern", text_of(F.col("mix_names"))).drop("mix_names")
    if len(counted) <= BROADCAST_PATTERNS:
        plan = F.broadcast(plan)
    bucket = F.expr("CASE WHEN mix_bits = 0 THEN 0 ELSE shiftrightunsigned(mix_hash, 64 - mix_bits) END").cast("int")
    with_plan = lambda df: df.withColumn("mix_pattern", text_of(F.col("mix_of"))).join(plan, "mix_pattern").withColumn("mix_bucket", bucket)
    sums = with_plan(light).groupBy("mix_pattern", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"), F.first("mix_rest").alias("mix_rest"))
    before = F.sum("mix_sum").over(Window.partitionBy("mix_pattern").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
    cut = sums.withColumn("mix_before", F.coalesce(before, F.lit(0))).where("mix_before <= mix_rest AND mix_rest < mix_before + mix_sum")
    cut = materialize(cut.select("mix_pattern", F.col("mix_bucket").alias("mix_cut"), (F.col("mix_rest") - F.col("mix_before")).alias("mix_gap")), "mix-cut")
    edge = with_plan(light).join(cut, "mix_pattern").where("mix_bucket = mix_cut")
    edge = edge.groupBy("mix_pattern", "mix_gap", "mix_hash", "mix_size", *key).agg(F.count("*").alias("mix_times"))
    kept = [f for f in edge.schema.fields if f.name in key]
    picked = edge.groupBy("mix_pattern").applyInPandas(
        pick_for([f.name for f in kept]), T.StructType([T.StructField("mix_pattern", T.StringType()), *kept, T.StructField("mix_size", T.LongType()), T.StructField("mix_take", T.IntegerType())])
    )
    picked = materialize(picked, "mix-picked")
    at = picked.select(*[F.col(c).alias(f"mix_k_{c}") for c in ("mix_pattern", "mix_size", *key)], "mix_take")
    all_ = with_plan(docs).join(cut, "mix_pattern", "left")
    same = F.col("mix_bucket") == F.col("mix_cut")
    for c in ("mix_pattern", "mix_size", *key):
        same = same & F.col(c).eqNullSafe(F.col(f"mix_k_{c}"))
    all_ = all_.join(at, same, "left")
    extra = F.when(F.col("mix_bucket") < F.col("mix_cut"), 1).when(F.col("mix_bucket") == F.col("mix_cut"), F.coalesce("mix_take", F.lit(0))).otherwise(0)
    # a document without tokens fits anywhere, also after the last pass
    passes = F.least(F.col("mix_whole") + extra, F.lit(len(PASS_COSTS))).cast("int").alias("passes")
    return all_.select(*[c for c in docs.columns if not c.startswith("mix_")], F.col("mix_size").alias("size"), "source_size", "target", passes)


def pick_for(key: list[str]):
    """Documents of the cut bucket in hash order, each taken if it still fits; the nearest one more if that comes closer."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix_hash", "mix_size", *key], kind="stable").reset_index(drop=True)
        gap, take, whole = int(rows["mix_gap"].iloc[0]), [0] * len(rows), (rows["mix_size"] * rows["mix_times"]).astype("int64").tolist()
        for i, n in enumerate(whole):
            if n <= gap:
                take[i], gap = 1, gap - n
        rest = [(n, i) for i, n in enumerate(whole) if not take[i]]
        if rest and min(rest)[0] - gap < gap:
            take[min(rest)[1]] = 1
        return rows.assign(mix_take=take)[["mix_pattern", *key, "mix_size", "mix_take"]]

    return pick


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    docs = materialize(docs, "mix-sizes")  # each text is counted once
    mixed = mix(docs, F.array("source"), F.col("words"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes")
