"""Secret scans: candidate spans by regular expression, judged by corpus-wide ownership.

Native DataFrame operations only. Every candidate's SHA-256 is counted by distinct repositories
and owners: a value that many owners share is an example, one that only few owners have and that
looks random is live. The text is scanned once; the small table of spans that the scan leaves is
written to the shared folder, and only hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, read

#: Base kinds as listed: name, pattern, group that holds the value, its least length.
KINDS = [
    (
        "assign",
        r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: The kind that the method adds: long mixed tokens, kept where they are owner-specific.
OWNED = ("owned", r"[A-Za-z0-9_-]{24,}", 0, 24)
#: Owners of a base kind's value up to which a stage that masks should take it for a secret.
EXAMPLE_OWNERS = 10
SPAN = "array<struct<start:int,ord:int,stop:int,value:string>>"


def matches(text: Column, kind: tuple, ord_: int) -> Column:
    """Leftmost non-overlapping matches as (start, ord, stop, value), in code points, failing ones dropped."""
    _, pattern, group, least = kind
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"), F.slice(pieces, 1, F.size(whole)).alias("gap"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), stop.alias("stop"), x["v"].alias("value"))
        return F.struct(stop.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, begin, step)["out"]).otherwise(F.array().cast(SPAN))


def looks_random(value: Column) -> Column:
    """At least four digits, four letters and ten different characters."""
    digits, letters = F.regexp_replace(value, "[^0-9]", ""), F.regexp_replace(value, "[^A-Za-z]", "")
    return (F.length(digits) >= 4) & (F.length(letters) >= 4) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "source", owner: str | None = None, max_owners: int = 1, base_owners: int | None = None) -> DataFrame:
    """One row per document: (key, row_key, base, extra), arrays of (start, ord, stop, value_hash, n_repos, n_owners, live).

    base holds the spans of KINDS, extra those of OWNED that touch no base span and are live. live:
    the value is random-looking and at most `max_owners` owners have it. With `base_owners` base spans
    need not look random, and are live where at most so many owners have the value; exact copies of
    a text then have one repository and owner, the least. A null text has no spans,
    a null repository or owner counts as one of its own; rows that agree in key and text have equal results, and
    each gives a row. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.col(repo).alias("repo"), F.col(owner or repo).alias("owner"))
    copies = [] if base_owners is None else ["copy"]
    base = rows.withColumn("copy", F.xxhash64("body")).select("key", F.xxhash64("key", "body").alias("row_key"), *copies, "repo", "owner", *[matches(F.col("body"), k, i).alias(f"s{i}") for i, k in enumerate([*KINDS, OWNED])])
    base = base.withColumn("base", F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(KINDS))])))
    free = F.filter(f"s{len(KINDS)}", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])) & looks_random(x["value"]))
    base = base.withColumn("spans", F.transform(F.concat("base", free), lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["stop"].alias("stop"), F.sha2(x["value"], 256).alias("hash"), looks_random(x["value"]).alias("random"))))
    base = materialize(base.select("key", "row_key", *copies, "repo", "owner", "spans"), "secret-spans")
    each = base.select("key", "row_key", *copies, "repo", "owner", F.explode("spans").alias("x"))
    # one row per value and owner first, so that a value in a third of all documents is combined before the shuffle
    held = each.select(F.col("x.hash").alias("hash"), *copies, "repo", "owner")
    if copies:
        held = held.groupBy("hash", "copy").agg(F.min("repo").alias("repo"), F.min("owner").alias("owner")).drop("copy")
    owners = held.distinct().groupBy("hash").agg(
        F.count_distinct(F.coalesce(F.concat(F.lit("="), "repo"), F.lit("-"))).alias("n_repos"), F.count_distinct(F.coalesce(F.concat(F.lit("="), "owner"), F.lit("-"))).alias("n_owners")
    )
    judged = each.join(owners, F.col("x.hash") == F.col("hash"))
    live = F.col("x.random") & (F.col("n_owners") <= max_owners)
    if base_owners is not None:
        live = F.when(F.col("x.ord") < len(KINDS), F.col("n_owners") <= base_owners).otherwise(live)
    span = F.struct(
        F.col("x.start").alias("start"), F.col("x.ord").alias("ord"), F.col("x.stop").alias("stop"), F.col("hash").alias("value_hash"),
        "n_repos", "n_owners", live.alias("live"),
    )
    per_row = judged.groupBy(F.col("row_key").alias("row_of"), F.col("key").alias("key_of")).agg(F.array_sort(F.collect_set(span)).alias("all"))
    out = base.join(per_row, (F.col("row_key") == F.col("row_of")) & F.col("key").eqNullSafe(F.col("key_of")), "left")
    spans = F.coalesce("all", F.filter(F.array(span_null()), lambda x: F.lit(False)))
    return out.select(
        F.col("key").alias(key), "row_key", F.filter(spans, lambda x: x["ord"] < len(KINDS)).alias("base"), F.filter(spans, lambda x: (x["ord"] == len(KINDS)) & x["live"]).alias("extra")
    )


def span_null() -> Column:
    return F.lit(None).cast("struct<start:int,ord:int,stop:int,value_hash:string,n_repos:bigint,n_owners:bigint,live:boolean>")


def said(spans: Column) -> Column:
    """kind:start:stop of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in [*KINDS, OWNED]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["ord"]], x["start"], x["stop"])), ",")


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "source", by: str = "[secret]", max_owners: int = 1, base_owners: int | None = None) -> DataFrame:
    """docs with the characters of live spans replaced by `by`; examples that many owners share stay as they are.

    Columns, their order and repeated rows stay; a null text stays null.
    """
    found = scan(docs, key, text, repo, max_owners=max_owners, base_owners=base_owners)
    row, spans = fresh("row", "spans")
    live = F.array_sort(F.filter(F.concat("base", "extra"), lambda x: x["live"]))
    found = found.where(F.exists(F.concat("base", "extra"), lambda x: x["live"])).select(F.col("row_key").alias(row), live.alias(spans)).dropDuplicates([row])
    joined = docs.withColumn(row, F.xxhash64(key, F.coalesce(F.col(text), F.lit("")))).join(found, row, "left")
    body = F.col(text)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.when(x["start"] >= acc["at"], body.substr(acc["at"] + 1, x["start"] - acc["at"])).otherwise("")
        return F.struct(
            F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["stop"] > acc["at"], F.concat(acc["out"], gap, F.lit(by))).otherwise(acc["out"]).alias("out")
        )

    cut = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.length(body))))
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), cut).otherwise(body)).select(*docs.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda i: F.size(F.filter("base", lambda x: x["ord"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size(F.filter(F.concat("base", "extra"), lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("base", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def _spans_sql(ord_: int, kind: tuple) -> str:
    _, pattern, group, least = kind
    pattern = pattern.replace("'", "''")
    return f"""
m{ord_} AS (SELECT n, {ord_} AS ord, unnest(range(len(m))) AS i, m, v, p FROM (SELECT n, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p FROM d)),
s{ord_} AS (SELECT n, ord, v[i + 1] AS val, CAST(list_sum(list_transform(p[1:i + 1], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: len(x))), 0) AS BIGINT) AS a,
                   len(m[i + 1]) AS l FROM m{ord_} WHERE len(v[i + 1]) >= {least})"""


OP1_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS t FROM documents),"
    + ",".join(_spans_sql(i, k) for i, k in enumerate([*KINDS, OWNED]))
    + f""",
base AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(KINDS)))}),
looks AS (SELECT *, len(regexp_replace(val, '[^0-9]', '', 'g')) >= 4 AND len(regexp_replace(val, '[^A-Za-z]', '', 'g')) >= 4 AND len(list_distinct(string_split(val, ''))) >= 10 AS random FROM (
  SELECT * FROM base UNION ALL SELECT * FROM s3 x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.n = x.n AND b.a < x.a + x.l AND x.a < b.a + b.l))),
cand AS (SELECT looks.*, source FROM looks JOIN d USING (n) WHERE ord < 3 OR random),
own AS (SELECT val, count(DISTINCT coalesce('=' || source, '-')) AS owners FROM cand GROUP BY val),
allspans AS (SELECT n, ord, a, a + l AS b, ['assign', 'access', 'hex', 'owned'][ord + 1] || ':' || a || ':' || (a + l) AS s, random AND owners <= 1 AS live FROM cand JOIN own USING (val)),
agg AS (SELECT n, count(*) FILTER (ord = 0) AS na, count(*) FILTER (ord = 1) AS nc, count(*) FILTER (ord = 2) AS nh,
   coalesce(string_agg(s, ',' ORDER BY a, ord) FILTER (ord < 3), '') AS bs, coalesce(string_agg(s, ',' ORDER BY a, ord) FILTER (ord < 3 OR live), '') AS sp,
   count(*) FILTER (live) AS nl, count(*) FILTER (ord < 3 AND NOT live) AS ne FROM allspans GROUP BY n)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans,
       coalesce(nl, 0) AS n_live, coalesce(ne, 0) AS n_example FROM d LEFT JOIN agg USING (n)
"""
)
