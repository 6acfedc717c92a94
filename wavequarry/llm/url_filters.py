"""URL filters: host-suffix and path-prefix expressions joined to rules by hash prefix.

Native DataFrame operations only. Each URL is expanded to the host suffixes and path prefixes
whose label counts and lengths occur among the rules; their SHA-256 digests meet the rules' in an
equi-join on the first 32 bits, the whole digest confirms, and the longest rule wins. The rows a
URL expands to are combined before the shuffle, which moves one row per URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of op7: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    """ASCII-lower-cased text after the first `://` up to `/`, `?`, `#` or the end; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row of `pages` by `rules` (host, path, verdict).

    Returns (key, host, path, rule, verdict), one row for each input row, repeated ones included.
    Nulls and URLs without `://` have an empty host and path, match no rule with a host and get
    `default`, with a null rule. A rule fits its host and all subdomains if the path starts with
    the rule's; the longest host+path wins, then the longer host, then `block`. Rules with a null
    field are ignored. Other columns of `pages` are dropped, so their names can't clash.
    """
    rules = rules.select(
        F.translate(F.col("host"), UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).dropna().dropDuplicates()
    rules = rules.withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256)).withColumn("short", F.substring("digest", 1, 8))
    shape = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths")
    ).first()  # two short lists: the label counts and path lengths in use
    rows = pages.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.", -1)
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    suffixes = F.transform(
        F.filter(ints(shape["labels"]), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    heads = F.transform(F.filter(ints(shape["lengths"]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.struct(s.alias("s"), h.alias("h")))))
    found = rows.select("key", "host", "path", F.posexplode_outer(pairs).alias("nth", "pair"))
    found = found.withColumn("digest_of", F.sha2(F.concat("pair.s", "pair.h"), 256))
    hit = (F.substring("digest_of", 1, 8) == F.col("short")) & (F.col("digest_of") == F.col("digest")) & (F.col("pair.s") == F.col("rule_host"))
    best = F.max(
        F.when(
            F.col("digest").isNotNull(),
            F.struct(
                F.length(F.concat("rule_host", "rule_path")).alias("n"),
                F.length("rule_host").alias("m"),
                (F.col("rule_verdict") == "block").alias("block"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            ),
        )
    )
    # `nth` is null or 0 once per input row and matching rule; count rows by it only where no second rule of equal digest doubles it
    judged = found.join(rules.groupBy("short", "digest", "rule_host").agg(F.max("rule_path").alias("rule_path"), F.max("rule_verdict").alias("rule_verdict")), hit, "left")
    judged = judged.groupBy("key", "host", "path").agg(best.alias("best"), F.sum((F.coalesce("nth", F.lit(0)) == 0).cast("int")).alias("times"))
    return judged.select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"),
    ).drop("time")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, sf_dir, "pages"), rules)


OP7_SQL = """
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, n, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
         FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""
