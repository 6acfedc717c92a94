"""Quality rules with risk-controlled thresholds.

Native DataFrame operations only. A document is rejected if any of its measures reaches that rule's
cutoff. The labelled documents are a holdout: for every stratum and every combination of cutoffs
(rules may also be left out) the good documents that the combination as a whole would reject are
counted. A combination may be used only where an exact binomial test shows that it rejects less
than `risk` of the stratum's good documents, at a level corrected for the number of combinations
and strata. Of those the one that catches most labelled bad documents is chosen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, materialize, read

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Measures, each a share of something, and the cutoffs tried for them.
RULES = {
    "symbol_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3],
    "dup_line_share": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
}
RISK, DELTA = 0.01, 0.05


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes: one for each window, in order."""

    def marked(h):
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s):
            n = F.size(s)
            return F.filter(
                F.transform(s, lambda x, j: F.when(((j > 0) & (F.get(s, j - 1)["x"] == x["x"])) | ((j < n - 1) & (F.get(s, j + 1)["x"] == x["x"])), x["i"])), lambda i: i.isNotNull()
            )

        def length(at):
            return F.aggregate(
                at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"]
            )

        return let(let(order, twice), lambda at: length(F.array_sort(at)))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all windows of 8 words, by doubling: 1, 2, 4, 8."""
    def pairs(step):  # each window with the one that starts `step` later
        none = F.array().cast("array<bigint>")
        return lambda a: F.when(F.size(a) > step, F.zip_with(F.slice(a, 1, F.size(a) - step), F.slice(a, step + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))).otherwise(none)

    h = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = let(h, pairs(step))
    return h


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares) for each row; null text: zeros."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    per_words = let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), covered(window_hashes(w)).cast("long").alias("n_repeat_words")))
    plain = F.translate(body, SYMBOLS, "")
    rows = docs.select(
        F.col(key).alias("key"), F.col(stratum).alias("stratum"), per_words.alias("w"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"), (F.length(body) - F.length(plain)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"),
    )
    return rows.select("key", "stratum", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_lines")


def shares(rows: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.withColumns({"symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words")})


def log_factorial(n: Column) -> Column:
    """ln n!: by the table below 20, by Stirling's series above (error under 1e-12)."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(19)).cast("int")).cast("double"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), or slightly more: summed downward from k.

    After 12 standard deviations the terms left, none above the last one, are added as so many times it.
    """
    k, n = k.cast("long"), n.cast("long")
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    most = F.least(k, (40 + 12 * F.sqrt(n * p * (1 - p))).cast("long"))
    sums = F.aggregate(
        F.sequence(F.lit(0).cast("long"), most), F.struct(top.alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct((acc["term"] * (k - j) * ((1 - p) / p) / (n - k + j + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"] + acc["term"] * (k - most),
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(sums)


def stratum_of(stratum: str) -> Column:
    """A name for each stratum; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-"))


def certify(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, n, k, caught, and a cutoff for each rule, null where it is left out) for each stratum with a certified combination.

    rows: key, stratum and the measures; labels: key, good. A key counts once in a stratum, however
    many rows it has: it is rejected if one of them is, and good if one of its labels says so. The
    level is delta over the number of tests: combinations times strata (Bonferroni). Ties go to
    fewer good documents rejected, then to laxer cutoffs. Where no bad document is caught none is chosen.
    """
    labels = labels.dropna().groupBy("key").agg(F.max("good").alias("good"))
    reached = [sum((F.col(r) >= c).cast("int") for c in cs).alias(f"level_{r}") for r, cs in RULES.items()]
    held = rows.select("key", stratum_of("stratum").alias("stratum"), *reached).join(labels, "key")
    held = held.groupBy("stratum", "key").agg(*[F.max(f"level_{r}").alias(f"level_{r}") for r in RULES], F.max("good").alias("good"))
    counts = held.groupBy("stratum", *[f"level_{r}" for r in RULES]).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    # a few hundred rows a stratum are left; each meets every combination of levels
    hit = F.lit(False)
    for r, cs in RULES.items():
        counts = counts.withColumn(f"at_{r}", F.explode(F.sequence(F.lit(1), F.lit(len(cs) + 1))))
        hit = hit | (F.col(f"level_{r}") >= F.col(f"at_{r}"))
    at = [f"at_{r}" for r in RULES]
    own = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    counts = counts.groupBy("stratum", *at).agg(F.sum("good").alias("n"), own("good").alias("k"), own("bad").alias("caught"))
    strata = counts.agg(F.count_distinct("stratum").alias("strata"))  # one row
    tests = math.prod(len(cs) + 1 for cs in RULES.values()) - 1
    sure = counts.where("caught > 0").join(F.broadcast(strata)).where(binomial_cdf(F.col("k"), F.col("n"), risk) <= F.lit(delta) / (tests * F.col("strata")))
    best = sure.groupBy("stratum").agg(F.max(F.struct("caught", (-F.col("k")).alias("less"), "n", *at)).alias("b"))
    cutoff = [F.get(F.array(*map(F.lit, cs)), F.col(f"b.at_{r}") - 1).alias(r) for r, cs in RULES.items()]
    return best.select("stratum", "b.n", (-F.col("b.less")).alias("k"), "b.caught", *cutoff)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """measure() with base_failed and kept for each row; a null key has no label, a null stratum is one of its own.

    A null text has no words and fails the base rules. Repeated rows give a row each; other columns are ignored.
    """
    rows = materialize(shares(measure(docs, key, text, stratum)), "quality-measures")
    cuts = certify(rows, labels.select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("good")), risk, delta)
    cuts = cuts.select(F.col("stratum").alias("cut_stratum"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    rows = rows.join(cuts, stratum_of("stratum") == F.col("cut_stratum"), "left")
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~hit).withColumnRenamed("key", key)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_HIT = " OR ".join(f"coalesce({r} >= v_{r}, false)" for r in RULES)
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS s FROM (SELECT id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT id, i FROM win QUALIFY count(*) OVER (PARTITION BY id, s) > 1),
cov AS (SELECT id, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS p FROM dup) GROUP BY id),
m AS (SELECT id, doc_id, coalesce('=' || lang, '-') AS stratum, len(ws) AS n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             len(t) - len(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN w USING (id) LEFT JOIN cov USING (id)),
s AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share FROM m),
good AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, doc_id, max(symbol_share) AS symbol_share, max(dup_line_share) AS dup_line_share, max(repeat_share) AS repeat_share, max(good) AS good FROM s JOIN good USING (doc_id) GROUP BY ALL),
{", ".join(f"c_{r}(a_{r}, v_{r}) AS (VALUES {', '.join(f'({i + 1}, {c}::DOUBLE)' for i, c in enumerate([*cs, math.inf]) if c < math.inf)}, ({len(cs) + 1}, NULL))" for r, cs in RULES.items())},
cnt AS (SELECT stratum, {", ".join(f"a_{r}, v_{r}" for r in RULES)}, sum(good) AS n, coalesce(sum(good) FILTER ({_HIT}), 0) AS k, count(*) FILTER (good = 0 AND ({_HIT})) AS caught
        FROM held, {", ".join(f"c_{r}" for r in RULES)} WHERE {" OR ".join(f"v_{r} IS NOT NULL" for r in RULES)} GROUP BY ALL),
sig AS (SELECT * FROM cnt, (SELECT count(DISTINCT stratum) AS strata FROM held)
        WHERE caught > 0 AND k <= n * {RISK} AND list_sum(list_transform(range(CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK}))))
              <= {DELTA} / ({math.prod(len(cs) + 1 for cs in RULES.values()) - 1} * strata)),
cut AS (SELECT stratum, {", ".join(f"v_{r}" for r in RULES)} FROM sig QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, k, {", ".join(f"a_{r} DESC" for r in RULES)}) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT ({_HIT}) AS kept
FROM s LEFT JOIN cut USING (stratum)
"""
