"""Sinks: JSON, CSV, manifests, SARIF, JUnit, metrics text and WAVE files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wave


def flat(df: DataFrame) -> DataFrame:
    """K3: nested columns as `_json` texts, so that a row stays flat."""
    nested = lambda t: t.startswith(("array", "struct", "map", "variant"))
    return df.select(*[F.to_json(c).alias(f"{c}_json") if nested(t) else F.col(c) for c, t in df.dtypes])


def write_ndjson(df: DataFrame, path: str) -> None:
    """K2: a JSON object per line; null fields are kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K3."""
    flat(df).write.option("header", "true").csv(path)


def json_document(df: DataFrame, order: list[str]) -> DataFrame:
    """K1: one JSON array of all rows in order; for reports, which are small."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct("*").alias("v"))))
    return df.agg(F.to_json(F.transform(rows, lambda x: x["v"])).alias("document"))


def manifest(assets: DataFrame, verdicts: list[str], order: list[str]) -> DataFrame:
    """K5: counts and assets; a false verdict fails an asset, a null one doesn't."""
    ok = F.lit(True)
    for v in verdicts:
        ok = ok & F.coalesce(F.col(v), F.lit(True))
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct("*").alias("v"))))
    found = assets.withColumn("passed", ok).agg(F.count("*").alias("assets_total"), F.count_if("passed").alias("assets_passed"), F.count_if(~F.col("passed")).alias("assets_failed"), F.transform(rows, lambda x: x["v"]).alias("assets"))
    return found.select(F.to_json(F.struct(F.lit(3).alias("version"), "*")).alias("document"))


def sarif(findings: DataFrame) -> DataFrame:
    """K6: SARIF 2.1.0 of findings (rule_id, severity, path, message)."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    rows = findings.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "rule_id", "message", result.alias("r")))), lambda x: x["r"]).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("ids"))
    driver = F.struct(F.struct(F.lit("wavequarry").alias("name"), F.transform("ids", lambda x: F.struct(x.alias("id"))).alias("rules")).alias("driver"))
    run = F.array(F.struct(driver.alias("tool"), F.col("results")))
    return rows.select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), run.alias("runs"))).alias("document"))


def xml_text(c: Column) -> Column:
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def junit(findings: DataFrame, suite: str) -> DataFrame:
    """K7: JUnit XML of findings (path, rule_id, passed, message): a case per asset and rule."""
    fail = F.when(~F.col("passed"), F.concat(F.lit('<failure message="'), xml_text(F.col("message")), F.lit('"/>'))).otherwise("")
    case = F.concat(F.lit('<testcase classname="'), xml_text(F.col("path")), F.lit('" name="'), xml_text(F.col("rule_id")), F.lit('">'), fail, F.lit("</testcase>"))
    rows = findings.agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("bad"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "rule_id", case.alias("c")))), lambda x: x["c"]), "\n").alias("cases"))
    return rows.select(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="{suite}" tests="'), F.col("n").cast("string"), F.lit('" failures="'), F.col("bad").cast("string"), F.lit('">\n'), F.col("cases"), F.lit("\n</testsuite>\n")).alias("document"))


def metrics_text(histogram: DataFrame, name: str) -> DataFrame:
    """Cumulative buckets (le, n) as metrics text."""
    line = F.concat(F.lit(f'{name}_bucket{{le="'), F.coalesce(F.col("le").cast("string"), F.lit("+Inf")), F.lit('"} '), F.col("n").cast("string"))
    order = F.coalesce("le", F.lit(float("inf")))
    rows = histogram.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("body"), F.max("n").alias("total"))
    return rows.select(F.concat(F.lit(f"# TYPE {name} histogram\n"), F.col("body"), F.lit(f"\n{name}_count "), F.col("total").cast("string"), F.lit("\n")).alias("document"))


def write_waves(chunks: DataFrame, folder: str, kind: str = "s16", dither: bool = False) -> DataFrame:
    """K9: a WAVE file per asset, written under a temporary name and moved into place; returns (asset_id, path, bytes).

    An asset's chunks meet in one task, which is what a file needs.
    """
    import numpy as np
    import pandas as pd

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        rows = rows.sort_values(["channel", "chunk_no"])
        x = np.stack([np.concatenate([np.asarray(s) for s in own["samples"]]) for _, own in rows.groupby("channel")])
        data = wave.wave_bytes(x, int(rows["sample_rate"].iloc[0]), kind, dither)
        asset = rows["asset_id"].iloc[0]
        name = asset.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/.{name}.part") as out:
            out.write(data)
        system.move(f"{root}/.{name}.part", f"{root}/{name}.wav")
        return pd.DataFrame([(asset, f"{root}/{name}.wav", len(data))], columns=["asset_id", "path", "bytes"])

    return chunks.groupBy("asset_id").applyInPandas(write, "asset_id string, path string, bytes long")
