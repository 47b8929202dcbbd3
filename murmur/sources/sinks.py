"""Writers: JSON, JSON lines, CSV, dead letters, sample bundles, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _safe(x: object) -> object:
    """JSON-safe values: whole decimals as integers, other decimals as floats, sets sorted as strings."""
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, dict):
        return {str(k): _safe(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted((_safe(v) for v in x), key=str)
    if isinstance(x, (list, tuple)):
        return [_safe(v) for v in x]
    return x


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A summary: two spaces, sorted keys."""
    write_text(spark, path, json.dumps(_safe(value), indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """Fixed columns in a fixed order; a column the schema does not name raises."""
    if extra := set(df.columns) - set(columns):
        raise ValueError(f"unexpected columns: {sorted(extra)}")
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_split(df: DataFrame, good: str, bad: str, status: str = "error") -> None:
    """Append rows without an error to one place and the others to another."""
    df.where(F.col(status).isNull()).drop(status).write.mode("append").json(good)
    df.where(F.col(status).isNotNull()).write.mode("append").json(bad)


def export_sample(tables: dict[str, DataFrame], folder: str, manifest: dict) -> None:
    """A closed sample: users, tweets, edges, splits, labels, two empty tables, manifest and statistics. An existing one is not overwritten."""
    spark = tables["user"].sparkSession
    for name in ("user", "tweet"):
        write_jsonl(tables[name], f"{folder}/{name}.jsonl")
    write_csv(tables["edge"].select("source_id", "target_id", "relation").orderBy("relation", "source_id", "target_id"), f"{folder}/edge.csv", ["source_id", "target_id", "relation"])
    for name in ("split", "label"):
        write_csv(tables["user"].select(F.col("user_id").alias("id"), name), f"{folder}/{name}.csv", ["id", name])
    for name in ("list.jsonl", "hashtag.jsonl"):
        write_text(spark, f"{folder}/{name}", "")
    counts = {k: {str(r[0]): r[1] for r in tables[t].groupBy(k).count().collect()} for t, k in (("user", "split"), ("user", "label"), ("edge", "relation"))}
    write_json(spark, f"{folder}/manifest.json", manifest | {"distributions": counts})
    write_text(spark, f"{folder}/stats.md", report("Sample", {k: v for k, v in counts.items()}))


def report(title: str, sections: dict[str, dict[str, object]]) -> str:
    """Markdown with a list of key and value for each section."""
    lines = [f"# {title}", ""]
    for name, values in sections.items():
        lines += [f"## {name}", "", *[f"- {k}: {round(v, 8) if isinstance(v, float) else v}" for k, v in sorted(values.items(), key=lambda kv: str(kv[0]))], ""]
    return "\n".join(lines)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """The viewer's tables, a JSON folder each."""
    for name, df in tables.items():
        write_jsonl(df, f"{folder}/{name}.json", "overwrite")


def write_vectors(df: DataFrame, path: str, key: str = "user_id", vector: str = "embedding") -> None:
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.parquet(path)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
