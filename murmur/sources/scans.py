"""Readers for CSV, JSON lines, JSON arrays and wrapped JSON objects, and keyed scans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys under which an object may hold its records.
WRAPPERS = ("data", "items", "records", "users", "tweets")


def _files(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted({str(f.getPath().toString()) for f in found or []})


def require_path(spark: SparkSession, path: str) -> str:
    if not _files(spark, path):
        raise FileNotFoundError(path)
    return path


def resolve(spark: SparkSession, folder: str, *names: str) -> str:
    """The first of some file names that a folder has; raises without any."""
    for name in names:
        if _files(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"{folder}: {', '.join(names)}")


def shards(spark: SparkSession, folder: str, stem: str = "tweet_*") -> list[str]:
    """Sorted shard files of a folder, JSON or JSON lines."""
    return sorted({f for suffix in ("json", "jsonl") for f in _files(spark, f"{folder}/{stem}.{suffix}")})


def _placed(df: DataFrame, place: str | None) -> DataFrame:
    """df, as a reader gives it, with a column that ascends in the order of the files' records: path, start of the split, number in the split."""
    if place is None:
        return df
    parts = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")
    return df.select("*", F.struct(*parts).alias(place))


def first_of(df: DataFrame, key: str, place: str = "place") -> DataFrame:
    """The first record of each key by `place`, which is dropped."""
    columns = [c for c in df.columns if c not in (key, place)]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), place).alias("r")).select(key, *[F.col(f"r.`{c}`") for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], place: str | None = None) -> DataFrame:
    """All cells as strings; null cells are empty strings. place: a column for the order of records, as in the further readers."""
    return _placed(spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"'), place).na.fill("")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, place: str | None = None) -> DataFrame:
    """One record a line; blank lines are skipped, a broken line raises."""
    reader = spark.read.option("mode", "FAILFAST")
    return _placed((reader.schema(schema) if schema else reader).json(path), place)


def read_json_array(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, place: str | None = None) -> DataFrame:
    """A file that is one array of records. Such a file is read by one task: convert it once."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", True)
    return _placed((reader.schema(schema) if schema else reader).json(path), place)


def read_json_object(spark: SparkSession, path: str | list[str], schema: str | T.StructType, place: str | None = None) -> DataFrame:
    """An object that wraps records under a known key, as an array or by id; or else each value that is an object, with `id` from its key."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = _placed(spark.read.text(path, wholetext=True), "place")
    inner = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in WRAPPERS])
    body = text.select(F.coalesce(inner, F.col("value")).alias("body"), "place")
    array = body.where(F.ltrim("body").startswith("[")).select("place", F.posexplode(F.from_json("body", T.ArrayType(kind))).alias("n", "r")).withColumn("k", F.lit(None).cast("string"))
    named = body.where(F.ltrim("body").startswith("{")).select("place", F.posexplode(F.from_json("body", T.MapType(T.StringType(), T.StringType()))).alias("n", "k", "v"))
    named = named.where(F.ltrim("v").startswith("{")).select("place", "n", F.from_json("v", kind).alias("r"), "k")
    rows = array.unionByName(named)
    fields = [F.coalesce(F.col("r.id").cast("string"), F.col("k")).alias("id") if f.name == "id" else F.col(f"r.`{f.name}`").alias(f.name) for f in kind.fields]
    nth = F.struct("place.path", "place.start", F.col("n").cast("long").alias("nth"))
    return rows.select(*fields, *([nth.alias(place)] if place else []))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None, place: str | None = None) -> DataFrame:
    """JSON of any of these forms, told apart by suffix and the first character that is not blank."""
    if path.endswith((".jsonl", ".ndjson")):
        return read_jsonl(spark, path, schema, place)
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    first = head[0].value.lstrip()[:1] if head else "["
    if first == "[":
        return read_json_array(spark, path, schema, place)
    if schema is None:
        raise ValueError("a JSON object needs a schema")
    return read_json_object(spark, path, schema, place)


def with_raw(df: DataFrame) -> DataFrame:
    """df with `raw`, each record whole as JSON, so that fields no schema names survive."""
    return df.withColumn("raw", F.to_json(F.struct(*df.columns)))


def read_map(df: DataFrame, value: str, order: str | None = None) -> DataFrame:
    """(id, value) from rows with id or user_id; of several the last by `order`, or the largest without one, as rows have no order."""
    keys = [F.when(F.col(c) != "", F.col(c)) for c in ("id", "user_id") if c in df.columns]
    rows = df.select(F.coalesce(*keys).alias("id"), F.col(value).alias(value), (F.col(order) if order else F.col(value)).alias("_o"))
    return rows.where("id is not null").groupBy("id").agg(F.max_by(value, "_o").alias(value))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def lookup(records: DataFrame, ids: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The first record of each wanted id."""
    found = records.join(ids.select(key).distinct(), key, "left_semi")
    by = Window.partitionBy(key).orderBy(order or F.xxhash64(*records.columns))
    return found.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def unprocessed(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records whose key an earlier output does not have."""
    return records.join(done.select(key).distinct(), key, "left_anti")
