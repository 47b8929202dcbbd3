"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on a local master, as in tests; a cluster has none that all share, so it raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="murmur-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors. Deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/murmur/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    at, fs = _fs(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame of written() once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at, fs = _fs(df.sparkSession, folder)
        fs.delete(at, True)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows (distinct keys) with their number from 0 in the order of the key. Ranges of keys are numbered for themselves, so no task has all rows."""
    parts = written(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("_first")
    return parts.join(F.broadcast(first), "_part").withColumn("number", number.cast("int")).drop("_part", "_first")
