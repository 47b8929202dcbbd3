"""Reading tables and chunking Arrow batches, used by all operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.sources.shared import drop_written, shared_dir, written

__all__ = ["drop_written", "fresh", "ordered", "partitions", "pieces", "raw", "shared_dir", "table", "written"]

#: Rows of a file that `ordered` puts in one run at most.
RUN = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `limit` bytes in a column (one row may exceed it): (rows, bytes, offsets)."""
    data, offsets = raw(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def fresh(columns: list[str], *names: str) -> list[str]:
    """The given names, each with as many underscores before it as no column of that name needs (case does not count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """These columns of df, and the order of its rows: `run`, texts in that order, of at most RUN rows each, and `row`, numbers in a run.

    Rows of a Parquet table go as they were written: by the numbers Spark gave the files, then by path, then by place in the file; readers deal
    them out otherwise. Any other frame is written first, so its rows go by partition and by place in it.
    """
    plan = df._jdf.queryExecution().analyzed()
    hidden = plan.metadataOutput()  # a frame with more than the scan has the scan's too, but not its own order in it
    if not plan.children().isEmpty() or hidden.isEmpty() or "row_index:" not in hidden.apply(0).dataType().simpleString():
        df = written(df.select(*[F.col(f"`{c}`") for c in columns]), "ordered")
    at = df.metadataColumn("_metadata")
    number = lambda pattern: F.lpad(F.regexp_extract(at["file_name"], pattern, 1), 10, "0")
    within = F.lpad(F.floor(at["row_index"] / RUN).cast("string"), 10, "0")
    run = F.concat_ws("/", number(r"^part-(\d+)"), number(r"-c(\d+)\."), at["file_path"], within)
    return df.select(*[F.col(f"`{c}`") for c in columns], run.alias("run"), at["row_index"].alias("row"))
