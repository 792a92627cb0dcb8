"""Helpers shared by the training-data operators: materialisation, batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (binds pa.compute)
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import cut as materialize  # noqa: F401
from ..sources.shared import new_folder as shared_dir  # noqa: F401
from ..sources.shared import _CLEANUP, release, ship  # noqa: F401

#: Bytes of text handled together by the numpy kernels; bounds a worker's memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucketed(df: DataFrame, column: str, n: int) -> DataFrame:
    """df written to the shared folder in n buckets of a column and read back: joins on that column deal out the other
    side alone. To be given back by `release` and `forget`."""
    spark, path, name = df.sparkSession, shared_dir(df.sparkSession), f"weft_{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        out = df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("compression", "zstd")
        out.saveAsTable(name, format="parquet", path=path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    out = spark.table(name)
    out._weft_path, out._weft_table = path, name
    return out


def forget(table: DataFrame) -> None:
    """Take a table that `bucketed` returned out of the catalog."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._weft_table}")


def fresh(columns: list[str], name: str) -> str:
    """A name for a further column, which none of these has."""
    taken = {c.lower() for c in columns}
    out = f"weft_{name}"
    while out in taken:
        out += "_"
    return out


def binary_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_binary without copying its bytes; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.view(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.view(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    return col


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about `most` bytes of the column each (one row at least), with that column's values."""
    values = binary_column(batch, column)
    n, at = len(values), 0
    if not n:
        return
    ends = np.cumsum(pa.compute.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at), values.slice(at, to - at).to_pylist()
        at = to
