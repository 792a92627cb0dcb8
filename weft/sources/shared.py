"""Tables written in the middle of a job, in the folder that all executors share, and code shipping."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which the shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir; only where that is unset (one machine, tests) a temporary folder. What is
    written there is removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/weft-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        return


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage stays short, and survives lost executors. The shuffle files
    that led to it are removed once it is written. by: a column whose values have folders of their own."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that `cut` returned and that nothing reads any more."""
    for table in tables:
        _drop(table.sparkSession, table._weft_path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_weft_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    tmp = tempfile.mkdtemp(prefix="weft-modules-")  # the driver's copy; Spark's file server hands it to executors
    atexit.register(shutil.rmtree, tmp, True)
    path = os.path.join(tmp, "weft_modules.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    sc._weft_shipped = True
