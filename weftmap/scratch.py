"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this machine only where none is named and all runs here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="weftmap-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/weftmap-{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftmap_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.weftmap_path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; where it errs, it is mostly too large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Tables proven to be below this many bytes are settled on the driver instead of in the shared folder.
LOCAL_BYTES = 8 << 20


def settle(df: DataFrame, most_rows: int, what: str, row_bytes: int = 64) -> DataFrame:
    """df worked out once: held by the driver if a bound known before says it is small, else written."""
    if most_rows * row_bytes <= LOCAL_BYTES:
        return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
    return materialise(df, what)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH doesn't already have it."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local":
        paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
        if str(root) not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *filter(None, paths)])
        return
    if getattr(context, "_weftmap_shipped", False):
        return
    # kept as long as the driver runs: executors may ask for it at any time
    target = Path(tempfile.mkdtemp(prefix="weftmap-"), "weftmap_src.zip")
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted((root / "weftmap").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(target))
    context._weftmap_shipped = True
