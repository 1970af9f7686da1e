"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet and returns a scan of it: computed once, read often, safe when an executor is lost.

    The table goes when the driver's JVM ends. Without a shared folder this works in local mode only.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        folder = tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    return spark.read.schema(df.schema).parquet(path)
