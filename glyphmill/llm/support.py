"""Shared plumbing of the training-data operators: shared-folder tables and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every contract of this subpackage defines them.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows below which a two- or three-column table may be broadcast (about 32 MB).
BROADCAST_ROWS = 1_000_000


#: Bytes of rows that Spark hands to Python at once, where the session does not say.
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or an own one in local mode where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        folder = tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_arrow_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch for Python workers: wide rows else come 10,000 at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, str(64 << 20), "67108864b", "64MB", str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        spark.conf.set(name, str(ARROW_BYTES))


#: Parquet options for rows of megabytes: sizes are looked at after every row, not after a hundred, so pages and row
#: groups, which readers and writers hold whole in several copies, are of a few rows.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(4 << 20), "parquet.enable.dictionary": "false"}


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns a scan of it.

    This cuts the lineage at a table that survives the loss of any executor. The
    folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if its counted ``rows`` stay below ``limit``; Spark shuffles it otherwise."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int) -> Column:
    """True for ids whose crc32 (as text) leaves remainder 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus) == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
