"""Versioned Parquet tables (K1-K13 storage): every write is a new folder, and a small version table points to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Tables under one root; ``write`` publishes a version, ``read`` opens the latest or a given one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(done(f"{self.root}/{name}/{n}/_SUCCESS")))

    def version(self, name: str) -> int:
        """Latest complete version; 0 if there is none."""
        return max(self._versions(name), default=0)

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        version = self.version(name) + 1
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v{version}")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{version or self.version(name)}")

    def clear(self, name: str) -> int:
        """Publishes an empty version (K4)."""
        return self.write(name, self.read(name).where(F.lit(False)))
