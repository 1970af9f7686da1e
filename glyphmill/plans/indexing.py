"""The index of a folder: incremental scan, tables, vectors and the lock around it (S6-S8, K1-K13, J15, ST6, X4, X5, API10)."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp_slice
from ..operators import imports, maintenance, rerank, symbols, syntax
from ..operators.chunking import vector_text
from ..sources.catalog import Catalog
from ..sources.corpus import crawl
from .context import Index

SCHEMAS = {
    "files": "path string, hash string, mtime double, size long, content string, language string, vector_index_hash string",
    "manifest": "path string, hash string, status string, chunk_count int",
    "chunks": "path string, hash string, chunk_index int, start int, end int, raw_start int, raw_end int, vector_start int, nws int, breadcrumb string, chunk_id string",
    "vectors": "path string, hash string, chunk_index int, chunk_id string, vector array<float>",
    "symbols": "path string, hash string, language string, name string, kind string, source string, start_line int, end_line int",
    "edges": "source_path string, callee string, line int, target_path string, target_line int",
    "links": "src string, language string, import_str string, dst string",
    "kv": "key string, value string",
}
#: Seconds that a scan waits for another one of the same project.
LOCK_WAIT = 600.0
Progress = Callable[[str, int], None]


class Project:
    """Indexed tables of one folder under ``root``; each write is a new version of a table."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[pd.Series], list[list[float]]] | None = None):
        self.spark, self.catalog, self.embedder = spark, Catalog(spark, root), embedder

    def read(self, name: str) -> DataFrame:
        """The latest version of a table, or an empty one."""
        return self.catalog.read(name) if self.catalog.version(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, name: str, df: DataFrame) -> None:
        columns = [f.split()[0] for f in SCHEMAS[name].split(", ")]
        self.catalog.write(name, df.select(*columns))

    @contextmanager
    def locked(self, wait: float = LOCK_WAIT):
        """One writer at a time: the folder ``lock`` is made by whoever holds it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.catalog.root}/lock")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        until = time.monotonic() + wait
        while True:
            try:
                fs.create(path, False).close()
                break
            except Exception as held:
                if time.monotonic() >= until:
                    raise TimeoutError(f"another scan holds {path.toString()}") from held
                time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(path, False)

    def index(self, scanned: DataFrame, vectors: bool = True, force: bool = False, progress: Progress | None = None) -> dict[str, int]:
        """Brings the tables up to date with the scanned files; returns the counts of the scan.

        Only changed files are parsed. Files whose vectors are not ready are embedded
        again, changed or not. ``force`` starts from empty tables.
        """
        tell = progress or (lambda stage, n: None)
        if force:
            for name in ("files", "chunks", "vectors", "symbols", "edges", "links"):
                self._write(name, self.spark.createDataFrame([], SCHEMAS[name]))
        known = self.read("files")
        status = maintenance.snapshot_diff(scanned, known)
        self.catalog.write("status", status)
        status = self.catalog.read("status")
        counts = maintenance.scan_counts(status).first().asDict()
        tell("scanned", counts["total"])
        changed = scanned.join(status.where("status IN ('added', 'modified')").select("path"), "path", "left_semi")
        gone = status.where("status = 'deleted'").select("path")
        new = changed.withColumn("vector_index_hash", F.lit(None).cast("string"))
        files = maintenance.upsert(known, new.select(*known.columns), ["path"], keep=["vector_index_hash"])
        self._write("files", files.join(gone, "path", "left_anti"))
        files = self.read("files")
        touched = status.where("status IN ('added', 'modified', 'deleted')").select("path")
        fresh = files.join(touched, "path", "left_semi")
        self._replace("chunks", syntax.chunks_of(fresh), touched)
        defined = syntax.symbols_of(fresh).withColumn("source", F.lit("tree-sitter"))
        self._replace("symbols", defined, touched)
        places = defined.where(F.col("kind").isin("function", "method", "class", "interface"))
        edges = symbols.nearest_definition(syntax.calls_of(fresh), places)
        edges = edges.select(F.col("path").alias("source_path"), "callee", "line", F.col("path").alias("target_path"), "target_line")
        self._write("edges", self._without("edges", touched, "source_path", gone).unionByName(edges))
        links = imports.resolve_imports(imports.extract_imports(files), files.select("path"))
        self._write("links", links)
        healed = 0
        if vectors:
            healed = self._embed(files, tell)
        if counts["added"] + counts["modified"] + counts["deleted"] + healed:
            self.bump()
        return counts | {"embedded": healed}

    def _without(self, name: str, touched: DataFrame, column: str, gone: DataFrame) -> DataFrame:
        old = self.read(name).join(touched.withColumnRenamed("path", column), column, "left_anti")
        return old.join(gone.withColumnRenamed("path", "target_path"), "target_path", "left_anti").select(*old.columns)

    def _replace(self, name: str, new: DataFrame, touched: DataFrame) -> None:
        old = self.read(name).join(touched, "path", "left_anti")
        self._write(name, old.unionByName(new.select(*old.columns)))

    def _embed(self, files: DataFrame, tell: Progress) -> int:
        """Embeds the chunks of all files whose vectors are not ready, marks them, and drops what no file has."""
        manifest = self.read("manifest").join(files.select("path"), "path", "left_semi")
        waiting = maintenance.needs_index(files, manifest)
        chunks = self.read("chunks").join(waiting, "path", "left_semi")
        n = waiting.count()
        if not n and maintenance.orphans(self.read("vectors"), files).isEmpty():
            return 0
        code = clamp_slice(F.col("content"), F.col("vector_start"), F.col("end"))
        texts = chunks.join(files.select("path", "content"), "path").select("path", "hash", "chunk_index", "chunk_id", vector_text(F.col("breadcrumb"), code).alias("text"))
        vectors = rerank.embed(texts, "text", embedder=self.embedder).drop("text")
        alive = self.read("vectors").join(waiting, "path", "left_anti").join(files.select("path"), "path", "left_semi")
        self._write("vectors", alive.unionByName(vectors.dropDuplicates(["chunk_id"]).select(*alive.columns)))
        number = chunks.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        marks = files.join(waiting, "path", "left_semi").join(number, "path", "left").select("path", "hash", F.lit("ready").alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
        self._write("manifest", maintenance.set_status(manifest, marks))
        self._write("files", files.withColumn("vector_index_hash", F.col("hash")))
        tell("embedded", n)
        return n

    def bump(self) -> int:
        """Raises the index version."""
        version = self.version() + 1
        self._write("kv", maintenance.kv_set(self.read("kv"), self.spark.createDataFrame([("index_version", str(version))], SCHEMAS["kv"])))
        return version

    def version(self) -> int:
        """The index version; a text that is no number counts as 0."""
        row = self.read("kv").where("key = 'index_version'").select(F.expr("try_cast(value AS INT)").alias("v")).first()
        return int(row["v"] or 0) if row else 0

    def search_index(self) -> Index:
        files = self.read("files")
        ready = maintenance.ready_hashes(files, self.read("manifest"))
        return Index(files, self.read("chunks"), self.read("vectors"), self.read("links"), ready, self.version())


_projects: dict[tuple[int, str], Project] = {}


def project_of(spark: SparkSession, root: str, embedder: Callable[[pd.Series], list[list[float]]] | None = None) -> Project:
    """One ``Project`` per session and root."""
    key = (id(spark), root)
    if key not in _projects:
        _projects[key] = Project(spark, root, embedder)
    return _projects[key]


def ensure_indexed(project: Project, folder: str, vectors: bool = True, force: bool = False, ignore: list[str] | None = None, progress: Progress | None = None) -> dict[str, int]:
    """An incremental scan of ``folder`` under the project's lock; metadata tools skip the vectors (API10)."""
    with project.locked():
        return project.index(crawl(project.spark, folder, ignore), vectors, force, progress)
