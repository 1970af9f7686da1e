"""Index maintenance: snapshot diff, upserts, cascades, manifest, outbox, garbage.

Tables are immutable DataFrames; each operation returns the next version. Keys meet in
plain equi joins (semi, anti, left), so Spark chooses the physical join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE_LIMIT = 100 * 1024
STATUSES = ("pending", "ready", "failed")


def skip_reason(path: Column, size: Column, content: Column, limit: int = SIZE_LIMIT) -> Column:
    """Why a file is not indexed (size, binary, lock file), or null."""
    lock = path.endswith(".json") & (path.endswith("-lock.json") | path.contains("node_modules/"))
    return F.when(size > limit, "large").when(F.instr(content, "\0") > 0, "binary").when(lock, "lock")


def snapshot_diff(scanned: DataFrame, known: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """Status of each path: added, modified, unchanged, skipped or deleted.

    Equal size and time skip the content (F2); otherwise equal hashes are unchanged (F4).
    """
    old = known.select("path", F.col("hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("there"))
    both = scanned.join(old, "path", "left")
    same = F.col("there") & (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    status = (
        F.when(F.col("size") > limit, "skipped").when(same, "unchanged").when(skip_reason(F.col("path"), F.col("size"), F.col("content"), limit).isNotNull(), "skipped")
        .when(F.col("there").isNull(), "added").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("modified")
    )
    gone = known.join(scanned, "path", "left_anti").select("path", F.lit("deleted").alias("status"))
    return both.select("path", status.alias("status")).unionByName(gone)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; columns ``keep`` retain their old values (K1)."""
    rest = old.join(new.select(*keys), keys, "left_anti")
    if keep:
        new = new.drop(*keep).join(old.select(*keys, *keep), keys, "left")
    return rest.unionByName(new.select(*old.columns))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk vectors of the paths in ``new`` are replaced; a chunk_id that occurs twice is kept once (K6)."""
    return replace_groups(old, new.dropDuplicates(["chunk_id"]), ["path"])


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """All rows of the groups that occur in ``new`` are replaced; an empty ``new`` changes nothing (K5, K6, K8)."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new.select(*old.columns))


def upsert_symbols(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Symbols per path are replaced; of rows with one key the last by ``order`` stays; null end lines are never equal (K7)."""
    key = ["path", "hash", "source", "kind", "name", "start_line", "end_line"]
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    single = new.where("end_line IS NOT NULL").withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth").unionByName(new.where("end_line IS NULL")).drop(order)
    return replace_groups(old, single, ["path"])


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Removes paths from files, manifest and symbols, and edges on either end (K3)."""
    paths = gone.select("path").distinct()
    out = {name: df.join(paths, "path", "left_anti") for name, df in tables.items() if name != "edges"}
    if "edges" in tables:
        for end in ("source_path", "target_path"):
            tables = tables | {"edges": tables["edges"].join(paths.withColumnRenamed("path", end), end, "left_anti")}
        out["edges"] = tables["edges"]
    return out


def ready_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths whose vectors are ready at the current hash."""
    m = manifest.where("status = 'ready'").select("path", F.col("hash").alias("m_hash"))
    return files.join(m, "path").where("vector_index_hash = hash AND m_hash = hash").select("path", "hash")


def needs_index(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths whose vectors are absent, stale, failed or pending."""
    m = manifest.select("path", F.col("hash").alias("m_hash"), "status")
    stale = "vector_index_hash IS NULL OR vector_index_hash <> hash OR m_hash IS NULL OR m_hash <> hash OR status <> 'ready'"
    return files.join(m, "path", "left").where(stale).select("path")


def orphans(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed (path, hash) pairs that no file has, and whether the path is gone as well."""
    lost = vectors.select("path", "hash").distinct().join(files.select("path", "hash"), ["path", "hash"], "left_anti")
    alive = files.select("path", F.lit(True).alias("there"))
    return lost.join(alive, "path", "left").select("path", "hash", F.col("there").isNull().alias("path_gone"))


def replay_outbox(outbox: DataFrame, files: DataFrame) -> DataFrame:
    """Marks that match the current hash apply, the others are discarded."""
    now = files.select("path", "hash", F.lit(True).alias("same"))
    return outbox.join(now, ["path", "hash"], "left").select("path", "hash", F.when(F.col("same"), "applied").otherwise("discarded").alias("outcome"))


def set_status(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """Manifest rows after status changes (``path, hash, status, chunk_count``); a null count keeps the old one (K9)."""
    old = manifest.select("path", F.col("chunk_count").alias("old_count"))
    new = changes.join(old, "path", "left").select("path", "hash", "status", F.coalesce("chunk_count", "old_count", F.lit(0)).alias("chunk_count"))
    return upsert(manifest.select("path", "hash", "status", "chunk_count"), new, ["path"])


def status_counts(manifest: DataFrame) -> DataFrame:
    """Rows by status, zero-filled (A1)."""
    every = manifest.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def touch(files: DataFrame, times: DataFrame) -> DataFrame:
    """``files`` with the times of ``times`` (path, mtime); other rows keep theirs (K2)."""
    new = times.select("path", F.col("mtime").alias("_mtime"))
    return files.join(new, "path", "left").withColumn("mtime", F.coalesce("_mtime", "mtime")).select(*files.columns)


def forget_vectors(files: DataFrame, manifest: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files without a vector hash and their manifest rows as pending, for ``paths`` or for all."""
    if paths is None:
        return files.withColumn("vector_index_hash", F.lit(None).cast("string")), manifest.withColumn("status", F.lit("pending"))
    mark = paths.select("path").distinct().withColumn("_mark", F.lit(True))
    files = files.join(mark, "path", "left").withColumn("vector_index_hash", F.when(F.col("_mark").isNull(), F.col("vector_index_hash"))).drop("_mark")
    manifest = manifest.join(mark, "path", "left").withColumn("status", F.when(F.col("_mark"), "pending").otherwise(F.col("status"))).drop("_mark")
    return files, manifest


def self_heal(status: DataFrame, waiting: DataFrame) -> DataFrame:
    """Unchanged paths whose vectors are not ready (J15): they are indexed again."""
    return status.where("status = 'unchanged'").select("path").join(waiting.select("path"), "path", "left_semi")


def scan_counts(status: DataFrame) -> DataFrame:
    """One row: total and paths by status (A4)."""
    names = ("added", "modified", "unchanged", "skipped", "deleted")
    return status.agg(F.count_if(F.col("status") != "deleted").alias("total"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def kv_set(kv: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value rows after setting ``new`` ones."""
    return upsert(kv, new, ["key"])


def kv_with_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    return kv.where(F.col("key").startswith(prefix)).orderBy("key")


def counters(events: DataFrame) -> DataFrame:
    """Counter values from appended increments; fractions are truncated."""
    return events.groupBy("key").agg(F.sum(F.col("delta").cast("long")).alias("value"))
