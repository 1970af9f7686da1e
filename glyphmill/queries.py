"""Registered queries over the test tables, with the SQL that must give the same rows.

Binding: ``documents`` is the file corpus (path ``source/doc_id.lang``); an embedding with
``vec_id = doc_id`` is a document's vector and its label drives the manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import chunking, expansion, imports, maintenance, ranking, rerank, symbols, syntax
from .plans.context import Index, context, with_code
from .sources.corpus import files_of_documents
from .sources.scratch import stored
from .streaming.watch import bursts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PHRASES = ["thing", "ation", "quel"]
FILES_SQL = "f AS (SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.' || coalesce(lang, 'txt') AS path, sha256(coalesce(text, '')) AS hash, CAST(n_chars AS BIGINT) AS size, text AS content, lang AS language FROM documents)"
MANIFEST_SQL = (
    FILES_SQL + ", v AS (SELECT f.path, f.hash, CASE WHEN f.doc_id % 11 = 0 THEN 'old' ELSE f.hash END AS m_hash, CASE e.label % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'ready' END AS status, e.label FROM f JOIN embeddings e ON e.vec_id = f.doc_id)"
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return files_of_documents(_table(spark, d, "documents"))


def _manifest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files with their vector hash, and the manifest."""
    files = _files(spark, d)
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    met = files.join(e, "doc_id", "left").withColumn("vector_index_hash", F.when(F.col("label").isNotNull(), F.col("hash")))
    status = F.when(F.col("label") % 5 == 0, "failed").when(F.col("label") % 5 == 1, "pending").otherwise("ready")
    manifest = met.where("label IS NOT NULL").select("path", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("hash")).alias("hash"), status.alias("status"), F.col("label").alias("chunk_count"))
    return met.select("path", "hash", "vector_index_hash"), manifest


def _vector(spark: SparkSession, d: str, vec_id: int = 7) -> list[float]:
    return list(_table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


# --- metadata and maintenance -------------------------------------------------------


@register("list_files_glob", f"WITH {FILES_SQL} SELECT path, language, size FROM f WHERE language = 'en' AND regexp_matches(path, '^(?:.*/)?[^/]*1[^/]\\.en$') ORDER BY path LIMIT 200")
def list_files_glob(spark, d):
    return symbols.list_files(_files(spark, d), "**/*1?.en", "en")


_SYMBOLS_SQL = FILES_SQL + ", y AS (SELECT path, hash, 'sym' || doc_id % 50 AS name, CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'call' ELSE 'method' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'ctags' ELSE 'tree-sitter' END AS source, doc_id % 97 AS start_line, language FROM f)"


def _symbols(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "function").when(i % 4 == 1, "class").when(i % 4 == 2, "call").otherwise("method")
    return _files(spark, d).select("path", "hash", F.concat(F.lit("sym"), i % 50).alias("name"), kind.alias("kind"), F.when(i % 3 == 0, "ctags").otherwise("tree-sitter").alias("source"), (i % 97).alias("start_line"), "language")


@register("list_symbols_filter", f"WITH {_SYMBOLS_SQL} SELECT path, name, kind, source, start_line FROM y WHERE path ILIKE 'SRC1%/%' AND kind IN ('function', 'class') AND source = 'tree-sitter' ORDER BY path, start_line, name LIMIT 100")
def list_symbols_filter(spark, d):
    return symbols.list_symbols(_symbols(spark, d), "SRC1*/*", ["function", "class"], source="tree-sitter").select("path", "name", "kind", "source", "start_line")


@register("symbols_per_file", f"WITH {_SYMBOLS_SQL} SELECT path, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM y WHERE kind <> 'call' GROUP BY path")
def symbols_per_file(spark, d):
    return symbols.symbols_per_file(_symbols(spark, d))


@register("languages_by_count", f"WITH {FILES_SQL} SELECT language, count(*) AS n FROM f GROUP BY language")
def languages_by_count(spark, d):
    return symbols.languages(_files(spark, d))


@register(
    "definition_rank",
    f"WITH {_SYMBOLS_SQL} SELECT path, name, kind, source, start_line FROM y WHERE name = 'sym3' AND kind NOT IN ('call', 'reference') ORDER BY CASE WHEN source = 'tree-sitter' THEN 0 ELSE 1 END, CASE WHEN starts_with(path, 'src/') THEN 0 WHEN starts_with(path, 'tests/') THEN 2 ELSE 1 END, start_line, path LIMIT 5",
)
def definition_rank(spark, d):
    return symbols.definitions_of(_symbols(spark, d), "sym3", limit=5).select("path", "name", "kind", "source", "start_line")


@register("health_snapshot", f"WITH {FILES_SQL}, l AS (SELECT language, count(*) AS n FROM f GROUP BY language) SELECT (SELECT count(*) FROM f) AS files, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM f) AS bytes, (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM l) AS languages, (SELECT count(*) FROM labels) AS pending")
def health_snapshot(spark, d):
    return symbols.health(_files(spark, d), _table(spark, d, "labels"))


@register("manifest_counts", f"WITH {MANIFEST_SQL}, s AS (SELECT unnest(['pending', 'ready', 'failed']) AS status) SELECT s.status, count(v.path) AS n FROM s LEFT JOIN v ON v.status = s.status GROUP BY s.status")
def manifest_counts(spark, d):
    return maintenance.status_counts(_manifest(spark, d)[1])


@register("ready_join", f"WITH {MANIFEST_SQL} SELECT path, hash FROM v WHERE status = 'ready' AND m_hash = hash")
def ready_join(spark, d):
    return maintenance.ready_hashes(*_manifest(spark, d))


@register("needs_index", f"WITH {MANIFEST_SQL} SELECT f.path FROM f LEFT JOIN v ON v.path = f.path WHERE v.path IS NULL OR v.m_hash <> f.hash OR v.status <> 'ready'")
def needs_index(spark, d):
    return maintenance.needs_index(*_manifest(spark, d))


@register("gc_orphans", f"WITH {MANIFEST_SQL}, a AS (SELECT path, hash FROM f WHERE doc_id % 13 <> 0) SELECT DISTINCT v.path, v.m_hash AS hash, NOT EXISTS (SELECT 1 FROM a WHERE a.path = v.path) AS path_gone FROM v WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path = v.path AND a.hash = v.m_hash)")
def gc_orphans(spark, d):
    return maintenance.orphans(_manifest(spark, d)[1], _files(spark, d).where("doc_id % 13 <> 0"))


@register("outbox_replay", f"WITH {MANIFEST_SQL} SELECT v.path, v.m_hash AS hash, CASE WHEN f.hash = v.m_hash THEN 'applied' ELSE 'discarded' END AS outcome FROM v LEFT JOIN f ON f.path = v.path WHERE v.status = 'pending'")
def outbox_replay(spark, d):
    return maintenance.replay_outbox(_manifest(spark, d)[1].where("status = 'pending'"), _files(spark, d))


@register(
    "snapshot_diff",
    f"""WITH {FILES_SQL}, s AS (SELECT * FROM f WHERE doc_id % 17 <> 0),
k AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE hash END AS hash, CASE WHEN doc_id % 3 = 0 THEN size ELSE size + 1 END AS size, doc_id FROM f WHERE doc_id % 10 <> 0)
SELECT s.path, CASE WHEN s.size > 102400 THEN 'skipped' WHEN k.path IS NOT NULL AND s.size = k.size THEN 'unchanged' WHEN k.path IS NULL THEN 'added' WHEN s.hash = k.hash THEN 'unchanged' ELSE 'modified' END AS status
FROM s LEFT JOIN k ON k.path = s.path UNION ALL SELECT path, 'deleted' FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = k.path)""",
)
def snapshot_diff(spark, d):
    files = _files(spark, d)
    i = F.col("doc_id")
    known = files.where(i % 10 != 0).select("path", F.when(i % 5 == 0, "x").otherwise(F.col("hash")).alias("hash"), F.when(i % 3 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"), "mtime")
    return maintenance.snapshot_diff(files.where(i % 17 != 0), known)


@register("scan_counts", f"""WITH {FILES_SQL}, s AS (SELECT * FROM f WHERE doc_id % 17 <> 0), k AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE hash END AS hash, CASE WHEN doc_id % 3 = 0 THEN size ELSE size + 1 END AS size FROM f WHERE doc_id % 10 <> 0),
t AS (SELECT CASE WHEN s.size > 102400 THEN 'skipped' WHEN k.path IS NOT NULL AND s.size = k.size THEN 'unchanged' WHEN k.path IS NULL THEN 'added' WHEN s.hash = k.hash THEN 'unchanged' ELSE 'modified' END AS status FROM s LEFT JOIN k ON k.path = s.path UNION ALL SELECT 'deleted' FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = k.path))
SELECT count(*) FILTER (status <> 'deleted') AS total, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'deleted') AS deleted FROM t""")
def scan_counts(spark, d):
    return maintenance.scan_counts(snapshot_diff(spark, d))


@register("self_heal", f"""WITH {MANIFEST_SQL}, w AS (SELECT f.path FROM f LEFT JOIN v ON v.path = f.path WHERE v.path IS NULL OR v.m_hash <> f.hash OR v.status <> 'ready'),
s AS (SELECT * FROM f WHERE doc_id % 17 <> 0), k AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE hash END AS hash, CASE WHEN doc_id % 3 = 0 THEN size ELSE size + 1 END AS size FROM f WHERE doc_id % 10 <> 0)
SELECT s.path FROM s JOIN k ON k.path = s.path WHERE s.size <= 102400 AND (s.size = k.size OR s.hash = k.hash) AND s.path IN (SELECT path FROM w)""")
def self_heal(spark, d):
    return maintenance.self_heal(snapshot_diff(spark, d), maintenance.needs_index(*_manifest(spark, d)))


@register(
    "symbol_upsert",
    f"""WITH {_SYMBOLS_SQL}, o AS (SELECT DISTINCT path, hash, source, kind, name, start_line FROM y)
SELECT path, 'new' AS hash, 'ctags' AS source, 'function' AS kind, name, start_line FROM o WHERE start_line % 2 = 0 UNION ALL SELECT path, hash, source, kind, name, start_line FROM o WHERE path NOT IN (SELECT path FROM o WHERE start_line % 2 = 0)""",
)
def symbol_upsert(spark, d):
    old = _symbols(spark, d).select("path", "hash", "source", "kind", "name", "start_line", F.col("start_line").alias("end_line"))
    fresh = old.where("start_line % 2 = 0").select("path", F.lit("new").alias("hash"), F.lit("ctags").alias("source"), F.lit("function").alias("kind"), "name", "start_line", "end_line")
    twice = fresh.withColumn("seq", F.lit(1)).unionByName(fresh.withColumn("seq", F.lit(2)))
    return maintenance.upsert_symbols(old, twice, "seq").drop("end_line")


_GONE = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@register(
    "cascade_delete",
    f"""SELECT 'files' AS part, c_custkey AS path, CAST(c_nationkey AS BIGINT) AS other FROM customer WHERE c_custkey NOT IN ({_GONE}) UNION ALL SELECT 'manifest', c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN ({_GONE})
UNION ALL SELECT 'symbols', o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN ({_GONE}) UNION ALL SELECT 'edges', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN ({_GONE}) AND o_orderkey NOT IN ({_GONE})""",
)
def cascade_delete(spark, d):
    customer, orders = _table(spark, d, "customer"), _table(spark, d, "orders")
    tables = {
        "files": customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("long").alias("other")),
        "manifest": customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("path"), F.lit(0).cast("long").alias("other")),
        "symbols": orders.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("other")),
        "edges": orders.select(F.col("o_orderkey").alias("source_path"), F.col("o_custkey").alias("target_path")),
    }
    left = maintenance.cascade_delete(tables, customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("path")))
    left["edges"] = left["edges"].select(F.col("source_path").alias("path"), F.col("target_path").alias("other"))
    parts = [df.select(F.lit(name).alias("part"), "path", "other") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("forget_vectors", f"WITH {MANIFEST_SQL} SELECT path, m_hash AS hash, CASE WHEN label % 2 = 0 THEN 'pending' ELSE status END AS status FROM v")
def forget_vectors(spark, d):
    files, manifest = _manifest(spark, d)
    return maintenance.forget_vectors(files, manifest, manifest.where("chunk_count % 2 = 0"))[1].select("path", "hash", "status")


@register("stats_rates", "SELECT event_type AS name, CASE WHEN count(*) > 0 THEN round(sum(value) / count(*), 6) END AS avg_ms, CASE WHEN count(*) FILTER (user_id % 2 = 0) > 0 THEN round(CAST(count(*) FILTER (user_id % 4 = 0) AS DOUBLE) / count(*) FILTER (user_id % 2 = 0), 6) END AS hit_rate FROM events GROUP BY event_type")
def stats_rates(spark, d):
    sums = _table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("total_ms"), F.count(F.lit(1)).alias("runs"), F.count_if(F.expr("user_id % 4 = 0")).alias("hits"), F.count_if(F.expr("user_id % 2 = 0")).alias("queries"))
    return symbols.rates(sums).select("name", F.round("avg_ms", 6).alias("avg_ms"), F.round("hit_rate", 6).alias("hit_rate"))


# --- chunks and text -----------------------------------------------------------------

CHUNKS_SQL = (
    FILES_SQL
    + r""", l AS (SELECT doc_id, i, s AS line, length(s) AS len, length(translate(s, E' \t\r\n', '')) AS nws, CAST(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(s) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(content, E'\n')) AS s, generate_subscripts(string_split(content, E'\n'), 1) AS i FROM f)),
r AS (SELECT doc_id, i, pos AS start, nws, pos, len, nws AS own FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.nws + l.nws > 500 THEN l.pos ELSE r.start END, CASE WHEN r.nws + l.nws > 500 THEN l.nws ELSE r.nws + l.nws END, l.pos, l.len, l.nws FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
g AS (SELECT doc_id, start, max(pos + len) AS "end", CAST(sum(own) AS BIGINT) AS nws FROM r GROUP BY doc_id, start),
c AS (SELECT f.path, f.hash, f.doc_id, f.content, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, CAST(g.start AS INTEGER) AS start, CAST(g."end" AS INTEGER) AS "end", CAST(coalesce(lead(g.start) OVER w, length(f.content)) AS INTEGER) AS raw_end, CAST(g.nws AS INTEGER) AS nws FROM g JOIN f ON f.doc_id = g.doc_id WINDOW w AS (PARTITION BY g.doc_id ORDER BY g.start))"""
)


def _chunks(spark, d):
    return chunking.chunk_table(_files(spark, d))


@register("line_chunks", f'WITH RECURSIVE {CHUNKS_SQL} SELECT path, chunk_index, start, "end", start AS raw_start, raw_end, nws FROM c')
def line_chunks(spark, d):
    return _chunks(spark, d).select("path", "chunk_index", "start", "end", "raw_start", "raw_end", "nws")


@register("chunk_slices", f'WITH RECURSIVE {CHUNKS_SQL} SELECT path || \'#\' || hash || \'#\' || chunk_index AS chunk_id, sha256(\'// Context: \' || path || E\'\\n\' || substr(content, start + 1, "end" - start)) AS sha FROM c')
def chunk_slices(spark, d):
    rows = _chunks(spark, d).join(_files(spark, d).select("path", "content"), "path")
    return rows.select("chunk_id", F.sha2(chunking.vector_text(F.col("breadcrumb"), tx.clamp_slice(F.col("content"), F.col("start"), F.col("end"))), 256).alias("sha"))


@register("offset_to_line", f"WITH {FILES_SQL} SELECT path, length(translate(content, E' \\t\\r\\n', '')) AS nws, 1 + length(substr(content, 1, CAST(size // 2 AS INTEGER))) - length(replace(substr(content, 1, CAST(size // 2 AS INTEGER)), E'\\n', '')) AS line FROM f")
def offset_to_line(spark, d):
    return _files(spark, d).select("path", tx.visible_length(F.col("content")).alias("nws"), tx.line_of(F.col("content"), F.floor(F.col("size") / 2).cast("int")).alias("line"))


@register(
    "scalar_text",
    f"""WITH {FILES_SQL} SELECT path, CASE WHEN length(path) <= 9 THEN path ELSE substr(path, 1, 3) || '...' || right(path, 3) END AS short,
CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size / 102.4 + 0.5) / 10) WHEN size IS NOT NULL THEN printf('%.1f MB', floor(size / 104857.6 + 0.5) / 10) END AS shown,
md5(content) AS digest, CASE WHEN length(content) <= 100 THEN content ELSE substr(content, 1, 67) || '...' || right(content, 30) END AS cut FROM f""",
)
def scalar_text(spark, d):
    c = F.col("content")
    return _files(spark, d).select("path", tx.truncate_middle(F.col("path"), 9).alias("short"), tx.human_size(F.col("size")).alias("shown"), F.md5(c).alias("digest"), tx.truncate_head_tail(c, 100).alias("cut"))


@register("references_lines", f"WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(content, E'\\n')) AS s, generate_subscripts(string_split(content, E'\\n'), 1) AS line FROM f) SELECT path, CAST(line AS INTEGER) AS line, trim(s, ' ') AS text FROM l WHERE regexp_matches(s, '(?:^|[^A-Za-z0-9_$])thing(?:$|[^A-Za-z0-9_$])')")
def references_lines(spark, d):
    return symbols.references(_files(spark, d), "thing")


# --- retrieval ------------------------------------------------------------------------


def _bm25_sql(table: str, keys: str, column: str, phrases: list[str], mode: str) -> str:
    """CTE ``{table}_bm25`` with exact BM25 scores."""
    tf = ", ".join(f"(length(lower({column})) - length(replace(lower({column}), '{p}', ''))) // {len(p)} AS f{i}" for i, p in enumerate(phrases))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(phrases)))
    any_ = (" AND " if mode == "and" else " OR ").join(f"f{i} > 0" for i in range(len(phrases)))
    return f"{table}_tf AS (SELECT {keys}, greatest(length({column}) - 2, 0) AS len, {tf} FROM {table}), {table}_st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean, {ns} FROM {table}_tf), {table}_bm25 AS (SELECT {keys}, {score} AS score FROM {table}_tf, {table}_st WHERE {any_})"


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@register("bm25_or_topk", f"WITH {FILES_SQL}, {_bm25_sql('f', 'path', 'content', PHRASES, 'or')} SELECT path, round(score, 6) AS score FROM f_bm25 ORDER BY f_bm25.score DESC, path LIMIT 20")
def bm25_or_topk(spark, d):
    return _rounded(ranking.bm25(_files(spark, d), ["path"], ["content"], PHRASES).orderBy(F.desc("score"), "path").limit(20), "score")


@register("bm25_and", f"WITH {FILES_SQL}, {_bm25_sql('f', 'path', 'content', PHRASES[:2], 'and')} SELECT path, round(score, 6) AS score FROM f_bm25")
def bm25_and(spark, d):
    return _rounded(ranking.bm25(_files(spark, d), ["path"], ["content"], PHRASES[:2], "and"), "score")


_FILL = ["ntthing", "quel"]


@register(
    "bm25_fill",
    f"WITH {FILES_SQL}, {_bm25_sql('f', 'path', 'content', _FILL, 'or')}, a AS (SELECT b.path, b.score, CASE WHEN t.f0 > 0 AND t.f1 > 0 THEN 1 ELSE 0 END AS strict FROM f_bm25 b JOIN f_tf t ON t.path = b.path) SELECT path, round(score, 6) AS score FROM a ORDER BY strict DESC, a.score DESC, path LIMIT 30",
)
def bm25_fill(spark, d):
    return _rounded(ranking.bm25_filled(_files(spark, d), ["path"], ["content"], _FILL, 30), "score")


_KNN_SQL = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), k AS (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT e FROM q) AS DOUBLE[])) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT {n})"


@register("knn_topk", f"WITH {_KNN_SQL.format(n=20)} SELECT vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM k")
def knn_topk(spark, d):
    return _rounded(ranking.nearest(_table(spark, d, "embeddings"), "vec_id", "embedding", _vector(spark, d), 20), "distance", "score")


@register(
    "hybrid_top10",
    f"""WITH {FILES_SQL}, {_bm25_sql('f', 'doc_id', 'content', PHRASES, 'or')}, {_KNN_SQL.format(n=60)},
x AS (SELECT doc_id, score FROM f_bm25 ORDER BY score DESC, doc_id LIMIT 40), p AS (SELECT doc_id, 0.4 / (20 + row_number() OVER (ORDER BY score DESC, doc_id) - 1) AS part, 'lexical' AS source FROM x
UNION ALL SELECT vec_id, 0.6 / (20 + row_number() OVER (ORDER BY 1 / (1 + distance) DESC, vec_id) - 1), 'vector' FROM k),
s AS (SELECT doc_id, sum(part) AS score, max(source) AS source FROM p GROUP BY doc_id) SELECT doc_id, round(score, 9) AS score, source FROM s ORDER BY s.score DESC, doc_id LIMIT 10""",
)
def hybrid_top10(spark, d):
    """Flagship: lexical and vector retrieval fused by weighted reciprocal rank."""
    lexical = ranking.bm25(_files(spark, d), ["doc_id"], ["content"], PHRASES).orderBy(F.desc("score"), "doc_id").limit(40)
    near = ranking.nearest(_table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _vector(spark, d), 60).drop("distance")
    out = ranking.hybrid(near, lexical, ["doc_id"]).orderBy(F.desc("score"), "doc_id").limit(10)
    return out.select("doc_id", F.round("score", 9).alias("score"), "source")


_OVERLAP_SQL = " + ".join(f"CASE WHEN NOT contains(lower(content), '{t}') THEN 0.0 WHEN regexp_matches(lower(content), '\\b{t}\\b') THEN 1.0 ELSE 0.5 END" for t in ("thing", "ation", "que", "the"))


@register("token_overlap", f"WITH {FILES_SQL} SELECT path, CAST({_OVERLAP_SQL} AS DOUBLE) AS overlap FROM f")
def token_overlap(spark, d):
    return _files(spark, d).select("path", tx.overlap_score(F.coalesce("content", F.lit("")), ["thing", "ation", "que", "the"]).alias("overlap"))


_CHUNK_OVERLAP = " + ".join(f"CASE WHEN NOT contains(lower(t), '{p}') THEN 0.0 WHEN regexp_matches(lower(t), '\\b{p}\\b') THEN 1.0 ELSE 0.5 END" for p in PHRASES)


@register(
    "lexical_drill_down",
    f"""WITH RECURSIVE {CHUNKS_SQL}, {_bm25_sql('f', 'path', 'content', PHRASES, 'or')}, t AS (SELECT path, score FROM f_bm25 ORDER BY score DESC, path LIMIT 20),
o AS (SELECT c.path, c.chunk_index, t.score AS file_score, c.path || ' ' || substr(c.content, c.start + 1, c."end" - c.start) AS t FROM c JOIN t ON t.path = c.path), s AS (SELECT path, chunk_index, file_score, CAST({_CHUNK_OVERLAP} AS DOUBLE) AS overlap FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY overlap DESC, chunk_index) AS nth FROM s WHERE overlap > 0)
SELECT path, chunk_index, round(score, 6) AS score FROM (SELECT path, chunk_index, file_score * (1 + 0.5 * overlap) AS score FROM n WHERE nth <= 2 ORDER BY file_score DESC, path, nth LIMIT 40)""",
)
def lexical_drill_down(spark, d):
    files = _files(spark, d)
    hits = ranking.pinned(ranking.bm25(files, ["path"], ["content"], PHRASES).orderBy(F.desc("score"), "path").limit(20))
    #: Only the files that were hit are cut into chunks.
    wanted = files.join(F.broadcast(hits.select("path")), "path", "left_semi")
    code = chunking.chunk_table(wanted).join(wanted.select("path", "content"), "path").withColumn("code", tx.clamp_slice(F.col("content"), F.col("start"), F.col("end"))).drop("content")
    return _rounded(ranking.drill_down(hits, code, PHRASES), "score")


_HITS_SQL = "h AS (SELECT user_id AS query_id, event_id AS chunk_index, event_type AS path, CAST(event_id % 101 AS DOUBLE) / 100 AS score FROM events)"


def _hits(spark, d):
    return _table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_index"), F.col("event_type").alias("path"), ((F.col("event_id") % 101).cast("double") / 100).alias("score"))


@register(
    "smart_cutoff",
    f"""WITH {_HITS_SQL}, r AS (SELECT *, row_number() OVER w - 1 AS rank, first_value(score) OVER w AS top FROM h WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, path, chunk_index)),
p AS (SELECT *, min(CASE WHEN CASE WHEN rank < 2 THEN score >= 0.25 ELSE score >= greatest(0.25, least(top * 0.5, top - 0.25)) END THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS ok FROM r WHERE rank < 8)
SELECT query_id, path, chunk_index, score, CAST(rank AS INTEGER) AS rank, top < 0.25 AS low_confidence FROM p WHERE (top < 0.25 AND rank = 0) OR (top >= 0.25 AND ok = 1)""",
)
def smart_cutoff(spark, d):
    return ranking.smart_cutoff(_hits(spark, d), ["query_id"], ["path", "chunk_index"])


@register("variant_merge", f"WITH {_HITS_SQL}, v AS (SELECT path, query_id % 20 AS bucket, score, query_id AS variant FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY path, bucket ORDER BY score DESC, variant) AS n FROM v) SELECT path, bucket, score, variant FROM b WHERE n = 1")
def variant_merge(spark, d):
    v = _hits(spark, d).select("path", (F.col("query_id") % 20).alias("bucket"), "score", F.col("query_id").alias("variant"))
    return ranking.merge_variants(v, ["path", "bucket"], "variant")


# --- expansion and packing ----------------------------------------------------------------

_SEEDS_SQL = (
    CHUNKS_SQL
    + """, s AS (SELECT CAST(doc_id % 7 AS BIGINT) AS query_id, path, chunk_index, score FROM (SELECT *, CAST((doc_id * 31 + chunk_index * 17) % 100 AS DOUBLE) / 100 AS score,
row_number() OVER (PARTITION BY path ORDER BY (doc_id * 31 + chunk_index * 17) % 100 DESC, chunk_index) AS nth FROM c) WHERE nth = 1)"""
)


def _seeds(chunks):
    """The best chunk of each file by a made-up score."""
    i = F.regexp_extract("path", r"/(\d+)\.", 1).cast("long")
    score = ((i * 31 + F.col("chunk_index") * 17) % 100).cast("double") / 100
    best = chunks.groupBy("path").agg(F.max(F.struct(score.alias("score"), (-F.col("chunk_index")).alias("late"))).alias("b"))
    return best.select((i % 7).alias("query_id"), "path", (-F.col("b.late")).alias("chunk_index"), F.col("b.score").alias("score"))


@register(
    "neighbor_expand",
    f"""WITH RECURSIVE {_SEEDS_SQL}, n AS (SELECT s.query_id, c.path, c.chunk_index, abs(c.chunk_index - s.chunk_index) AS dist, s.score, row_number() OVER (PARTITION BY s.query_id, c.path, c.chunk_index ORDER BY abs(c.chunk_index - s.chunk_index), s.score DESC) AS nth
FROM s JOIN c ON c.path = s.path AND abs(c.chunk_index - s.chunk_index) BETWEEN 1 AND 2 WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.query_id = s.query_id AND z.path = c.path AND z.chunk_index = c.chunk_index))
SELECT query_id, path, chunk_index, round(score * power(0.8, dist), 9) AS score FROM n WHERE nth = 1""",
)
def neighbor_expand(spark, d):
    chunks = stored(_chunks(spark, d).select("path", "chunk_index"), "chunks")
    return expansion.neighbours(_seeds(chunks), chunks).withColumn("score", F.round("score", 9))


@register(
    "breadcrumb_expand",
    f"""WITH RECURSIVE {_SEEDS_SQL}, u AS (SELECT query_id, path, max(score) AS score FROM s GROUP BY query_id, path),
n AS (SELECT g.query_id, c.path, c.chunk_index, g.score, row_number() OVER (PARTITION BY g.query_id, c.path ORDER BY c.chunk_index) AS nth FROM u g JOIN c ON c.path = g.path WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.query_id = g.query_id AND z.path = c.path AND z.chunk_index = c.chunk_index))
SELECT query_id, path, chunk_index, round(score * 0.7, 9) AS score FROM n WHERE nth <= 3""",
)
def breadcrumb_expand(spark, d):
    chunks = stored(_chunks(spark, d).select("path", "chunk_index", "breadcrumb"), "chunks")
    return expansion.breadcrumb_siblings(_seeds(chunks), chunks).withColumn("score", F.round("score", 9))


#: Source code made of table rows: a Python class of eight customers a file, a TypeScript class of eight suppliers.
_CODE_SQL = r"""py AS (SELECT c_custkey // 8 AS g, c_custkey AS k, row_number() OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_custkey // 8) AS n, 'py/g' || c_custkey // 8 || '.py' AS path, 'class G' || c_custkey // 8 || E':
' AS head, 'class G' || c_custkey // 8 AS class, 'c' || c_custkey AS name,
'    def c' || c_custkey || E'(self, a):
' || repeat('        total = total + compute(a, "' || c_name || E'") * 2
', 6) AS m, '' AS tail, 4 AS indent, 7 AS lines, 'function' AS kind, 'def ' AS label FROM customer),
ts AS (SELECT s_suppkey // 8 AS g, s_suppkey AS k, row_number() OVER (PARTITION BY s_suppkey // 8 ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_suppkey // 8) AS n, 'ts/s' || s_suppkey // 8 || '.ts' AS path, 'export class S' || s_suppkey // 8 || E' {
' AS head, 'class S' || s_suppkey // 8 AS class, 'm' || s_suppkey AS name,
'  m' || s_suppkey || E'(a: string): number {
' || repeat('    this.total = this.total + compute(a, "' || s_name || E'") * 2;
', 5) || E'  }
' AS m, E'}
' AS tail, 2 AS indent, 7 AS lines, 'method' AS kind, '' AS label FROM supplier),
code AS (SELECT *, CAST(length(head) + sum(length(m)) OVER (PARTITION BY path ORDER BY i) - length(m) AS INTEGER) AS pos FROM (SELECT * FROM py UNION ALL SELECT * FROM ts)),
cut AS (SELECT path, CAST(i - 1 AS INTEGER) AS chunk_index, CASE WHEN i = 1 THEN 0 ELSE pos + indent END AS start, CAST(pos + length(m) - 1 + CASE WHEN i = n THEN 2 * CAST(tail <> '' AS INTEGER) ELSE 0 END AS INTEGER) AS "end", CASE WHEN i = 1 THEN 0 ELSE pos - 1 END AS raw_start,
CAST(CASE WHEN i = n THEN pos + length(m) + length(tail) ELSE pos + length(m) - 1 END AS INTEGER) AS raw_end, path || ' > ' || class || ' > ' || label || name AS breadcrumb FROM code)"""


def _code_files(spark, d):
    def made(table, key, label, language, folder, extension, head, method, tail):
        k = F.col(key)
        g = F.floor(k / 8).cast("long").cast("string")
        rows = _table(spark, d, table).select(g.alias("g"), k.alias("k"), method(k.cast("string"), F.col(label)).alias("m"))
        whole = rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]), "").alias("body"))
        content = F.concat(F.format_string(head, "g"), F.col("body"), F.lit(tail))
        path = F.concat(F.lit(folder), F.col("g"), F.lit(extension))
        return whole.select(path.alias("path"), F.sha2(content, 256).alias("hash"), F.lit(language).alias("language"), content.alias("content"))

    python = made(
        "customer", "c_custkey", "c_name", "python", "py/g", ".py", "class G%s:\n",
        lambda k, n: F.concat(F.lit("    def c"), k, F.lit("(self, a):\n"), F.repeat(F.concat(F.lit('        total = total + compute(a, "'), n, F.lit('") * 2\n')), F.lit(6))), "",
    )
    script = made(
        "supplier", "s_suppkey", "s_name", "typescript", "ts/s", ".ts", "export class S%s {\n",
        lambda k, n: F.concat(F.lit("  m"), k, F.lit("(a: string): number {\n"), F.repeat(F.concat(F.lit('    this.total = this.total + compute(a, "'), n, F.lit('") * 2;\n')), F.lit(5)), F.lit("  }\n")), "}\n",
    )
    return python.unionByName(script)


@register("syntax_chunks", f'WITH {_CODE_SQL} SELECT path, chunk_index, start, "end", raw_start, raw_end, breadcrumb FROM cut')
def syntax_chunks(spark, d):
    return syntax.chunks_of(_code_files(spark, d)).select("path", "chunk_index", "start", "end", "raw_start", "raw_end", "breadcrumb")


@register("syntax_symbols", f"WITH {_CODE_SQL} SELECT path, name, kind, CAST(2 + (i - 1) * lines AS INTEGER) AS start_line, CAST(1 + i * lines AS INTEGER) AS end_line FROM code UNION ALL SELECT path, substr(class, 7), 'class', 1, CAST(1 + n * lines + CAST(tail <> '' AS INTEGER) AS INTEGER) FROM code WHERE i = 1")
def syntax_symbols(spark, d):
    return syntax.symbols_of(_code_files(spark, d)).select("path", "name", "kind", "start_line", "end_line")


@register("syntax_calls", f"WITH {_CODE_SQL} SELECT path, 'compute' AS callee, CAST(2 + (i - 1) * lines + x AS INTEGER) AS line FROM code, unnest(range(1, CASE WHEN tail = '' THEN 7 ELSE 6 END)) AS r(x)")
def syntax_calls(spark, d):
    return syntax.calls_of(_code_files(spark, d)).select("path", "callee", "line")


@register(
    "class_siblings",
    f"""WITH {_CODE_SQL}, s AS (SELECT path, chunk_index FROM cut WHERE chunk_index % 3 = 1), n AS (SELECT c.path, c.chunk_index, row_number() OVER (PARTITION BY c.path ORDER BY c.chunk_index) AS nth FROM cut c WHERE c.path IN (SELECT path FROM s) AND c.chunk_index % 3 <> 1)
SELECT CAST(0 AS INTEGER) AS query_id, path, chunk_index, CAST(0.7 AS DOUBLE) AS score FROM n WHERE nth <= 3""",
)
def class_siblings(spark, d):
    """Members of one class share the parent of their breadcrumbs: the general case of ``breadcrumb_expand``."""
    chunks = stored(syntax.chunks_of(_code_files(spark, d)).select("path", "chunk_index", "breadcrumb"), "chunks")
    seeds = chunks.where("chunk_index % 3 = 1").select(F.lit(0).alias("query_id"), "path", "chunk_index", F.lit(1.0).alias("score"))
    return expansion.breadcrumb_siblings(seeds, chunks).withColumn("score", F.round("score", 9))


@register("definition_snippets", f"WITH {_CODE_SQL} SELECT path, name, CAST(2 + (i - 1) * lines AS INTEGER) AS start_line, rtrim(m, E'\n') AS snippet FROM code")
def definition_snippets(spark, d):
    files = _code_files(spark, d)
    found = syntax.symbols_of(files).where("kind <> 'class'")
    return symbols.definition_snippets(found, files).select("path", "name", "start_line", "snippet")


_LINKS_SQL = (
    FILES_SQL
    + ", t AS (SELECT greatest(count(*), 1) AS n FROM f), k AS (SELECT a.path AS src, b.path AS dst FROM f a, t JOIN f b ON b.doc_id IN ((a.doc_id * 7 + 1) % t.n, (a.doc_id * 3 + 2) % t.n)), s AS (SELECT doc_id // 20 AS query_id, path, CAST(doc_id % 10 AS DOUBLE) / 10 AS score FROM f)"
)


def _links(spark, d):
    """Two made-up links from every file to any others, and every file as a seed of a query of twenty."""
    files = _files(spark, d).select("doc_id", "path")
    n = F.lit(max(1, files.count()))
    to = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.array((F.col("doc_id") * 7 + 1) % n, (F.col("doc_id") * 3 + 2) % n))).alias("doc_id"))
    seeds = files.select(F.floor(F.col("doc_id") / 20).alias("query_id"), "path", F.lit(0).alias("chunk_index"), ((F.col("doc_id") % 10).cast("double") / 10).alias("score"))
    return to.join(files.withColumnRenamed("path", "dst"), "doc_id").select("src", "dst"), seeds


@register(
    "import_expand",
    f"""WITH {_LINKS_SQL}, m AS (SELECT s.query_id, s.path, s.score, k.dst AS other, row_number() OVER (PARTITION BY s.query_id, s.path ORDER BY k.dst) AS nth FROM s JOIN (SELECT DISTINCT * FROM k) k ON k.src = s.path WHERE k.dst <> s.path AND NOT EXISTS (SELECT 1 FROM s z WHERE z.query_id = s.query_id AND z.path = k.dst))
SELECT query_id, other AS path, round(max(score) * 0.6, 9) AS score FROM m WHERE nth <= 3 GROUP BY query_id, other""",
)
def import_expand(spark, d):
    links, seeds = _links(spark, d)
    return expansion.linked_files(seeds, links).withColumn("score", F.round("score", 9))


@register(
    "reverse_links",
    f"""WITH {_LINKS_SQL}, m AS (SELECT s.query_id, k.src AS path, max(s.score) * 0.5 AS score FROM s JOIN (SELECT DISTINCT * FROM k) k ON k.dst = s.path WHERE k.src <> s.path AND NOT EXISTS (SELECT 1 FROM s z WHERE z.query_id = s.query_id AND z.path = k.src) GROUP BY s.query_id, k.src),
q AS (SELECT query_id, count(DISTINCT path) AS n FROM s GROUP BY query_id), r AS (SELECT m.*, q.n, row_number() OVER (PARTITION BY m.query_id ORDER BY m.score DESC, m.path) AS nth FROM m JOIN q ON q.query_id = m.query_id)
SELECT query_id, path, round(score, 9) AS score FROM r WHERE nth <= n * 2""",
)
def reverse_links(spark, d):
    links, seeds = _links(spark, d)
    return expansion.linked_files(seeds, links, reverse=True, per_seed=2, decay=0.5).withColumn("score", F.round("score", 9))


_SPANS_SQL = "z AS (SELECT l_suppkey AS query_id, CAST(l_orderkey % 3 AS VARCHAR) AS path, l_partkey % 1000 AS raw_start, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS raw_end, l_discount AS score FROM lineitem)"
_ISLANDS_SQL = _SPANS_SQL + ", a AS (SELECT *, CASE WHEN raw_start <= max(raw_end) OVER (PARTITION BY query_id, path ORDER BY raw_start, raw_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM z), b AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, path ORDER BY raw_start, raw_end ROWS UNBOUNDED PRECEDING) AS island FROM a), m AS (SELECT query_id, path, min(raw_start) AS raw_start, max(raw_end) AS raw_end, max(score) AS score, count(*) AS parts FROM b GROUP BY query_id, path, island)"


def _spans(spark, d):
    start = F.col("l_partkey") % 1000
    return _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") % 3).cast("string").alias("path"), start.alias("raw_start"), (start + F.col("l_quantity").cast("long")).alias("raw_end"), F.col("l_discount").alias("score"))


@register("interval_merge", f"WITH {_ISLANDS_SQL} SELECT query_id, path, raw_start, raw_end, score, parts FROM m")
def interval_merge(spark, d):
    return expansion.merge_intervals(_spans(spark, d), ["query_id", "path"])


@register(
    "budget_pack",
    f"""WITH RECURSIVE {_ISLANDS_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, raw_start) AS nth FROM m) WHERE nth <= 3),
o AS (SELECT t.*, row_number() OVER (PARTITION BY t.query_id ORDER BY x.best DESC, t.path, t.raw_start) AS i FROM t JOIN (SELECT query_id, path, max(score) AS best FROM t GROUP BY query_id, path) x ON x.query_id = t.query_id AND x.path = t.path),
r AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, '' AS stopped, '' AS path, CAST(0 AS BIGINT) AS raw_start, CAST(0 AS BIGINT) AS raw_end, false AS kept FROM (SELECT DISTINCT query_id FROM o)
  UNION ALL SELECT o.query_id, o.i, CASE WHEN r.stopped = o.path OR r.total >= 300 OR r.total + o.raw_end - o.raw_start > 300 THEN r.total ELSE r.total + o.raw_end - o.raw_start END,
    CASE WHEN r.stopped <> o.path AND r.total < 300 AND r.total + o.raw_end - o.raw_start > 300 THEN o.path ELSE r.stopped END, o.path, o.raw_start, o.raw_end, NOT (r.stopped = o.path OR r.total >= 300 OR r.total + o.raw_end - o.raw_start > 300) FROM r JOIN o ON o.query_id = r.query_id AND o.i = r.i + 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS position, path, CAST(raw_start AS INTEGER) AS raw_start, CAST(raw_end AS INTEGER) AS raw_end FROM r WHERE kept""",
)
def budget_pack(spark, d):
    merged = expansion.merge_intervals(_spans(spark, d), ["query_id", "path"])
    return expansion.pack(expansion.best_segments(merged, ["query_id", "path"]), budget=300)


@register(
    "nearest_definition",
    """WITH y AS (SELECT DISTINCT l_suppkey AS path, l_linenumber AS callee, l_partkey % 500 AS start_line FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT l_suppkey AS path, l_linenumber AS callee, l_orderkey % 500 AS line FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT c.path, c.callee, c.line, y.start_line, row_number() OVER (PARTITION BY c.path, c.callee, c.line ORDER BY CASE WHEN y.start_line <= c.line THEN 0 ELSE 1 END, CASE WHEN y.start_line <= c.line THEN -y.start_line ELSE y.start_line END) AS n FROM c JOIN y ON y.path = c.path AND y.callee = c.callee)
SELECT path, callee, line, start_line AS target_line FROM j WHERE n = 1""",
)
def nearest_definition(spark, d):
    items = _table(spark, d, "lineitem")
    defs = items.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("name"), (F.col("l_partkey") % 500).alias("start_line"))
    calls = items.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("callee"), (F.col("l_orderkey") % 500).alias("line")).distinct()
    return symbols.nearest_definition(calls, defs)


@register("import_strings", r"""WITH h AS (SELECT url AS src, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS import_str FROM pages) SELECT src, import_str FROM h""")
def import_strings(spark, d):
    pages = _table(spark, d, "pages")
    return pages.select(F.col("url").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("import_str"))


@register(
    "import_resolve",
    """WITH c AS (SELECT c_custkey AS k, c_custkey // 10 AS g FROM customer), s AS (SELECT s_suppkey AS k, s_suppkey // 10 AS g FROM supplier), p AS (SELECT p_partkey AS k FROM part)
SELECT 'pkg/g' || a.g || '/c' || a.k || '.py' AS src, '.c' || b.k AS import_str, 'pkg/g' || b.g || '/c' || b.k || '.py' AS dst FROM c a JOIN c b ON b.k = a.k + 1 AND b.g = a.g
UNION ALL SELECT 'pkg/g' || a.g || '/c' || a.k || '.py', 'pkg.g' || b.g || '.c' || b.k, 'pkg/g' || b.g || '/c' || b.k || '.py' FROM c a JOIN c b ON b.k = a.k + 2
UNION ALL SELECT 'web/g' || a.g || '/m' || a.k || '.ts', './m' || b.k, 'web/g' || b.g || '/m' || b.k || '.ts' FROM s a JOIN s b ON b.k = a.k + 1 AND b.g = a.g
UNION ALL SELECT 'web/g' || a.g || '/m' || a.k || '.ts', './m' || b.k || '.js', 'web/g' || b.g || '/m' || b.k || '.ts' FROM s a JOIN s b ON b.k = a.k + 2 AND b.g = a.g
UNION ALL SELECT 'rs/src/m' || a.k || '.rs', 'crate::m' || b.k || '::T', 'rs/src/m' || b.k || '.rs' FROM p a JOIN p b ON b.k = a.k + 1""",
)
def import_resolve(spark, d):
    """Every customer, supplier and part as a Python, TypeScript or Rust file that imports the next ones."""

    def made(table, key, language, path, content, group=True):
        k = F.col(key).cast("long")
        g = lambda x: [F.floor(x / 10).cast("long"), x] if group else [x]
        return _table(spark, d, table).select(F.format_string(path, *g(k)).alias("path"), F.lit(language).alias("language"), content(k, g).alias("content"))

    python = made("customer", "c_custkey", "python", "pkg/g%d/c%d.py", lambda k, g: F.format_string("from .c%d import f\nimport pkg.g%d.c%d\n", k + 1, *g(k + 2)))
    script = made("supplier", "s_suppkey", "typescript", "web/g%d/m%d.ts", lambda k, g: F.format_string("import { a } from './m%d';\nimport './m%d.js';\nimport r from 'react';\n", k + 1, k + 2))
    rust = made("part", "p_partkey", "rust", "rs/src/m%d.rs", lambda k, g: F.format_string("use crate::m%d::T;\nuse std::fmt;\nmod q;\n", k + 1), False)
    files = python.unionByName(script).unionByName(rust)
    return imports.resolve_imports(imports.extract_imports(files), files.select("path")).select("src", "import_str", "dst")


@register("watch_bursts", "WITH e AS (SELECT user_id AS project, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT project, count(*) AS changes, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM s GROUP BY project, n")
def watch_bursts(spark, d):
    found = bursts(_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "3600 seconds", ignored=F.col("event_type") == "view")
    return found.select("project", "changes", (F.unix_micros("end") - F.unix_micros("start")).alias("span")).select("project", "changes", F.floor((F.col("span") - 3_600_000_000) / 1e6).alias("seconds"))


@register("context_pack")
def context_pack(spark, d):
    """The whole retrieval plan for one query: positions, paths and spans of the packed segments.

    Every chunk has a vector (the local embedder), and files whose manifest row is not ready are not found.
    """
    files = _files(spark, d)
    chunks = stored(_chunks(spark, d), "chunks")
    texts = with_code(Index(files, chunks), chunks.select("path", "chunk_index")).select("path", "chunk_index", "code")
    vectors = stored(rerank.embed(texts, "code").drop("code"), "vectors")
    query = "thing and ation with quel"
    vector = list(rerank.embed(spark.createDataFrame([(query,)], "text string"), "text").first()["vector"])
    ready = maintenance.ready_hashes(*_manifest(spark, d))
    return context(Index(files, chunks, vectors, _links(spark, d)[0], ready), query, vector).select("position", "path", "raw_start", "raw_end")
