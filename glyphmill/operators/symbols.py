"""Symbols, references, call graph and metadata tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_segments, glob_to_regex, line_of, path_filter_to_like, quote
from .syntax import breadcrumb_tail

#: Definition patterns by language; {name} stands for the symbol.
DEFINITIONS = {
    "typescript": (r"function\s+{name}\b", r"class\s+{name}\b", r"(?:const|let|var)\s+{name}\b", r"interface\s+{name}\b", r"type\s+{name}\b", r"enum\s+{name}\b"),
    "javascript": (r"function\s+{name}\b", r"class\s+{name}\b", r"(?:const|let|var)\s+{name}\b"),
    "python": (r"def\s+{name}\b", r"class\s+{name}\b"),
    "go": (r"func\s+{name}\b", r"type\s+{name}\b", r"const\s+{name}\b", r"var\s+{name}\b"),
    "rust": (r"fn\s+{name}\b", r"struct\s+{name}\b", r"enum\s+{name}\b", r"const\s+{name}\b"),
    "java": (r"class\s+{name}\b", r"interface\s+{name}\b", r"enum\s+{name}\b", r"\b{name}\s*\("),
    "c_sharp": (r"class\s+{name}\b", r"interface\s+{name}\b", r"enum\s+{name}\b", r"\b{name}\s*\("),
    "cpp": (r"class\s+{name}\b", r"struct\s+{name}\b", r"\b{name}\s*\("),
    "c": (r"\b{name}\s*\(",),
}
DEFINITIONS["csharp"] = DEFINITIONS["c_sharp"]
#: Call-like words that are no calls.
_KEYWORDS = ("if", "for", "while", "switch", "return", "catch", "with", "def", "class", "function", "elif", "print_function")


def list_files(files: DataFrame, glob: str | None = None, language: str | None = None, limit: int = 200) -> DataFrame:
    """Files by path, filtered by glob and language before the limit (API2)."""
    if language:
        files = files.where(F.col("language") == language)
    if glob:
        files = files.where(F.col("path").rlike(glob_to_regex(glob)))
    return files.select("path", "language", "size").orderBy("path").limit(limit)


def list_symbols(symbols: DataFrame, path_filter: str | None = None, kinds: list[str] | None = None, language: str | None = None, source: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols by path and line (API3); ``*`` in the path filter crosses folders, case of ASCII is ignored (F8)."""
    if path_filter:
        symbols = symbols.where(F.col("path").ilike(path_filter_to_like(path_filter)))
    if kinds:
        symbols = symbols.where(F.col("kind").isin(*kinds))
    for column, value in (("language", language), ("source", source)):
        if value:
            symbols = symbols.where(F.col(column) == value)
    return symbols.orderBy("path", "start_line", "name").limit(limit)


def definitions_of(symbols: DataFrame, name: str, hint: str | None = None, limit: int = 3) -> DataFrame:
    """Definition rows of a symbol: parsed before tagged, ``src`` before others before ``tests``, or by closeness to ``hint``."""
    found = symbols.where((F.col("name") == name) & ~F.col("kind").isin("call", "reference"))
    if hint:
        return found.orderBy(F.desc(common_segments(F.col("path"), F.lit(hint))), "path", "start_line").limit(limit)
    place = F.when(F.col("path").startswith("src/"), 0).when(F.col("path").startswith("tests/"), 2).otherwise(1)
    return found.orderBy(F.when(F.col("source") == "tree-sitter", 0).otherwise(1), place, "start_line", "path").limit(limit)


def references(files: DataFrame, symbol: str, limit: int | None = None, chunks: DataFrame | None = None, exclude_definition: bool = False, any_label: bool = False) -> DataFrame:
    """Lines that hold ``symbol`` as a whole identifier (F10, API4): path, line, text.

    ``exclude_definition`` leaves out the lines of ``chunks`` (path, raw spans, breadcrumb)
    whose breadcrumb ends with the symbol (F12); with ``any_label`` also after a label as in ``fn name``.
    """
    whole = r"(?<![A-Za-z0-9_$])" + quote(symbol) + r"(?![A-Za-z0-9_$])"
    found = files.where(F.col("content").contains(symbol))
    lines = found.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "text")).where(F.col("text").rlike(whole))
    out = lines.select("path", (F.col("n") + 1).alias("line"), F.trim("text").alias("text"))
    if exclude_definition and chunks is not None:
        tail = breadcrumb_tail(F.col("breadcrumb"))
        own = chunks.where((F.regexp_replace(tail, r"^.*\s", "") if any_label else tail) == symbol)
        spans = own.join(found.select("path", "content"), "path").select("path", line_of(F.col("content"), F.col("start")).alias("first"), line_of(F.col("content"), F.greatest(F.col("end") - 1, F.col("start"))).alias("last"))
        inside = spans.select("path", F.explode(F.sequence("first", "last")).alias("line")).distinct()
        out = out.join(inside, ["path", "line"], "left_anti")
    return out.orderBy("path", "line").limit(limit) if limit else out


def definition_snippets(definitions: DataFrame, files: DataFrame, without_end: int = 5) -> DataFrame:
    """Definition rows with the code of their lines (J17); files without content are left out."""
    met = definitions.join(files.where(F.length("content") > 0).select("path", "content"), "path")
    first, last = F.greatest(F.col("start_line"), F.lit(1)), F.coalesce("end_line", F.col("start_line") + without_end)
    lines = F.split("content", "\n", -1)
    return met.withColumn("snippet", F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")).drop("content")


def fallback_definitions(chunks: DataFrame, symbol: str, hint: str | None = None, limit: int = 3) -> DataFrame:
    """Chunks that define ``symbol`` where no symbol row does (T8): exact breadcrumb, closeness to ``hint``, score, path.

    ``chunks`` are lexical hits for the symbol: path, chunk_index, breadcrumb, code, score, language.
    """
    exact = (breadcrumb_tail(F.col("breadcrumb")) == symbol).cast("int")
    match = defines(F.col("code"), F.col("language"), symbol)
    near = common_segments(F.col("path"), F.lit(hint)) if hint else F.lit(0)
    ranked = chunks.withColumn("exact", exact).where((F.col("exact") == 1) | match).withColumn("near", near)
    return ranked.orderBy(F.desc("exact"), F.desc("near"), F.desc("score"), "path", "chunk_index").limit(limit).drop("near")


def defines(text: Column, language: Column, symbol: str) -> Column:
    """Whether a text defines ``symbol`` by the patterns of its language; unknown languages are read as TypeScript."""
    match: Column = F.lit(False)
    for lang, patterns in DEFINITIONS.items():
        here = language == lang
        if lang == "typescript":
            here = here | language.isNull() | ~language.isin(*DEFINITIONS)
        for p in patterns:
            match = match | (here & text.rlike(p.replace("{name}", quote(symbol))))
    return match


def definition_lines(files: DataFrame, symbol: str, language: str = "language") -> DataFrame:
    """Lines that define ``symbol`` by the patterns of the file's language."""
    lines = files.where(F.col("content").contains(symbol)).select("path", language, F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    return lines.where(defines(F.col("text"), F.col(language), symbol)).select("path", (F.col("n") + 1).alias("line"), F.trim("text").alias("text"))


def symbols_per_file(symbols: DataFrame) -> DataFrame:
    """Number and sorted names of the definitions of each file."""
    own = symbols.where(~F.col("kind").isin("call", "reference"))
    return own.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def languages(files: DataFrame) -> DataFrame:
    """Files by language, the most frequent first."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def ctags_symbols(tags: DataFrame, files: DataFrame, line: str = "value") -> DataFrame:
    """Symbols of ctags JSON lines (column ``line``) for known files; other lines are left out."""
    schema = "_type string, name string, path string, line int, end int, kind string, kindName string, scope string"
    tag = F.from_json(F.col(line), schema)
    rows = tags.select(tag.alias("t")).where("t._type = 'tag' AND length(t.name) > 0 AND t.line > 0")
    kind = F.coalesce("t.kindName", "t.kind", F.lit("symbol"))
    named = rows.select(F.col("t.path").alias("path"), F.col("t.name").alias("name"), kind.alias("kind"), F.lit("ctags").alias("source"), F.col("t.line").alias("start_line"), F.col("t.end").alias("end_line"), F.col("t.scope").alias("container"))
    return named.join(files.select("path", "hash", "language"), "path")


def extract_symbols(files: DataFrame) -> DataFrame:
    """Function and class definitions by language pattern: path, hash, language, name, kind, start_line (G1)."""
    lines = files.select("path", "hash", "language", F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    named = F.regexp_extract("text", r"\b(?:def|function|func|fn|class|interface|struct|trait|enum)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)", 1)
    kind = F.when(F.col("text").rlike(r"\b(?:class|struct|enum)\s"), "class").when(F.col("text").rlike(r"\b(?:interface|trait)\s"), "interface").otherwise("function")
    return lines.withColumn("name", named).where((F.length("name") > 0) & (F.length("name") <= 200)).select("path", "hash", "language", "name", kind.alias("kind"), (F.col("n") + 1).alias("start_line"))


def extract_calls(files: DataFrame) -> DataFrame:
    """Call sites (path, callee, line): identifiers before a parenthesis that are neither keywords nor definitions."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    bare = F.regexp_replace("text", r"\b(?:def|function|func|fn|class)\s+[A-Za-z_$][\w$]*\s*\(", "(")
    calls = lines.select("path", (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1))).alias("callee"))
    return calls.where(~F.col("callee").isin(*_KEYWORDS))


def nearest_definition(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The definition of a call's name that last precedes it in its file, else the first one there.

    An as-of join without a join: definitions and calls of a (path, name) are sorted
    together, the last definition before a call is carried along, and the first one of
    all is the fallback, so the work is linear in both.
    """
    d = symbols.select("path", F.col("name").alias("callee"), F.col("start_line").alias("line")).distinct()
    both = d.withColumn("is_call", F.lit(0)).unionByName(calls.select("path", "callee", "line").distinct().withColumn("is_call", F.lit(1)))
    own = Window.partitionBy("path", "callee").orderBy("line", "is_call")
    defined = F.when(F.col("is_call") == 0, F.col("line"))
    carried = both.withColumn("before", F.last(defined, True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    carried = carried.withColumn("first", F.first(defined, True).over(own.rowsBetween(0, Window.unboundedFollowing)))
    met = carried.where("is_call = 1").withColumn("target_line", F.coalesce("before", "first")).where("target_line IS NOT NULL")
    return met.select("path", "callee", "line", "target_line")


def health(files: DataFrame, outbox: DataFrame) -> DataFrame:
    """One row: files, bytes, languages as ``name=count`` by name, pending marks (A2)."""
    by_language = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "language", "n"))), ",")
    return by_language.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), listed.alias("languages")).join(F.broadcast(outbox.agg(F.count(F.lit(1)).alias("pending"))))


def rates(values: DataFrame) -> DataFrame:
    """Average latency and cache hit rate; null where there were no runs (A3)."""
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return values.select("name", part("total_ms", "runs").alias("avg_ms"), part("hits", "queries").alias("hit_rate"))


def diagnostics(row: DataFrame) -> DataFrame:
    """Messages of the rules that a health row breaks."""
    rules = [
        ("files = 0", "no files are indexed"), ("pending > 0", "marks wait for replay"), ("failed > 0", "some files failed to index"),
        ("hit_rate < 0.1", "the cache hardly helps"), ("avg_ms > 2000", "retrieval is slow"),
    ]
    return row.select("*", F.array_compact(F.array(*[F.when(F.expr(c), m) for c, m in rules])).alias("messages"))
