"""Import extraction and resolution for seven languages.

Each language turns an import into candidate paths in order of preference; an equi join
with the path table finds those that exist and the first one wins. Suffix rules join on
the last path segments and take the longest common prefix with the importing file, then
the smallest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import common_segments, resolve_path

#: One-group import patterns by language.
PATTERNS = {
    "typescript": (r"""(?m)^\s*(?:import|export)\s(?:[^'"\n=;(]|\n)*?\bfrom\s*['"]([^'"\n]+)['"]""", r"""(?m)^\s*import\s*['"]([^'"\n]+)['"]""", r"""(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""),
    "python": (r"(?m)^\s*from\s+([.\w]+)\s+import\b", r"(?m)^\s*import\s+([\w.]+)"),
    "go": (r"""(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)\"""",),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;",),
    "rust": (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([A-Za-z_][\w]*(?:::[A-Za-z_]\w*)+)", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(mod\s+[A-Za-z_]\w*)\s*;"),
    "cpp": (r"""(?m)^\s*#\s*include\s*"([^"\n]+)\"""",),
    "c_sharp": (r"(?m)^\s*using\s+(?!static\b)(?:\w+\s*=\s*)?([\w.]+)\s*;",),
}
#: A block of Go imports; its strings are the paths.
_GO_BLOCK, _GO_PATH = r"(?m)^\s*import\s*\(([^)]*)\)", r'"([^"\n]+)"'
#: Roots of a Rust path that stay inside the crate.
_RUST_ROOTS = r"^(?:crate|self|super)::|^mod\s"
PATTERNS["javascript"] = PATTERNS["typescript"]
PATTERNS["c"] = PATTERNS["cpp"]
_JS_ENDS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def extract_imports(files: DataFrame) -> DataFrame:
    """One row per import: src, language, import_str."""
    found: Column = F.array().cast("array<string>")
    for language, patterns in PATTERNS.items():
        every = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])
        if language == "go":
            blocks = F.array_join(F.regexp_extract_all("content", F.lit(_GO_BLOCK), F.lit(1)), "\n")
            every = F.concat(every, F.regexp_extract_all(blocks, F.lit(_GO_PATH), F.lit(1)))
        if language == "rust":
            every = F.filter(every, lambda x: x.rlike(_RUST_ROOTS))
        found = F.when(F.col("language") == language, every).otherwise(found)
    return files.where("content IS NOT NULL").select(F.col("path").alias("src"), "language", F.explode(F.array_distinct(found)).alias("import_str"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _under(folder: Column, rest: Column) -> Column:
    return resolve_path(F.concat_ws("/", folder, rest))


def exact_candidates() -> Column:
    """Array of candidate paths of an import row, best first (relative and folder rules)."""
    src, text, language = F.col("src"), F.col("import_str"), F.col("language")
    folder = _folder(src)
    js = _under(folder, text)
    swapped = F.regexp_replace(js, r"\.jsx?$", "")
    js_paths = F.array(*[F.concat(js, F.lit(e)) for e in _JS_ENDS], *[F.concat(swapped, F.lit(e)) for e in (".ts", ".tsx", ".jsx")])
    dots = F.length(F.regexp_extract(text, r"^(\.+)", 1))
    ups = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    module = _under(folder, F.concat(ups, F.translate(F.regexp_replace(text, r"^\.+", ""), ".", "/")))
    python = F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))
    stem = F.regexp_replace(F.regexp_extract(src, r"([^/]*)$", 1), r"\.rs$", "")
    own = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(F.concat_ws("/", folder, stem))
    parts = F.regexp_replace(F.regexp_replace(text, "^(?:crate|self|super)::", ""), "::", "/")
    base = F.when(text.startswith("mod "), own).when(text.startswith("crate"), F.regexp_extract(src, r"^((?:.*/)?src)(?:/|$)", 1)).when(text.startswith("super"), F.when(own == folder, _folder(folder)).otherwise(folder)).otherwise(own)
    leaf = F.when(text.startswith("mod "), F.regexp_replace(text, r"^mod\s+", "")).otherwise(parts)
    shorter = F.regexp_replace(leaf, "/[^/]+$", "")
    rust = F.array(*[F.concat(_under(base, x), F.lit(e)) for x in (leaf, shorter) for e in (".rs", "/mod.rs")])
    cpp = F.array(_under(folder, text))
    nothing = F.array().cast("array<string>")
    return (
        F.when(language.isin("typescript", "javascript") & text.startswith("."), js_paths).when((language == "python") & text.startswith("."), python)
        .when(language == "rust", rust).when(language.isin("cpp", "c"), cpp).otherwise(nothing)
    )


def suffix_candidates() -> Column:
    """Array of path endings of an import row, best first (module, package and include rules)."""
    text, language = F.col("import_str"), F.col("language")
    slashed = F.translate(text, ".", "/")
    nothing = F.array().cast("array<string>")
    return (
        F.when((language == "python") & ~text.startswith("."), F.array(F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py"))))
        .when(language == "java", F.array(F.concat(slashed, F.lit(".java")))).when(language == "c_sharp", F.array(F.concat(slashed, F.lit(".cs")), F.concat(F.regexp_extract(text, r"([^.]+)$", 1), F.lit(".cs"))))
        .when(language.isin("cpp", "c"), F.array(F.regexp_replace(text, r"^(?:\.\.?/)+", ""))).otherwise(nothing)
    )


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """``imports`` with ``dst``, the file that each resolves to (unresolved ones are left out).

    Suffixes meet paths in an equi join on all endings of a path, so there is no theta join.
    """
    keyed = imports.select("src", "language", "import_str")
    exact = keyed.select("*", F.posexplode(exact_candidates()).alias("nth", "dst")).join(paths.select(F.col("path").alias("dst")), "dst").withColumn("near", F.lit(0))
    segments = F.split("path", "/")
    endings = paths.select(F.col("path").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"))).alias("ending"))
    suffix = keyed.select("*", F.posexplode(suffix_candidates()).alias("nth", "ending")).join(endings, "ending").withColumn("near", -common_segments(F.col("src"), F.col("dst"))).withColumn("nth", F.col("nth") + 100)
    go = keyed.where("language = 'go' AND (import_str LIKE '%/%' OR import_str LIKE '%.%')").withColumn("ending", F.regexp_extract("import_str", r"([^/]+/[^/]+|[^/]+)$", 1))
    folders = endings.where("dst LIKE '%.go' AND dst NOT LIKE '%\\_test.go'").select("dst", _folder(F.col("ending")).alias("ending")).where("ending <> ''")
    packages = go.join(folders, "ending").select("src", "language", "import_str", F.lit(200).alias("nth"), "dst", F.lit(0).alias("near"))
    columns = ["src", "language", "import_str", "nth", "near", "dst"]
    every = exact.select(*columns).unionByName(suffix.select(*columns)).unionByName(packages.select(*columns)).where("src <> dst")
    best = every.groupBy("src", "language", "import_str").agg(F.min(F.struct("nth", "near", "dst")).alias("b"))
    return best.select("src", "language", "import_str", F.col("b.dst").alias("dst"))
