"""File sources: crawl, ignore rules, languages, decoding (S1-S8), and the corpus that binds a document table."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote

#: Language by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "md": "markdown", "py": "python", "go": "go",
    "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "c": "c", "sh": "shell", "bash": "shell",
    "zsh": "shell", "fish": "shell", "ps1": "powershell", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "html": "html", "css": "css",
    "scss": "scss", "sass": "sass", "less": "less", "vue": "vue", "svelte": "svelte", "rb": "ruby", "php": "php", "dart": "dart", "lua": "lua", "r": "r",
}
#: Folders and files that are never indexed.
DEFAULT_IGNORE = (
    "node_modules", "bower_components", ".venv", "venv", ".env.*", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "Gemfile.lock", "composer.lock",
    "Cargo.lock", ".git", ".svn", ".hg", ".idea", ".vscode", ".vs", "dist", "build", "out", "target", "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dll", "*.exe", "*.bin", "*.wasm",
    ".next", ".nuxt", ".output", ".svelte-kit", ".turbo", ".parcel-cache", ".webpack", ".esbuild", ".rollup.cache", "coverage", ".nyc_output", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".tox", ".eggs", "*.egg-info", "*.min.js", "*.min.css", "*.map", "*.svg", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.webp", "*.bmp", "*.pdf", "*.mp3",
    "*.mp4", "*.wav", "*.webm", "*.ogg", "*.flac", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.otf", "*.zip", "*.tar", "*.gz", "*.rar", "*.7z", ".DS_Store", "Thumbs.db",
    "__snapshots__", "*.snap", "test/fixtures", "tests/fixtures", "__fixtures__", "test/data", "tests/data", "testdata", "test-data", "testutils", "mock", "mocks", "__mocks__",
    "stub", "stubs", "vendor", "vendors", "third_party", "thirdparty", "3rdparty", "external", "externals", "generated", "gen", "auto-generated", "*.generated.ts",
    "*.generated.js", "*.pb.go", "*.pb.ts", "*.log", ".cache", ".tmp", "tmp",
)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension_of(path)), F.lit("unknown"))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_allowed(path: Column) -> Column:
    return extension_of(path).isin(*LANGUAGES)


def compile_ignore(patterns: list[str]) -> list[tuple[str, bool]]:
    """Ordered (regex, ignored) rules of gitignore lines; the last match wins."""
    rules = []
    for line in patterns:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        ignored = not rule.startswith("!")
        rule = rule.lstrip("!").replace("\\", "/")
        folder, rooted = rule.endswith("/"), "/" in rule.rstrip("/")
        body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or quote(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", rule.strip("/")))
        rules.append((("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), ignored))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out: Column = F.lit(False)
    for regex, ignored in rules:
        out = F.when(path.rlike(regex), ignored).otherwise(out)
    return out


#: Encodings of texts that are no UTF-8, by how likely they are where they fit.
_WIDE, _NARROW = ("gb18030", "shift_jis", "euc_kr", "big5"), ("cp1252", "latin-1")


def guessed(raw: bytes) -> str:
    """Text of bytes that are no valid UTF-8: a wide encoding where high bytes come in pairs, a Western one otherwise."""
    for start, codec in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be")):
        if raw.startswith(start):
            return raw[4:].decode(codec, "replace")
    high = np.frombuffer(raw, dtype=np.uint8) >= 0x80
    paired = int((high[1:] & high[:-1]).sum())
    for codec in (*(_WIDE if 2 * paired >= high.sum() else ()), *_NARROW):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def decoded(content: Column) -> Column:
    """Text of bytes by byte-order mark, as UTF-8 where that is valid, by a guess otherwise.

    Only bytes that are not valid reach Python.
    """

    @F.pandas_udf(T.StringType())
    def guess(raws: pd.Series) -> pd.Series:
        return raws.map(lambda raw: None if raw is None else guessed(bytes(raw)))

    start = F.hex(F.substring(content, 1, 4))
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    wide = start.isin("FFFE0000", "0000FEFF")
    marked = F.when(start.startswith("EFBBBF"), F.decode(rest(3), "UTF-8")).when(start.startswith("FFFE") & ~wide, F.decode(rest(2), "UTF-16LE")).when(start.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
    valid = F.is_valid_utf8(content.cast("string")) & ~wide
    odd = marked.isNull() & ~valid
    return F.coalesce(marked, F.when(valid, content.cast("string")), guess(F.when(odd, content)))


def root_ignore(spark: SparkSession, root: str) -> list[str]:
    """Rules of ``IGNORE_PATTERNS`` (comma-separated) and of the ``.gitignore`` in the root folder, in this order."""
    own = [p.strip() for p in os.environ.get("IGNORE_PATTERNS", "").split(",") if p.strip()]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):  # Spark's own readers leave dot files out
        stream = fs.open(path)
        own += spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        stream.close()
    return own


def crawl(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Files under ``root``: path (relative), hash, mtime, size, content, language; ignore and extension rules apply before reading bytes."""
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + quote(base.removeprefix("file:")), "")
    rules = compile_ignore([*DEFAULT_IGNORE, *(ignore or []), *root_ignore(spark, root)])
    kept = found.withColumn("path", relative).where(is_allowed(F.col("path")) & ~is_ignored(F.col("path"), rules))
    text = kept.select("path", F.unix_millis("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), decoded(F.col("content")).alias("content"))
    return text.select("path", F.sha2("content", 256).alias("hash"), "mtime", "size", "content", language_of(F.col("path")).alias("language"))


def files_of_documents(docs: DataFrame) -> DataFrame:
    """The document table as a file corpus: ``source/doc_id.lang`` holds the text."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id"), F.lit("."), F.coalesce("lang", F.lit("txt")))
    return docs.select("doc_id", path.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"), F.col("text").alias("content"), F.col("lang").alias("language"))
