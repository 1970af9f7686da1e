"""Command line (API7-API9): ``python -m glyphmill.cli COMMAND``; tables lie in ``FOLDER/.glyphmill`` unless ``--store`` says otherwise."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BOUNDS, load_config, masked_secret
from .operators import maintenance, render, rerank, symbols
from .plans.context import context, lexical_hits, with_code
from .plans.indexing import Project, ensure_indexed, project_of
from .streaming.watch import watch


def _query_vector(spark: SparkSession, text: str) -> list[float]:
    return list(rerank.embed(spark.createDataFrame([(text,)], "text string"), "text").first()["vector"])


def _project(args: argparse.Namespace, vectors: bool) -> Project:
    spark = SparkSession.builder.appName("glyphmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = args.store or f"{args.folder.rstrip('/')}/.glyphmill"
    project = project_of(spark, store)
    ensure_indexed(project, args.folder, vectors, ignore=[".glyphmill/"])
    return project


def init(args: argparse.Namespace) -> str:
    """Writes the settings file with the defaults, unless there is one."""
    path = Path(args.settings)
    if path.exists():
        return f"{path} is there already"
    path.write_text(json.dumps({k: v for k, v in asdict(load_config()).items() if k in BOUNDS}, indent=2, sort_keys=True))
    return f"wrote {path}"


def index(args: argparse.Namespace) -> str:
    spark = SparkSession.builder.appName("glyphmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    project = project_of(spark, args.store or f"{args.folder.rstrip('/')}/.glyphmill")
    return json.dumps(ensure_indexed(project, args.folder, True, args.force, [".glyphmill/"]), sort_keys=True)


def search(args: argparse.Namespace) -> str:
    project = _project(args, True)
    found = project.search_index()
    config = load_config(_settings(args), args.mode)
    vector = _query_vector(project.spark, args.text)
    packed = context(found, args.text, vector, config, args.term, args.mode == "deep", include=args.include, exclude=args.exclude, language=args.language, max_files=args.max_files)
    shown = render.with_lines(packed, found.files)
    row = (render.as_json if args.json else render.markdown)(shown).first()
    return row[0] or ""


def stats(args: argparse.Namespace) -> str:
    project = _project(args, False)
    files, manifest = project.read("files"), project.read("manifest")
    facts = symbols.health(files, manifest.where("status = 'pending'")).first().asDict()
    facts |= {r["status"]: r["n"] for r in maintenance.status_counts(manifest).collect()}
    facts |= {"languages": [f"{r['language']}={r['n']}" for r in symbols.languages(files).collect()], "version": project.version()}
    return json.dumps(facts, sort_keys=True) if args.json else "\n".join(f"{k}: {v}" for k, v in sorted(facts.items()))


def _lines(df: DataFrame) -> str:
    return "\n".join("\t".join(str(x) for x in row) for row in df.collect())


def list_files(args: argparse.Namespace) -> str:
    return _lines(symbols.list_files(_project(args, False).read("files"), args.glob, args.language, min(args.limit, 1000)))


def list_symbols(args: argparse.Namespace) -> str:
    found = symbols.list_symbols(_project(args, False).read("symbols"), args.path, args.kind, args.language, None, max(1, min(args.limit, 500)))
    return _lines(found.select("path", "start_line", "kind", "name"))


def definition(args: argparse.Namespace) -> str:
    """Definitions of a symbol with their code; lexical hits where no symbol row has the name."""
    project = _project(args, False)
    limit = max(1, min(args.limit, 20))
    files = project.read("files")
    found = symbols.definitions_of(project.read("symbols"), args.symbol, args.hint, limit)
    if not found.isEmpty():
        return _lines(symbols.definition_snippets(found, files).select("path", "start_line", "end_line", "kind", "snippet"))
    store = project.search_index()
    code = with_code(store, store.chunks.select("path", "chunk_index")).join(files.select("path", "language"), "path")
    hits = code.join(lexical_hits(code, args.symbol, max(5 * limit, 20)), ["path", "chunk_index"])
    return _lines(symbols.fallback_definitions(hits, args.symbol, args.hint, limit).select("path", "breadcrumb", "code"))


def references(args: argparse.Namespace) -> str:
    project = _project(args, False)
    found = symbols.references(project.read("files"), args.symbol, max(1, min(args.limit, 200)), project.read("chunks"), args.exclude_definition)
    return _lines(found)


def watch_folder(args: argparse.Namespace) -> str:
    """Indexes at once, then after every burst of changes until the process is stopped."""
    project = _project(args, True)
    changes = project.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(args.folder)
    quiet = changes.where(~F.col("path").contains("/.glyphmill/")).select("path")
    query = watch(quiet, lambda _: ensure_indexed(project, args.folder, ignore=[".glyphmill/"]), f"{project.catalog.root}/watch", f"{args.debounce} milliseconds", args.once)
    query.awaitTermination()
    return "stopped"


def _settings(args: argparse.Namespace) -> dict:
    path = Path(args.settings)
    return json.loads(path.read_text()) if path.exists() else {}


def config(args: argparse.Namespace) -> str:
    """Lists, sets or checks settings."""
    own = _settings(args)
    if args.action == "set":
        if args.name not in BOUNDS and not str(args.name).endswith("_key"):
            raise SystemExit(f"unknown setting {args.name}; known: {', '.join(sorted(BOUNDS))}")
        own[args.name] = args.value if args.name.endswith("_key") else json.loads(args.value)
        Path(args.settings).write_text(json.dumps(own, indent=2, sort_keys=True))
    if args.action == "validate":
        held = asdict(load_config(own))
        wrong = [f"{k}: {v} becomes {held.get(k)}" for k, v in sorted(own.items()) if not k.endswith("_key") and (k not in BOUNDS or held[k] != v)]
        return "\n".join(wrong) or "all settings are within bounds"
    keys = {k: masked_secret(str(v)) for k, v in own.items() if k.endswith("_key")}
    return json.dumps(asdict(load_config(own)) | keys, indent=2, sort_keys=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    top.add_argument("--settings", default="glyphmill.json")
    top.add_argument("--store", help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable[[argparse.Namespace], str], *options: tuple[str, dict], folder: bool = True) -> None:
        command = commands.add_parser(name, help=(run.__doc__ or name).splitlines()[0])
        for flag, details in options:
            command.add_argument(flag, **details)
        if folder:
            command.add_argument("--folder", default=".")
        command.set_defaults(run=run)

    text, many, yes = {"type": str}, {"action": "append"}, {"action": "store_true"}
    number = lambda n: {"type": int, "default": n}
    add("init", init, folder=False)
    add("index", index, ("--force", yes))
    add("watch", watch_folder, ("--debounce", number(500)), ("--once", yes))
    add("search", search, ("text", text), ("--term", many), ("--mode", {"choices": ("quick", "balanced", "deep"), "default": "balanced"}), ("--json", yes), ("--include", many), ("--exclude", many), ("--language", text), ("--max-files", {"type": int}))
    add("stats", stats, ("--json", yes))
    add("list-files", list_files, ("--glob", text), ("--language", text), ("--limit", number(200)))
    add("list-symbols", list_symbols, ("--path", text), ("--kind", many), ("--language", text), ("--limit", number(100)))
    add("definition", definition, ("symbol", text), ("--hint", text), ("--limit", number(3)))
    add("references", references, ("symbol", text), ("--exclude-definition", yes), ("--limit", number(50)))
    add("config", config, ("action", {"choices": ("list", "set", "validate")}), ("name", {"nargs": "?"}), ("value", {"nargs": "?"}), folder=False)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    print(args.run(args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
