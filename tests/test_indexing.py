"""The index of a folder, the command line on it, and a stream of changes."""

import json
import time

import pytest
from pyspark.sql import functions as F

from glyphmill import cli
from glyphmill.operators import imports, maintenance, ranking, rerank, symbols
from glyphmill.plans.context import Searcher
from glyphmill.plans.indexing import Project, ensure_indexed
from glyphmill.streaming.watch import bursts

APP = "import { helper } from './util';\nimport './side';\nexport class Runner {\n  start(job: string): number {\n    return helper(job);\n  }\n}\n"
UTIL = "export function helper(job: string): number {\n  return job.length;\n}\n"


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "src"
    base.mkdir()
    (base / "app.ts").write_text(APP)
    (base / "util.ts").write_text(UTIL)
    (base / "side.ts").write_text("export const side = 1;\n")
    (base / "skip.log").write_text("no")
    (base / "hidden.ts").write_text("export const hidden = 1;\n")
    (base / ".gitignore").write_text("hidden.ts\n")
    (base / "node_modules").mkdir()
    (base / "node_modules" / "x.js").write_text("var x;")
    return base


def test_incremental_index(spark, folder, tmp_path):
    project = Project(spark, str(tmp_path / "store"))
    first = ensure_indexed(project, str(folder))
    assert (first["added"], first["embedded"], project.version()) == (3, 3, 1)
    assert {r.path for r in project.read("files").collect()} == {"app.ts", "util.ts", "side.ts"}
    assert {(r.name, r.kind) for r in project.read("symbols").collect()} >= {("Runner", "class"), ("start", "method"), ("helper", "function")}
    assert {(r.src, r.dst) for r in project.read("links").collect()} == {("app.ts", "util.ts"), ("app.ts", "side.ts")}
    again = ensure_indexed(project, str(folder))
    assert again["unchanged"] == 3 and again["embedded"] == 0 and project.version() == 1
    (folder / "util.ts").write_text(UTIL.replace("length", "size"))
    (folder / "side.ts").unlink()
    third = ensure_indexed(project, str(folder), vectors=False)
    assert (third["modified"], third["deleted"], third["embedded"]) == (1, 1, 0)
    assert maintenance.needs_index(project.read("files"), project.read("manifest")).collect()[0].path == "util.ts"
    healed = ensure_indexed(project, str(folder))
    assert healed["embedded"] == 1 and {r.path for r in project.read("vectors").collect()} == {"app.ts", "util.ts"}
    index = project.search_index()
    assert {r.path for r in index.only_ready().chunks.collect()} == {"app.ts", "util.ts"}
    found = Searcher(index, "p").search("helper job", include=["*.ts"], max_files=1)
    assert len({r["path"] for r in found}) == 1 and "helper" in found[0]["text"]
    forced = ensure_indexed(project, str(folder), force=True)
    assert forced["added"] == 2


def test_lock_keeps_second_writer_out(spark, tmp_path):
    project = Project(spark, str(tmp_path / "store"))
    with project.locked(), pytest.raises(TimeoutError), project.locked(wait=0.1):
        pass
    began = time.monotonic()
    with project.locked():
        assert time.monotonic() - began < 5


def test_command_line(spark, folder, tmp_path, capsys):
    common = ["--settings", str(tmp_path / "s.json"), "--store", str(tmp_path / "store")]

    def said(*args: str) -> str:
        assert cli.main([*common, *args]) == 0
        return capsys.readouterr().out.strip()

    assert "wrote" in said("init")
    assert json.loads(said("index", "--folder", str(folder)))["added"] == 3
    assert said("list-files", "--glob", "**/*.ts", "--folder", str(folder)).splitlines()[0].startswith("app.ts")
    assert "helper" in said("definition", "helper", "--folder", str(folder)) and "Runner" in said("list-symbols", "--kind", "class", "--folder", str(folder))
    assert len(said("references", "helper", "--folder", str(folder)).splitlines()) == 3
    assert "class Runner" in said("search", "Runner start", "--folder", str(folder)) and '"version": 1' in said("stats", "--json", "--folder", str(folder))
    assert json.loads(said("config", "set", "max_k", "99"))["max_k"] == 15 and "max_k" in said("config", "validate")


def test_references_without_definition(spark):
    files = spark.createDataFrame([("a.ts", "typescript", "function go() {}\ngo();\n")], "path string, language string, content string")
    chunks = spark.createDataFrame([("a.ts", 0, 16, "a.ts > fn go")], "path string, start int, end int, breadcrumb string")
    lines = lambda **how: sorted(r.line for r in symbols.references(files, "go", None, chunks, True, **how).collect())
    assert lines() == [1, 2] and lines(any_label=True) == [2]


def test_fallback_definitions_and_ctags(spark):
    chunks = spark.createDataFrame([("b.py", 0, "b.py > def go", "def go(): pass", 1.0, "python"), ("a.py", 0, "a.py", "def go(): pass", 3.0, "python"), ("c.py", 0, "c.py", "go()", 9.0, "python"), ("d.py", 0, "d.py > go", "x", 0.5, "python")], "path string, chunk_index int, breadcrumb string, code string, score double, language string")
    assert [r.path for r in symbols.fallback_definitions(chunks, "go").collect()] == ["d.py", "a.py", "b.py"]
    tags = spark.createDataFrame([('{"_type":"tag","name":"go","path":"a.py","line":3,"kind":"f","kindName":"function"}',), ('{"_type":"ptag","name":"x"}',), ("broken",), ('{"_type":"tag","name":"n","path":"zz.py","line":1}',)], "value string")
    files = spark.createDataFrame([("a.py", "h", "python")], "path string, hash string, language string")
    assert [(r.path, r.name, r.kind, r.start_line, r.hash) for r in symbols.ctags_symbols(tags, files).collect()] == [("a.py", "go", "function", 3, "h")]


def test_imports_of_every_form(spark):
    rows = [
        ("a.ts", "typescript", "import './side';\nimport {\n  a,\n  b\n} from './many';\nexport * from './all';\nexport const x = 'no';\nconst y = require('./req');\n"),
        ("b.go", "go", 'import "fmt"\nimport (\n\t"os"\n\tx "a/b"\n)\nvar s = `\n"not"\n`\n'),
        ("c.cs", "c_sharp", "using System.IO;\nusing static System.Math;\nusing A = B.C;\n"),
        ("d.rs", "rust", "pub use crate::net::tcp;\nuse std::fmt;\npub(crate) mod inner;\n"),
    ]
    found = imports.extract_imports(spark.createDataFrame(rows, "path string, language string, content string")).collect()
    got = {p: {r.import_str for r in found if r.src == p} for p in ("a.ts", "b.go", "c.cs", "d.rs")}
    assert got == {"a.ts": {"./side", "./many", "./all", "./req"}, "b.go": {"fmt", "os", "a/b"}, "c.cs": {"System.IO", "B.C"}, "d.rs": {"crate::net::tcp", "mod inner"}}


def test_skip_rules(spark):
    rows = [("a/x-lock.json",), ("composer.json",), ("node_modules/a.json",), ("b.lock.json",)]
    df = spark.createDataFrame(rows, "path string")
    got = df.select("path", maintenance.skip_reason(F.col("path"), F.lit(1), F.lit("x")).alias("why")).collect()
    assert {r.path for r in got if r.why} == {"a/x-lock.json", "node_modules/a.json"}


def test_failing_rerank_service_changes_nothing(spark):
    rows = spark.createDataFrame([("a", 0, 0.9, "x y"), ("b", 0, 0.1, "x z z")], "path string, chunk_index int, score double, text string")
    tries = {"fail": rerank.service(lambda texts, tokens: 1 / 0), "good": rerank.service(lambda texts, tokens: [float(len(t)) for t in texts])}
    order = lambda how: [(r.path, r.score) for r in rerank.rerank(rows, "text", ["x"], ["path", "chunk_index"], 10, tries[how]).collect()]
    assert order("fail") == [("a", 0.9), ("b", 0.1)] and order("good") == [("b", 5.0), ("a", 3.0)]


def test_cutoff_fills_up_after_repeats(spark):
    rows = spark.createDataFrame([(0, "a", 0.9), (0, "a", 0.9), (0, "b", 0.3), (0, "c", 0.26)], "q int, path string, score double")
    got = ranking.smart_cutoff(rows, ["q"], ["path"], min_k=2, max_k=2).collect()
    assert sorted(r.path for r in got) == ["a", "b"]


def test_stream_of_bursts(spark, tmp_path):
    rows = [("p", "2024-01-01 00:00:00"), ("p", "2024-01-01 00:00:30"), ("p", "2024-01-01 02:00:00"), ("q", "2024-01-01 00:10:00"), ("q", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "project string, t string").select("project", F.to_timestamp("t").alias("ts")).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("project string, ts timestamp").parquet(str(tmp_path / "in"))
    out = bursts(stream, gap="5 minutes", late="1 hour")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.project, r.changes) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", 1), ("p", 2), ("q", 1)]  # the last burst of q waits for the watermark
