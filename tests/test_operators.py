"""Operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.config import load_config, masked_secret
from glyphmill.functions import text as tx
from glyphmill.functions.query_text import ResultCache, query_variants, tokens_of, variants_of
from glyphmill.operators import chunking, expansion, imports, maintenance, ranking, render, rerank, symbols
from glyphmill.sources.catalog import Catalog
from glyphmill.sources.corpus import compile_ignore, crawl, decoded, is_ignored
from glyphmill.streaming.watch import watch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlap_scores(spark):
    cases = [("MyClass function handleAuth() {}", ["handleauth"], 1.0), (" handleAuth", ["auth"], 0.5), ("Foo bar baz", ["xyz"], 0.0), ("x", [], 0.0), ("UserService function login() { validate(); }", ["login", "validate"], 2.0)]
    for text, tokens, want in cases:
        got = spark.createDataFrame([(text,)], "t string").select(tx.overlap_score(F.col("t"), tokens)).first()[0]
        assert got == want, text


def test_clamp_slice(spark):
    df = spark.createDataFrame([("0123456789", 0, 5), ("0123456789", 8, 99), ("0123456789", 7, 3), ("0123456789", -4, 2), (None, 0, 4)], "t string, s int, e int")
    assert [r[0] for r in df.select(tx.clamp_slice(F.col("t"), F.col("s"), F.col("e"))).collect()] == ["01234", "89", "", "01", ""]


def test_paths_and_globs(spark):
    df = spark.createDataFrame([("src/nested/util.ts",), ("src/app.ts",), ("README.md",)], "path string")
    assert rows(df.where(F.col("path").rlike(tx.glob_to_regex("src/**/*.ts")))) == [("src/app.ts",), ("src/nested/util.ts",)]
    one = spark.createDataFrame([("a/./b/../c", "a/b/x", "a/b/y/z")], "p string, q string, r string")
    assert tuple(one.select(tx.resolve_path(F.col("p")), tx.common_segments(F.col("q"), F.col("r"))).first()) == ("a/c", 2)


def test_line_chunks_tile_the_text(spark):
    random.seed(3)
    texts = ["", "a\nb", "x" * 700, "\n".join("w" * random.randint(0, 90) for _ in range(60)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", chunking.line_chunks(F.col("t"), 100).alias("c"))
    for r in df.collect():
        if r.t is None:
            continue
        assert r.c[0].raw_start == 0 and r.c[-1].raw_end == len(r.t)
        assert all(a.raw_end == b.raw_start for a, b in zip(r.c, r.c[1:], strict=False))
        assert "\n".join(r.t[x.start : x.end] for x in r.c) == r.t


def test_tokens_and_variants():
    assert variants_of("apiKey") == ["apikey", "api_key"]
    assert variants_of("api_key") == ["api_key", "apikey", "apiKey"]
    assert "index.ts" in tokens_of("open index.ts AND NOT it")
    got = query_variants("trace token refresh and retry behavior", ["AuthService", "refreshToken"])
    assert got[0] == "trace token refresh and retry behavior" and "AuthService refreshToken trace token refresh and retry behavior" in got and len(got) <= 4
    assert query_variants("a  b", enabled=False) == ["a b"]


def test_cache_is_bounded_and_keyed():
    cache = ResultCache(2)
    keys = [ResultCache.key("q", "p", v, {"k": 1}) for v in range(3)]
    for k in keys:
        cache.put(k, k)
    assert cache.get(keys[0]) is None and cache.get(keys[2]) == keys[2]


def test_config_clamps():
    c = load_config({"vector_top_k": "999", "import_files": -10, "max_k": 99, "w_vec": ".7", "floor": "x"})
    assert (c.vector_top_k, c.import_files, c.max_k, c.w_vec, c.w_lex, c.floor) == (200, 0, 15, 0.7, 0.3, 0.25)


def test_cutoff_low_confidence(spark):
    hit = spark.createDataFrame([(1, "a", 0, 0.2)], "query_id int, path string, chunk_index int, score double")
    assert ranking.smart_cutoff(hit, ["query_id"], ["path"], floor=0.4, behaviour="return_empty").count() == 0
    assert ranking.smart_cutoff(hit, ["query_id"], ["path"], floor=0.4).first().low_confidence


def test_hybrid_without_lexical_hits(spark):
    v = spark.createDataFrame([("a", 0.5)], "k string, score double")
    assert rows(ranking.hybrid(v, v.where("false"), ["k"])) == [("a", 0.5, "vector")]


def test_intervals_and_budget(spark):
    spans = spark.createDataFrame([(1, "f", 0, 50, 0.9), (1, "f", 50, 80, 0.8), (1, "g", 0, 40, 0.3), (1, "g", 100, 150, 0.2)], "query_id int, path string, raw_start int, raw_end int, score double")
    merged = expansion.merge_intervals(spans, ["query_id", "path"])
    assert {(r.path, r.raw_start, r.raw_end) for r in merged.collect()} == {("f", 0, 80), ("g", 0, 40), ("g", 100, 150)}
    assert [(r.path, r.raw_start) for r in expansion.pack(merged, 125).orderBy("position").collect()] == [("f", 0), ("g", 0)]


def test_snapshot_and_outbox(spark):
    kind = "path string, hash string, size long, mtime double, content string"
    scan = spark.createDataFrame([("a", "1", 1, 1.0, "x"), ("b", "2", 1, 2.0, "y"), ("c", "3", 999999, 1.0, ""), ("d", "4", 1, 9.0, "z")], kind)
    known = spark.createDataFrame([("a", "1", 1, 1.0), ("b", "0", 1, 1.0), ("e", "5", 1, 1.0), ("d", "4", 1, 1.0)], "path string, hash string, size long, mtime double")
    assert rows(maintenance.snapshot_diff(scan, known)) == [("a", "unchanged"), ("b", "modified"), ("c", "skipped"), ("d", "unchanged"), ("e", "deleted")]
    marks = spark.createDataFrame([("a", "1"), ("b", "old"), ("zz", "1")], "path string, hash string")
    assert rows(maintenance.replay_outbox(marks, scan)) == [("a", "1", "applied"), ("b", "old", "discarded"), ("zz", "1", "discarded")]


def test_references_and_definitions(spark):
    files = spark.createDataFrame([("src/auth.ts", "export function login(user: string) {\n  return user;\n}\n", "typescript"), ("src/app.ts", "const result = login(user);\nconst ignored = loginUser(user);\nlogin(user);\n", "typescript")], "path string, content string, language string")
    assert [(r.path, r.line) for r in symbols.references(files, "login").orderBy("path", "line").collect()] == [("src/app.ts", 1), ("src/app.ts", 3), ("src/auth.ts", 1)]
    assert [(r.path, r.line) for r in symbols.definition_lines(files, "login").collect()] == [("src/auth.ts", 1)]


def test_call_graph(spark):
    files = spark.createDataFrame([("m.py", "h", "python", "def foo():\n    pass\n\ndef bar():\n    foo()\n")], "path string, hash string, language string, content string")
    found = symbols.extract_symbols(files)
    assert [(r.name, r.start_line) for r in found.orderBy("start_line").collect()] == [("foo", 1), ("bar", 4)]
    assert rows(symbols.nearest_definition(symbols.extract_calls(files), found)) == [("m.py", "foo", 5, 1)]


def test_imports_without_targets(spark):
    files = spark.createDataFrame([("a.ts", "typescript", "import x from 'react';"), ("b.py", "python", None)], "path string, language string, content string")
    assert imports.resolve_imports(imports.extract_imports(files), files.select("path")).count() == 0


def test_hit_window():
    text = "\n".join(f"line {i}" for i in range(50))
    got = rerank.hit_window(text, ["line 25"], 40)
    assert "line 25" in got and len(got) <= 46 and got.startswith("...") and got.endswith("...")


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/node_modules/x.js",), ("keep.log",), ("b.log",), ("src/a.ts",)], "path string")
    rules = compile_ignore(["node_modules/", "*.log", "!keep.log"])
    assert rows(df.where(~is_ignored(F.col("path"), rules))) == [("keep.log",), ("src/a.ts",)]


def test_crawl_and_catalog(spark, tmp_path):
    (tmp_path / "repo" / "node_modules").mkdir(parents=True)
    (tmp_path / "repo" / "a.py").write_text("x = 1\n")
    (tmp_path / "repo" / "node_modules" / "b.js").write_text("y")
    found = crawl(spark, str(tmp_path / "repo"))
    assert [(r.path, r.language) for r in found.collect()] == [("a.py", "python")]
    catalog = Catalog(spark, str(tmp_path / "store"))
    assert catalog.version("files") == 0 and catalog.write("files", found) == 1
    assert catalog.read("files").count() == 1 and catalog.clear("files") == 2 and catalog.read("files").count() == 0


def test_decoding(spark):
    texts = {"utf-8": "plain é", "utf-8-sig": "marked é", "utf-16": "wide é", "utf-32": "wider é", "gb18030": "数据库连接测试文本", "cp1252": "un été à la plage", "utf-16-be": None}
    raw = [(name, bytearray(text.encode(name))) for name, text in texts.items() if text] + [("null", None), ("utf-16-be", bytearray(b"\xfe\xff" + "big é".encode("utf-16-be")))]
    got = {r.n: r.t for r in spark.createDataFrame(raw, "n string, b binary").select("n", decoded(F.col("b")).alias("t")).collect()}
    assert got == {**{k: v for k, v in texts.items() if v}, "utf-16-be": "big é", "null": None}


def test_secrets_are_masked():
    assert [masked_secret(x) for x in ("", "12345678", "abcd1234wxyz")] == ["", "********", "abcd****wxyz"]


def test_watch_runs_once_over_what_is_there(spark, tmp_path):
    spark.createDataFrame([("p", 1), ("p", 2)], "project string, n int").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("project string, n int").parquet(str(tmp_path / "in"))
    watch(stream, lambda batch: seen.append(batch.count()), str(tmp_path / "check"), once=True).awaitTermination(60)
    assert sum(seen) == 2


@pytest.mark.parametrize("empty", ["or", "and"])
def test_bm25_short_phrases(spark, empty):
    df = spark.createDataFrame([("a", "some text"), ("b", None)], "k string, t string")
    assert ranking.bm25(df, ["k"], ["t"], ["so"], empty).count() == 0
    assert [r.k for r in ranking.bm25(df, ["k"], ["t"], ["some"], empty).collect()] == ["a"]


def test_renderers(spark):
    files = spark.createDataFrame([("a.py", "x = 1\ny = 2\nz = 3\n", "python", 18)], "path string, content string, language string, size long")
    packed = spark.createDataFrame([(1, "a.py", 12, 18, "z = 3\n"), (0, "a.py", 0, 6, "x = 1\n")], "position int, path string, raw_start int, raw_end int, text string")
    lines = render.with_lines(packed, files)
    text = render.markdown(lines).first()[0]
    assert text.index("L1-L1") < text.index("L3-L3") and "```python\nx = 1" in text
    assert render.as_json(lines).first()[0].startswith('[{"position":0,"path":"a.py","first_line":1')
    assert render.file_lines(files).first().line == "a.py (python, 18 B)"


def test_linked_chunks_by_overlap(spark):
    files = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.4)], "query_id int, path string, score double")
    texts = [("a", i, "alpha beta" if i == 7 else "alpha" if i == 5 else "other") for i in range(9)] + [("b", i, "other") for i in range(5)]
    got = expansion.chunks_of_files(files, spark.createDataFrame(texts, "path string, chunk_index int, text string"), ["alpha", "beta"]).collect()
    assert sorted((r.path, r.chunk_index) for r in got) == [("a", 5), ("a", 7), ("b", 0), ("b", 1), ("b", 2)]


def test_barrel_imports(spark):
    links = spark.createDataFrame([("s.ts", "lib/index.ts"), ("lib/index.ts", "lib/a.ts"), ("lib/index.ts", "lib/b.ts"), ("lib/index.ts", "lib/c.ts"), ("lib/a.ts", "lib/d.ts")], "src string, dst string")
    seeds = spark.createDataFrame([(0, "s.ts", 0, 1.0)], "query_id int, path string, chunk_index int, score double")
    got = {r.path: r.score for r in expansion.linked_files(seeds, links).collect()}
    assert got == {"lib/index.ts": pytest.approx(0.6), "lib/a.ts": pytest.approx(0.42), "lib/b.ts": pytest.approx(0.42)}
