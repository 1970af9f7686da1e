"""Block parsers, chunk windows, definitions and calls."""

from pathlib import Path

import pytest

from glyphmill.operators import syntax

SAMPLES = {
    "python": ('class A(Base):\n    """doc { ( """\n    def one(self, x=(1,\n                     2)):\n        return self.two(x) + os.path.join("def no(", x)\n\n    @property\n    async def two(self):\n        pass\n', [("A", "class", 1, 9), ("one", "function", 3, 5), ("two", "function", 7, 9)], [("self.two", 5), ("os.path.join", 5)]),
    "typescript": ("export abstract class Foo<T> extends Bar {\n  constructor(private a: string) { super(); }\n  async run(id: number): Promise<void> {\n    if (id) { this.go(id); } else { log(`x ${id} {`); }\n  }\n}\nexport const add = (a, b) => { return a + b; };\nfunction* gen() { yield 1 }\n", [("Foo", "class", 1, 6), ("constructor", "method", 2, 2), ("run", "method", 3, 5), ("add", "function", 7, 7), ("gen", "function", 8, 8)], [("go", 4), ("log", 4)]),
    "javascript": ("class A {\n  go(x) { return f(x) }\n}\nfunction b() {}\n", [("A", "class", 1, 3), ("go", "method", 2, 2), ("b", "function", 4, 4)], [("f", 2)]),
    "go": ("type T struct {\n\ta int\n}\nfunc (t *T) Name() string {\n\treturn fmt.Sprint(t.a)\n}\n", [("T", "class", 1, 3), ("Name", "function", 4, 6)], [("fmt.Sprint", 5)]),
    "rust": ("pub struct P<'a> { x: &'a str }\nimpl<'a> P<'a> {\n    pub fn new(x: &'a str) -> Self { Self { x } }\n    fn go(&self) { self.go2('c'); }\n}\n", [("P", "class", 1, 1), ("new", "function", 3, 3), ("go", "function", 4, 4)], [("self.go2", 4)]),
    "java": ("public class Main extends B {\n    public Main(int y) { this.x = y; }\n    @Override\n    public List<String> names(Map<String, Integer> m) throws E {\n        return helper(m);\n    }\n}\n", [("Main", "class", 1, 7), ("Main", "method", 2, 2), ("names", "method", 3, 6)], [("helper", 5)]),
    "c": ('#include "x.h"\nstatic int add(int a) {\n  return g(a);\n}\ntypedef struct { int a; } foo_t;\n', [("add", "function", 2, 4), ("foo_t", "type", 5, 5)], [("g", 3)]),
    "cpp": ("namespace ns {\nclass K : public L {\n  int f(int a) const { return g(a); }\n};\nint K::h(int z)\n{\n  return z;\n}\n}\n", [("ns", "module", 1, 9), ("K", "class", 2, 4), ("f", "function", 3, 3), ("K::h", "function", 5, 8)], [("g", 3)]),
    "c_sharp": ("namespace N.M {\n  public class C {\n    public void F(string s) { G(s); }\n  }\n}\n", [("N.M", "module", 1, 5), ("C", "class", 2, 4), ("F", "method", 3, 3)], [("G", 3)]),
    "ruby": ("module M\n  class A < B\n    def self.go(x)\n      y.each do |z|\n        f(z)\n      end\n    end\n  end\nend\n", [("M", "module", 1, 9), ("A", "class", 2, 8), ("go", "function", 3, 7)], [("f", 5)]),
    "php": ("<?php\nclass C { public function f($a) { return g($a); } }\nfunction top() { }\n", [("C", "class", 1, 2), ("f", "function", 2, 2), ("top", "function", 3, 3)], [("g", 2)]),
    "kotlin": ("class A(val x: Int) {\n  fun f(a: Int): Int {\n    return g(a)\n  }\n}\nobject O { }\n", [("A", "class", 1, 5), ("f", "function", 2, 4), ("O", "class", 6, 6)], [("g", 3)]),
    "swift": ("class A {\n  init(x: Int) { }\n  func f() -> Int { return g() }\n}\n", [("A", "class", 1, 4), ("init", "function", 2, 2), ("f", "function", 3, 3)], [("g", 3)]),
    "lua": ("local function f(a)\n  if a then return 1 end\n  for i=1,3 do\n    g(i)\n  end\nend\nM.x = function() return 2 end\n", [("f", "function", 1, 6), ("M.x", "function", 7, 7)], [("g", 4)]),
    "shell": ('# c\ngo() {\n  echo "x # y }"\n}\nfunction two {\n  go 1\n}\n', [("go", "function", 2, 4), ("two", "function", 5, 7)], []),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_definitions_and_calls(language):
    text, definitions, calls = SAMPLES[language]
    assert syntax.definitions_in(text, language) == definitions
    assert syntax.calls_in(text, language) == calls


def test_every_language_has_a_sample():
    assert set(SAMPLES) == set(syntax.LANGUAGES)


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_chunks_tile_the_text(language):
    text = SAMPLES[language][0]
    for most in (10, 40, 500):
        for broken in (text, text[: len(text) // 2], text[len(text) // 3 :], "}}" + text + "{{("):
            made = syntax.Chunker(broken, most, most // 10, most // 12).chunks("p", syntax.outline(broken, language))
            assert [c["raw_start"] for c in made] == [0, *(c["raw_end"] for c in made[:-1])][: len(made)] and (not made or made[-1]["raw_end"] == len(broken))
            assert all(a["end"] <= b["start"] for a, b in zip(made, made[1:], strict=False))
            covered = "".join(broken[c["start"] : c["end"]] for c in made)
            assert not broken.strip("{}(); \n") or len("".join(covered.split())) >= 0.8 * len("".join(broken.split())) - 6


def test_comments_go_with_the_code_after_them():
    text = "def a():\n    " + "x" * 300 + "\n\n# about b\ndef b():\n    " + "y" * 300 + "\n"
    first, second = syntax.Chunker(text).chunks("f.py", syntax.outline(text, "python"))
    assert text[second["start"] :].startswith("# about b") and first["breadcrumb"] == "f.py > def a" and second["breadcrumb"] == "f.py > def b"


def test_windows_of_other_declarations_have_a_smaller_budget():
    body = lambda n: "    " + "z" * n + "\n"
    near = "class A:\n    def a(self):\n    " + body(150) + "    def b(self):\n    " + body(150)
    far = near.replace("z" * 150, "z" * 200)
    assert len(syntax.Chunker(near, most=320, least=5).chunks("f", syntax.outline(near, "python"))) == 2
    assert len(syntax.Chunker(far, most=1000, least=5).chunks("f", syntax.outline(far, "python"))) == 1


def test_overlap_reaches_back():
    text = "def a():\n    " + "x" * 300 + "\ndef b():\n    " + "y" * 300 + "\n"
    second = syntax.Chunker(text).chunks("f.py", syntax.outline(text, "python"))[1]
    overlap = text[second["vector_start"] : second["start"]]
    assert len("".join(overlap.split())) == syntax.OVERLAP
    assert syntax.Chunker("ab cd").overlap_start(3) == 3


def test_tables_of_chunks(spark):
    text = Path(syntax.__file__).read_text(encoding="utf-8")
    rows = [("a.py", "h", "python", text), ("b.md", "h", "markdown", "# t\n" * 300), ("c.vue", "h", "vue", "<x>"), ("d.py", "h", "python", None), ("e.py", "h", "python", ""), ("f.py", "h", "python", "x = '" + "é😀" * 900 + "'\ny = 1\n")]
    files = spark.createDataFrame(rows, "path string, hash string, language string, content string")
    made = syntax.chunks_of(files).toPandas()
    assert set(made["path"]) == {"a.py", "b.md", "f.py"} and made["chunk_id"].is_unique
    own = made[made["path"] == "a.py"].sort_values("chunk_index")
    assert own["raw_end"].iloc[-1] == len(text) and (own["nws"] <= 750).mean() > 0.9
    assert any("class Chunker > def chunks" in b for b in own["breadcrumb"])
    names = {r.name for r in syntax.symbols_of(files).collect()}
    assert {"Chunker", "outline", "chunks_of", "_by_end"} <= names
    assert {r.callee for r in syntax.calls_of(files).collect()} >= {"self.joined", "masked"}
