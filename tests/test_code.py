"""Symbols and relations of seven languages: literals, nesting, parameters, and time in proportion to a file."""

import time

import pytest

from quillmesh.operators import code


def read(source, language):
    s = code._Source(source, language)
    return {(x["name"], x["kind"], x["parent"]) for x in s.symbols()}, {(r, src, t) for r, src, t, _ in s.relations(s.symbols())}


def test_rust():
    symbols, relations = read(
        """/* outer /* inner */ fn ghost() {} */
use std::{fmt, io::Read};
const LIMIT: usize = 4; static mut TICKS: u8 = b'\\'';
macro_rules! twice { ($x:expr) => { $x + $x } }
mod shapes {
    pub(crate) struct Ring<'a> { name: &'a str }
    pub trait Area: Sized + Clone { fn area(&self) -> f64; }
    impl<'a> Area for Ring<'a> {
        fn area(&self) -> f64 { let r = r#"fn fake() { "quoted" }"#; measure(r.len(), |x| x.pow(2)) }
    }
}
""",
        "Rust",
    )
    assert symbols == {
        ("LIMIT", "const", None), ("TICKS", "var", None), ("twice", "macro", None), ("shapes", "mod", None), ("Ring", "struct", "shapes"), ("Area", "trait", "shapes"), ("area", "method", "Area"), ("Area", "impl", "shapes"),
    }
    assert {("imports", None, "std::{fmt, io::Read}"), ("inherits", "Area", "Clone"), ("calls", "area", "measure"), ("calls", "area", "r.len"), ("calls", "area", "x.pow")} <= relations
    assert ("implements", "Ring", "Area") in relations and not any("fake" in t or "ghost" in t for _, _, t in relations)


def test_python():
    symbols, relations = read(
        '''import os.path, sys
from pkg.mod import thing
TEXT = """
def ghost():
    pass
"""
class Base(Root, metaclass=Meta):
    @wraps(
        other,
    )
    async def run(self, a=dict(b=(1, 2)), *rest):
        def inner(): return "def fake()"
        return helper(inner())  # call()
''',
        "Python",
    )
    assert symbols == {("Base", "class", None), ("run", "fn", "Base"), ("run", "method", "run"), ("inner", "method", "run")}
    assert {("imports", None, "pkg.mod"), ("inherits", "Base", "Root"), ("calls", "run", "helper"), ("calls", "run", "inner")} <= relations and not any(t == "fake" or t == "call" for _, _, t in relations)


def test_go():
    symbols, relations = read(
        """package p
import ("fmt"; m "math")
const (
	First = iota
	Second
)
var (
	table = map[string]int{
		"a": 1,
	}
)
type Pair[T any] struct { a, b T }
type (
	Visitor interface { Visit(n int) error }
	Count int
)
func (p *Pair[T]) Each(f func(x T) error, done func()) error { return f(p.a) }
func Map[T any](f func(T) T) { s := `func ghost() {`; fmt.Println(s) }
""",
        "Go",
    )
    assert symbols == {
        ("First", "const", None), ("Second", "const", None), ("table", "var", None), ("Pair", "type", None), ("Visitor", "type", None), ("Count", "type", None), ("Each", "method", None), ("Map", "fn", None),
    }
    assert {("imports", None, '"fmt"'), ("imports", None, '"math"'), ("calls", "Each", "f"), ("calls", "Map", "fmt.Println")} <= relations


def test_typescript_and_javascript():
    source = """import { a } from "./a";
export class Panel extends Widget<Props> implements Shown, Hidden {
  constructor(private x = make(1, two())) { super(x); }
  render(cb: (n: number) => void = () => {}): Map<string, number> { return draw(`a ${"}"} ${`in ${cb(2)}`} function ghost() {`); }
  static async #load(url) { const re = /[/"'{]+/g, n = a / b / c; return fetch(url); }
}
interface Shown extends Root { shown: boolean }
type Id = string; enum Kind { A }
export default async function* go<T>(t: T) { const local = 1; for (const k of t) { new Panel(k); } }
"""
    for language in ("TypeScript", "JavaScript"):
        symbols, relations = read(source, language)
        assert symbols == {
            ("Panel", "class", None), ("constructor", "method", "Panel"), ("render", "method", "Panel"), ("#load", "method", "Panel"), ("re", "var", "#load"), ("Shown", "interface", None), ("Id", "type", None),
            ("Kind", "enum", None), ("go", "fn", None), ("local", "var", "go"),
        }
        assert {("imports", None, '"./a"'), ("inherits", "Panel", "Widget<Props>"), ("implements", "Panel", "Shown"), ("implements", "Panel", "Hidden"), ("inherits", "Shown", "Root")} <= relations
        calls = {(s, t) for r, s, t in relations if r == "calls"}
        assert {("constructor", "make"), ("constructor", "two"), ("render", "draw"), ("#load", "fetch"), ("go", "Panel")} <= calls and not any(t in ("render", "ghost") for _, t in calls)


def test_c_sharp():
    symbols, relations = read(
        '''using System.Text;
namespace App.Core {
    public interface IShape { double Area(Func<int, bool> f); string Name { get; } }
    public sealed class Ring : Shape, IShape {
        private readonly string path = @"c:\\{"; // { fn()
        public Ring(int r) { Init(r); }
        public double Area(Func<int, bool> f) => Compute(f(1));
        public string Name => $"ring {path}";
        public List<Dictionary<string, int>> Parts { get; set; } = new();
        protected override async Task<int> RunAsync(CancellationToken t = default(CancellationToken)) { return await Go(t); }
    }
    enum Kind { A }
}
''',
        "C#",
    )
    assert symbols == {
        ("App.Core", "namespace", None), ("IShape", "interface", "App.Core"), ("Area", "method", "IShape"), ("Name", "property", "IShape"), ("Ring", "class", "App.Core"), ("Area", "method", "Ring"),
        ("Name", "property", "Ring"), ("Parts", "property", "Ring"), ("RunAsync", "method", "Ring"), ("Kind", "enum", "App.Core"),
    }
    assert {("imports", None, "System.Text"), ("inherits", "Ring", "Shape"), ("implements", "Ring", "IShape"), ("calls", "Area", "Compute"), ("calls", "RunAsync", "Go"), ("calls", "Ring", "Init")} <= relations


def test_c_plus_plus():
    symbols, relations = read(
        '''#include <vector>
#include "own.h"
#define TWICE(x) \\
    ((x) + (x))
namespace geo {
struct Base { virtual ~Base() {} };
class Ring final : public Base, private Mixin<int> {
  void visit(std::function<void(int)> f, int n = size(1)) const { f(n); }
};
Ring::Ring(int r) : radius(r), name{"x{"} { start(r); }
typedef unsigned long word;
enum class Kind { A };
const char* raw = R"x(int ghost() { )" )x";
}
''',
        "C++",
    )
    assert symbols == {
        ("TWICE", "macro", None), ("geo", "namespace", None), ("Base", "struct", "geo"), ("~Base", "method", "Base"), ("Ring", "class", "geo"), ("visit", "method", "Ring"), ("Ring", "method", "geo"), ("word", "type", "geo"),
        ("Kind", "enum", "geo"),
    }
    assert {("imports", None, "<vector>"), ("imports", None, '"own.h"'), ("inherits", "Ring", "Base"), ("inherits", "Ring", "Mixin<int>"), ("calls", "visit", "f"), ("calls", "Ring", "start")} <= relations
    assert not any("ghost" in t for _, _, t in relations)


@pytest.mark.parametrize("language", ["Rust", "Python", "Go", "TypeScript", "C#", "C++"])
def test_odd_sources(language):
    for source in ("", "\n", '"', "'", "`", "/*", "((((", "}}}}", "fn a( { { struct", "class", "func (", "\ufeffdef é(): pass", "/" * 50, "r#" * 50, "`${" * 50, "é" * 3000 + "("):
        read(source, language)


@pytest.mark.parametrize("path, unit", [("a.rs", "/// Says é {k}\nfn f{k}(x: u8) -> u8 {{ g{k}(x) }}\n"), ("a.py", "def f{k}(x):\n    return g{k}(x)\n"), ("a.ts", "class C{k} {{ m{k}(x = y()) {{ return g{k}(x); }} }}\n"), ("a.rs", "fn f{k}( {{\n")])
def test_time_grows_with_the_file(path, unit):
    took = []
    for n in (1500, 6000):
        source = "".join(unit.format(k=k) for k in range(n))
        start = time.process_time()
        s = code._Source(source, code.language_of(path))
        code._symbol_rows(path, s)
        code._relation_rows(path, s)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 6


def test_rows_have_places_in_lines_and_bytes(spark):
    source = "// é\nfn one() {\n    two();\n}\n\n/// Docs é\n///\n/// more\npub fn two() {}\n"
    df = spark.createDataFrame([("a.rs", source), ("b.txt", source), ("c.py", None)], "path string, source string")
    rows = {r.name: r for r in code.symbols(df).collect()}
    raw = source.encode()
    for name, r in rows.items():
        assert raw[r.start_byte : r.end_byte].decode().lstrip("pub ").startswith(f"fn {name}")
    assert (rows["one"].start_line, rows["one"].end_line) == (2, 4) and rows["two"].doc == "Docs é\n\nmore" and rows["two"].exported
    (call,) = [r for r in code.relations(df).collect() if r.relation == "calls"]
    assert (call.source_symbol, call.target, call.line) == ("one", "two", 3) and raw[call.byte :].startswith(b"two(")


def test_long_blanks_are_cut_and_change_nothing(monkeypatch):
    """Forms run over code whose comments are cut short; places, names and targets are those of the whole."""
    pad = "// " + "word " * 400 + "\n"
    text = pad * 30 + "class" + " " * 40 + "A" + " " * 30 + "extends\n" + pad * 3 + "Base<X," + " " * 20 + "Y> {\n  go(a) {" + " " * 50 + "return run(a); }\n}\n" + " " * 30 + "import x from 'm'\n"
    python = "def f():\n" + " " * 24 + "import os\n" + "# word\n" * 40 + " " * 24 + "@dec\n\n" + " " * 24 + "class B( X ," + " " * 20 + "Y): pass\n"
    cases = [("TypeScript", text), ("Python", python), ("C++", "enum" + " " * 20 + "class E { a };\n" + pad + "#define X 1 \\\n" + " " * 30 + "2\n")]

    def read():
        made = [code._Source(source, language) for language, source in cases]
        return [(code._symbol_rows("p", s), code._relation_rows("p", s)) for s in made]

    cut = read()
    squeezed = code._Squeezed(code._Source(text, "TypeScript").flat)
    assert len(squeezed.code) * 50 < len(text) and squeezed.at(len(squeezed.code)) == len(text)
    monkeypatch.setattr(code, "_LONG_BLANK", code.re.compile(r"(?!)"))
    assert cut == read() and len(cut[0][0]) == 2 and len(cut[0][1]) == 3 and len(cut[1][1]) == 3
