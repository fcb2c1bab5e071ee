"""Symbols of scripts and of Python files with syntax errors, and chunks by language."""

from hunkloom.operators import chunking, symbols
from hunkloom.operators.scripts import declarations

JS = r'''
import React, { useState } from "react";
import {
  a,
  b
} from './x'
// function no() {}
/* class No {} */
const s = `template ${ f({a: `in ${1} }`}) } function inner() {} {`;
const re = /[/}{]"'`/g, q = a / b / c;
export default async function main(
  first,
  second = {x: 1},
  ...rest
)
{
  function nested() { return "}"; }
  return first
}
const g = async function (x, y) {
  return x;
}
export const h = async (p, {q, r}, z) => {
  return { a: 1 };
}, k = v => v * 2
let m = function named(a) {}
class A extends B {
  #secret() { return 1 }
  static count = 0
  handler = () => { return 1 }
  constructor(a, b) { super(a) }
  get value() { return 1 }
  static async *load(x)
  {
    yield x
  }
  async() { }
  static { init() }
}
function* gen(a) { yield a }
if (x) { function hidden() {} }
foo(function cb() {})
module.exports = { main }
var last = 1
'''
TS = r'''
import type { X } from './x';
export interface Foo<T> extends Bar<{a: 1}> {
  a: string;
  m(): void;
}
type U =
  | 'a'
  | { b: number }
export type V<T> = Map<string, T>;
@Injectable({ x: 1 })
export class Svc<T> implements I {
  constructor(private readonly http: Http, @Inject() x?: Map<string, number>) {}
  private items: string[] = [];
  abstract foo(): void;
  async find<K extends keyof T>(key: K, ...rest: any[]): Promise<{ a: T[K] }> {
    return null!;
  }
  public static of(): Svc<any> { return new Svc(); }
}
export abstract class Base { abstract run(): void; go(): void {} }
function over(a: string): void;
function over(a: any): { x: number } {
  return { x: 1 };
}
export const fn = <T,>(a: T, b: number = 3): { ok: boolean } => ({ ok: true });
const typed: (a: number) => void = (a) => { };
declare function amb(): void;
enum E { A, B }
namespace N { export function inside() {} }
const broken = (a: {
'''
BROKEN = '''import os

@deco(1)
@other
def f(a, b: int, c=2, d: int = 3, *args, e, **kw: str) -> list[int]:
    """Doc of f.
def not_one():
"""
    return a

def broken(x, y: str, z=")", w: int = 1,
           q=3):
    if x = 1:
        return

class E(Base):
    def ok(self): return 1

    @property
    def bad(self, a):
        retrun x y

    async def after(self):
        pass

x = [1,

def last(a):
    return a
'''


def short(found):
    return [(s["name"], s["kind"], s["start_line"], s["end_line"], "|".join(s["parameters"]), s["parent"], s["is_exported"]) for s in found if s["kind"] != "import"]


def test_javascript():
    found, balanced = declarations(JS, False)
    assert balanced and short(found) == [
        ("main", "function", 11, 19, "first|...rest", None, True), ("g", "function", 20, 22, "x|y", None, False), ("h", "function", 23, 25, "p|z", None, True), ("k", "function", 25, 25, "", None, True),
        ("m", "function", 26, 26, "a", None, False), ("A", "class", 27, 39, "", None, False), ("constructor", "method", 31, 31, "a|b", "A", False), ("value", "method", 32, 32, "", "A", False),
        ("load", "method", 33, 36, "x", "A", False), ("async", "method", 37, 37, "", "A", False), ("gen", "function", 40, 40, "a", None, False),
    ]
    assert [(s["start_line"], s["end_line"]) for s in found if s["kind"] == "import"] == [(2, 2), (3, 6)]


def test_typescript():
    found, balanced = declarations(TS, True)
    assert not balanced  # the last line opens brackets that nothing closes
    assert short(found) == [
        ("Foo", "interface", 3, 6, "", None, True), ("U", "type_alias", 7, 9, "", None, False), ("V", "type_alias", 10, 10, "", None, True), ("Svc", "class", 12, 20, "", None, True),
        ("constructor", "method", 13, 13, "private readonly http: Http|@Inject() x?: Map<string, number>", "Svc", False), ("find", "method", 16, 18, "key: K|...rest: any[]", "Svc", False), ("of", "method", 19, 19, "", "Svc", False),
        ("Base", "class", 21, 21, "", None, True), ("go", "method", 21, 21, "", "Base", False), ("over", "function", 23, 25, "a: any", None, False), ("fn", "function", 26, 26, "a: T|b: number = 3", None, True), ("typed", "function", 27, 27, "a", None, False),
    ]


def test_scripts_without_semicolons_and_odd_ones():
    text = "let a = 1\nconst b = () => 2\nlet c\nfunction d() {}\nvar e = function () {\n}\nf()\nconst g = h =>\n  h + 1\n"
    assert [(s[0], s[2], s[3]) for s in short(declarations(text, False)[0])] == [("b", 2, 2), ("d", 4, 4), ("e", 5, 6), ("g", 8, 9)]
    for odd in ("", "`", "/*", "'", "}", "${", "class", "export", "const", "function (", "@", "import", "type", "const a =", "class A {", "class A { x", "a => {", "`${`${`", "\x00\u2028"):
        declarations(odd, False), declarations(odd, True)


def test_python_with_syntax_errors():
    found = symbols.python_symbols(BROKEN)
    assert short(found) == [
        ("f", "function", 5, 9, "a|b: int|c=2|e|**kw: str", None, True), ("broken", "function", 11, 14, 'x|y: str|z=")"|q=3', None, True), ("E", "class", 16, 24, "", None, True), ("ok", "method", 17, 17, "self", "E", True),
        ("bad", "method", 20, 21, "self|a", "E", True), ("after", "method", 23, 24, "self", "E", True), ("last", "function", 28, 29, "a", None, True),
    ]
    assert all(s["error"] == symbols.BROKEN for s in found) and found[1]["decorators"] == ["deco", "other"]
    for odd in ("def", "def (", "class", "@", "\x00", "(", "\"\"\"", "  def f(:\n", "class A(\n  def f(self): pass\n", "\tdef f():\n x"):
        assert all(s["error"] for s in symbols.python_symbols(odd) or [{"error": 1}])


def test_parameters_and_docstrings_as_written():
    found = symbols.python_symbols("def f(self, a, /, b: int, *, c=1, d: int = 2, **k):\n    '''  Some é text.\n    '''\ndef g(*a: int): 'x' 'y'\nclass _A:\n    import b\n")
    assert [s["parameters"] for s in found] == [["self", "a", "b: int", "c=1"], ["*a: int"], [], []]
    assert [s["docstring"] for s in found][0] == "Some é text." and [s["is_exported"] for s in found][:3] == [True, True, False] and found[3]["parent"] == "_A"


def test_chunks_by_language(spark):
    body = "\n".join("    x = 1  # " + "y" * 40 for _ in range(100))
    rows = [("r", "a.py", "python", f"import os\ndef small():\n    pass\ndef large():\n{body}\n"), ("r", "b.py", "python", "def (\n"), ("r", "c.go", "go", "a\nb"), ("r", "d.py", "python", "x = 1\n"), ("r", "e.js", "javascript", " \n"), ("r", "f.ts", "typescript", None), ("r", "g", None, "text")]
    got = chunking.chunk_files(spark.createDataFrame(rows, "repo string, file_path string, language string, content string"))
    found = {(r.file_path, r.symbol_name, r.symbol_kind, r.start_line, r.end_line) for r in got.collect()}
    assert {f for f in found if f[1] != "large"} == {("a.py", "small", "function", 2, 3), ("b.py", None, None, 1, 2), ("c.go", None, None, 1, 2), ("d.py", None, None, 1, 2), ("g", None, None, 1, 1)}
    large = sorted(f[3:] for f in found if f[1] == "large")
    assert large[0][0] == 4 and large[-1][1] == 104 and all(b[0] == a[1] - 4 for a, b in zip(large, large[1:], strict=False))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
