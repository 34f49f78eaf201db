import ast
import json
import random
import tomllib
import warnings

import pytest
from codequarry.llm.derivatives import Grammar
from codequarry.llm.syntax import error_rates, first_error, syntax_errors

VALID = {
    "json": ['{"a": [1, -2.5e3, null, true, "\\u00e9"]}', "[]", '"x"'],
    "toml": ['a = 1\n[b."c d"]\nx = [1,\n 2,]\ny = {z = 1.5, w = "s"}\n[[t]]\nd = 1979-05-27T07:32:00Z\n', "", "# only\n"],
    "python": [
        'match = {"a": 1, **b}\nmatch x:\n    case [1, *r] if r: pass\n    case {"k": v} | None: y = f"{x!r:>{w}} {d["k"]}"\n', "async def f(a, /, b: int = 1, *c, **d) -> x:\n\tasync with a as b, c: return [i async for i in d if (y := i)]\n",
        "x: int = 1; y = lambda *a, k=2: (yield)\nprint(*a, sep='')\n@d.e(1)\nclass C[T](B, m=1):\n    '''doc'''\n", "try: pass\nexcept* (A, B) as e: raise X from e\nelse: pass\nfinally: del a[1:2], b.c\n",
    ],
    "go": ['package a\nimport (\n"fmt"\nx "os"\n)\nfunc (p *T[K]) f(a, b int, c ...string) (x error) {\nfor i, v := range m { if x := g(v); x != nil { continue } }\nswitch t := v.(type) {\ncase int, []string:\n return\n}\ngo func() { ch <- T{A: 1, B: []int{1, 2}} }()\nreturn nil\n}\ntype I interface { ~int | string; M(x int) }\n'],
    "java": ['package a.b;\nimport static x.Y.*;\n@A(v = 1) public sealed class C<T extends D & E> extends F permits G {\n int[] a = {1, 2}, b[];\n record P(int x, String... y) { P { } }\n enum K { A(1) { void f() {} }, B; }\n <U> void m(final Map<String, List<? super U>> z) throws X {\n for (var e : z.entrySet()) { if (e instanceof Foo f && f.x() > 2 >> 1) continue; }\n Runnable r = () -> { int q = switch (k) { case A, B -> 1; default -> { yield 2; } }; };\n try (var s = o()) { } catch (A | B ex) { throw (RuntimeException) ex; } finally { }\n String t = """\n x""" + (char) 1; f(String[]::new, this::g);\n }\n}\n'],
    "javascript": [
        "import a, { b as c } from './d'\nexport default async function* f({ x = 1, ...r }, [y] = []) { for await (const z of w) yield* z }\nlet re = /[/]\\/(?<n>x)/g, t = `a${b ? `c${d}` : 1}e`\n", "const f = async (a, b = 2) => ({ a, get b() { return 1 }, [c]: d?.e?.[0] ?? 1 })\nlabel: while (1) { if (a) break label; else continue }\nx\n++y\n",
        "class A extends (B) { static #p = 1; static { this.x = 2 } get y() { return this.#p } async *z() {} }\nvar i = a / b / c, o = { if: 1 }\ndo x++; while (x < 5) y = 1\n",
    ],
    "typescript": ["export interface A<T = any> extends B { readonly x?: number | null; [k: string]: unknown; m<U>(a: U): a is string }\ntype M = { [K in keyof T]?: T[K] extends (infer R)[] ? R : never }\nabstract class C<T> implements D { private constructor(public a: string, readonly b?: T) { super() } declare x: number; foo?(): void }\nconst m = new Map<string, Array<Array<number>>>(), n = (x as any)!.y satisfies Z\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nfunction f(this: W, a?: T): asserts a is U;\nconst g = <T,>(a: T): T => a\n"],
}
BROKEN = {
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": 01}", '{"a": NaN}', "[1] 2", '"\t"', "{"],
    "toml": ["a = ", "a: 1", "a = [1", "[a\n", "a = 1 b = 2", "a = 'x"],
    "python": ["def f(:\n", "print 'x'\n", "if x:\ny = 1\n", "x = (1,\n", "a b\n", "class = 1\n", "  x = 1\n", "'abc\n", "if x:\n\ty\n        z\n", "f() = 1\n", "raise A, b\n", "x = 0777\n", "f'{a'\n"],
    "go": ["package", "package a\nfunc f() {", "package a\nfunc f() { x := }\n", "package a\nvar x int = 'ab'\n", "package a\n}\n"],
    "java": ["class A {", "class A { int x = ; }", "class A { void f() { return 1 } }", "class A { } }", "public class", "class A { String s = \"x; }"],
    "javascript": ["function f( {", "let x = ;", "if (a { }", "const {{ a }} = b", "a b", "x = 'y\n'", "<<<<<<< HEAD\n", "`a${b", "{ \"a\": 1, \"b\": 2 }", "return (x\n"],
    "typescript": ["interface A { x: }", "const x: = 1", "type = 1 +", "let a: Map<string, = b", "class A { private }{"],
}
CASES = lambda d: [(k, t) for k, ts in d.items() for t in ts]


@pytest.mark.parametrize("language, text", CASES(VALID))
def test_valid(language, text):
    assert first_error(text, language) is None
    if language != "toml":
        assert first_error(text.replace("\n", "\r\n"), language) is None


@pytest.mark.parametrize("language, text", CASES(BROKEN))
def test_broken(language, text):
    assert first_error(text, language) is not None


def test_failing_token_and_truncation():
    assert first_error('{"a": 1 2}', "json") == (8, "token") and first_error('{"a": [1', "json") == (8, "end")


@pytest.mark.parametrize("language, parse", [("python", ast.parse), ("json", json.loads), ("toml", tomllib.loads)])
def test_mutations_agree_with_the_standard_library(language, parse):
    warnings.simplefilter("ignore")
    r, wrong, n = random.Random(4), [], 0
    for text in VALID[language] * 60:
        if not text:
            continue
        i = r.randrange(len(text))
        text = r.choice([text[:i], text[:i] + text[i + 1 :], text[:i] + r.choice("()[]{}:,='\"\n #x1") + text[i:]])
        try:
            parse(text)
            good = True
        except Exception:  # noqa: BLE001
            good = False
        n += 1
        if good != (first_error(text, language) is None):
            wrong.append(text)
    assert len(wrong) <= 0.04 * n, wrong[:3]


def test_derivatives_are_remembered_and_bounded():
    g = Grammar("s: {'(' s ')'}\n")
    assert g.parse(list("(()())")) == -1 and g.parse(list("(()")) == 3 and g.parse(list("())")) == 2
    n = len(g.states)
    g.parse(list("(()())" * 50))
    assert len(g.states) == n


def test_forgetting_within_a_text_changes_nothing(monkeypatch):
    monkeypatch.setattr("codequarry.llm.derivatives.MOST_STATES", 7)
    g = Grammar("s: {'(' s ')' | 'x'}\n")
    text = "(" * 40 + "x" + ")" * 40
    assert g.parse(list(text)) == -1 and g.parse(list(text[:-1])) == len(text) - 1 and g.parse(list(text + ")")) == len(text)


@pytest.mark.parametrize("language, opened, inner, closed", [("python", "x = ", "f([", "])"), ("json", "", "[", "]"), ("go", "package a\nvar x = ", "(", ")"), ("typescript", "x = ", "f(", ")")])
def test_deep_nesting(language, opened, inner, closed):
    n = 20_000
    one = "1"
    assert first_error(f"{opened}{inner * n}{one}{closed * n}\n", language) is None
    assert first_error(f"{opened}{inner * n}{one}{closed * (n - 1)}\n", language)[1] == ("token" if language == "go" else "end")


SCHEMA = "file_id long, repository_id string, extension string, language string, content string, at int"


def test_tables(spark):
    rows = [(1, "r", ".PY", None, "x = (", 1), (2, "r", ".py", "python", "x = 1", 1), (3, "r", ".json", "json", None, 1), (4, "q", ".txt", None, "(", 1), (5, "q", ".x", " JSON ", "", 1), (6, "q", ".js", "shell", "(", 1)]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    assert {tuple(x) for x in syntax_errors(df).collect()} == {(1, "python", 5, "end"), (5, "json", 0, "end")}
    assert {tuple(x) for x in error_rates(df).collect()} == {("r", "python", 2, 1, 0.5), ("q", "json", 1, 1, 1.0)}
    assert syntax_errors(spark.createDataFrame([], SCHEMA)).count() == 0


UNSEEN = {
    "python": ['f"{a b}"', 'f"{a +}"', 'f"{ }"', '"\\x1"', "b'\\xg1'", 'f"\\x1{a}"', "def f(a=1, b): pass", "f(a=1, b)", "lambda a=1, b: a", "f(**a, *b)", "f(x for x in y, 1)", "def f(*): pass", 'f"{a!x}"', 'f"{a:{b c}}"', 'f"a}"', "def f(**k, a): pass"],
    "toml": ["a = 1\na = 2\n", "[a]\n[a]\n", "a = {b = 1, b = 2}\n", "a = 1\na.b = 2\n"], "javascript": ["x = '\\x1'", "x = '\\u12'", "x = '\\07'"], "java": ['class A { String s = "\\q"; }'], "go": ['package a\nvar x = "\\q"\n'],
}
STILL = {
    "python": [
        "f'{a!r:>{w}.{p}} {{b}} {x=} {d[\"k\"]:%Y} {y = !s} {(lambda: 1)()} {a!=b}'", "f'''{\n a  # note\n}\n'''", "rf'\\d{a}\\{b}' f\"\\N{BULLET}{f'{c}'}\"", "'\\\\x' r'\\x' '\\x41\\u00e9'", "b'\\N'", "f(a, *b, c=1, *d, **e, g=2)", "f(x for x in y)", "f'{*a, b}'",
        "def f(a, b=1, /, c=2, *d, e, f=3, **g): pass", "def f(a, /, b, *, c, d=1,): pass", "def f(*, a): pass", "lambda a, b=1, *c, d, **e: a", "f(**a, b=1, **c)", "def f(**k,): pass", "x = a / b // c\n", 'x = f"{a:=5}" ""', "f'{a\n}'",
    ],
    "toml": ["[a]\nb = 1\n[c]\nb = 1\n[[d]]\nx = 1\n[[d]]\nx = 1\n"], "javascript": ["x = '\\x41\\u{1F600}\\0\\d'"], "java": ['class A { String s = "\\t\\u00e9\\07"; }'], "go": ['package a\nvar x = "\\t\\x41\\u00e9\\101"\n'],
}


@pytest.mark.parametrize("language, text", CASES(UNSEEN))
def test_errors_inside_tokens_and_of_order(language, text):
    assert first_error(text, language) is not None


@pytest.mark.parametrize("language, text", CASES(STILL))
def test_their_valid_neighbours(language, text):
    assert first_error(text, language) is None
    if language == "python":
        ast.parse(text)


ACCEPTED = {
    "python": [
        'x = [\n1,\n2]\n', 'f"{\n a}"\n', 'f"{x!r:>{w}}"\n', 'try:\n  pass\nexcept E:\n  pass\nexcept:\n  pass\n', 'f(a, b=1, *c, **d)\n',
        'def f(a, b=1, *, c, **k): pass\n', "b'abc'\n", 'async def f():\n  async with a as b:\n    await c\n', 'def f():\n  return\n',
        'class A:\n  def f(self):\n    return 1\n', 'while x:\n  break\nelse:\n  pass\n', 'for i in x:\n  if i:\n    continue\n', '(a for a in b)\n',
        "print(*a, sep='')\n", 'x: int = 3\n', 'lambda *a, **k: 1\n', 'def f(a, /, b): pass\n',
        "match x:\n  case [1, *r]:\n    pass\n  case {'a': b, **c} if b:\n    pass\n", 'f(x for x in y)\n', 'a = b = c\n', 'del a[0], b.c\n',
        'with (open(a) as b, c as d):\n  pass\n',
    ],
    "toml": [
        '3.14 = "pi"\n', 'inf = 1\n', 'nan = 2\n', '1979-05-27 = 1\n', 'a.1.b = 2\n', '[a.3.b]\n', 'true = 1\n', 'x = [1, 2,\n 3]\n', '1=2\n',
        '-1 = 2\n', '1e5 = 3\n', 'a = inf\nb = -nan\n',
    ],
    "javascript": [
        'if (x) /re"/.test(y)\n', 'var \\u0061b = 1\n', 'while (x) /a"b/.exec(y)\n', '(a) / b / c\n', 'const a = {}\nconst b = 1\n',
        'function f(){ return 1 }\n', 'for (const x of y) { break }\n', 'x = a ?? b\n', '(a ?? b) || c\n', '(-1) ** 2\n', '-(1 ** 2)\n',
        'const {a} = b\n', 'for (const k in o) {}\n', 'for (const x of y) {}\n', '[a, b] = [b, a]\n', '({a, b} = c)\n', 'a.b = c[d] = 1\n',
        'outer: for (;;) { continue outer }\n', 'switch (x) { case 1: break; default: }\n', 'const f = () => { return 1 }\n',
        'class A { m() { return 1 } get x() { return 2 } static { } f = 1; }\n', 'import a, {b as c} from "x"\nexport default a\n',
        'const f = async x => await x\n', 'x++\n', '--x.y\n', 'let a; let b = 1\n', 'if (a) b; else c\n', 'a ? b : c\n', '`a${b}c`\n',
        'function* g() { yield 1; yield* h() }\n', 'for await (const x of y) ;\n', 'x = y\n/a/g.exec(z)\n', 'do x(); while (y) z()\n',
        'export function f() {} export class B {}\n', 'if (a) { b } else { c } d\n', 'delete a.b, void 0, typeof x\n', 'a?.b?.[c]?.(d)\n',
        'new A.B(c).d\n', 'x = function () {} \n', 'a = b ? (c, d) : e => f\n', 'for (let i = 0, n = 2; i < n; i++) continue\n', 'for (x.y of z) ;\n',
        'label: { break label }\n', 'try { } catch { } finally { }\n', 'throw new E("x")\n', 'const [a,,b=1,...c] = d\n', 'x **= 2\n', 'a => ({})\n',
        '(function () { return })()\n', 'var a = class { }\n',
    ],
    "typescript": [
        'let x = <T>(y)\n', 'let x = <any>y\n', 'declare const x: number;\n', 'const f = <T,>(x: T) => x\n',
        'interface A { a: string; b?: number }\n', 'abstract class A { abstract f(): void; }\n',
        'function f(a: string): void;\nfunction f(a: any) {}\n', 'let x = y as unknown as Z\n', 'x!.y = 1\n', 'enum A { B = 1, C }\n',
        'declare module "x" { const a: number; }\n', 'export const a = {} as const\n', 'let a!: string\n', 'type A = { [k in B]?: C }\n',
        'let f: (a: number) => void = () => {}\n', 'function f(this: A, b?: c) {}\n', '(x as any) = 1\n', 'const x: A<B<C>> = y\n',
        'declare function f(): void\n',
    ],
    "java": [
        'class A { void f() { a(); i++; --j; x = 1; new A(); a.b().c(); } }',
        'class A { int x = 09.5f > 1 ? 2 : 3; int y = 017, z = 0, w = 0_7; double d = 09e1; }',
        'class A { void f() { int a = b; a += 1; String s = "x"; for (int i = 0, j; i < 1; i++, j--) { } } }',
        'class A { int[] a = new int[3]; int[] b = {1,2}; void f() { a[0] = 1; this.x = 2; super.f(); } }',
        'class A { Runnable r = () -> { }; Function<A,B> g = x -> x; void f() { r.run(); A.super.f(); } }',
        'class A { int f(int x) { return switch (x) { case 1 -> 2; default -> { yield 3; } }; } }', 'record P(int x, int y) { }',
        'class A { void f() { if (x instanceof String s) g(s); List<String> l = new ArrayList<>(); l.add(1); (a).f(); ((A) b).f(); } }',
        'class A { void f() { a.b = c; a[1]++; ++a.b; synchronized (this) { } label: for (;;) { break label; } } }',
        'class A { void f() { int x = a < b ? 1 : 2; var y = (int) z; A<B> c; A.B<C>[] d = null; } }',
    ],
    "go": [
        'package a\nfunc f(a, b int, c string) (int, error) { return 1, nil }\n', 'package a\nfunc f(int, string) {}\n',
        'package a\nfunc f(a int, b ...string) {}\n', 'package a\ntype F func(int, string) error\n',
        'package a\nfunc (r *R) f() { x := []int{1}; for i := range x { _ = i } }\n', 'package a\nvar m = map[string]func(a int) int{}\n',
        'package a\nfunc f(a, b, c int, d, e *T, f []byte) {}\n', 'package a\nfunc f(a, b pkg.T) (x, y int) { return }\n',
        'package a\nfunc f(pkg.T, *T, []int, ...int) {}\n', 'package a\nfunc f[T any](a T, b func(x, y int) int) T { return a }\n',
    ],
    "json": [
        '[1]', '{"a":{"b":[true,null]}}',
    ],
}
REFUSED = {
    "python": [
        'f(a=1, 2)\n', 'def f(a=1, b): pass\n', 'def f(*): pass\n', 'try:\n  pass\nexcept:\n  pass\nexcept E:\n  pass\n', '"\\xZ"\n', "b'é'\n",
        "f'{a b}'\n", 'return 1\n', 'break\n', 'def f():\n  continue\n', 'f() = 1\n', '1 = x\n', 'x + 1 = 2\n', "'a' b'c'\n", 'f(**a, *b)\n',
        'class A:\n  return 1\n', 'for x in y:\n  def f():\n    break\n', 'x = yield = 1\n', 'None = 1\n', 'def f(None): pass\n',
        'a.b: int = c = 2\n', '(a, b): int = 1\n', 'del f()\n', 'with a as f(): pass\n', 'for f() in x: pass\n', 'import a.b as c.d\n',
        'from x import *, a\n', '(a + b) += 1\n', 'try:\n  pass\nfinally:\n  pass\nexcept E:\n  pass\n',
        'try: pass\nexcept A: pass\nexcept* B: pass\n', 'x = 5 if y\n', 'class A(b=1, c): pass\n', '[x for x in *y]\n', '{**a for a in b}\n',
        '{1: 2, 3}\n',
    ],
    "toml": [
        'a = 1\na = 2\n', '[a]\n[a]\n', 'd = 2020-13-01\n', 'a = 01\n', 'a = 1.\n', 'a. = 1\n', '= 1\n', 'a = 1 b = 2\n', '[a\n', "a = 'x\n",
        '3.14\n',
    ],
    "javascript": [
        '1 = 2\n', 'f() = 1\n', 'const x;\n', 'return 1\n', 'break\n', 'a ?? b || c\n', '-1 ** 2\n', 'const a = {} const b = 1\n', 'continue\n',
        'while (1) { function f() { break } }\n', 'a && b ?? c\n', 'this = 1\n', 'x++ ++\n', '++f()\n', 'for (const x = 1 of y) ;\n',
        'import a from b\n', 'export { a b }\n', 'a => {} ()\n', 'if (a) const b = 1\n', 'function f( { }\n', '({a: 1, a b})\n', 'let let = 1\n',
        'yield = 1\n', '`a${b`\n', 'await = 1\n', 'var class\n', 'with (a) { b }\n', '010\n', "'\\08'\n", 'break foo\n', '({a=1})\n', 'let [a]\n',
        'function* g() { yield\n* 2 }\n', 'throw\nx\n', 'if (1) function* g() {}\n', "import {default} from 'x'\n", 'export default const a = 1\n',
        'for (let x, y of z) ;\n', 'try { }\n', 'switch (a) { case 1: default: default: }\n',
    ],
    "typescript": [
        'const x;\n', 'let x: = 1\n', '1 = 2\n', 'return 1\n', 'interface A { a: }\n', 'const a = {} const b = 1\n', 'break\n', 'f() = 2\n',
        'enum A { B C }\n', 'type A = \n', 'class A { x: }\n', 'function f(a?: number, b) {', 'let x = y as\n',
    ],
    "java": [
        'class A { void f() { a + b; } }', 'class A { int x = 09; }', 'class A { void f() { 1; } }', 'class A { void f() { x; } }',
        'class A { void f() { f() = 1; } }', 'class A { void f() { break; } }', 'class A { void f() { int x = 1 } }',
        'class A { void f() { continue; } }', 'class A { void f() { a.b; } }', 'class A { int x = 1__; }', 'class A { void f() { (a); } }',
        'class A { void f() { "x"; } }', 'class A { void f() { a == b; } }', 'class A { void f() { 1++; } }', 'class A { void f() { -x; } }',
        "class A { char c = 'ab'; }", 'class A { void f() { else { } } }', 'class A { void f() { case 1: } }',
        'class A { void f() { if (x) int y = 1; } }', 'class A { int f() { } int }', 'class A { void f() { for (int i : a; ) {} } }',
    ],
    "go": [
        'package a\nfunc f(a int, string) {}\n', 'package a\nfunc f() { a + b }\n', 'package a\nfunc f() { x }\n', 'package a\nfunc f() { 1 }\n',
        'package a\nfunc f(a, b int, c) {}\n', 'package a\nfunc f(a ...int, b int) {}\n', 'package a\nfunc f() { if x { } \n else { } }\n',
        'package a\nvar x int = \n', 'package a\nimport fmt\n', 'package a\nfunc f() { x := 1 y := 2 }\n', 'package a\nfunc f() { break x y }\n',
        'package a\nvar x = 09\n', 'package a\nfunc f() { 1 := 2 }\n', 'package a\nfunc f() { a.b := 2 }\n', 'package a\nfunc f() { defer x }\n',
        'package a\nfunc f() { go f }\n', 'package a\nfunc f() { for i := 0; i < 1; i := 2 { } }\n', 'package a\nfunc f() { f()++ \n 1 = }\n',
        'package a\nvar x = 0x\n', 'package a\nvar x = 1_\n',
    ],
    "json": [
        '', '[1,]', "{'a':1}", '[01]', 'nul', '[1] 2',
    ],
}


@pytest.mark.parametrize("language, text", CASES(ACCEPTED))
def test_accepted(language, text):
    assert first_error(text, language) is None


@pytest.mark.parametrize("language, text", CASES(REFUSED))
def test_refused(language, text):
    assert first_error(text, language) is not None
