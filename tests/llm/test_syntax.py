import ast

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import docpairs as D
from lodestone.llm import sourcecode, syntax
from lodestone.llm.derivatives import Grammar


def test_derivatives_accept_exactly_the_language():
    g = Grammar("Start = '(' Start ')' Start | A? ;", "Start")

    def accepts(text):
        x = g.start
        for c in text:
            x = g.derive(x, {"a": "A"}.get(c, c))
        return x.nullable, x is g.empty

    assert accepts("(a)") == (True, False) and accepts("((") == (False, False) and accepts(")") == (False, True)


PY_OK = [
    "", "x = 1\n", "def f(a, /, b: int = 1, *, c, **d) -> int: return a\n", "if x:\n\ty = 1\nelse:\n\ty = 2", "async def f():\n    async with a as b, c: pass\n    return [x async for x in y]\n",
    "match a:\n    case [1, *_] | {'k': v, **r} if v: pass\n    case C(x=1): pass\n", "print(*a, **b, c=1)\n", "x: int\nx = y = (yield)\n" if False else "x: int\n", "class A[T](B, metaclass=M):\n    '''d'''\n",
    "@a.b(1)\ndef f(): pass\n", "lambda *a, b=1: (a, b)\n", "x = a if b else c\ndel a[1:2, ::3], b\n", "try:\n  pass\nexcept* E as e:\n  pass\nfinally:\n  pass\n", "type X[T] = list[T]\n", "f'{a!r:>{w}}' 'b'\n", "a = {**b, 'c': 1}\n", "# only\n",
]
PY_BAD = ["def f(:\n pass\n", "x = (1,\n", "if x\n    y\n", "  x = 1\n", "a = 'open\n", "<<<<<<< HEAD\n", "exec 'x'\n", "raise E, 'x'\n", "def f(a=1, b): pass\n", "f(a=1, b)\n" if False else "f(a b)\n", "x = {'a': 1, 'b' 2}\n", "if a:\nb\n", "a..b\n", "0777\n", "try:\n  x\n", "if True:\n    a\n   b\n"]


def test_python():
    for text in PY_OK:
        ast.parse(text)
        assert syntax.check("a.py", text) is None, text
    for text in PY_BAD:
        assert syntax.check("a.py", text) is not None, text
    assert syntax.check("a.py", "x = (1,\n")[0] == "truncated"
    assert syntax.check("a.py", "x = 1\ny = 2 3\n") == ("rejected", 2, "3")


JS_OK = {
    "js": ["", "export default async (a, {b, ...c} = {}, [d]) => a ?? b?.c?.[0]\n", "const r = /[/]\\/(x)/g.test(s) / 2\n", "let s = `a${`b${c}`}d`\n", "for (const [k, v] of m) { if (k) continue; else break }\n", "class A extends B { static #x = 1; get y() { return this.#x } async *z() { yield* a } static { } }\n",
           "a = b\n++c\nreturn_ = 1\n", "import x, {y as z} from 'm'; export * from 'n'\n", "switch (a) { case 1: default: b() }\n", "x = {a, b: 1, [c]: 2, async d() {}, get e() { return 1 }, ...f}\n", "label: while (1) { break label }\n", "do x(); while (y)\n", "var a = 1, b\nthrow new Error(`x ${a}`)\n"],
    "ts": ["interface A<T> extends B { a?: T[]; readonly b: string, c(x: number): void; [k: string]: unknown }\n", "type X = { [K in keyof T]?: T[K] } | 'a' | (() => void);\n", "function f<T extends A = B>(this: X, a?: number, ...r: string[]): a is string { return <any>a as unknown as string }\n",
           "abstract class C<T> implements D { private readonly a!: Map<string, Array<{id: string}>>; constructor(public x: number) { super() } protected abstract g(): void }\n", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\n", "const a = <T,>(x: T): T => x; let b = c!.d!\n", "import type { A } from 'b'; export type { C } from 'd';\n", "let f: (a: number, b?: string) => Promise<void> = async () => {};\n", "x = a < b && c > d;\n"],
    "jsx": ["const a = <div className='x' {...p} on={() => 1}>a {b} it's <b/> <></> &amp; <C.D x:y=\"1\">t</C.D></div>;\n", "f(<p>one</p>)\n"],
    "tsx": ["export const V = ({a}: P): JSX.Element => { return (<ul>{a.map((x: number) => <li key={x}>{x}</li>)}</ul>); };\n", "const g = <T,>(x: T) => x;\n"],
}
JS_BAD = {
    "js": ["const a = ;\n", "function f( {\n", "let x: number = 1\n", "interface A { }\n", "const a = <div/>;\n", "a = [1, 2\n", "if (a { }\n", "x = {a: 1, b 2}\n", "{ a: 1, b: 2 }\n", "a b\n", "'open\n", "/* open\n", "<<<<<<< HEAD\n", "@@ -1 +1 @@\n"],
    "ts": ["const a = <div>x</div>;\n", "interface A { a: }\n", "function f(a: ) {}\n", "import os\nimport sys from\n"],
    "jsx": ["const a = <div></p>;\n", "const a = <div>;\n", "const a: number = 1\n"],
    "tsx": ["const a = <div><b></div></b>;\n", "const a: = 1\n"],
}


def test_javascript():
    for kind, texts in JS_OK.items():
        for text in texts:
            assert syntax.check(f"a.{kind}", text) is None, (kind, text, syntax.check(f"a.{kind}", text))
            assert syntax._walk(syntax.grammar(kind), kind in ("jsx", "tsx"), text) is None, (kind, text)
    for kind, texts in JS_BAD.items():
        for text in texts:
            assert syntax.check(f"a.{kind}", text) is not None, (kind, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_never_raises(text):
    for kind in ("py", "js", "jsx", "ts", "tsx"):
        syntax.check(f"a.{kind}", text)
        D.pairs(f"a.{kind}", text)


def test_pairs():
    py = 'def load_it(a):\n    """Reads the whole table from disk."""\n\nclass A:\n    async def b(self):\n        \'\'\'B does.\n\n        :param x: many words that do not count here\n        \'\'\'\n        def c():\n            "Counts every row of the inner table."\ns = \'\'\'\ndef d():\n    """Never counted because of the string."""\n\'\'\'\n'
    assert [(n, line) for n, line, *_ in D.pairs("a.py", py)] == [("load_it", 1), ("c", 10)]
    ts = "/** Reads the whole table from disk. */\n@Memo()\nexport async function loadIt<T>(a: Map<string, T>): Promise<{a: T}> { return '/** no */ function x() {}' }\n/** Sorts all rows by their key. */\n// between\nfunction none() {}\nclass K {\n  /**\n   * Counts every row of the table.\n   * @param a nothing\n   */\n  static async count(a) { return 1 }\n}\n/** 校验输入参数并写入队列。 */\nexport const put = (a: number): void => { a };\n"
    got = D.pairs("a.ts", ts)
    assert [(n, line) for n, line, *_ in got] == [("loadIt", 3), ("count", 12), ("put", 15)]
    assert got[0][5].endswith("x() {}' }")
    assert D.pairs("a.ts", None) == [] and D.pairs("a.sql", "x") == []
    assert not D.telling("Loads it.", "load_it") and D.telling("one two three four", "load_it")


def test_operators(spark):
    rows = [("a/x.py", "r", "def f(:\n"), ("a/x.py", "r", "def f(:\n"), ("a/y.py", "r", None), (None, "r", "x"), ("a/z.js", None, "let a = 1"), ("a/q.txt", "r", "((")]
    f = spark.createDataFrame(rows, "path string, repo string, content string").selectExpr("*", "1 AS kind", "2 AS keep_0")
    assert [r["path"] for r in sourcecode.syntax_errors(f).select("path").distinct().collect()] == ["a/x.py"]
    assert sourcecode.syntax_errors(f.limit(0)).count() == 0 and sourcecode.documented_functions(f.limit(0)).count() == 0
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"]) for r in sourcecode.syntax_rates(f.where("path IS NOT NULL")).collect()}
    assert rates[("r", "python")] == (2, 1)


def test_templates_with_nested_braces_hide_no_documentation():
    doc = "/** Reads the whole table from disk. */ "
    for hole in ("f({a:1})", "x.map(y => { return `<${y}>` })", "`a${`b${c}`}`", "f('}', \"`\")", "/[`}]/.test(x)", "a /* ` } */"):
        text = f"const a=`x ${{{hole}}} y`; {doc}function g(){{ return `p${{{hole}}}q` }} const b=`z`\n{doc}function h(){{}}\n"
        assert syntax.check("a.ts", text) is None, text
        got = D.pairs("a.ts", text)
        assert [(n, line) for n, line, *_ in got] == [("g", 1), ("h", 2)], text
        assert got[0][5].endswith("q` }")
    assert D.pairs("a.ts", f"const a=`${{f({{}})}} {doc}function g(){{}}`\n") == []


def test_pairs_and_errors_share_one_verdict(spark):
    doc = '    """Reads the whole table from disk."""\n'
    texts = {"a.py": f'def f(d):\n{doc}    return f"{{d["k"]}}"\n', "b.py": f"def f(d):\n{doc}    f() = 1 2\n", "c.py": f"def f(d):\n{doc}    return d\n"}
    f = spark.createDataFrame(list(texts.items()), "path string, content string")
    assert {r["path"] for r in sourcecode.syntax_errors(f).collect()} == {"b.py"}
    assert {r["path"] for r in sourcecode.documented_functions(f).collect()} == {"a.py", "c.py"}


def test_fields_of_python_strings():
    good = ['f"{d["k"]}"', 'f"{a!r:>{w}}"', 'f"{x:{y:{z}}}"', 'f"{{}}{a=}"', "rf'\\{a}{{2}}'", 'f"{f"{f"{1}"}"}"', "f'''{\na}'''", 'f"{a:=5}"', 'f"{\'}\'}"', 'f"\\N{BULLET}{a}"']
    bad = ['f"{a b}"', 'f"{"', 'f"}"', 'f"{}"', 'f"{a!x}"', 'f"{lambda x:1}"', 'f"{a:{b c}}"', 'f"{a["b" c]}"', 't"{a}"', 'f"{a;b}"', "f'''{a\nb}'''", 'f"{a=b}"']
    for text in good:
        assert syntax.check("a.py", f"x = {text}\n") is None and ast.parse(f"x = {text}\n"), text
    for text in bad:
        assert syntax.check("a.py", f"x = {text}\n") is not None, text
    assert syntax.check("a.py", 'a = 1\nx = f"{a b}"\n') == ("rejected", 2, 'f"{a b}"')
    assert syntax.check("a.py", "x = " + 'f"{' * 400 + "1" + '}"' * 400) is not None
    for text in ('x = "\\x4"\n', "x = b'é'\n", "x = '\\N{no such sign}'\n", "f() = 1\n"):
        assert syntax.verdict("a.py", text)[:2] == ("rejected", 1), text
    assert syntax.verdict("a.py", '\ufeffx = f"{d["k"]}"\n') is None


def test_names_and_gaps_in_markup():
    for text in ("<À", "const a = <Àb />;", f"const a = <b{' ' * 500}/>;", f"const f = <{' ' * 500}T,>(x) => x;"):
        syntax.check("a.tsx", text)
    assert syntax.check("a.tsx", f"const a = <b{' ' * 500}/{' ' * 100}>;\n") is None
    assert syntax.check("a.tsx", f"const f = <{' ' * 500}T,>(x: T) => x;\n") is None
    assert syntax.check("a.jsx", "const a = <àb ô='1'>x</àb>;\n") is None


def test_the_symbol_table_changes_no_verdict():
    """What only it refuses (repeated parameters, names declared too late) is left to the parser."""
    for text in ("def f(a, a): pass\n", "def f():\n    x = 1\n    global x\n", "nonlocal x\n", "x = 1\n"):
        assert syntax.verdict("a.py", text) is None, text
    for text in ("f() = 1\n", "x = (\n", "x = '\\x4'\n"):
        assert syntax.verdict("a.py", text) is not None, text
