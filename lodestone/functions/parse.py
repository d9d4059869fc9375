"""Parsers as table-valued functions: each takes a file's text and gives rows; none raises."""

from __future__ import annotations

import ast
import bisect
import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARG = "array<struct<name:string,type_annotation:string,default:string>>"
FUNC = f"struct<name:string,docstring:string,args:{ARG},returns:string,anchor:struct<file:string,line:int>,end_line:int,decorators:array<string>>"
MODULE = (
    f"path string, language string, docstring string, imports array<string>, external_imports array<string>, exports array<string>, total_lines int, functions array<{FUNC}>, "
    f"classes array<struct<name:string,docstring:string,bases:array<string>,methods:array<{FUNC}>,anchor:struct<file:string,line:int>,end_line:int,decorators:array<string>>>, "
    "interfaces array<struct<name:string,members:array<struct<name:string,type:string>>,docstring:string,anchor:struct<file:string,line:int>,end_line:int>>, "
    "components array<struct<name:string,props_type:string,hooks:array<string>,anchor:struct<file:string,line:int>,end_line:int>>, error string"
)
#: Modules of the standard library that count as external.
STDLIB = frozenset(
    "os sys re json time datetime collections typing abc io pathlib math random logging unittest itertools functools asyncio subprocess hashlib uuid dataclasses enum copy textwrap argparse traceback "
    "warnings contextlib inspect ast threading multiprocessing queue socket http urllib xml csv sqlite3 pickle shutil tempfile glob fnmatch statistics decimal fractions concurrent importlib pkgutil types".split()
)
#: Hooks looked for in components.
HOOKS = "useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect".split()


def tree_of(text: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _show(node):
    return None if node is None else ast.unparse(node)


def _function(node, path) -> dict:
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    pairs = list(zip(plain, defaults)) + list(zip(a.kwonlyargs, a.kw_defaults))
    return {
        "name": node.name, "docstring": ast.get_docstring(node), "returns": _show(node.returns), "end_line": node.end_lineno,
        "args": [{"name": x.arg, "type_annotation": _show(x.annotation), "default": _show(v)} for x, v in pairs],
        "anchor": {"file": path, "line": node.lineno}, "decorators": [_show(x) for x in node.decorator_list],
    }


_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse_python(path: str, text: str) -> dict:
    """The module record of a Python file; async functions count. On a syntax error only path, language,
    lines and ``error``."""
    out = {"path": path, "language": "python", "total_lines": text.count("\n") + 1 if text else 0}
    try:
        tree = tree_of(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out | {"error": f"[Syntax Error] {e}", "docstring": f"[Syntax Error] {e}"}
    internal, external = set(), set()
    for n in ast.walk(tree):
        names = [x.name for x in n.names] if isinstance(n, ast.Import) else ["." * n.level + (n.module or "")] if isinstance(n, ast.ImportFrom) else []
        for name in names:
            (external if name.split(".")[0] in STDLIB else internal).add(name)
    classes = [
        {
            "name": c.name, "docstring": ast.get_docstring(c), "bases": [_show(b) for b in c.bases], "anchor": {"file": path, "line": c.lineno}, "end_line": c.end_lineno,
            "methods": [_function(m, path) for m in c.body if isinstance(m, _DEF)], "decorators": [_show(x) for x in c.decorator_list],
        }
        for c in tree.body if isinstance(c, ast.ClassDef)
    ]
    return out | {
        "docstring": ast.get_docstring(tree), "imports": sorted(internal), "external_imports": sorted(external), "classes": classes,
        "functions": [_function(f, path) for f in tree.body if isinstance(f, _DEF)],
    }


_IMPORT = re.compile(r"""(?:^|\n)\s*(?:import|export)\b[^'"\n;]*?\bfrom\s*['"]([^'"]+)['"]|(?:^|\n)\s*import\s*['"]([^'"]+)['"]|\b(?:import|require)\(\s*['"]([^'"]+)['"]\s*\)""")
_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)")
_FUNC = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^>(]*>)?\s*\(", re.M)
_ARROW = re.compile(r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:<[^>(]*>)?\(", re.M)
_CLASS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)(?:<[^>{]*>)?(?:\s+extends\s+([\w$.]+))?(?:<[^>{]*>)?(?:\s+implements\s+([^{]+))?\s*\{", re.M)
_METHOD = re.compile(r"(?:^|(?<=[{};]))[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?([\w$#]+)\s*(?:<[^>(]*>)?\(", re.M)
_INTERFACE = re.compile(r"^[ \t]*(?:export\s+)?interface\s+([\w$]+)[^{]*\{", re.M)
_MEMBER = re.compile(r"([\w$]+)\??\s*:\s*([^;,\n]+)")
_MASK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "super"}


def _close(masked: str, at: int, pair: str = "{}") -> int:
    depth = 0
    for i in range(at, len(masked)):
        if masked[i] == pair[0]:
            depth += 1
        elif masked[i] == pair[1]:
            depth -= 1
            if not depth:
                return i
    return len(masked) - 1


def _body(masked: str, at: int) -> tuple[int, bool]:
    """After a parameter list: where the body's brace stands (-1 if there is none) and whether an arrow comes
    first. A return type may hold braces of its own: those that follow ``:``, ``|``, ``&``, ``<``, ``,`` or ``(``."""
    i, n, typed, last, arrow = at + 1, len(masked), False, "", False
    while i < n:
        c = masked[i]
        if c == "=" and masked[i : i + 2] == "=>":
            arrow, last, i = True, "=>", i + 2
            rest = i
            while rest < n and masked[rest].isspace():
                rest += 1
            if not typed or masked[rest : rest + 1] == "{":
                return (rest, True) if masked[rest : rest + 1] == "{" else (-1, True)
            continue
        if c == "{":
            if not typed or last not in ":|&<,(":
                return i, arrow
            i = _close(masked, i)
            last = "}"
        elif c in "([":
            i = _close(masked, i, "()" if c == "(" else "[]")
            last = ")"
        elif c == ":" and not typed:
            typed, last = True, c
        elif c in ";=)},]" or (not typed and not c.isspace()):
            return -1, arrow
        elif not c.isspace():
            last = c
        i += 1
    return -1, arrow


def _doc_before(text: str, at: int) -> str | None:
    """The documentation comment that ends right before a place, without its stars."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    begin = text.rfind("/**", 0, at) if text.endswith("*/", 0, at) else -1
    if begin < 0 or text.find("*/", begin + 3, at) != at - 2:
        return None
    return "\n".join(x.strip().lstrip("*").strip() for x in text[begin + 3 : at - 2].split("\n")).strip() or None


def _lines(text: str):
    """A function from a place to the number of its line."""
    ends = [i for i, c in enumerate(text) if c == "\n"]
    return lambda i: bisect.bisect_left(ends, i) + 1


def _split(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}") - (c == ">" and text[i - 1 : i] != "=")
        if c == "," and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def parse_typescript(path: str, text: str) -> dict:
    """The module record of a JavaScript or TypeScript file, by patterns over text whose comments and
    strings are masked."""
    masked = _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = _lines(text)
    imports = sorted({a or b or c for a, b, c in _IMPORT.findall(text)})
    external = sorted({"/".join(i.split("/")[: 2 if i[0] == "@" else 1]) for i in imports if not i.startswith(("@/", "~/", "."))})

    def function(m):
        open_ = m.end() - 1
        close = _close(masked, open_, "()")
        brace, arrow = _body(masked, close)
        end = _close(masked, brace) if brace >= 0 else close
        args = []
        for a in _split(text[open_ + 1 : close]):
            name, _, default = a.partition("=") if "=>" not in a else (a, "", "")
            name, _, kind = name.partition(":")
            args.append({"name": name.strip(" .?"), "type_annotation": kind.strip() or None, "default": default.strip() or None})
        doc = _doc_before(text, m.start())
        stop = brace if brace >= 0 else masked.find("=>", close) if arrow else close + 1
        typed = text[close + 1 : stop].strip().removesuffix("=>").rstrip()
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        return {"name": m[1], "docstring": doc, "args": args, "returns": typed[1:].strip() if typed.startswith(":") else None, "anchor": {"file": path, "line": line(start)}, "end_line": line(end), "decorators": []}, m.start(), end, arrow

    classes, spans = [], []
    for m in _CLASS.finditer(masked):
        end = _close(masked, m.end() - 1)
        spans.append((m.start(), end))
        methods = []
        inner = m.end()
        while (k := _METHOD.search(masked, inner, end)) is not None:
            f, _, stop, _ = function(k)
            inner = max(stop, k.end())
            if k[1] not in _WORDS and masked[_close(masked, k.end() - 1, "()") + 1 : stop].count("{"):
                methods.append(f)
        bases = [x for x in [m[2], *[y.strip() for y in (m[3] or "").split(",")]] if x]
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        classes.append({"name": m[1], "docstring": _doc_before(text, m.start()), "bases": bases, "methods": methods, "anchor": {"file": path, "line": line(start)}, "end_line": line(end), "decorators": []})
    functions, components = [], []
    for rx in (_FUNC, _ARROW):
        for m in rx.finditer(masked):
            if any(a <= m.start() <= b for a, b in spans):
                continue
            f, start, end, arrow = function(m)
            body = text[start : end + 1]
            if rx is _ARROW and not arrow:
                continue
            functions.append(f)
            if f["name"][0].isupper() and "<" in body and ">" in body:
                components.append({"name": f["name"], "props_type": f["args"][0]["type_annotation"] if f["args"] else None, "hooks": [h for h in HOOKS if h in body], "anchor": f["anchor"], "end_line": f["end_line"]})
    functions.sort(key=lambda f: f["anchor"]["line"])
    interfaces = []
    for m in _INTERFACE.finditer(masked):
        end = _close(masked, m.end() - 1)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        interfaces.append({"name": m[1], "docstring": _doc_before(text, m.start()), "members": [{"name": a, "type": b.strip()} for a, b in _MEMBER.findall(text[m.end() : end])], "anchor": {"file": path, "line": line(start)}, "end_line": line(end)})
    return {
        "path": path, "language": "typescript" if path.endswith((".ts", ".tsx")) else "javascript", "imports": imports, "external_imports": external, "exports": sorted(set(_EXPORT.findall(masked))),
        "functions": functions, "classes": classes, "interfaces": interfaces, "components": components, "total_lines": text.count("\n") + 1 if text else 0,
    }


def parse_module(path: str, text: str | None) -> dict:
    text = (text or "").replace("\r\n", "\n")
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("ts", "tsx", "js", "jsx"):
        return parse_typescript(path, text)
    if ext == "py":
        return parse_python(path, text)
    return {"path": path, "language": "infra", "total_lines": text.count("\n") + 1 if text else 0}


_CALL = re.compile(r"(?<![\w$])(?:(?P<owner>[\w$]+)\s*\??\.\s*)?(?P<name>[\w$]+)\s*(?:<[^<>(){};]*>)?\(")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "super", "typeof", "await", "new", "in", "of", "do", "else", "with", "import", "case", "throw", "delete", "void", "yield", "async"}


def typescript_calls(path: str, text: str):
    """(module, line, name, full_name, receiver) of each call ``f()``, ``a.f()`` or ``g().f()`` of a JavaScript or
    TypeScript file; definitions, constructions and calls on longer chains of names are none."""
    text = text.replace("\r\n", "\n")
    masked = _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = _lines(text)
    for m in _CALL.finditer(masked):
        name, owner, at = m["name"], m["owner"], m.start()
        if name in _NO_CALL or name[0].isdigit() or (owner and owner[0].isdigit()):
            continue
        before = at - 1
        while before >= 0 and masked[before].isspace():
            before -= 1
        word = re.search(r"[\w$]+$", masked[max(0, before - 12) : before + 1])
        if word and word[0] in ("function", "new", "class"):
            continue
        if not owner:
            stop, arrow = _body(masked, _close(masked, m.end() - 1, "()"))
            if stop >= 0 and not arrow and (before < 0 or masked[before] in "{};*)]" or word):
                continue  # a method or function is defined here
        if before >= 0 and masked[before] == ".":
            if owner:
                continue
            before -= 1
            while before >= 0 and masked[before] in " \n\t?":
                before -= 1
            if before < 0 or masked[before] != ")":
                continue
            depth = 0
            while before >= 0:
                depth += (masked[before] == ")") - (masked[before] == "(")
                if not depth:
                    break
                before -= 1
            chain = re.search(r"[\w$.]+$", masked[max(0, before - 200) : before].rstrip())
            owner = chain[0] if chain else None
        yield path, line(at), name, f"{owner}.{name}" if owner else name, owner


def call_sites(path: str, text: str):
    """(module, line, name, full_name, receiver) of each call of a file, by its language."""
    if path.lower().endswith((".ts", ".tsx", ".js", ".jsx")):
        yield from typescript_calls(path, text)
        return
    try:
        tree = tree_of(text.replace("\r\n", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                yield path, n.lineno, f.id, f.id, None
            elif isinstance(f, ast.Attribute):
                owner = f.value.func if isinstance(f.value, ast.Call) else f.value
                yield path, n.lineno, f.attr, ast.unparse(f), ast.unparse(owner)


class FlowGraph:
    """Basic blocks of one function and their successors; block 0 is the entry, block 1 the exit.

    A place in the code is ``(open, before)``: the block that goes on there, or else the blocks after which
    a new one begins; a place after nothing is dead. Within ``try`` every block may jump to each handler and
    to ``finally``; a ``with`` whose body does not fall through may still be left by a suppressed exception.
    Conditions that are constants have one way out."""

    def __init__(self, body: list):
        self.succ: list[set] = [set(), set()]
        self.around: list[tuple] = []
        self.join(self.leaves(self.body(body, (None, [0]))), 1)

    def new(self, before) -> int:
        self.succ.append(set())
        self.join(before, len(self.succ) - 1)
        return len(self.succ) - 1

    def join(self, blocks, target: int):
        for b in blocks:
            self.succ[b].add(target)

    @staticmethod
    def leaves(place) -> list:
        return place[1] if place[0] is None else [place[0]]

    def jump(self, kind: str, b: int):
        """Leaves block ``b`` by ``return``, ``raise``, ``break`` or ``continue``, through what lies around it."""
        for what, x, head in reversed(self.around):
            if what == "finally":
                x.append((kind, b))
                return
            if what == "try" and kind == "raise":
                return
            if what == "loop" and kind == "break":
                x.append(b)
                return
            if what == "loop" and kind == "continue":
                self.succ[b].add(head)
                return
        self.succ[b].add(1)

    def body(self, statements: list, place):
        for n in statements:
            place = self.statement(n, place)
        return place

    def statement(self, n, place):
        if isinstance(n, (ast.While, ast.For, ast.AsyncFor)):
            return self.loop(n, self.leaves(place))
        if isinstance(n, (ast.Try, ast.TryStar)):
            return self.attempt(n, self.leaves(place))
        b = self.new(place[1]) if place[0] is None else place[0]
        if isinstance(n, ast.If):
            ends = []
            while True:
                known = bool(n.test.value) if isinstance(n.test, ast.Constant) else None
                ends += self.leaves(self.body(n.body, (None, [] if known is False else [b])))
                other = [] if known else [b]
                if len(n.orelse) != 1 or not isinstance(n.orelse[0], ast.If):
                    return None, ends + self.leaves(self.body(n.orelse, (None, other)))
                n, b = n.orelse[0], self.new(other)
        if isinstance(n, ast.Match):
            ends, open_end = [], True
            for c in n.cases:
                ends += self.leaves(self.body(c.body, (None, [b])))
                open_end &= c.guard is not None or not isinstance(c.pattern, ast.MatchAs) or c.pattern.pattern is not None
            return None, ends + [b] * open_end
        if isinstance(n, (ast.With, ast.AsyncWith)):
            end = self.body(n.body, (b, []))
            return end if self.leaves(end) else (None, [b])
        if isinstance(n, ast.Assert):
            self.jump("raise", b)
            return None, [b]
        if isinstance(n, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            self.jump(type(n).__name__.lower(), b)
            return None, []
        return b, []

    def loop(self, n, before):
        head, breaks = self.new(before), []
        known = bool(n.test.value) if isinstance(n, ast.While) and isinstance(n.test, ast.Constant) else None
        self.around.append(("loop", breaks, head))
        self.join(self.leaves(self.body(n.body, (None, [] if known is False else [head]))), head)
        self.around.pop()
        return None, self.leaves(self.body(n.orelse, (None, [] if known else [head]))) + breaks

    def attempt(self, n, before):
        first, jumps = len(self.succ), []
        if n.finalbody:
            self.around.append(("finally", jumps, None))
        if n.handlers:
            self.around.append(("try", None, None))
        end = self.body(n.body, (self.new(before), []))
        tried = range(first, len(self.succ))
        if n.handlers:
            self.around.pop()
        ends = self.leaves(self.body(n.orelse, (None, self.leaves(end)))) if n.orelse else self.leaves(end)
        for h in n.handlers:
            ends = ends + self.leaves(self.body(h.body, (self.new(tried), [])))
        if not n.finalbody:
            return None, ends
        self.around.pop()
        alive = self.reached([0])
        last = self.leaves(self.body(n.finalbody, (self.new(range(first, len(self.succ))), [])))
        for b in last:
            for kind in dict.fromkeys(["raise", *[k for k, x in jumps if x in alive]]):
                self.jump(kind, b)
        return None, last if alive & set(ends) else []

    def reached(self, todo: list) -> set:
        seen: set = set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo.extend(self.succ[b])
        return seen

    def dead(self) -> int:
        """Blocks of code that the entry does not reach."""
        return len(self.succ) - len(self.reached([0]) | {1})


def control_flow(path: str, text: str):
    """(module, function, line, blocks, edges, complexity, nesting, dead_blocks) of each Python function: basic
    blocks (entry and exit included) and edges of its control-flow graph, decision points plus one, the
    deepest nesting of compound statements, and the blocks that the entry does not reach."""
    try:
        tree = tree_of(text.replace("\r\n", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    branch = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Assert)
    compound = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)

    def inside(n):
        for c in ast.iter_child_nodes(n):
            if not isinstance(c, (*_DEF, ast.ClassDef, ast.Lambda)):
                yield c
                yield from inside(c)

    def depth(n):
        own = [depth(c) for c in ast.iter_child_nodes(n) if not isinstance(c, (*_DEF, ast.ClassDef))]
        return max(own, default=0) + isinstance(n, compound)

    for f in ast.walk(tree):
        if isinstance(f, _DEF):
            cc = 1
            for n in inside(f):
                cc += isinstance(n, branch) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) + (len(n.ifs) if isinstance(n, ast.comprehension) else 0)
            g = FlowGraph(f.body)
            yield path, f.name, f.lineno, len(g.succ), sum(map(len, g.succ)), cc, max((depth(c) for c in f.body), default=0), g.dead()


def _graphs(path: str, text: str):
    try:
        tree = tree_of(text.replace("\r\n", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for f in ast.walk(tree):
        if isinstance(f, _DEF):
            yield f.name, f.lineno, FlowGraph(f.body)


def flow_blocks(path: str, text: str):
    """(module, function, line, block, kind, reachable) of each basic block."""
    for name, line, g in _graphs(path, text):
        seen = g.reached([0])
        for b in range(len(g.succ)):
            yield path, name, line, b, "entry" if b == 0 else "exit" if b == 1 else "block", b in seen


def flow_edges(path: str, text: str):
    """(module, function, line, src, dst) of each edge between basic blocks."""
    for name, line, g in _graphs(path, text):
        for b, after in enumerate(g.succ):
            for t in sorted(after):
                yield path, name, line, b, t


def definitions_uses(path: str, text: str):
    """(module, function, line, source, target, operation): from each variable read to each one written by
    an assignment; ``<literal>`` where nothing is read. Nested functions are their own."""
    try:
        tree = tree_of(text.replace("\r\n", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return

    def statements(body):
        for s in body:
            if not isinstance(s, (*_DEF, ast.ClassDef)):
                yield s
                for part in ("body", "orelse", "finalbody"):
                    yield from statements(getattr(s, part, []) or [])
                for h in getattr(s, "handlers", []):
                    yield from statements(h.body)

    for f in ast.walk(tree):
        if isinstance(f, _DEF):
            for s in statements(f.body):
                if isinstance(s, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and s.value is not None:
                    to = [n.id for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) for n in ast.walk(t) if isinstance(n, ast.Name)]
                    use = sorted({n.id for n in ast.walk(s.value) if isinstance(n, ast.Name)}) or ["<literal>"]
                    op = "augmented" if isinstance(s, ast.AugAssign) else "assignment"
                    for t in to:
                        for u in use:
                            yield path, f.name, s.lineno, u, t, op


#: Names by which tainted data enters, leaves and is cleaned.
TAINT_SOURCES = "request.args request.form request.json request.data os.environ.get os.environ input sys.argv open pathlib.Path.read_text Path.read_text file.read raw_input".split()
TAINT_SINKS = "subprocess.run subprocess.call subprocess.Popen os.system os.popen os.exec eval exec compile sqlite3.execute sqlite3.executemany cursor.execute cursor.executemany open pickle.load pickle.loads yaml.load marshal.loads ctypes.CDLL".split()
TAINT_CLEANERS = "html.escape html.unescape int float str bool list dict json.loads json.dumps re.match re.fullmatch re.search bleach.clean markupsafe.escape hashlib.sha256 hashlib.md5 base64.b64encode base64.b64decode urllib.parse.quote urllib.parse.quote_plus".split()


def taint_flows(path: str, text: str):
    """(module, source_line, sink_line, source, sink, risk): low if a cleaner lies between, medium if the
    source comes first, else high. Marks are looked for line by line within one function's lines."""
    lines = text.replace("\r\n", "\n").split("\n")
    marks = lambda names: [(i, n) for i, x in enumerate(lines, 1) for n in names if n in x]
    clean = sorted({i for i, _ in marks(TAINT_CLEANERS)})
    try:
        spans = [(f.lineno, f.end_lineno) for f in ast.walk(tree_of("\n".join(lines))) if isinstance(f, _DEF)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    sources, sinks = marks(TAINT_SOURCES), marks(TAINT_SINKS)
    for a, b in spans:
        for i, s in sources:
            if a <= i <= b:
                for j, k in sinks:
                    if a <= j <= b:
                        yield path, i, j, s, k, "low" if any(i < x < j for x in clean) else "medium" if i < j else "high"


_TABLE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\(", re.I)
_FOREIGN = re.compile(r"FOREIGN\s+KEY\s*\(\s*[`\"]?(\w+)[`\"]?\s*\)\s*REFERENCES\s+[`\"]?(\w+)[`\"]?\s*\(\s*[`\"]?(\w+)[`\"]?\s*\)", re.I)
_CONSTRAINT = re.compile(r"(?:PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK|KEY|INDEX)\b", re.I)


def parse_ddl(path: str, text: str):
    """(source, table, column, type, primary_key, nullable, referenced_table, referenced_column)."""
    for m in _TABLE.finditer(text):
        body = text[m.end() : _close(text, m.end() - 1, "()")]
        keys = {a: (b, c) for a, b, c in _FOREIGN.findall(body)}
        primary = {x.strip(' `"') for g in re.findall(r"PRIMARY\s+KEY\s*\(([^)]*)\)", body, re.I) for x in g.split(",")}
        for col in _split(body):
            if _CONSTRAINT.match(col):
                continue
            part = col.split(None, 1)
            name, rest = part[0].strip('`"[]'), part[1] if len(part) > 1 else ""
            kind = re.match(r"\w+(?:\s*\([^)]*\))?", rest)
            pk = bool(re.search(r"PRIMARY\s+KEY|AUTO_?INCREMENT", rest, re.I)) or name in primary
            ref = keys.get(name) or (re.search(r"REFERENCES\s+(\w+)\s*\(\s*(\w+)", rest, re.I) or [None, None, None])[1:3] or (None, None)
            yield path, m[1], name, kind[0] if kind else None, pk, not (pk or bool(re.search(r"NOT\s+NULL", rest, re.I))), ref[0], ref[1]


#: Bases of table classes, and names with ``Base`` that are none.
ORM_BASES = {"DeclarativeBase", "db.Model", "Model", "Base", "AsyncBaseModel", "TimestampMixin", "BaseModel", "BaseMixin"}
ORM_NOT = {"BaseHTTPMiddleware", "BaseMiddleware", "BaseSettings", "BaseException", "BaseError", "BaseClass"}


def parse_orm(path: str, text: str):
    """(source, table, class, column, type, primary_key, nullable, referenced, relationship) of classes that
    map tables."""
    try:
        tree = tree_of(text.replace("\r\n", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for c in ast.walk(tree):
        bases = [_show(b) for b in c.bases] if isinstance(c, ast.ClassDef) else []
        if not any(b in ORM_BASES or ("Base" in b and b not in ORM_NOT) for b in bases):
            continue
        name, seen = c.name.lower(), set()
        for s in c.body:
            if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Name) and s.targets[0].id == "__tablename__" and isinstance(s.value, ast.Constant):
                name = s.value.value
        for s in c.body:
            target = s.targets[0] if isinstance(s, ast.Assign) else getattr(s, "target", None)
            call = getattr(s, "value", None)
            if not isinstance(target, ast.Name) or not isinstance(call, ast.Call) or target.id in seen:
                continue
            f = _show(call.func).split(".")[-1]
            seen.add(target.id)
            if f in ("Column", "mapped_column"):
                args = [_show(a) for a in call.args]
                ref = next((m[1] for a in args if (m := re.match(r"(?:\w+\.)?ForeignKey\(['\"]([^'\"]+)", a))), None)
                kw = {k.arg: _show(k.value) for k in call.keywords}
                pk = kw.get("primary_key") == "True" or target.id == "id"
                kind = f"FK({ref})" if ref else next((a for a in args if not a.startswith(("'", '"'))), None)
                yield path, name, c.name, target.id, kind, pk, not pk and kw.get("nullable") != "False", ref, None
            elif f == "relationship":
                yield path, name, c.name, target.id, None, False, True, None, call.args[0].value if call.args and isinstance(call.args[0], ast.Constant) else None


TABLES = {
    "call_sites": (call_sites, "module string, line int, name string, full_name string, receiver string"),
    "control_flow": (control_flow, "module string, function string, line int, blocks int, edges int, complexity int, nesting int, dead_blocks int"),
    "flow_blocks": (flow_blocks, "module string, function string, line int, block int, kind string, reachable boolean"),
    "flow_edges": (flow_edges, "module string, function string, line int, src int, dst int"),
    "definitions_uses": (definitions_uses, "module string, function string, line int, source string, target string, operation string"),
    "taint_flows": (taint_flows, "module string, source_line int, sink_line int, source string, sink string, risk string"),
    "ddl": (parse_ddl, "source string, table_name string, column_name string, type string, primary_key boolean, nullable boolean, referenced_table string, referenced_column string"),
    "orm": (parse_orm, "source string, table_name string, class string, column_name string, type string, primary_key boolean, nullable boolean, referenced string, relationship string"),
}


def extract(files: DataFrame, what: str, path: str = "path", content: str = "content") -> DataFrame:
    """The rows of one of ``TABLES`` for every file; null contents give none."""
    import pandas as pd

    f, schema = TABLES[what]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for df in frames:
            rows = [r for p, c in zip(df["path"], df["content"]) for r in f(p, c)]
            yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n, t in (x.split() for x in schema.split(", ")) if t == "int"})

    data = files.where(F.col(content).isNotNull() & F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"))
    return data.mapInPandas(run, schema)


def modules_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The module record of every file, parsed in parallel; a file that cannot be parsed has ``error``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    data = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"))
    arrow = to_arrow_schema(_parse_datatype_string(MODULE))

    def run(batches):
        for b in batches:
            rows = [parse_module(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    return data.mapInArrow(run, MODULE)
