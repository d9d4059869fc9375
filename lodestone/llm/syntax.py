"""Token streams of Python and JavaScript/TypeScript sources, read by the memoised derivative parser.

``check(path, content)`` -> ``None`` for a valid file, else ``(kind, line, token)`` with kind
``rejected`` (the derivative became empty at that token) or ``truncated`` (the end derivative is not
nullable). The language is that of the extension; unknown extensions are not judged.

Files without JSX are first read by a context-free scan; only when that is rejected, and for JSX, the
lexer asks the parser which token may follow (regular expression or division, markup or comparison),
so the scan is a shortcut that never decides against a file.
"""

from __future__ import annotations

import ast
import re
import symtable
import warnings
from functools import cache, reduce
from operator import getitem

from . import grammars
from .derivatives import Grammar

#: The reserved and contextual words that the grammars name.
PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield match case type _".split()
)
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with null true false let yield await async of get "
    "set static as from type require abstract declare namespace global interface enum readonly keyof unique infer is asserts "
    "satisfies implements accessor constructor assert out override".split()
)
JS_CONTEXT = frozenset("public private protected module".split())

_NUM = (
    r"(?:0[xX](?:_?[0-9a-fA-F])+n?|0[oO](?:_?[0-7])+n?|0[bB](?:_?[01])+n?"
    r"|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[njJ]?)(?![\w])"
)

# ------------------------------------------------------------------------------------------- Python
def _f_plain(quote: str, text: str, inner: str) -> str:
    """F-strings whose fields hold no brackets of their kind, escapes, comments or quotes but plain strings."""
    return rf"{quote}(?:{text}|\\N\{{[^{{}}\n]*\}}|\\(?!N\{{)[^{{}}]|\{{\{{|\}}\}}|\{{(?:[^{{}}'\"\\\n#]|{inner})*\}})*{quote}"


_IN_1, _IN_2 = r"'[^'\\\n{}]*'(?!')", r'"[^"\\\n{}]*"(?!")'
_F_PLAIN = (
    "(?:[fF][rR]?|[rR][fF])(?:" + _f_plain("'''", r"[^{}'\\]|'(?!'')", _IN_2) + "|" + _f_plain('"""', r'[^{}"\\]|"(?!"")', _IN_1)
    + "|" + _f_plain("'", r"[^{}'\\\n]", _IN_2) + "|" + _f_plain('"', r'[^{}"\\\n]', _IN_1) + ")"
)
_F_OPEN = re.compile(r"([fF][rR]?|[rR][fF])('''|\"\"\"|['\"])")
_F_TEXT = re.compile(r"[^{}\\'\"\n]*")
_F_CONVERSION, _F_DEBUG = re.compile(r"![rsa](?!\w)\s*(?=[:}])"), re.compile(r"=\s*(?=[:}]|!(?!=))")
_PY = re.compile(
    r"[ \t\f]*(?:\\\n[ \t\f]*)*("
    r"[^\W\d]\w*(?!['\"\w])|[()\[\]{},;~]"
    r"|\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*[ \t\f]*"
    r"|\#[^\n]*"
    rf"|{_F_PLAIN}|(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|['\"])"
    r"|(?:[rRbBuU]|[bB][rR]|[rR][bB])?(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''"
    r'|"""(?:[^\\"]|\\[\s\S]|"(?!""))*"""'
    r"|'(?!'')(?:[^\\'\n]|\\[\s\S])*'|\"(?!\"\")(?:[^\\\"\n]|\\[\s\S])*\")"
    r"|[^\W\d]\w*"
    rf"|{_NUM}"
    r"|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|[-+*/%&|^@]=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%&|^~@<>()\[\]{},:;.=]"
    r"|[\s\S])"
)
_PY_OP = {x: "AUG" for x in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()}
_PY_OP |= {x: "CMP" for x in "< > <= >= == !=".split()} | {x: "AROP" for x in "// % << >> & ^".split()}
_PY_OP |= {x: x for x in "... -> := ** + - * / @ ~ | ( ) [ ] { } , : ; . =".split()}


class _Classes(dict):
    """Token text -> class, filled on demand and bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token):
        found = self.make(token)
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found


def _py_class(t: str):
    """The class; for a line break, the width of the next line's indentation."""
    c = t[0]
    if c == "\n":
        return _width(t[t.rfind("\n") + 1 :])
    if c == "#" or c in " \t\f":
        return " "
    if t in PY_WORDS:
        return t
    if t in _PY_OP:
        return _PY_OP[t]
    if c.isalpha() or c == "_":
        if _F_OPEN.match(t):
            return "STR" if _f_end(t, 0) == len(t) else "ERROR"
        if t[-1] in "'\"":
            return "STR"
        return "NAME" if t.isidentifier() else "ERROR"
    if c in "'\"":
        return "STR" if len(t) > 1 else "ERROR"
    if c.isdigit() or c == "." and len(t) > 1:
        return "ERROR" if re.fullmatch(r"0[\d_]*[1-9][\d_]*", t) or t[-1] == "n" else "NUM"
    return "ERROR"


def _width(ws: str) -> tuple[int, int]:
    wide = 0
    for c in ws:
        wide = (wide // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else wide + 1
    return wide, len(ws)


def _f_end(text: str, pos: int, nest: int = 0):
    """Where the f-string at ``pos`` ends; None if it does not, if one of its fields is not valid, or if it
    lies in 150 others, the limit of the language's own reader."""
    m = _F_OPEN.match(text, pos)
    return _f_text(text, m.end(), m[2], "r" in m[1].lower(), 0, nest) if nest < 150 else None


def _f_text(text: str, pos: int, quote: str, raw: bool, level: int, nest: int):
    """The end of the text of an f-string, or (``level`` over 0) of a format specification in it."""
    while True:
        pos = _F_TEXT.match(text, pos).end()
        c = text[pos : pos + 1]
        if not c:
            return None
        if text.startswith(quote, pos):
            return None if level else pos + len(quote)
        if c == "\\":
            if not raw and text.startswith("N{", pos + 1):
                pos = text.find("}", pos) + 1
                if not pos:
                    return None
            else:
                pos += 1 if text[pos + 1 : pos + 2] in "{}" else 2
        elif c == "{":
            pos = pos + 2 if not level and text.startswith("{", pos + 1) else _f_field(text, pos + 1, quote, raw, level, nest)
            if pos is None:
                return None
        elif c == "}":
            if level:
                return pos + 1
            if not text.startswith("}", pos + 1):
                return None
            pos += 2
        elif c == "\n" and len(quote) == 1 and not level:
            return None
        else:
            pos += 1


def _f_field(text: str, pos: int, quote: str, raw: bool, level: int, nest: int):
    """The end of the field whose expression begins at ``pos``; the expression is derived by the grammar."""
    g = machine_of("py").grammar
    s, depth = g.rules["Value"], 0
    while level < 3 and (m := _PY.match(text, pos)):
        t, at, pos = m[1], m.start(1), m.end()
        if not depth and (t[0] in ":!}" and t != "!=" or t == "=" and _F_DEBUG.match(text, at)):
            if not s.nullable:
                return None
            if t == "=":
                at = _F_DEBUG.match(text, at).end()
            if text[at] == "!":
                m = _F_CONVERSION.match(text, at)
                if not m:
                    return None
                at = m.end()
            return at + 1 if text[at] == "}" else _f_text(text, at + 1, quote, raw, level + 1, nest)
        if _F_OPEN.match(t):
            pos, c = _f_end(text, at, nest + 1), "STR"
        else:
            c = _PY_CLASSES[t]
            if c == " " or type(c) is tuple:
                continue
        s = g.derive(s, c)
        if pos is None or s is g.empty:
            return None
        depth += (c in _OPEN) - (c in _CLOSE)
    return None


_PY_CLASSES = _Classes(_py_class)
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}


class State(dict):
    """What has been read so far: the language of the rest and what lies outside the grammar (line
    breaks, indentation). Maps token classes to the next state; states are shared, so that reading a
    known token is one lookup."""

    __slots__ = ("machine", "lang", "rest")

    def __missing__(self, c):
        found = self[c] = self.machine.step(self.lang, self.rest, c)
        return found


class _Machine:
    """Shared states over a grammar; dropped with the grammar's memo when that has grown too large."""

    def __init__(self, text: str, start: str, first):
        self.text, self.first_rule, self.first_rest = text, start, first
        self.reset()

    def reset(self):
        self.grammar = Grammar(self.text, self.first_rule)
        self.states: dict = {}
        self.start = self.state(self.grammar.start, self.first_rest)
        self.dead = self.state(self.grammar.empty, None)

    def state(self, lang, rest):
        if lang is self.grammar.empty:
            rest = None
        found = self.states.get((lang, rest))
        if found is None:
            found = self.states[lang, rest] = State()
            found.machine, found.lang, found.rest = self, lang, rest
        return found

    def begin(self):
        if len(self.states) + len(self.grammar.table) > 500_000:
            self.reset()
        return self.start


class _PyMachine(_Machine):
    """rest: (open brackets, indentation levels, at the start of a line)."""

    def step(self, lang, rest, c):
        g = self.grammar
        if rest is None or c == " ":
            return self.state(lang, rest)
        depth, levels, fresh = rest
        if type(c) is not tuple:
            n = g.derive(lang, c)
            depth += (c in _OPEN) - (c in _CLOSE)
            return self.state(n, (depth, levels, False))
        if depth:
            return self.state(lang, rest)
        if not fresh:
            lang = g.derive(lang, "NEWLINE")
        top = levels[-1]
        if c != top:
            if c[0] > top[0] and c[1] > top[1]:
                levels += (c,)
                lang = g.derive(lang, "INDENT")
            elif c[0] < top[0] and c[1] < top[1]:
                while levels[-1][0] > c[0]:
                    levels = levels[:-1]
                    lang = g.derive(lang, "DEDENT")
                if levels[-1] != c:
                    lang = g.empty
            else:
                lang = g.empty
        return self.state(lang, (0, levels, True))


def check_python(text: str):
    machine = machine_of("py")
    s = machine.begin()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text[:1] == "\ufeff":
        text = text[1:]
    if "\x00" in text:
        return "rejected", text.count("\n", 0, text.index("\x00")) + 1, "\\x00"
    text = "\n" + text + "\n"
    toks = _PY.findall(text)
    s = reduce(getitem, map(_PY_CLASSES.__getitem__, toks), s)
    if s is not machine.dead:
        return None if s.lang.nullable and not s.rest[0] else ("truncated", text.count("\n") - 1, "")
    s, dead, pos = machine.start, machine.dead, 0
    while m := _PY.match(text, pos):  # again, with f-strings of any nesting
        t, pos = m[1], m.end()
        end = _f_end(text, m.start(1)) if _F_OPEN.match(t) else None
        s = s["STR" if end else _PY_CLASSES[t]]
        pos = end or pos
        if s is dead:
            return "rejected", text.count("\n", 0, m.start(1)), "line break or indentation" if t[0] == "\n" else t[:40]
    return None if s.lang.nullable and not s.rest[0] else ("truncated", text.count("\n") - 1, "")


# --------------------------------------------------------------------------------- JavaScript family
_STR = r"'(?:[^\\'\n]|\\[\s\S])*'|\"(?:[^\\\"\n]|\\[\s\S])*\""
_PUNCT = (
    r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)"
    r"|\*\*|<<|[-+*/%&|^~!?:;,.<>=(){}\[\]@]"
)
_REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_WORD = r"\#?[A-Za-z_$\u0080-\U0010ffff][\w$\u200c\u200d]*"
_JS_SCAN = re.compile(
    r"[^\S\n  ]*("
    r"\n\s*|//[^\n]*|/\*[\s\S]*?\*/"
    rf"|{_STR}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{[^{{}}`]*\}})*`|{_WORD}|{_NUM}"
    rf"|(?:(?<=[(,=:\[!&|?{{}};+])|(?<=[(,=:\[!&|?{{}};+] )|(?<=return )){_REGEX}"
    rf"|{_PUNCT}|[\s\S])"
)
_JS_SKIP = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")
_JS_TOKEN = re.compile(rf"(?:{_STR}|{_WORD}|{_NUM}|{_PUNCT}|[\s\S])")
_JS_REGEX = re.compile(_REGEX)
_TPL_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JSX_TEXT, _JSX_ID, _JSX_STR = re.compile(r"[^{}<>]+"), re.compile(r"(?:[^\W\d]|\$)[\w$-]*"), re.compile(r"'[^']*'|\"[^\"]*\"")
_JSX_TAG = re.compile(r"\s*(/?)\s*((?:[^\W\d]|\$)[\w$.:-]*)?")
_SELF_CLOSE = re.compile(r"/\s*>")
_GENERIC = re.compile(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b)")
_JS_OP = {x: "OP" for x in "** % << <= == != === !== ^ && || ??".split()}
_JS_OP |= {x: "ASSIGN" for x in "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()} | {"++": "INC", "--": "INC"}
_JS_OP |= {x: x for x in "... => >= ?. + - * / & | ~ ! ? : ; , . < > = ( ) { } [ ] @".split()}


def _js_class(t: str):
    c = t[0]
    if c == "\n" or t[:2] in ("//", "/*") or t.isspace():
        return "\n" if "\n" in t else " "
    if t in JS_WORDS:
        return t
    if t in JS_CONTEXT:
        return "CONTEXT"
    if t in _JS_OP:
        return _JS_OP[t]
    if c == "`":
        return "ERROR" if len(t) == 1 else "TPL" if "${" not in t else ("TPL", " ".join(re.findall(r"\$\{[^{}`]*\}", t)))
    if c in "'\"":
        return "STR" if len(t) > 1 else "ERROR"
    if c.isdigit() or c == "." and len(t) > 1:
        return "NUM" if t[-1] not in "jJ" or t[:2] in ("0x", "0X") else "ERROR"
    if c == "#":
        return "PRIVATE" if len(t) > 1 and t[1:].replace("$", "_").isidentifier() else "ERROR"
    if c == "/" and len(t) > 1:
        return "REGEX"
    if c == "$" or c == "_" or c.isalpha():
        return "NAME" if t.isascii() or t.replace("$", "_").isidentifier() else "ERROR"
    return "ERROR"


_JS_CLASSES = _Classes(_js_class)
class _JsMachine(_Machine):
    """rest: whether a line break has just been read. The rule by which a missing semicolon is taken
    as read (a token that may not follow, after a line break or being ``}``) is part of the step."""

    def __init__(self, kind: str):
        self.kind = kind
        super().__init__(grammars.javascript(kind in ("ts", "tsx"), kind in ("jsx", "tsx"), loose=True), "Module", False)

    def step(self, lang, rest, c):
        g = self.grammar
        if rest is None or c == " ":
            return self.state(lang, rest)
        if c == "\n":
            return self.state(lang, True)
        if type(c) is tuple:  # a template whose expressions hold no braces
            if not self.holes_valid(c[1]):
                return self.dead
            c = "TPL"
        n = g.derive(lang, c)
        if rest and c == "INC" or n is g.empty and (rest or c == "}"):  # a line break ends what ++ would follow
            closed = g.derive(g.derive(lang, ";"), c)
            n = n if closed is g.empty else closed
        return self.state(n, False)

    def holes_valid(self, token: str) -> bool:
        g = self.grammar
        for hole in re.findall(r"\$\{([^{}`]*)\}", token):
            s = g.rules["Expr"]
            for t in _JS_SCAN.findall(hole):
                c = _JS_CLASSES[t]
                if c not in (" ", "\n"):
                    s = g.derive(s, c)
            if not s.nullable:
                return False
        return True

    def accepts(self, text: str) -> bool:
        """Whether the context-free scan is accepted."""
        if "/>" in text and self.kind in ("jsx", "tsx") or text.startswith("#!"):
            return False
        s = reduce(getitem, map(_JS_CLASSES.__getitem__, _JS_SCAN.findall(text)), self.begin())
        if not (s.lang.nullable or self.grammar.derive(s.lang, ";").nullable):
            return False
        if "</" in text and self.kind in ("jsx", "tsx"):  # names of closing tags, where nothing is doubtful
            names, tags = set(re.findall(r"</([\w$.:-]*)", text)), []
            for close, name in re.findall(r"<(/?)([\w$.:-]*)", text):
                if not close:
                    tags.append(name)
                else:
                    while tags and tags[-1] not in names:
                        tags.pop()
                    if not tags or tags.pop() != name:
                        return False
            return not names & set(tags)
        return True


@cache
def machine_of(kind: str):
    return _PyMachine(grammars.PYTHON, "File", (0, ((0, 0),), True)) if kind == "py" else _JsMachine(kind)


@cache
def grammar(kind: str) -> Grammar:
    return Grammar(grammars.javascript(kind in ("ts", "tsx"), kind in ("jsx", "tsx")), "Module")


def _walk(g: Grammar, jsx: bool, text: str):
    """Reads the text with a lexer that asks the parser what may follow."""
    s, empty, derive = g.start, g.empty, g.derive
    pos, end, braces, tags, closing = 0, len(text), [], [], False
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else end

    def can(c):
        return derive(s, c) is not empty

    while True:
        if jsx and can("JSX_TEXT") and pos < end and text[pos] not in "{}<>":
            m = _JSX_TEXT.match(text, pos)
            s, pos = derive(s, "JSX_TEXT"), m.end()
            continue
        skipped = _JS_SKIP.match(text, pos).end()
        if text.startswith("/*", skipped):
            return "truncated", text.count("\n") + 1, ""
        broken = "\n" in text[pos:skipped]
        pos = skipped
        if pos >= end:
            break
        ch, c, stop = text[pos], None, pos + 1
        if jsx and ch.isalpha() | (ch in "_$") and can("JSX_ID"):
            c, stop = "JSX_ID", _JSX_ID.match(text, pos).end()
        elif jsx and ch in "'\"" and can("JSX_STR"):
            m = _JSX_STR.match(text, pos)
            c, stop = ("JSX_STR", m.end()) if m else ("ERROR", pos + 1)
        elif jsx and ch == "<" and can("JSX_OPEN") and not (can("<") and _GENERIC.match(text, pos)):
            m = _JSX_TAG.match(text, pos + 1)
            c = "JSX_OPEN"
            if not m[1]:
                tags.append(m[2] or "")
            elif not tags or tags.pop() != (m[2] or ""):
                c = "ERROR"
            else:
                closing = True
        elif ch == "`":
            m = _TPL_TEXT.match(text, pos + 1)
            if not m:
                return "truncated", text.count("\n") + 1, ""
            c, stop = "TPL" if m[1] == "`" else "TPL_HEAD", m.end()
            if c == "TPL_HEAD":
                braces.append("$")
        elif ch == "}" and braces and braces[-1] == "$":
            m = _TPL_TEXT.match(text, pos + 1)
            if not m:
                return "truncated", text.count("\n") + 1, ""
            c, stop = "TPL_TAIL" if m[1] == "`" else "TPL_MID", m.end()
            if c == "TPL_TAIL":
                braces.pop()
        elif ch == "/" and not can("/") and not (text[pos : pos + 2] == "/=" and can("ASSIGN")) and (m := _JS_REGEX.match(text, pos)):
            c, stop = "REGEX", m.end()
        else:
            m = _JS_TOKEN.match(text, pos)
            stop = m.end()
            c = _JS_CLASSES[m[0]]
            if c == "{":
                braces.append("{")
            elif c == "}" and braces:
                braces.pop()
        if jsx and c == "/" and _SELF_CLOSE.match(text, pos) and can("/"):
            if closing:
                closing = False
            elif tags:
                tags.pop()
        elif c == "/":
            closing = False
        n = derive(s, c)
        if broken and c == "INC" or n is empty and (broken or c in ("}", "TPL_TAIL", "TPL_MID")):
            closed = derive(derive(s, ";"), c)
            n = n if closed is empty else closed
        if n is empty and c == "REGEX":
            c, stop = "/", pos + 1
            n = derive(s, c)
        if n is empty:
            return "rejected", text.count("\n", 0, pos) + 1, text[pos:stop][:40]
        s, pos = n, stop
    return None if s.nullable or derive(s, ";").nullable else ("truncated", text.count("\n") + 1, "")


def check_javascript(text: str, kind: str):
    g = grammar(kind)
    g.trim()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text[:1] == "﻿":
        text = text[1:]
    return None if machine_of(kind).accepts(text) else _walk(g, kind in ("jsx", "tsx"), text)


KINDS = {"py": "py", "js": "js", "jsx": "jsx", "ts": "ts", "tsx": "tsx"}


def extension(path: str | None) -> str:
    return (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""


def check(path: str | None, content: str | None):
    kind = KINDS.get(extension(path))
    if kind is None or not content:
        return None
    return check_python(content) if kind == "py" else check_javascript(content, kind)


def verdict(path: str | None, content: str | None):
    """``check``; about a Python file the interpreter's own parser has the last word, unless it is too deep for it."""
    bad = check(path, content)
    if not content or extension(path) != "py":
        return bad
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:  # the symbol table is made without a tree of objects; it refuses more than the parser does
                symtable.symtable(content.removeprefix("\ufeff"), "<file>", "exec")
                return None
            except (SyntaxError, ValueError):
                pass
            compile(content.removeprefix("\ufeff"), "<file>", "exec", ast.PyCF_ONLY_AST, True)
    except SyntaxError as e:
        return bad or ("rejected", e.lineno or 1, (e.text or "").strip()[:40])
    except ValueError:
        return bad or ("rejected", 1, "")
    except (MemoryError, RecursionError):
        return bad
    return None
