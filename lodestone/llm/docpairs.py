"""Functions paired with their documentation, by recursive patterns.

One pattern per language family captures documentation, signature and balanced body together; the
sub-patterns for brackets call themselves, and strings, templates, regular expressions and comments
are consumed whole wherever they stand, so that code inside them yields nothing. The pattern is tried
at every comment (or ``def``) that is not itself inside one of those, so functions inside bodies are
found too.

Defined results: null or empty content and unknown extensions give no pairs; documentation that is
empty, or whose description has fewer than ``min_words`` words that are not words of the function's
own name and fewer than ``min_han`` Chinese characters, gives no pair.
"""

from __future__ import annotations

import re

import regex

from .syntax import extension, verdict

# parts without recursion are written out in place: only brackets inside brackets call themselves
_S = r"""'(?:[^\\'\n]++|\\[\s\S])*+'|"(?:[^\\"\n]++|\\[\s\S])*+\""""
# a template whose holes hold no braces, quotes or slashes is read in place, any other by recursion
_T = r"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{)|\$\{[^{}`'\"/]*+\})*+`"
_C = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
_X = (
    r"(?:(?<=[(,=:\[!&|?{};+>])|(?<=[(,=:\[!&|?{};+>]\s)|(?<=return\s))/(?![*/])"
    r"(?:[^\\/\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
)
_SKIP = rf"{_S}|{_T}|(?&tpl)|{_C}|{_X}|['\"`/]"
_JS_DEFINE = rf"""
(?(DEFINE)
 (?P<tpl>`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|\$(?&brace))*+`)
 (?P<paren>\((?:[^()'"`/]++|{_SKIP}|(?&paren))*+\))
 (?P<brack>\[(?:[^\[\]'"`/]++|{_SKIP}|(?&brack))*+\])
 (?P<brace>\{{(?:[^{{}}'"`/]++|{_SKIP}|(?&brace))*+\}})
 (?P<angle><(?:[^<>()\[\]{{}};'"`]++|(?<==)>|{_S}|(?&paren)|(?&brack)|(?&brace)|(?&angle))*+>)
 (?P<ret>:\s*+(?:[^(){{}}\[\]<>;='"`]++|{_S}|(?&paren)(?:\s*+=>(?=[^{{;\n]*=>))?+|(?&brack)|(?&angle)|(?&brace)(?=\s*+(?:[\[|&{{]|=>)))*+)
 (?P<arrow>(?:async\b\s*+)?(?:(?&angle)\s*+)?(?:(?&paren)\s*+(?&ret)?+|[\w$]++\s*+)=>)
 (?P<body>(?&brace)|(?:[^()\[\]{{}}'"`/;\n]++|{_SKIP}|(?&paren)|(?&brack)|(?&brace))++)
)
"""
#: What follows a documentation comment, up to and with the body.
_JS = regex.compile(
    _JS_DEFINE
    + r"""
\s*+(?:@[\w.$]++(?:\s*+(?&paren))?+\s*+)*+
(?P<code>
   (?:export\s++)?+(?:default\s++)?+(?:declare\s++)?+(?:async\s++)?+(?P<at>function)\b\s*+\*?+\s*+(?P<name>[\w$]++)\s*+(?:(?&angle)\s*+)?+(?P<args>(?&paren))\s*+(?&ret)?+
     (?&brace)
 | (?:export\s++)?+(?P<at>const|let|var)\s++(?P<name>[\w$]++)\s*+(?::[^=;]++(?:=>[^=;]++)*+)?+=\s*+(?:(?:React\.)?(?:memo|forwardRef)(?:(?&angle))?\(\s*+)?+
     (?:(?:async\s++)?+function\b\s*+\*?+\s*+[\w$]*+\s*+(?:(?&angle)\s*+)?+(?P<args>(?&paren))\s*+(?&ret)?+(?&brace)
       | (?=(?:async\b\s*+)?+(?:(?&angle)\s*+)?+(?P<args>(?&paren)|[\w$]++))(?&arrow)\s*+(?&body))
 | (?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|accessor)\s++(?=[\w$\#*\[]))*+\*?+\s*+
     (?P<at>(?P<name>(?!(?:if|for|while|switch|catch|function|return|with|class|interface|export|import|const|let|var|new|throw|do|else|try)\b)\#?+[\w$]++))\s*+
     (?: \??+\s*+(?:(?&angle)\s*+)?+(?P<args>(?&paren))\s*+(?&ret)?+(?&brace)
       | (?::[^=;(]++)?+[=:]\s*+(?:(?:async\s++)?+function\b\s*+\*?+\s*+[\w$]*+\s*+(?P<args>(?&paren))\s*+(?&ret)?+(?&brace)
       | (?=(?:async\b\s*+)?+(?P<args>(?&paren)|[\w$]++))(?&arrow)\s*+(?&body)))
)
""",
    regex.VERSION1 | regex.VERBOSE,
)
#: Comments and everything that may hold what only looks like one; a backtick alone opens a template
#: that only the recursive pattern can read.
_JS_MARKS = re.compile(
    r"/\*[\s\S]*?\*/|//[^\n]*|'(?:[^\\'\n]|\\[\s\S])*'|\"(?:[^\\\"\n]|\\[\s\S])*\"|" + _T + r"|`"
    r"|(?:(?<=[(,=:\[!&|?{};+>])|(?<=[(,=:\[!&|?{};+>] )|(?<=return ))/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
)
_TEMPLATE = regex.compile(_JS_DEFINE + "(?&tpl)", regex.VERSION1 | regex.VERBOSE)
_L = r"""[A-Za-z]{0,2}+(?:\"\"\"(?:[^\\\"]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']++|\\[\s\S]|'(?!''))*+''')"""
_Q = r"[A-Za-z]{0,2}+(?:'(?:[^\\'\n]++|\\[\s\S])*+'|\"(?:[^\\\"\n]++|\\[\s\S])*+\")"
_PY_SKIP = rf"{_L}|{_Q}|\#[^\n]*+|\w++|['\"]"
_PY = regex.compile(
    rf"""
(?(DEFINE)
 (?P<paren>\((?:[^()'\"\#\w]++|{_PY_SKIP}|(?&paren))*+\))
 (?P<brack>\[(?:[^\[\]'\"\#\w]++|{_PY_SKIP}|(?&brack))*+\])
 (?P<item>{_L}|{_Q})
)
(?P<indent>[ \t]*+)(?:async[ \t]++)?+(?P<at>def)[ \t]++(?P<name>\w++)[ \t]*+(?:(?&brack)[ \t]*+)?+(?P<args>(?&paren))
 [ \t]*+(?:->(?:[^:\n()\[\]'\"\#\w]++|{_PY_SKIP}|(?&paren)|(?&brack))++)?+:
 [ \t]*+(?:\#[^\n]*+)?+(?:\n[ \t]*+(?:\#[^\n]*+)?+)*+
 (?P<doc>\(?+[ \t]*+(?![fFbB]|[rR][fFbB])(?&item)(?:[ \t]*+(?:\\\n[ \t]*+)?+(?![fFbB]|[rR][fFbB])(?&item))*+[ \t]*+\)?+)[ \t]*+(?=[;\n\#]|$)
 (?P<body>[^\n]*+(?:\n(?:[ \t]*+(?:\#[^\n]*+)?+(?=\n|$)|(?P=indent)[ \t]++[^\n]*+))*+)
""",
    regex.VERSION1 | regex.VERBOSE,
)
_PY_MARKS = re.compile(
    r"^[ \t]*(?:async[ \t]+)?def\b(?=[^\n]*[(\[])|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\""
    r"|'(?:[^\\'\n]|\\[\s\S])*'|\"(?:[^\\\"\n]|\\[\s\S])*\"|\#[^\n]*",
    re.M,
)

#: Where the description of a docstring ends.
_PY_SECTION = re.compile(
    r"^[ \t]*(?::(?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raise|raises|yield|yields|var|ivar|cvar)\b"
    r"|@(?:param|return|returns|type|rtype|raise|raises|arg|example)\b|>>>|\.\. (?:code|code-block|doctest)::|```"
    r"|(?:Args|Arguments|Parameters|Params|Param|Keyword Args|Keyword Arguments|Other Parameters|Returns?|Yields?|Raises|Examples?|Usage|Attributes|参数|返回|返回值|示例)[ \t]*[:：]"
    r"|(?:Args|Arguments|Parameters|Returns?|Yields?|Raises|Examples?|Usage|Attributes)[ \t]*\n[ \t]*[-=~]{3,})",
    re.M,
)
_JS_SECTION = re.compile(r"^[ \t]*@\w+|```|^[ \t]*(?:Args|Arguments|Parameters|Returns?|Examples?|Usage)[ \t]*:", re.M)
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\dA-Za-z_]+")


def clean_comment(doc: str) -> str:
    """The text of a ``/** */`` comment without its frame."""
    return "\n".join(re.sub(r"^[ \t]*\*?[ \t]?", "", x) for x in doc[3:-2].split("\n")).strip()


_LITERAL = regex.compile(r"[A-Za-z]{0,2}+(?:(\"\"\"|''')([\s\S]*?)(?<!\\)(?:\\\\)*\1|(['\"])((?:[^\\\n]|\\[\s\S])*?)\3)")


def clean_docstring(literal: str) -> str:
    """The value of the string literals of a docstring, dedented; escapes are left as written."""
    out = []
    for m in _LITERAL.finditer(literal):
        out.append(m[2] if m[1] else m[4])
    return "\n".join(x.strip() for x in "".join(out).split("\n")).strip()


def description(doc: str, python: bool) -> str:
    """The text before any parameter, return or example section or tag."""
    m = (_PY_SECTION if python else _JS_SECTION).search(doc)
    return (doc[: m.start()] if m else doc).strip()


def telling(text: str, name: str, min_words: int = 4, min_han: int = 8) -> bool:
    own = {x.lower() for x in _NAME_PARTS.findall(name)} | {name.lower()}
    if len(_HAN.findall(text)) >= min_han:
        return True
    n = 0
    for w in _WORDS.findall(text):
        if w.lower() not in own and not w.isdigit() and not _HAN.match(w):
            n += 1
            if n >= min_words:
                return True
    return False


def _js_marks(content: str):
    """The matches of ``_JS_MARKS``, none of them inside a template."""
    pos = 0
    while mark := _JS_MARKS.search(content, pos):
        pos = mark.end()
        if mark[0] == "`":
            whole = _TEMPLATE.match(content, mark.start())
            pos = whole.end() if whole else pos
        else:
            yield mark


def pairs(path: str | None, content: str | None, min_words: int = 4, min_han: int = 8):
    """(name, line, args, description, documentation, code) of each documented function of one file."""
    kind = extension(path)
    if not content or kind not in ("py", "js", "jsx", "ts", "tsx"):
        return []
    python = kind == "py"
    if python and "def" not in content or not python and "/**" not in content:
        return []
    if "\r" in content:
        content = content.replace("\r\n", "\n").replace("\r", "\n")
    out, line, last = [], 1, 0
    for mark in _PY_MARKS.finditer(content) if python else _js_marks(content):
        text = mark[0]
        if python:
            if not text.endswith("def"):
                continue
            m = _PY.match(content, mark.start())
        elif text.startswith("/**") and len(text) > 4:
            doc = clean_comment(text)
            about = description(doc, False)
            if not telling(about, "", min_words, min_han):
                continue
            m = _JS.match(content, mark.end())
        else:
            continue
        if m is None:
            continue
        if python:
            doc = clean_docstring(m["doc"])
            about = description(doc, True)
        name = m["name"]
        if not telling(about, name, min_words, min_han):
            continue
        at = m.start("at")
        line += content.count("\n", last, at)
        last = at
        out.append((name, line, m["args"] or "", about, doc, m[0] if python else m["code"]))
    return out


def valid_pairs(path, content, min_words: int = 4, min_han: int = 8):
    """``pairs`` of a file that is valid by the verdict that the syntax errors go by, none of any other."""
    found = pairs(path, content, min_words, min_han)
    return found if found and verdict(path, content) is None else []
