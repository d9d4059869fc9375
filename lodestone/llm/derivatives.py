"""Memoised parsing with derivatives.

A language is a hash-consed node. ``derive(node, token)`` gives the language of what may follow once
``token`` has been read; every node keeps the derivatives it has been asked for (a node *is* the
dictionary from token class to derivative), so that in the steady state reading a token costs one
dictionary lookup. The empty language as a derivative marks the failing token; an end derivative that
is not nullable means that the text stops too early.

Grammars are written in a small EBNF: ``Name = alternatives ;`` with ``'tok'`` and UPPER-case token
classes, ``( )``, ``?``, ``*``, ``+``, ``|`` and ``!{'a' 'b'} X`` ("X, but not starting with these").
Left recursion must be written as repetition; with that, no fixed point is needed except for
nullability, which is computed once per grammar.
"""

from __future__ import annotations

import re

EMPTY_KIND, EPS_KIND, TOK, SEQ, ALT, STAR, REF, EXCEPT = range(8)


class Lang(dict):
    """One hash-consed language; maps token classes to derivatives already computed."""

    __slots__ = ("kind", "a", "b", "nullable")

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other


class Grammar:
    """Rules over hash-consed languages. ``limit`` bounds the memo: beyond it the memo is dropped and
    rebuilt, which changes the time but never a result."""

    def __init__(self, text: str, start: str, limit: int = 400_000):
        self.limit = limit
        self.table: dict = {}
        self.empty = self._node(EMPTY_KIND, None, None, False)
        self.eps = self._node(EPS_KIND, None, None, True)
        self.rules: dict[str, Lang] = {}
        self.source = _read(text)
        names = self._nullable_names()
        self.null_names = names
        for name, body in self.source.items():
            self.rules[name] = self._build(body)
        self.start = self._ref(start)
        self.base = len(self.table)

    # construction -----------------------------------------------------------------------------
    def _node(self, kind, a, b, nullable):
        key = (kind, a, b)
        found = self.table.get(key)
        if found is None:
            found = Lang()
            found.kind, found.a, found.b, found.nullable = kind, a, b, nullable
            self.table[key] = found
        return found

    def _ref(self, name):
        if name not in self.source:
            raise KeyError(f"grammar has no rule {name}")
        return self._node(REF, name, None, name in self.null_names)

    def seq(self, a, b):
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == SEQ:
            return self.seq(a.a, self.seq(a.b, b))
        return self._node(SEQ, a, b, a.nullable and b.nullable)

    def alt(self, parts):
        """Union; sequences with the same head are factored, so that ambiguity nested n deep needs
        n nodes rather than 2**n."""
        heads: dict = {}
        rest = set()
        todo = list(parts)
        while todo:
            x = todo.pop()
            if x.kind == ALT:
                todo.extend(x.a)
            elif x.kind == SEQ:
                heads.setdefault(x.a, set()).add(x.b)
            elif x is not self.empty:
                rest.add(x)
        for head, tails in heads.items():
            if head in rest:
                rest.discard(head)
                tails.add(self.eps)
            rest.add(self.seq(head, self.alt(tails) if len(tails) > 1 else next(iter(tails))))
        if not rest:
            return self.empty
        if len(rest) == 1:
            return next(iter(rest))
        return self._node(ALT, frozenset(rest), None, any(x.nullable for x in rest))

    def star(self, a):
        if a is self.empty or a is self.eps:
            return self.eps
        return self._node(STAR, a, None, True)

    def _build(self, e):
        op = e[0]
        if op == "tok":
            return self._node(TOK, e[1], None, False)
        if op == "ref":
            return self._ref(e[1])
        if op == "seq":
            out = self.eps
            for x in reversed(e[1]):
                out = self.seq(self._build(x), out)
            return out
        if op == "alt":
            return self.alt([self._build(x) for x in e[1]])
        if op == "opt":
            return self.alt([self._build(e[1]), self.eps])
        if op == "star":
            return self.star(self._build(e[1]))
        if op == "plus":
            x = self._build(e[1])
            return self.seq(x, self.star(x))
        if op == "not":
            return self._node(EXCEPT, self._build(e[2]), e[1], False)
        raise ValueError(op)

    def _nullable_names(self):
        """Least fixed point of nullability over the rules."""
        names: set[str] = set()

        def null(e):
            op = e[0]
            if op in ("opt", "star"):
                return True
            if op == "seq":
                return all(null(x) for x in e[1])
            if op == "alt":
                return any(null(x) for x in e[1])
            if op == "plus":
                return null(e[1])
            return op == "ref" and e[1] in names

        while True:
            more = {n for n, e in self.source.items() if n not in names and null(e)}
            if not more:
                return names
            names |= more

    # derivation -------------------------------------------------------------------------------
    def derive(self, x: Lang, token: str) -> Lang:
        found = x.get(token)
        if found is not None:
            return found
        kind = x.kind
        if kind == TOK:
            out = self.eps if x.a == token else self.empty
        elif kind == SEQ:
            out = self.seq(self.derive(x.a, token), x.b)
            if x.a.nullable:
                out = self.alt([out, self.derive(x.b, token)])
        elif kind == ALT:
            out = self.alt([self.derive(y, token) for y in x.a])
        elif kind == STAR:
            out = self.seq(self.derive(x.a, token), x)
        elif kind == REF:
            out = self.derive(self.rules[x.a], token)
        elif kind == EXCEPT:
            out = self.empty if token in x.b else self.derive(x.a, token)
        else:
            out = self.empty
        x[token] = out
        return out

    def trim(self) -> None:
        """Call between texts: bounds the memo."""
        if len(self.table) > self.limit:
            self.__init__(self._text, self._start, self.limit)

    def __new__(cls, text, start, limit=400_000):
        self = super().__new__(cls)
        self._text, self._start = text, start
        return self


_LEX = re.compile(r"\s*(?:#[^\n]*)?(?:'([^'\s]+)'|([A-Za-z_]\w*)|(!\{[^}]*\})|([=;|()?*+]))?")


def _read(text: str) -> dict:
    toks, pos = [], 0
    while pos < len(text):
        m = _LEX.match(text, pos)
        if m.end() == pos:
            raise ValueError(f"grammar: {text[pos:pos + 40]!r}")
        pos = m.end()
        if m[1]:
            toks.append(("tok", m[1]))
        elif m[2]:
            toks.append(("tok", m[2]) if m[2].isupper() else ("ref", m[2]))
        elif m[3]:
            toks.append(("not", frozenset(re.findall(r"'([^'\s]+)'", m[3]))))
        elif m[4]:
            toks.append((m[4],))
    rules, i = {}, 0

    def alternatives(i):
        parts = []
        while True:
            seq = []
            while toks[i][0] not in ("|", ")", ";"):
                item, i = postfix(i)
                seq.append(item)
            parts.append(seq[0] if len(seq) == 1 else ("seq", seq))
            if toks[i][0] != "|":
                return (parts[0] if len(parts) == 1 else ("alt", parts)), i
            i += 1

    def postfix(i):
        t = toks[i]
        if t[0] == "(":
            e, i = alternatives(i + 1)
            assert toks[i][0] == ")"
            i += 1
        elif t[0] == "not":
            e, i = postfix(i + 1)
            return ("not", t[1], e), i
        else:
            e, i = t, i + 1
        while toks[i][0] in ("?", "*", "+"):
            e = ({"?": "opt", "*": "star", "+": "plus"}[toks[i][0]], e)
            i += 1
        return e, i

    while i < len(toks):
        name = toks[i][1]
        assert toks[i][0] == "ref" and toks[i + 1][0] == "=", toks[i : i + 3]
        rules[name], i = alternatives(i + 2)
        assert toks[i][0] == ";", (name, toks[i])
        i += 1
    return rules
