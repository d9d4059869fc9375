"""Sentence boundaries across languages and scripts, by a pushdown automaton.

A text is cut into blocks (blank lines, headings, list items, paragraphs). Open list levels are kept on a
stack by their indentation and last number, so that an item knows its level and a number that a line break has
moved to the start of a line opens none. Within a paragraph the
automaton moves from one mark of interest to the next and keeps the open quotations and brackets on a
stack: a terminator ends a sentence only where the stack is empty, or where closing the last quotation
or bracket leaves nothing else of the sentence. Abbreviations are looked up in a trie read backwards
from the full stop; scripts without spaces or capitals have their own terminators.

Defined results: null, empty and blank texts give no sentences; offsets count characters; no sentence
begins or ends with white space.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Abbreviations that never end a sentence, and those that may where a capital follows.
NEVER = (
    "mr mrs ms dr prof st sr sra srta dra mme mlle mm fig figs no nos nr vs cf e.g i.e eg ie sec ch p pp vol approx ca mind bzw z d u p.s ps op resp incl excl "
    "min max gen rev hon capt col sgt lt art núm pág págs n ed eds eq eqs ref refs hr fr hl str abb bd kap evtl ggf sog vgl zzgl bspw etwa geb allg "
    "ex ej env av réf chap st ste т е напр см стр рис табл им ул гл тыс млн млрд руб тов проф акад डॉ श्री पृ सं प्रो د أ م ص ee tel dept est cap"
).split()
MAY = "etc al inc ltd co corp a.m p.m u.s u.k u.n usw uu г гг д п др ж в jr ph.d b.c a.d u.a o.ä etc cie sa s.a gmbh ag jan feb mar apr jun jul aug sep sept oct nov dec okt dez".split()
_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split()
_DE_BEFORE_ORDINAL = "dem den der die das am im vom zum zur seit bis des jeden jedem jeder ab beim ins und".split()
OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "〈": "〉", "《": "》", "»": "«"}
CLOSERS = "\"”“»›」』)）]】〉》’'"
_STOP = re.compile(r"[.!?…。！？｡．؟۔।॥\"“”„«»‹›「」『』()（）\[\]【】〈〉《》]|\s+")
_RUN = re.compile(r"[.!?…。！？｡．؟۔।॥]+")
_FULL = "。！？｡．"
_CASELESS = "؟۔।॥"
_THAI = re.compile(r"[฀-๿]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_HEADING = re.compile(r"[ \t]*(#{1,6})[ \t]+(?=\S)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦▪·–][ \t]+|\(?(?:\d{1,3}|[a-z])[.)][ \t]+|\d{1,3}[、．])(?:\[[ xX]\][ \t]+)?(?=\S)")
_DIGITS = re.compile(r"\d+")
_QUOTE = re.compile(r"[ \t]*(?:(?:>+|//+[!/]?|#+|--+|;+|%+|\*+)[ \t]+)+(?=\S)")
_JA_GOES_ON = "とっのはがをにでもへやか、，"
_ZH_GOES_ON = "，、：；的地得后之等"


class Trie:
    """Abbreviations, read backwards from the full stop."""

    def __init__(self, never, may):
        self.root: dict = {}
        for words, kind in ((may, "may"), (never, "never")):
            for w in words:
                node = self.root
                for c in reversed(w):
                    node = node.setdefault(c, {})
                node[""] = kind

    def find(self, text: str, stop: int, begin: int) -> str | None:
        """The kind of the abbreviation that ends before ``stop``, if a word begins where it begins."""
        node, i, found = self.root, stop - 1, None
        while i >= begin:
            node = node.get(text[i].lower())
            if node is None:
                break
            if "" in node and (i == begin or not (text[i - 1].isalnum() or text[i - 1] in "_./-")):
                found = node[""]
            i -= 1
        return found


_ABBREVIATIONS = Trie(NEVER, MAY)
_TOKEN = re.compile(r"\S+")


def _starts(text: str, at: int, end: int) -> str:
    """What follows: ``end``, ``start`` (of a sentence), ``lower`` (a plain word in lower case)."""
    m = _TOKEN.search(text, at, end)
    if not m:
        return "end"
    word = m[0].lstrip("\"“„«‹「『(（[【*_~'‘¿¡`")
    if word != m[0] and m[0][0] in "`¿¡":
        return "start"
    if not word:
        word = m[0]
    if word[0].islower():
        plain = word.rstrip(".,;:!?)\"”»'’…")
        return "lower" if plain.replace("-", "").replace("'", "").replace("’", "").isalpha() and plain[1:] == plain[1:].lower() else "start"
    return "start"


def _block(text: str, begin: int, end: int, out: list) -> None:
    """Sentences of the prose between two offsets."""
    first = begin
    while first < end and text[first].isspace():
        first += 1
    start, stack = first, []

    def emit(stop):
        nonlocal start
        a, b = start, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        start = stop

    first_of: dict[int, int] = {}  # the first character of a sentence that is no space
    ahead: dict[str, int] = {}  # where a closing mark comes next

    def fresh(at):
        if start not in first_of:
            first_of.clear()
            first_of[start] = _skip(text, start, end)
        return first_of[start] >= at

    def follows_closing(c, pos):
        """Whether the mark stands at ``pos`` or later; every stretch is searched once."""
        found = ahead.get(c, -1)
        if found < pos:
            found = text.find(c, pos, end)
            ahead[c] = found = end if found < 0 else found
        return found < end

    pos = first
    while pos < end:
        m = _STOP.search(text, pos, end)
        if not m:
            break
        at, c = m.start(), m[0][0]
        pos = m.end()
        if c.isspace():
            if not stack and _THAI.match(text, pos) and at > start and _thai_before(text, start, at):
                emit(at)
            continue
        if c == '"':
            if stack and stack[-1][0] == '"':
                c = "close"
            elif (at == 0 or not text[at - 1].isalnum()) and pos < end and not text[pos].isspace() and follows_closing('"', pos):
                stack.append(('"', '"', fresh(at)))
                continue
            else:
                continue
        elif stack and c in stack[-1][1]:
            c = "close"
        elif c in OPEN:
            if any(follows_closing(x, pos) for x in OPEN[c]):
                stack.append((c, OPEN[c], fresh(at)))
            continue
        elif c in CLOSERS:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if text[at] in stack[i][1]), None)
            if depth is not None:
                del stack[depth + 1 :]
                c = "close"
            else:
                continue
        if c == "close":
            _, _, whole = stack.pop()
            if stack:
                continue
            k = at - 1
            while k > start and text[k].isspace():
                k -= 1
            if text[k] not in ".!?…。！？｡．؟۔।॥" or text[max(start, k - 2) : k + 1] == "...":
                continue
            while pos < end and text[pos] in CLOSERS and text[pos] not in OPEN:
                pos += 1
            run = _RUN.match(text, pos, end)
            if run:  # the sentence's own terminator follows
                continue
            nxt = text[pos] if pos < end else ""
            follows = _starts(text, pos, end)
            if follows == "end":
                emit(pos)
            elif nxt.isspace():
                if follows == "start" and (whole or not _CJK.match(text, _skip(text, pos, end)) or text[at] not in "”」』）"):
                    emit(pos)
            elif whole and nxt not in _ZH_GOES_ON and nxt not in ",;:，；：" and (_CJK.match(nxt) or nxt in OPEN or nxt.isalnum()):
                if nxt not in _JA_GOES_ON:
                    emit(pos)
            continue
        # a terminator
        run = _RUN.match(text, at, end)
        pos = run.end()
        if stack:
            continue
        marks = run[0]
        stop = pos
        while stop < end and text[stop] in CLOSERS and (text[stop] not in OPEN or text[stop] in "”’"):
            if text[stop] == '"' and stop + 1 < end and not text[stop + 1].isspace() and text[stop + 1] not in CLOSERS:
                break
            stop += 1
        if any(x in _FULL for x in marks) or any(x in _CASELESS for x in marks):
            emit(stop)
            pos = stop
            continue
        follows = _starts(text, stop, end)
        if follows == "end":
            emit(stop)
            pos = stop
            continue
        if not text[stop].isspace():
            # the space after a sentence may be missing
            nxt = text[stop]
            if marks[-1] in "!?":
                glued = bool(_CJK.match(nxt)) or nxt.isupper() or nxt in "¿¡«„“"
            else:
                word = _TOKEN.search(text, stop, end)[0]
                glued = marks == "." and at > start and (text[at - 1].islower() or text[at - 1] in ")\"”»") and (
                    nxt in "¿¡«„“" or len(word) > 1 and nxt.isupper() and word[1:].isalpha() and word[1:].islower()
                )
            if glued:
                emit(stop)
                pos = stop
            continue
        if marks.startswith("..") or "…" in marks:
            if at > start and not text[at - 1].isspace() and follows == "start" and not _CJK.match(text, at - 1):
                emit(stop)
                pos = stop
            continue
        if marks == ".":
            kind = _ABBREVIATIONS.find(text, at, start)
            w = at - 1
            while w >= start and not text[w].isspace():
                w -= 1
            word = text[w + 1 : at]
            bare = word.lstrip("(\"“„«[（'")
            nxt = _TOKEN.search(text, stop, end)[0]
            if kind == "never":
                if bare.lower() in ("no", "min", "max", "art", "col", "est", "cap", "ex", "ed", "fig", "str") and not nxt[0].isdigit() and not bare[0].isupper():
                    pass
                elif bare.lower() == "no" and not nxt[0].isdigit():
                    pass
                else:
                    continue
            elif kind == "may":
                if follows == "lower" or bare[:3].lower() in ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "okt", "dez") and nxt[0].isdigit():
                    continue
            elif len(bare) == 1 and bare.isalpha() and bare.isupper() and not _CJK.match(bare):
                continue
            elif bare.isdigit():
                if nxt.strip(".,;:") in _MONTHS or (_word_before(text, start, w + 1).lower() in _DE_BEFORE_ORDINAL and nxt[0].isupper()):
                    continue
            if follows == "lower":
                continue
        elif follows == "lower":
            continue
        emit(stop)
        pos = stop
    emit(end)


def _skip(text, at, end):
    while at < end and text[at].isspace():
        at += 1
    return at


def _word_before(text, start, at) -> str:
    while at > start and text[at - 1].isspace():
        at -= 1
    begin = at
    while begin > start and not text[begin - 1].isspace():
        begin -= 1
    return text[begin:at]


def _thai_before(text, start, at) -> bool:
    return bool(_THAI.search(text, start, at))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in order."""
    return [x[:2] for x in leveled(text)]


def leveled(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, list level) of each sentence, in order; the level is 0 outside lists."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int, int]] = []
    lines, at = [], 0  # runs of lines that are not blank
    for line in text.split("\n"):
        if line.strip():
            lines.append((at, at + len(line)))
        elif lines:
            _paragraph(text, lines, out)
            lines = []
        at += len(line) + 1
    if lines:
        _paragraph(text, lines, out)
    return out


def _whole(text, a, b, out, level=0):
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if b > a:
        out.append((a, b, level))


class _Wrapped:
    """Whether the marked lines from a line on are one hard-wrapped paragraph rather than items of a list:
    all are marked, long, and one runs on in lower case. Answered from sums over the lines behind."""

    def __init__(self, text, lines, marks):
        n = len(lines)
        self.marked, self.size, self.runs = [True] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        after = ""
        for i in range(n - 1, -1, -1):
            body = text[marks[i].end() : lines[i][1]].strip() if marks[i] else ""
            self.marked[i] = self.marked[i + 1] and marks[i] is not None
            self.size[i] = self.size[i + 1] + len(body)
            self.runs[i] = self.runs[i + 1] or bool(body and after and body[-1] not in ".!?。！？…" and after[0].islower())
            after = body
        self.n = n

    def __call__(self, i) -> bool:
        count = self.n - i
        return count >= 2 and self.marked[i] and self.runs[i] and self.size[i] >= 36 * count


class _Levels:
    """The stack of open list levels: indentation and, for numbered ones, the last number. A mark deeper than
    the innermost level opens one, a mark at less depth closes those inside; a number that neither opens a
    list nor follows the last one of its level is no mark but text that a line break has moved there."""

    def __init__(self):
        self.stack: list[list] = []

    def item(self, mark) -> bool:
        raw = mark[0].expandtabs(4)
        indent = len(raw) - len(raw.lstrip())
        digits = _DIGITS.search(raw)
        number = int(digits[0]) if digits else None
        depth = len(self.stack)
        while depth and self.stack[depth - 1][0] > indent:
            depth -= 1
        same = self.stack[depth - 1] if depth and self.stack[depth - 1][0] == indent else None
        if number is not None and self.stack and number > 1 and not (same and same[1] is not None and number - same[1] in (0, 1)):
            return False
        del self.stack[depth:]
        if same:
            same[1] = number
        else:
            self.stack.append([indent, number])
        return True


def _paragraph(text: str, lines: list, out: list) -> None:
    """The sentences of a run of lines that are not blank: headings, then one list or one piece of prose,
    in which a list may follow."""
    n = len(lines)
    marks = [_ITEM.match(text, a, b) for a, b in lines]
    wrapped = _Wrapped(text, lines, marks)
    i = 0
    while i < n:
        head = _HEADING.match(text, *lines[i])
        below = i + 1 < n and text[lines[i + 1][0] : lines[i + 1][1]].lstrip().startswith("#")
        if head and (not below or len(head[1]) > 1):
            _whole(text, head.end(), lines[i][1], out)
            i += 1
        elif marks[i] and not wrapped(i):
            _list(text, lines[i:], marks[i:], out)
            return
        else:
            i = _prose(text, lines, marks, wrapped, i, out)


def _list(text, lines, marks, out) -> None:
    levels, start, level = _Levels(), None, 0
    for (a, _), m in zip(lines, marks):
        if m and levels.item(m):
            if start is not None:
                _whole(text, start, a, out, level)
            start, level = m.end(), len(levels.stack)
    _whole(text, start, lines[-1][1], out, level)


def _prose(text, lines, marks, wrapped, i, out) -> int:
    """The sentences of the prose from line ``i`` on; gives the line at which a list goes on without a blank
    line between, or the number of lines."""
    n = len(lines)
    quote = _QUOTE.match(text, *lines[i])
    stop = n
    for k in range(i + 1, n):
        number = marks[k] and _DIGITS.search(marks[k][0])
        opens = marks[k] and (not number or int(number[0]) <= 1)  # a wrapped "5." is no list
        if opens and not quote and not wrapped(k):
            before = text[lines[k - 1][0] : lines[k - 1][1]].rstrip()
            if before[-1:] in ":：" or n - k > 1 and wrapped.marked[k]:
                stop = k
                break
    got: list = []
    _block(text, quote.end() if quote else lines[i][0], lines[stop - 1][1], got)
    if quote and n - i > 1:  # a sentence that begins with a later line begins after its mark
        begins = {a for a, _ in lines[i + 1 :]}
        for a, b in got:
            m = _QUOTE.match(text, a, b) if a in begins or text[a - 1 : a] == "\n" else None
            _whole(text, m.end() if m else a, b, out)
    else:
        out.extend((a, b, 0) for a, b in got)
    return stop


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sentence`` (from 1), ``start_pos, end_pos, level, text``: the sentences of every document in
    order, with the level of the list that an item belongs to (0 outside lists).
    Rows with a null key are dropped; of rows that repeat key and text one is kept."""
    data = spread(documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = dict(data.dtypes)["key"]

    def run(batches):
        for b in batches:
            rows = [
                (k, n, s, e, level, t[s:e])
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for n, (s, e, level) in enumerate(leveled(t), 1)
            ]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [b.schema.field(0).type, *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "sentence", "start_pos", "end_pos", "level", "text"])

    got = data.mapInArrow(run, f"key {kind}, sentence bigint, start_pos bigint, end_pos bigint, level bigint, text string")
    return got.dropDuplicates(["key", "start_pos", "end_pos"]).withColumnRenamed("key", key)
