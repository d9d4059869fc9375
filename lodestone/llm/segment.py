"""Splitting oversized texts at natural boundaries, by lexical cohesion.

The units of a text are its lines; a line that is itself over the limit becomes several units, cut at
sentence ends or blanks. At every unit boundary the words of a block before it are compared with those
of a block after it (cosine); the depth of a valley says how much the vocabulary changes there. Each
piece ends at the deepest valley of its window, and the next piece begins up to ``overlap`` characters
earlier, at a unit or word boundary.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]{2,}|[぀-ヿ㐀-鿿]")
_BREAK = re.compile(r"(?<=[.!?。！？；;…])\s+|(?<=[。！？；…])|\s+|(?<=[,，、])")


def units(text: str, size: int, overlap: int = 0) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end without the line feed) of each unit, and the numbers of the lines over ``size``. Units of
    a line over ``size`` leave room for an overlap."""
    out, long_lines, at, most = [], [], 0, max(1, size - overlap)
    for number, line in enumerate(text.split("\n"), 1):
        end = at + len(line)
        if len(line) <= size:
            out.append((at, end))
        else:
            long_lines.append(number)
            start, last, target = at, at, max(1, size // 4)
            for m in _BREAK.finditer(text, at, end):
                cut = m.end()
                if cut - start > most and last > start:
                    out.append((start, last))
                    start = last
                if cut - start >= target:
                    while cut - start > most:  # no boundary in reach
                        out.append((start, start + most))
                        start += most
                    if cut > start:
                        out.append((start, cut))
                    start = last = cut
                else:
                    last = cut
            if end - start > most and last > start:
                out.append((start, last))
                start = last
            while end - start > most:
                out.append((start, start + most))
                start += most
            if end > start:
                out.append((start, end))
        at = end + 1
    return out, long_lines


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    dot = sum(v * b[w] for w, v in a.items() if w in b)
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def depths(bags: list[Counter], block: int = 6) -> list[float]:
    """The depth of the valley after each unit: how far the similarity rises on both sides."""
    n = len(bags)
    sims = []
    left, right = Counter(), Counter()
    for b in bags[1 : 1 + block]:
        right += b
    for i in range(n - 1):
        left += bags[i]
        if i - block >= 0:
            left -= bags[i - block]
        sims.append(_cosine(left, right))
        right -= bags[i + 1]
        if i + 1 + block < n:
            right += bags[i + 1 + block]
    # the peak on either side is that of the run that falls towards the boundary
    left_peak, right_peak = list(sims), list(sims)
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            left_peak[i] = left_peak[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right_peak[i] = right_peak[i + 1]
    return [round(p + q - 2 * s, 9) for p, q, s in zip(left_peak, right_peak, sims)] + [0.0]


_OVERLAP_AT = re.compile(r"\s(?=\S)|[。！？，、；：…](?=\S)")


def pieces(text: str, size: int = 2000, overlap: int = 200) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end) of each piece, at most ``size`` characters long, and the lines that had to be cut.

    A piece ends at the deepest valley of its window, which begins ``overlap`` characters into what the piece
    adds to the one before and ends where ``size`` is reached; of equal valleys the last one counts. The
    windows only move forward, so their deepest valleys are kept in a queue and a text costs linear time."""
    cells, long_lines = units(text, size, overlap)
    deep = depths([Counter(w.lower() for w in _WORD.findall(text[a:b])) for a, b in cells])
    out, i, start, n = [], 0, 0, len(cells)
    queue: deque[int] = deque()  # falling depths of the window
    j, low = -1, 0
    while i < n:
        while j + 1 < n and (cells[j + 1][1] - start <= size or j < i):
            j += 1
            while queue and deep[queue[-1]] <= deep[j]:
                queue.pop()
            queue.append(j)
        if j == n - 1:
            out.append((start, max(start, len(text)) if len(text) - start <= size else cells[j][1]))
            break
        low = max(low, i)
        while low < j and cells[low][1] - cells[i][0] < overlap:
            low += 1
        while queue[0] < low:
            queue.popleft()
        cut = queue[0]
        end = cells[cut][1]
        out.append((start, end))
        i = cut + 1
        room = min(overlap, size - (cells[i][1] - cells[i][0]) - 1)
        start, k = cells[i][0], cut
        while k >= 0 and end - cells[k][0] <= room and cells[k][0] > out[-1][0]:
            start = cells[k][0]
            k -= 1
        if start == cells[i][0] and room > 0:  # no whole unit fits: begin after a blank or mark
            least = max(out[-1][0] + 1, end - room)
            m = _OVERLAP_AT.search(text, least - 1, end)
            start = m.end() if m and m.end() < end else least  # without a boundary any place will do
    return out, long_lines


def split_oversized(
    chunks: DataFrame,
    key: str = "chunk_id",
    text: str = "text",
    start_line: str = "start_line",
    max_bytes: int = 6000,
    size: int = 2000,
    overlap: int = 200,
) -> DataFrame:
    """One row per piece: the columns of ``chunks`` are reduced to ``key``; added are ``piece`` (from 1),
    ``pieces``, ``text``, ``start_line``, ``end_line``, ``start_char``, ``end_char`` and ``cut_lines``
    (numbers within the text of the lines over ``size``).

    Texts of up to ``max_bytes`` UTF-8 bytes stay whole (one piece, ``pieces`` = 1), as do null and empty
    texts; rows with a null key stay whole as well. Of rows that repeat a key one is kept. Where the start
    line is null or 0 it counts as 1. The pieces of a text cover it but for line feeds at cuts, and
    consecutive ones share at most ``overlap`` characters. Only long texts reach Python."""
    data = chunks.select(F.col(key).alias("key"), F.col(text).alias("text"), F.greatest(F.coalesce(F.col(start_line), F.lit(1)), F.lit(1)).cast("bigint").alias("line"))
    over = (F.octet_length("text") > max_bytes) & F.col("key").isNotNull()
    lines = F.length("text") - F.length(F.translate("text", "\n", ""))
    whole = data.where(~F.coalesce(over, F.lit(False))).select(
        "key",
        F.lit(1).cast("bigint").alias("piece"),
        F.lit(1).cast("bigint").alias("pieces"),
        "text",
        F.col("line").alias("start_line"),
        (F.col("line") + F.coalesce(lines, F.lit(0))).alias("end_line"),
        F.lit(0).cast("bigint").alias("start_char"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("end_char"),
        F.lit(None).cast("array<bigint>").alias("cut_lines"),
    )
    names = ["key", "piece", "pieces", "text", "start_line", "end_line", "start_char", "end_char", "cut_lines"]

    def run(batches):
        for b in batches:
            rows = []
            for k, t, line in zip(*(b.column(i).to_pylist() for i in range(3))):
                got, long_lines = pieces(t, size, overlap)
                for n, (s, e) in enumerate(got, 1):
                    first = line + t.count("\n", 0, s)
                    rows.append((k, n, len(got), t[s:e], first, first + t.count("\n", s, e), s, e, long_lines))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [b.schema.field(0).type, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kind = dict(data.dtypes)["key"]
    schema = f"key {kind}, piece bigint, pieces bigint, text string, start_line bigint, end_line bigint, start_char bigint, end_char bigint, cut_lines array<bigint>"
    cut = data.where(over).mapInArrow(run, schema)
    # repeated rows are removed by key; rows without one cannot repeat and bypass the shuffle
    keyed = whole.where("key IS NOT NULL").unionByName(cut).dropDuplicates(["key", "piece"])
    return keyed.unionByName(whole.where("key IS NULL")).withColumnRenamed("key", key)


def oversized_pieces(chunks: DataFrame, key: str = "chunk_id", text: str = "text", start_line: str = "start_line", max_bytes: int = 6000, **how) -> DataFrame:
    """The pieces of the texts that had to be split, without the texts that stay whole."""
    return split_oversized(chunks.where(F.octet_length(text) > max_bytes), key, text, start_line, max_bytes, **how)
