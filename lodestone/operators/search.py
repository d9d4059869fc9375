"""Searching code: a catalogue of named patterns, and patterns of one's own."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The named patterns, what they are called and for which languages they are meant.
PATTERNS = {
    "env_read_py": ("Environment variable reads (Python)", r"os\.environ(?:\[|\.get)|\bos\.getenv\b", ["python"]),
    "env_read_ts": ("Environment variable reads (TypeScript)", r"process\.env\.\w+", ["typescript", "javascript"]),
    "sql_query": ("SQL query execution", r"\.execute\s*\(|\.executemany\s*\(|executemany\s*\(|\.raw\s*\(", ["python"]),
    "http_request": ("HTTP requests", r"(?:requests|httpx|aiohttp)\.(?:get|post|put|delete|patch)\s*\(|fetch\s*\(.*['\"]https?://", ["python", "typescript", "javascript"]),
    "file_write": ("File write operations", r"open\s*\([^)]*['\"][wa][^'\"]*['\"]|\.write_text\s*\(|writeFileSync|fs\.writeFile", ["python", "typescript", "javascript"]),
    "exception_handling": ("Exception handling", r"\btry\s*:|\bexcept\s+|\bcatch\s*\(|\bthrow\s+new\s+Error", ["python", "typescript", "javascript"]),
    "async_pattern": ("Async/await patterns", r"\basync\s+def\b|\basync\s+\(|\bawait\s+\w+", ["python", "typescript", "javascript"]),
    "use_state": ("React useState hooks", r"\buseState\s*<\s*\w+\s*>|\buseState\s*\(|const\s*\[\s*\w+\s*,\s*\w+\s*\]\s*=\s*useState", ["typescript", "javascript"]),
    "decorator_pattern": ("Python decorators", r"@\w+(?:\.\w+)*(?:\([^)]*\))?\s*\n\s*(?:def|class)\s+\w+", ["python"]),
}
_FOUND = "name string, path string, language string, position bigint, line bigint, match string, context string, error string"


def catalogue(spark: SparkSession) -> DataFrame:
    """``name, label, languages``: the patterns there are."""
    return spark.createDataFrame([(n, label, ",".join(langs)) for n, (label, _, langs) in PATTERNS.items()], "name string, label string, languages string")


def _search(files: DataFrame, patterns: list[tuple[str, re.Pattern, list[str] | None]], path: str, content: str, language: str | None) -> DataFrame:
    """Every match of every pattern in each text, read where it lies; only findings are shuffled."""
    lang = F.lower(F.col(language)) if language else F.lit(None).cast("string")
    data = files.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(F.col(path).alias("path"), lang.alias("language"), F.col(content).alias("content"))
    wanted = {x for _, _, langs in patterns for x in langs or ()}
    if language and all(langs for _, _, langs in patterns):
        data = data.where(F.col("language").isin(sorted(wanted)))

    def run(batches):
        for b in batches:
            rows = []
            for p, g, text in zip(*(c.to_pylist() for c in b.columns)):
                for name, rx, langs in patterns:
                    if langs and language and g not in langs:
                        continue
                    line, at = 1, 0
                    for m in rx.finditer(text):
                        line += text.count("\n", at, m.start())
                        at = m.start()
                        context = text[max(0, m.start() - 40) : m.end() + 40].replace("\n", " ")[:120]
                        rows.append((name, p, g, at, line, m[0][:100], context, None))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    return data.mapInArrow(run, _FOUND).dropDuplicates(["name", "path", "position", "match"])


def search(files: DataFrame, names: list[str] | None = None, path: str = "path", content: str = "content", language: str | None = None) -> DataFrame:
    """``name, path, language, position`` (from 0), ``line`` (from 1), ``match`` (100 characters of it),
    ``context`` and ``error`` (null) of the named patterns, all of them if none are given. With a column of
    languages a pattern looks only at files of its own. Unknown names find nothing; repeated rows count once."""
    chosen = [(n, re.compile(PATTERNS[n][1], re.M), PATTERNS[n][2] if language else None) for n in names or PATTERNS if n in PATTERNS]
    return _search(files, chosen, path, content, language)


def search_custom(files: DataFrame, pattern: str, languages: list[str] | None = None, path: str = "path", content: str = "content", language: str | None = None) -> DataFrame:
    """The same for one pattern, without regard to case; a pattern that cannot be read gives one row with
    ``error``."""
    try:
        rx = re.compile(pattern, re.M | re.I)
    except re.error:
        return files.sparkSession.createDataFrame([(None,) * 7 + (f"Invalid regex: {pattern}",)], _FOUND)
    return _search(files, [("custom", rx, languages)], path, content, language)
