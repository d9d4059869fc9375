"""Queries of the code search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..session import table
from .catalog import query


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _matches(name, pattern, where=""):
    return f"""SELECT {_text(name)} AS name, path, language, i, pieces, found, content FROM (SELECT path, language, content, string_split_regex(content, {_text(pattern)}) AS pieces, regexp_extract_all(content, {_text(pattern)}) AS found, unnest(range(1, len(regexp_extract_all(content, {_text(pattern)})) + 1)) AS i
 FROM f{where})"""


_F = "f AS (SELECT DISTINCT path, content, lower(language) AS language FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL)"
_BEFORE = "array_to_string(list_slice(pieces, 1, i), '') || coalesce(array_to_string(list_slice(found, 1, i - 1), ''), '')"
_ROW = f"name, path, CAST(len(string_split({_BEFORE}, chr(10))) AS BIGINT) AS line, substr(found[i], 1, 100) AS match"
_ALL = " UNION ALL ".join(_matches(n, p) for n, (_, p, _) in S.PATTERNS.items())
_OWN = " UNION ALL ".join(_matches(n, p, " WHERE language IN ('" + "', '".join(g) + "')") for n, (_, p, g) in S.PATTERNS.items())


@query(f"WITH {_F}, x AS ({_ALL}) SELECT DISTINCT {_ROW}, length({_BEFORE}) AS position FROM x")
def pattern_search(spark, d):
    """All nine patterns in all files."""
    return S.search(table(spark, d, "source_files")).select("name", "path", "line", "match", "position").distinct()


@query(
    f"WITH {_F}, x AS ({_OWN}), y AS (SELECT DISTINCT {_ROW}, language, length({_BEFORE}) AS a, content, found[i] AS whole FROM x) SELECT name, path, line, match, language, substr(replace(substr(content, greatest(a - 39, 1), a - greatest(a - 40, 0) + length(whole) + 40), chr(10), ' '), 1, 120) AS context FROM y"
)
def pattern_search_by_language(spark, d):
    """The patterns in files of their languages, with what stands around a match."""
    return S.search(table(spark, d, "source_files"), language="language").select("name", "path", "line", "match", "language", "context")


@query(
    f"WITH {_F}, x AS ({_matches('custom', '(?i)todo[^a-z]|fixme')}) SELECT DISTINCT {_ROW}, length({_BEFORE}) AS position FROM x"
)
def custom_search(spark, d):
    return S.search_custom(table(spark, d, "source_files"), "todo[^a-z]|fixme").select("name", "path", "line", "match", "position").distinct()


@query("SELECT 'Invalid regex: (open' AS error")
def custom_search_error(spark, d):
    return S.search_custom(table(spark, d, "source_files"), "(open").select("error")


@query("SELECT * FROM (VALUES " + ", ".join(f"({_text(n)}, {_text(label)}, {_text(','.join(g))})" for n, (label, _, g) in S.PATTERNS.items()) + ") t(name, label, languages)")
def pattern_list(spark, d):
    return S.catalogue(spark)
