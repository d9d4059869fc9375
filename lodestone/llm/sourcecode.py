"""Syntax and documentation of source files as DataFrame operators.

Both read each file once, in Arrow batches, without moving contents over the network: only paths and
findings leave a task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .docpairs import valid_pairs
from .syntax import verdict


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def syntax_errors(files: DataFrame, path: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each file that is not valid for its extension: ``path``, ``kind`` (``rejected`` with the failing
    token, ``truncated`` where the text stops too early), ``line``, ``token`` and the columns of ``keep``.

    Repeated rows give one row. Null paths or contents, empty contents and extensions other than py, js,
    jsx, ts and tsx count as valid. Names of other columns do not matter."""
    data = files.select(F.col(path).alias("path"), F.col(content).alias("content"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])

    def run(batches):
        for b in batches:
            rows = []
            keeps = [_column(b, f"keep_{i}") for i in range(len(keep))]
            for i, (p, c) in enumerate(zip(_column(b, "path"), _column(b, "content"))):
                bad = verdict(p, c) if p and c else None
                if bad:
                    rows.append((p, *bad, *[k[i] for k in keeps]))
            cols = list(zip(*rows)) if rows else [[] for _ in range(4 + len(keep))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]
                + [pa.array(c, pa.string()) for c in cols[4:]],
                ["path", "kind", "line", "token", *[f"keep_{i}" for i in range(len(keep))]],
            )

    schema = "path string, kind string, line bigint, token string" + "".join(f", keep_{i} string" for i in range(len(keep)))
    out = spread(data).mapInArrow(run, schema).dropDuplicates()
    return out.select("path", "kind", "line", "token", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def language_of(path) -> F.Column:
    """The language that an extension stands for; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "py", "python").when(ext.isin("js", "jsx"), "javascript").when(ext.isin("ts", "tsx"), "typescript")


def syntax_rates(files: DataFrame, repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """Files, invalid files and their share for each repository and language; a path counts once."""
    bad = syntax_errors(files, path, content).select("path").distinct().withColumn("bad", F.lit(1))
    every = files.select(F.col(repo).alias("repo"), F.col(path).alias("path")).distinct()
    return (
        every.join(bad, "path", "left")
        .groupBy("repo", language_of(F.col("path")).alias("language"))
        .agg(F.count("*").alias("files"), F.sum(F.coalesce("bad", F.lit(0))).cast("bigint").alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 4))
    )


def documented_functions(files: DataFrame, path: str = "path", content: str = "content", min_words: int = 4, min_han: int = 8) -> DataFrame:
    """Code-description pairs: ``path``, ``name``, ``line``, ``args``, ``description``, ``docstring``,
    ``code``, one row for each documented function of each file that parses.

    Repeated rows give one row, as do versions of a path that document a function on one line (the least in
    the order of the columns); null or empty contents give none; ``min_words`` and ``min_han`` say how
    much a description must say beyond the function's own name."""
    data = files.select(F.col(path).alias("path"), F.col(content).alias("content"))

    def run(batches):
        for b in batches:
            rows = [(p, *f) for p, c in zip(_column(b, "path"), _column(b, "content")) if p and c for f in valid_pairs(p, c, min_words, min_han)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int64()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "name", "line", "args", "description", "docstring", "code"])

    found = spread(data).mapInArrow(run, "path string, name string, line bigint, args string, description string, docstring string, code string")
    one = F.min(F.struct("args", "description", "docstring", "code")).alias("x")
    return found.groupBy("path", "name", "line").agg(one).select("path", "name", "line", "x.*")
