"""Queries of the parsers, over every source file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..session import spread, table
from .catalog import query


def _found(spark, d, what):
    """What a parser finds in every file; findings, not contents, are made distinct."""
    return P.extract(spread(table(spark, d, "source_files").select("path", "content")), what).distinct()


@query()
def parse_modules(spark, d):
    m = P.modules_of(spread(table(spark, d, "source_files").select("path", "content")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return m.select("path", "language", "total_lines", *[F.greatest(size(c), F.lit(0)).alias(c) for c in ("functions", "classes", "interfaces", "components", "imports")], "error").distinct()


@query()
def parse_call_sites(spark, d):
    return _found(spark, d, "call_sites")


@query()
def cfg_complexity(spark, d):
    return _found(spark, d, "control_flow")


@query()
def flow_blocks(spark, d):
    return _found(spark, d, "flow_blocks")


@query()
def flow_edges(spark, d):
    return _found(spark, d, "flow_edges")


@query()
def def_use_edges(spark, d):
    return _found(spark, d, "definitions_uses")


@query()
def taint_flows(spark, d):
    return _found(spark, d, "taint_flows")


@query()
def ddl_parse(spark, d):
    return _found(spark, d, "ddl")


@query()
def orm_parse(spark, d):
    return _found(spark, d, "orm")
