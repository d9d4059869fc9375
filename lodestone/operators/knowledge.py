"""The knowledge graph of a code base, chunks of its entities, and texts made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import role, slashes
from . import resolve as R
from .windows import top_per_group


def names_only(column: str):
    """A column of entities reduced to what a graph needs of them: names, bases and the names of methods."""
    named = lambda x: F.struct(x["name"].alias("name"))
    if column == "classes":
        kept = F.transform(column, lambda c: F.when(c.isNotNull(), F.struct(c["name"].alias("name"), c["bases"].alias("bases"), F.transform(c["methods"], lambda m: F.when(m.isNotNull(), named(m))).alias("methods"))))
    else:
        kept = F.transform(column, lambda x: F.when(x.isNotNull(), named(x)))
    return kept.alias(column)


def build(modules: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, type, name``) and edges (``src, dst, relation``): modules, classes, functions, methods and
    interfaces; CONTAINS, INHERITS, IMPLEMENTS, IMPORTS and CALLS, the last two only between known nodes."""
    m = modules.select(slashes(F.col("path")).alias("module"), "functions", "classes", "interfaces")
    ident = lambda *c: F.concat_ws("::", "module", F.concat_ws(".", *c))
    c = m.select("module", F.explode("classes").alias("c")).where("c IS NOT NULL AND c.name IS NOT NULL")
    f = m.select("module", F.explode("functions").alias("f")).where("f IS NOT NULL AND f.name IS NOT NULL")
    g = c.select("module", F.col("c.name").alias("cls"), F.explode("c.methods").alias("f")).where("f IS NOT NULL AND f.name IS NOT NULL")
    i = m.select("module", F.explode("interfaces").alias("i")).where("i IS NOT NULL AND i.name IS NOT NULL")
    kinds = [
        m.select(F.col("module").alias("id"), F.lit("module").alias("type"), F.col("module").alias("name"), F.lit(None).cast("string").alias("parent")),
        c.select(ident("c.name"), F.lit("class"), "c.name", "module"),
        f.select(ident("f.name"), F.lit("function"), "f.name", "module"),
        g.select(ident("cls", "f.name"), F.lit("method"), "f.name", ident("cls")),
        i.select(ident("i.name"), F.lit("interface"), "i.name", "module"),
    ]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.union(k)
    nodes = every.groupBy("id").agg(F.min(F.struct("type", "name")).alias("x")).select("id", "x.*")
    edges = every.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("relation"))
    edges = edges.union(R.inherits(modules).select("child", "parent", F.lit("INHERITS")))
    edges = edges.union(R.implements(modules).select(ident("cls"), ident("interface"), F.lit("IMPLEMENTS")))
    known = nodes.select(F.col("id").alias("src"))
    both = imports.select("src", "dst", F.lit("IMPORTS").alias("relation")).union(calls.select("src", "dst", F.lit("CALLS")))
    both = both.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "relation")
    return nodes, edges.union(both).distinct()


def entity_chunks(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``source, title, symbol_name, symbol_type, parent_class, start_line, end_line, text``: one chunk per
    function, method, class, interface and component: header lines, documentation and the source lines."""
    none = F.lit(None).cast("string")

    def entity(x, kind, parent=none, doc=True):
        return F.struct(
            x["name"].alias("symbol_name"), F.lit(kind).alias("symbol_type"), parent.alias("parent_class"), x["anchor"]["line"].alias("start_line"), x["end_line"].alias("end_line"),
            (x["docstring"] if doc else none).alias("doc"),
        )

    def each(column, f):
        return F.coalesce(F.transform(column, f), F.array())

    methods = F.flatten(F.transform(F.filter(F.coalesce("classes", F.array()), lambda c: c.isNotNull() & c["methods"].isNotNull()), lambda c: F.transform(c["methods"], lambda m: entity(m, "method", c["name"]))))
    every = F.concat(
        each("functions", lambda x: entity(x, "function")), each("classes", lambda x: entity(x, "class")), F.coalesce(methods, F.array()),
        each("interfaces", lambda x: entity(x, "interface")), each("components", lambda x: entity(x, "component", doc=False)),
    )
    # a record's entities stay together until the file has met them, so a text is joined once, not once for each
    m = modules.select(slashes(F.col("path")).alias("source"), F.filter(every, lambda e: e["symbol_name"].isNotNull()).alias("entities")).where(F.size("entities") > 0)
    text = files.select(slashes(F.col("path")).alias("source"), F.col("content"))
    e = m.join(text, "source", "left").select("source", F.split("content", "\n", -1).alias("lines"), F.explode("entities").alias("e")).select("source", "lines", "e.*")
    first = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    last = F.greatest(F.coalesce(F.nullif("end_line", F.lit(0)), first), first)
    body = F.array_join(F.slice("lines", first, last - first + 1), "\n")
    label = F.concat(F.lit("File: "), "source", F.lit("\n"), F.initcap("symbol_type"), F.lit(": "), F.concat_ws(".", "parent_class", "symbol_name"))
    return e.select(
        "source", F.concat_ws(" > ", "source", F.concat_ws(".", "parent_class", "symbol_name")).alias("title"), "symbol_name", "symbol_type", "parent_class",
        first.alias("start_line"), last.alias("end_line"), F.concat_ws("\n", label, "doc", body).alias("text"),
    ).distinct()


def module_pages(modules: DataFrame, edges: DataFrame, limit: int = 28000, context: int = 8) -> DataFrame:
    """``path, role, markdown``: the page of each module from its records, with the first dependencies and
    dependents by name; cut at ``limit`` characters."""
    m = modules.select(slashes(F.col("path")).alias("path"), "language", "docstring", "total_lines", "functions", "classes")

    def few(key, other, name):
        first = top_per_group(edges.select(F.col(key).alias("path"), F.col(other).alias("x")).distinct(), ["path"], [F.col("x")], context)
        return first.groupBy("path").agg(F.sort_array(F.collect_list("x")).alias(name))  # at most ``context``

    j = m.join(few("src", "dst", "uses"), "path", "left").join(few("dst", "src", "used_by"), "path", "left")
    names = lambda c: F.transform(F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("- `"), F.coalesce(x["name"], F.lit("?")), F.lit("` "), F.coalesce(F.split(x["docstring"], "\n")[0], F.lit(""))))
    items = lambda c: F.transform(F.coalesce(c, F.expr("array()").cast("array<string>")), lambda x: F.concat(F.lit("- "), x))
    section = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(rows, "\n")))
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), "path"), "docstring", section("Classes", names(F.col("classes"))), section("Functions", names(F.col("functions"))), section("Depends on", items(F.col("uses"))), section("Used by", items(F.col("used_by")))
    )
    return j.select("path", role(F.regexp_replace("path", "^[^/]*/", "")).alias("role"), F.substring(text, 1, limit).alias("markdown"))


def dependency_context(modules: DataFrame, edges: DataFrame, few: int = 8) -> DataFrame:
    """``path, direction, position, other, summary``: the first modules that each one depends on and that
    depend on it, with their documentation or else their size; those without a record are left out."""
    size = lambda c: F.greatest(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))
    text = F.format_string("%d entities, %d lines", size("classes") + size("functions") + size("interfaces"), F.coalesce("total_lines", F.lit(0)))
    told = modules.select(slashes(F.col("path")).alias("other"), F.coalesce(F.nullif("docstring", F.lit("")), text).alias("summary")).groupBy("other").agg(F.min("summary").alias("summary"))
    uses = edges.select(F.col("src").alias("path"), F.lit("depends on").alias("direction"), F.col("dst").alias("other"))
    both = uses.union(edges.select("dst", F.lit("used by"), "src")).distinct()
    first = top_per_group(both, ["path", "direction"], [F.col("other")], few).withColumnRenamed("rank", "position")
    return first.join(told, "other").select("path", "direction", "position", "other", "summary")
