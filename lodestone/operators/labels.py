"""Anchors in pages, safe diagram labels, file selection and filters that keep context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHOR = r"\[@src:([^\]:]+):(\d+)\]"


def anchors(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, line`` of every source marker ``[@src:path:line]``."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(ANCHOR), F.lit(0)))
    a = pages.select(key, found.alias("a"))
    return a.select(key, F.regexp_extract("a", ANCHOR, 1).alias("path"), F.regexp_extract("a", ANCHOR, 2).cast("int").alias("line"))


def safe_label(label: Column) -> Column:
    """A label without characters that end one: quotes, brackets, braces, angles, bars and line breaks."""
    out = F.translate(label, '"[]{}|', "'()()/")
    return F.regexp_replace(F.translate(out, "<>", "⟨⟩"), r"[\r\n]+", " ")


def safe_identifier(name: Column) -> Column:
    out = F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")
    return F.when(out.rlike(r"^\d"), F.concat(F.lit("n_"), out)).otherwise(out)


def select_files(files: DataFrame, words: list[str], name: str = "path", text: str = "content", k: int = 10, head: int = 5000) -> DataFrame:
    """The k files that fit a question best: three points per word in the name, one per word in the first
    ``head`` characters (the score, not the file, looks at the head), files with content first."""
    low, start = F.lower(F.col(name)), F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, head))
    score = F.lit(0)
    for w in words:
        score = score + F.when(F.coalesce(low.contains(w.lower()), F.lit(False)), 3).otherwise(0) + F.when(start.contains(w.lower()), 1).otherwise(0)
    rows = files.select(F.col(name).alias("path"), score.cast("bigint").alias("score"), (F.length(F.coalesce(F.col(text), F.lit(""))) > 0).alias("filled"))
    return rows.groupBy("path").agg(F.max("score").alias("score"), F.max("filled").alias("filled")).orderBy(F.desc("score"), F.desc("filled"), "path").limit(k)


def matching_with_edges(edges: DataFrame, word: str) -> DataFrame:
    """Edges that touch a node whose name holds the word."""
    has = lambda c: F.lower(F.col(c)).contains(word.lower())
    return edges.where(has("src") | has("dst"))


def matching_with_ancestors(tree: DataFrame, word: str) -> DataFrame:
    """Of a file tree (``parent, name``): the entries whose name holds the word and the folders above them."""
    full = tree.select("parent", "name", F.concat_ws("/", F.nullif("parent", F.lit("")), "name").alias("path"))
    hit = full.where(F.lower("name").contains(word.lower()))
    s = F.split("path", "/")
    above = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, 1, i), "/"))).alias("path")).distinct()
    return full.join(above, "path", "left_semi")


def layer_diagram(edges: DataFrame, layer) -> DataFrame:
    """``src_layer, dst_layer, edges``: dependencies between layers, as an architecture diagram draws them."""
    e = edges.select(layer(F.col("src")).alias("src_layer"), layer(F.col("dst")).alias("dst_layer"))
    return e.where("src_layer <> dst_layer").groupBy("src_layer", "dst_layer").agg(F.count("*").alias("edges"))


def shown_modules(edges: DataFrame, most: int = 30, near: int = 20) -> DataFrame:
    """``path`` of the modules with most edges, and of the first of those that share an edge with one."""
    both = edges.select(F.col("src").alias("path"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    top = both.groupBy("path").count().orderBy(F.desc("count"), "path").limit(most).select("path")
    beside = both.join(F.broadcast(top), "path", "left_semi").select(F.col("other").alias("path")).distinct()  # as many as asked for
    return top.union(beside.join(F.broadcast(top), "path", "left_anti").orderBy("path").limit(near))


def class_diagram(modules: DataFrame, edges: DataFrame, per_module: int = 8, per_class: int = 6) -> DataFrame:
    """``path, line``: of the modules that are shown, class boxes with their first public methods and
    inheritance arrows."""
    shown = F.broadcast(shown_modules(edges))
    modules = modules.select(F.translate("path", "\\", "/").alias("path"), "classes").join(shown, "path", "left_semi")
    c = modules.select(F.translate("path", "\\", "/").alias("path"), F.posexplode("classes").alias("p", "c")).where("c IS NOT NULL AND c.name IS NOT NULL")
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("p"))).where(F.col("r") <= per_module)
    own = F.slice(F.filter(F.coalesce("c.methods", F.array()), lambda m: m.isNotNull() & ~F.coalesce(m["name"].startswith("_"), F.lit(True))), 1, per_class)
    body = F.array_join(F.transform(own, lambda m: F.concat(F.lit("        +"), m["name"], F.lit("()"))), "\n")
    box = c.select("path", F.concat(F.lit("    class "), safe_identifier(F.col("c.name")), F.lit(" {\n"), body, F.lit("\n    }")).alias("line"))
    arrows = c.select("path", F.col("c.name").alias("n"), F.explode("c.bases").alias("b")).where("b IS NOT NULL")
    return box.union(arrows.select("path", F.concat(F.lit("    "), safe_identifier(F.col("b")), F.lit(" <|-- "), safe_identifier(F.col("n"))))).distinct()


def sequence_diagram(e: DataFrame, centre: DataFrame, callers: int = 3, callees: int = 5) -> DataFrame:
    """``line``: messages of the first callers of the node of ``centre`` (column ``node``) to it, and of it to
    its first callees."""
    e = e.where("src <> dst")
    near = e.join(F.broadcast(centre.select(F.col("node").alias("dst"))), "dst", "left_semi").select("src", "dst").orderBy("src").limit(callers)
    far = e.join(F.broadcast(centre.select(F.col("node").alias("src"))), "src", "left_semi").select("src", "dst").orderBy("dst").limit(callees)
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return near.union(far).select(F.format_string("    %s->>%s: uses", safe(F.col("src")), safe(F.col("dst"))).alias("line"))


def matching_tables(columns: DataFrame, word: str = "", only: str | None = None) -> DataFrame:
    """Of columns (``table_name, class, column_name, referenced_table, kind``), those of the tables whose name,
    class, any column or any referenced table holds the word; ``only`` keeps one kind of tables."""
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(word.lower()), F.lit(False))
    rows = columns if only is None else columns.where(F.col("kind") == only)
    hit = rows.where(has("table_name") | has("class") | has("column_name") | has("referenced_table")).select("table_name").distinct()
    return rows.join(hit, "table_name", "left_semi")


def camel_case(df: DataFrame) -> DataFrame:
    """Columns renamed from ``snake_case`` to ``camelCase``."""
    return df.toDF(*[re.sub(r"_([a-z])", lambda m: m[1].upper(), c) for c in df.columns])
