"""Joins that resolve names: imports, calls, enclosing functions, base classes, implicit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import slashes

#: Names of calls that are never resolved.
SKIPPED_CALLS = (
    "print len range type int str float bool list dict set tuple enumerate zip map filter sorted reversed min max sum abs round isinstance hasattr getattr setattr delattr super iter next "
    "open input issubclass staticmethod classmethod property repr format console.log console.error console.warn console.info"
).split()


def callables(modules: DataFrame) -> DataFrame:
    """``id, name, module, parent_class, kind, start_line, end_line`` of functions and methods; null
    elements and names are skipped, an end of 0 counts as the start line, of equal ids the last is kept."""
    m = modules.select(slashes(F.col("path")).alias("module"), "functions", "classes")
    f = m.select("module", F.lit(None).cast("string").alias("parent_class"), F.lit("function").alias("kind"), F.explode("functions").alias("x"))
    c = m.select("module", F.explode("classes").alias("c")).where("c IS NOT NULL")
    g = c.select("module", F.col("c.name").alias("parent_class"), F.lit("method").alias("kind"), F.explode("c.methods").alias("x"))
    every = f.unionByName(g).where("x IS NOT NULL AND x.name IS NOT NULL")
    name = F.concat_ws(".", "parent_class", "x.name")
    out = every.select(
        F.concat_ws("::", "module", name).alias("id"), F.col("x.name").alias("name"), "module", "parent_class", "kind",
        F.col("x.anchor.line").alias("start_line"), F.greatest(F.coalesce(F.col("x.end_line"), F.lit(0)), F.coalesce("x.anchor.line", F.lit(0))).alias("end_line"),
    )
    return out.groupBy("id").agg(F.max(F.struct("start_line", "end_line", "name", "module", "parent_class", "kind")).alias("s")).select("id", "s.*")


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """The smallest span of the same key that holds each point (ties: the smaller name): the points'
    columns and ``name``. The key is the hash key of the join, the range its filter; points are
    distinct, and each keeps one candidate by partial aggregation."""
    s = spans.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_n"))
    hit = points.join(s, (points[key] == F.col("_k")) & (points[at] >= F.col("_s")) & (points[at] <= F.col("_e")))
    best = F.min(F.struct((F.col("_e") - F.col("_s")).alias("w"), F.col("_n").alias("n")))
    return hit.groupBy(*points.columns).agg(best.alias("b")).select(*points.columns, F.col("b.n").alias(name))


def resolve_calls(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Each distinct call with ``callee`` (null if unresolved): ``self``/``this`` in the same module; other
    receivers the same module first, else any; bare names the same module only if it is the only one there,
    else another module, else any. Within a rule the smallest id wins. Names are reduced to their first
    candidate per module and overall before the join, so a common name never multiplies calls."""
    here = known.groupBy(F.col("module").alias("m"), F.col("name").alias("n")).agg(F.min("id").alias("here"), F.count("*").alias("here_n"))
    # the two smallest modules that define a name are enough to find one outside any given module
    firsts = known.groupBy("name", "module").agg(F.min("id").alias("first"))
    two = firsts.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("first"))).where("r <= 2")
    glob = two.groupBy(F.col("name").alias("gn")).agg(
        F.min(F.when(F.col("r") == 1, F.struct("module", "first"))).alias("a"), F.min(F.when(F.col("r") == 2, F.struct("module", "first"))).alias("b")
    )
    s = sites.join(here, (sites.module == F.col("m")) & (sites.name == F.col("n")), "left").join(glob, sites.name == F.col("gn"), "left")
    other = F.when(F.col("a.module") != F.col("module"), F.col("a.first")).otherwise(F.col("b.first"))
    bare = F.coalesce(F.when(F.col("here_n") == 1, F.col("here")), other, F.col("a.first"))
    own = F.col("receiver").isin("self", "this")
    skip = F.coalesce(F.col("name").isin(SKIPPED_CALLS) | F.col("full_name").isin(SKIPPED_CALLS), F.lit(False))
    callee = F.when(skip, None).when(F.col("receiver").isNull(), bare).when(own, F.col("here")).otherwise(F.coalesce("here", "a.first"))
    return s.select(*sites.columns, callee.alias("callee"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``src, name, dst``: each import (``src``, ``name``) resolved among ``files`` (``path``), by the first
    candidate that exists: the dotted or slashed path itself, below the repository, with each extension
    or as an index; else a file of that base name, the same folder first, then the smallest path."""
    ext = [".py", ".ts", ".tsx", ".js", ".jsx"]
    f = files.select(slashes(F.col("path")).alias("path")).distinct()
    known = f.select("path", F.regexp_replace("path", "^[^/]*/", "").alias("inner"), F.split("path", "/")[0].alias("repo"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("base"))
    i = imports.select(slashes(F.col("src")).alias("src"), "name").where("src IS NOT NULL AND name IS NOT NULL").distinct()
    ups = F.length(F.regexp_extract("name", r"^\.*", 0))
    folder = F.regexp_replace(F.col("src"), "/?[^/]*$", "")
    plain = F.regexp_replace("name", r"^(?:@/|~/|(?:\.\.?/)+|\.+)", "")
    is_path = F.col("name").contains("/")
    inner = F.when(is_path, plain).otherwise(F.translate(plain, ".", "/"))
    i = i.withColumn("repo", F.split("src", "/")[0]).withColumn("folder", folder).withColumn("inner", inner).withColumn("rel", F.col("name").startswith("."))
    up = F.when(F.col("name").startswith("../"), 1).when(~is_path & (ups > 1), ups - 1).otherwise(0)
    i = i.withColumn("dir", F.when(up > 0, F.regexp_replace("folder", "/[^/]*$", "")).otherwise(F.col("folder")))
    tails = [F.lit("")] + [F.lit(e) for e in ext] + [F.lit("/index" + e) for e in ext] + [F.lit("/__init__.py")]
    cands = []
    for base, order in ((F.concat_ws("/", F.when(F.col("rel"), F.col("dir")).otherwise(F.col("repo")), "inner"), 0), (F.concat_ws("/", "folder", "inner"), 100), (F.concat_ws("/", "repo", F.lit("src"), "inner"), 200)):
        cands += [F.struct(F.lit(order + k).alias("priority"), F.concat(base, t).alias("cand")) for k, t in enumerate(tails)]
    exact = i.select("src", "name", F.explode(F.array(*cands)).alias("c")).join(f, F.col("c.cand") == F.col("path"))
    best = exact.groupBy("src", "name").agg(F.min(F.struct("c.priority", "path")).alias("b")).select("src", "name", F.col("b.path").alias("dst"))
    left = i.join(best, ["src", "name"], "left_anti").withColumn("base", F.element_at(F.split("inner", "/"), -1))
    # files are reduced to the smallest path of a name in the repository and below each folder before the join
    anywhere = known.groupBy("repo", "base").agg(F.min("path").alias("far"))
    parts = F.split("path", "/")
    above = known.select("path", "base", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")).select("path", "base", F.array_join(F.slice(parts, 1, F.col("n")), "/").alias("folder"))
    below = above.groupBy("folder", "base").agg(F.min("path").alias("near"))
    named = left.join(anywhere, ["repo", "base"]).join(below, ["folder", "base"], "left")
    by_name = named.groupBy("src", "name").agg(F.min(F.struct(F.col("near").isNull().alias("p"), F.coalesce("near", "far").alias("path"))).alias("b")).select("src", "name", F.col("b.path").alias("dst"))
    return best.unionByName(by_name)


def inherits(modules: DataFrame) -> DataFrame:
    """``child, parent``: base classes resolved by name, the smallest defining id."""
    c = modules.select(slashes(F.col("path")).alias("module"), F.explode("classes").alias("c")).where("c IS NOT NULL AND c.name IS NOT NULL")
    ids = c.select(F.concat_ws("::", "module", "c.name").alias("id"), F.col("c.name").alias("name"))
    bases = c.select(F.concat_ws("::", "module", "c.name").alias("child"), F.explode("c.bases").alias("base")).where("base IS NOT NULL").distinct()
    first = ids.groupBy("name").agg(F.min("id").alias("parent"))
    return bases.join(first, bases.base == first.name).select("child", "parent").distinct()


def implements(modules: DataFrame) -> DataFrame:
    """``cls, interface``: bases that name an interface of the same module."""
    m = modules.select(slashes(F.col("path")).alias("module"), "classes", "interfaces")
    i = m.select("module", F.explode("interfaces").alias("i")).where("i IS NOT NULL").select("module", F.col("i.name").alias("interface")).distinct()
    b = m.select("module", F.explode("classes").alias("c")).where("c IS NOT NULL").select("module", F.col("c.name").alias("cls"), F.explode("c.bases").alias("interface"))
    return b.join(i, ["module", "interface"]).select("module", "cls", "interface").distinct()


def implicit_keys(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """``table_name, column, target``: a column ``x_id`` refers to table ``x``, ``xs`` or ``x`` without
    underscores, the first that exists and is not its own table."""
    stem = F.regexp_extract("column", "^(.*)_id$", 1)
    c = columns.where(F.col("column").rlike("._id$")).select("table_name", "column", F.posexplode(F.array(stem, F.concat(stem, F.lit("s")), F.translate(stem, "_", ""))).alias("p", "cand"))
    hit = c.join(tables.select(F.col("table_name").alias("cand")).distinct(), "cand").where("cand <> table_name")
    return hit.groupBy("table_name", "column").agg(F.min(F.struct("p", "cand")).alias("b")).select("table_name", "column", F.col("b.cand").alias("target"))


def delta(current: DataFrame, stored: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """``key, change``: added, changed, deleted or same. A null digest on the current side counts as
    deleted, on the stored side as changed."""
    c = current.select(F.col(key).alias("k"), F.col(digest).alias("c"), F.lit(True).alias("has"))
    s = stored.select(F.col(key).alias("k"), F.col(digest).alias("s"), F.lit(True).alias("had"))
    change = F.when(F.col("has").isNull() | F.col("c").isNull(), "deleted").when(F.col("had").isNull(), "added").when(~F.col("c").eqNullSafe(F.col("s")), "changed").otherwise("same")
    return c.join(s, "k", "full_outer").select(F.col("k").alias(key), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def sync_decision(changes: DataFrame) -> DataFrame:
    """One row: ``skip`` if nothing has changed, else ``rebuild``, and how much has."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    some = F.count_if(F.col("change") != "same") > 0
    return changes.agg(F.when(some, "rebuild").otherwise("skip").alias("decision"), n("added"), n("changed"), n("deleted"))


def class_uses(modules: DataFrame) -> DataFrame:
    """``src, name, dst``: imports of modules with classes that name a run of the folders and the name of
    another module with classes, the smallest path. Runs are looked up by equality, as many per path as it has
    pairs of folders, so no import meets every path."""
    own = modules.where(F.exists("classes", lambda c: c.isNotNull())).select(slashes(F.col("path")).alias("path"), "imports")
    i = own.select(F.col("path").alias("src"), F.explode("imports").alias("x")).where("x IS NOT NULL").select("src", F.translate("x", ".", "/").alias("name")).distinct()
    s = own.select("path", F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/").alias("s")).distinct()
    a = s.select("path", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("a"))
    runs = a.select("path", "s", "a", F.explode(F.sequence("a", F.size("s"))).alias("b")).select(F.col("path").alias("dst"), F.array_join(F.slice("s", F.col("a"), F.col("b") - F.col("a") + 1), "/").alias("name")).distinct()
    return i.join(runs, "name").where("src <> dst").groupBy("src", "name").agg(F.min("dst").alias("dst"))


def table_union(first: DataFrame, second: DataFrame, name: str = "table_name") -> DataFrame:
    """Columns of both sources; a table that both know by one name is taken from the first."""
    return first.unionByName(second.join(first.select(name).distinct(), name, "left_anti"), allowMissingColumns=True)


def explicit_keys(columns: DataFrame) -> DataFrame:
    """``source, source_column, target, target_column``: references that a schema states."""
    c = columns.where("referenced_table IS NOT NULL")
    return c.select(F.col("table_name").alias("source"), F.col("column_name").alias("source_column"), F.col("referenced_table").alias("target"), F.col("referenced_column").alias("target_column")).distinct()


def add_missing(nodes: DataFrame, more: DataFrame, key: str = "path") -> DataFrame:
    """``nodes`` and those of ``more`` that are not among them."""
    return nodes.unionByName(more.join(nodes.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def path_steps(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """The definitions and uses of a module (``module, line, ...``) whose line lies between source and sink of
    a flow (``module, source_line, sink_line``)."""
    return flows.join(steps, "module").where("line BETWEEN source_line AND sink_line").distinct()
