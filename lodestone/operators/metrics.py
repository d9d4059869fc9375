"""Measures of module records: totals, smells, complexity, health, hotspots, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import slashes


def functions_of(modules: DataFrame) -> DataFrame:
    """``path, owner`` (class or null), ``name, docstring, args`` (without null elements), ``length``."""
    m = modules.select(slashes(F.col("path")).alias("path"), "functions", "classes")
    f = m.select("path", F.lit(None).cast("string").alias("owner"), F.explode("functions").alias("x"))
    c = m.select("path", F.explode("classes").alias("c")).where("c IS NOT NULL").select("path", F.col("c.name").alias("owner"), F.explode("c.methods").alias("x"))
    args = F.filter(F.coalesce("x.args", F.expr("array()").cast("array<struct<name:string,type_annotation:string,default:string>>")), lambda a: a.isNotNull())
    length = F.when((F.col("x.end_line") > 0) & F.col("x.anchor.line").isNotNull(), F.col("x.end_line") - F.col("x.anchor.line"))
    return f.unionByName(c).where("x IS NOT NULL").select("path", "owner", F.col("x.name").alias("name"), F.col("x.docstring").alias("docstring"), args.alias("args"), length.alias("length"))


def heuristic_complexity(functions: DataFrame) -> DataFrame:
    """A guess from the signature: functions start at 1 and add half a point per parameter (unless the
    only one is self), methods start at 2 and add half a point per parameter but self and cls; a docstring adds 1."""
    n = F.size("args")
    named = F.size(F.filter("args", lambda a: ~F.coalesce(a["name"].isin("self", "cls"), F.lit(False))))
    only_self = (n == 1) & (F.col("args")[0]["name"] == "self")
    own = F.when(F.col("owner").isNull(), F.lit(1.0) + F.when((n > 0) & ~F.coalesce(only_self, F.lit(False)), 0.5 * n).otherwise(0.0)).otherwise(F.lit(2.0) + 0.5 * named)
    return functions.withColumn("complexity", own + F.when(F.length(F.coalesce("docstring", F.lit(""))) > 0, 1.0).otherwise(0.0))


def smells(functions: DataFrame) -> DataFrame:
    """Long functions (over 50 lines), many parameters (over 5) and god classes (over 10 methods) by path."""
    per = functions.groupBy("path", "owner").agg(F.count_if(F.col("length") > 50).alias("long"), F.count_if(F.size("args") > 5).alias("wide"), F.count("*").alias("n"))
    return per.groupBy("path").agg(F.sum("long").alias("long_functions"), F.sum("wide").alias("many_parameters"), F.count_if(F.col("owner").isNotNull() & (F.col("n") > 10)).alias("god_classes"))


def smell_details(functions: DataFrame) -> DataFrame:
    """``path, owner, name, smell, measure`` of each long function and each one with many parameters."""
    kinds = F.array(
        F.when(F.col("length") > 50, F.struct(F.lit("long function").alias("smell"), F.col("length").cast("bigint").alias("measure"))),
        F.when(F.size("args") > 5, F.struct(F.lit("many parameters").alias("smell"), F.size("args").cast("bigint").alias("measure"))),
    )
    return functions.select("path", "owner", "name", F.explode(F.array_compact(kinds)).alias("s")).select("path", "owner", "name", "s.*")


#: The factors of the health score, as (name, points) over the columns named below.
def health_factors() -> list[tuple[str, Column]]:
    c, one = F.col, F.lit
    n = F.greatest(c("functions"), one(1))
    cut = lambda limit, x: -F.least(one(float(limit)), x)
    zero = one(0.0)
    return [
        ("avg_complexity", cut(25, 2 * F.greatest(zero, c("avg_cc") - 3))),
        ("max_complexity", F.when(c("max_cc") > 10, cut(15, 0.8 * (c("max_cc") - 10))).otherwise(zero)),
        ("avg_coupling", cut(15, 2 * F.greatest(zero, c("avg_coupling") - 3))),
        ("max_coupling", F.when(c("max_coupling") > 5, cut(10, c("max_coupling") - 5.0)).otherwise(zero)),
        ("isolated", F.when(c("isolated") / n > 0.2, -8.0).otherwise(zero)),
        ("dead_blocks", cut(10, 3.0 * c("dead"))),
        ("size", F.when(c("lines") > 50000, cut(5, c("lines") / 100000 * 5)).otherwise(zero)),
        ("coverage", F.least(one(15.0), 15 * c("coverage"))),
        ("churn", cut(10, 2.0 * c("churned"))),
        ("long_functions", cut(10, 25.0 * c("long") / n)),
        ("many_parameters", cut(8, 20.0 * c("wide") / n)),
        ("god_classes", cut(8, 16.0 * c("god") / F.greatest(c("classes"), one(1)))),
    ]


def health_score() -> Column:
    total = F.lit(100.0)
    for _, points in health_factors():
        total = total + points
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1)


def score_breakdown(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row per factor in order, with its points and the running score."""
    rows = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(name).alias("factor"), F.round(points, 1).alias("points"), points.alias("exact")) for i, (name, points) in enumerate(health_factors())])
    flat = facts.select(*key, F.explode(rows).alias("r")).select(*key, "r.*")
    running = F.sum("exact").over(Window.partitionBy(*key).orderBy("step")) + 100
    return flat.withColumn("score", F.round(running, 1)).drop("exact")


def hotspots(facts: DataFrame, k: int = 10) -> DataFrame:
    """Modules by risk: 0.3 for complexity over 10, up to 0.4 for over five edges, up to 0.3 for churn over 5."""
    risk = (
        F.when(F.col("avg_cc") > 10, 0.3).otherwise(0.0)
        + F.when(F.col("edges") > 5, F.least(F.lit(0.4), 0.05 * F.col("edges"))).otherwise(0.0)
        + F.when(F.col("churn") > 5, F.least(F.lit(0.3), 0.03 * F.col("churn"))).otherwise(0.0)
    )
    return facts.withColumn("risk", F.round(risk, 2)).where("risk > 0").orderBy(F.desc("risk"), "path").limit(k)
