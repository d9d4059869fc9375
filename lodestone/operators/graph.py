"""Graphs as edge tables: degrees, reachability, paths, ranks, components.

Loops keep their state as DataFrames, cut their lineage by reliable checkpoints and stop when a round
changes nothing; nothing but counts reaches the driver. Self-edges and repeated edges are allowed
everywhere; rows with a null end are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """``node, fan_out, fan_in, degree``."""
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"), (F.sum("o") + F.sum("i")).alias("degree"))


def isolated(vertices: DataFrame, e: DataFrame, key: str) -> DataFrame:
    return vertices.join(nodes(e).withColumnRenamed("node", key), key, "left_anti")


def within(e: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """Edges of which both ends are vertices."""
    v = vertices.select(F.col(key).alias("src")).distinct()
    return e.join(v, "src", "left_semi").join(v.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def reach(e: DataFrame, seeds: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """``node, depth``: least number of steps from any seed (column ``node``), seeds at 0. With no depth
    given, until nothing new is found."""
    step = e.select(F.col("dst").alias("node"), F.col("src").alias("next")) if reverse else e.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    front, d = seen, 0
    while depth is None or d < depth:
        d += 1
        new = front.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d).cast("bigint"))
        if depth is None or depth > 4:
            new = cut(new)
            if new.isEmpty():
                break
        seen = seen.union(new)
        front = new
        if d % 4 == 0:
            seen = cut(seen)
    return seen


def shortest_path(e: DataFrame, start: str, end: str, depth: int = 8) -> DataFrame:
    """The first shortest path in alphabetical order, as an array of nodes; no row if there is none."""
    spark = e.sparkSession
    if start == end:
        return spark.createDataFrame([([start],)], "path array<string>")
    best = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = best
    for _ in range(depth):
        new = best.join(e, best.node == e.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = cut(new.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti"))
        hit = best.where(F.col("node") == end)
        if not hit.isEmpty() or best.isEmpty():
            return hit.select("path")
        seen = seen.union(best)
    return seen.where(F.lit(False)).select("path")


def labelled_path(labelled: DataFrame, start: str, end: str, depth: int = 8) -> DataFrame:
    """``step, node, relation``: the shortest path, the first in alphabetical order, with the first relation of
    each of its edges; the start has ``start``, or ``self`` if it is the end as well."""
    path = shortest_path(edges(labelled), start, end, depth)
    steps = path.select(F.posexplode("path").alias("i", "node"), "path").select(F.col("i").cast("bigint").alias("step"), "node", F.when(F.col("i") > 0, F.try_element_at("path", F.col("i"))).alias("from"))
    first = labelled.groupBy(F.col("src").alias("from"), F.col("dst").alias("node")).agg(F.min("relation").alias("relation"))
    alone = F.lit("self" if start == end else "start")
    return steps.join(first, ["from", "node"], "left").select("step", "node", F.when(F.col("step") == 0, alone).otherwise(F.col("relation")).alias("relation"))


def neighbours(labelled: DataFrame, seed: str, depth: int = 1) -> DataFrame:
    """``node, relation, depth``: both directions, reverse hits labelled ``REV_``; a node is reported once,
    at its least depth, under its first label."""
    fwd = labelled.select(F.col("src").alias("at"), F.col("dst").alias("node"), "relation")
    rev = labelled.select(F.col("dst").alias("at"), F.col("src").alias("node"), F.concat(F.lit("REV_"), "relation").alias("relation"))
    step = fwd.union(rev)
    seen = labelled.sparkSession.createDataFrame([(seed, "", 0)], "node string, relation string, depth bigint")
    front = seen.select(F.col("node").alias("at"))
    for d in range(1, depth + 1):
        new = front.join(step, "at").groupBy("node").agg(F.min("relation").alias("relation")).join(seen.select("node"), "node", "left_anti")
        new = new.withColumn("depth", F.lit(d).cast("bigint"))
        seen = seen.union(new)
        front = new.select(F.col("node").alias("at"))
    return seen.where("depth > 0")


def page_rank(e: DataFrame, iterations: int = 50, damping: float = 0.85) -> DataFrame:
    """``node, rank``; starts at 1/N, weight of nodes without outgoing edges is lost. Partial sums are
    formed before the shuffle, so a hub is no bottleneck."""
    v = cut(nodes(e))
    n = v.count()
    if n == 0:
        return v.withColumn("rank", F.lit(0.0))
    links = cut(e.join(e.groupBy("src").agg(F.count("*").alias("out")), "src"))
    rank = v.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        given = links.join(rank, links.src == rank.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = v.join(given, v.node == given.dst, "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 0 and i < iterations:
            rank = cut(rank)
    return rank


def components(e: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node). Rounds alternate between taking the least label of the
    neighbours and the label of one's label, so long chains shrink exponentially; a hub's labels are
    reduced before they are shuffled."""
    both = cut(e.union(e.select("dst", "src")).union(nodes(e).select("node", F.col("node"))).toDF("a", "b").distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("l")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("l")), "b").groupBy("a").agg(F.min("l").alias("m"))
        # whoever carries a label hears of what that label's node has found
        up = near.join(label, "a").groupBy(F.col("l").alias("a")).agg(F.min("m").alias("m"))
        better = near.union(up).groupBy("a").agg(F.min("m").alias("m"))
        jump = better.join(better.select(F.col("a").alias("m"), F.col("m").alias("j")), "m", "left").select("a", F.least("m", F.coalesce("j", "m")).alias("l"))
        new = cut(jump)
        changed = new.join(label.withColumnRenamed("l", "old"), "a").where("l <> old").limit(1)
        label = new
        if changed.isEmpty():
            return label.select(F.col("a").alias("node"), F.col("l").alias("component"))


def strong_components(e: DataFrame) -> DataFrame:
    """``node, component``: its strongly connected component, named by its smallest node. In each round
    every node takes the smallest name of those that reach it; what such a name's node can be reached from,
    within the nodes of that name, is one component and leaves the graph."""
    left, out = cut(e.where("src <> dst")), None
    rest = cut(nodes(e))
    while True:
        label = rest.withColumn("l", F.col("node"))
        while True:
            got = left.join(label, left.src == label.node).groupBy(F.col("dst").alias("node")).agg(F.min("l").alias("m"))
            new = cut(label.join(got, "node", "left").select("node", F.least("l", F.coalesce("m", "l")).alias("l")))
            done = new.join(label.withColumnRenamed("l", "old"), "node").where("l <> old").isEmpty()
            label = new
            if done:
                break
        inside = left.join(label.select(F.col("node").alias("src"), F.col("l").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("l").alias("b")), "dst").where("a = b").select("src", "dst")
        members = reach(cut(inside), label.where("node = l").select("node"), None, reverse=True).select("node")
        found = cut(label.join(members, "node", "left_semi").select("node", F.col("l").alias("component")))
        out = found if out is None else out.union(found)
        rest = cut(rest.join(found, "node", "left_anti"))
        if rest.isEmpty():
            return out
        left = cut(left.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))


def longest_chain(e: DataFrame) -> DataFrame:
    """``node, depth``: edges on the longest chain that ends in each node. Nodes are taken off the graph as
    soon as all before them have been; where cycles stop that, chains are those of the graph in which each
    strongly connected component is one node, so a cycle adds nothing."""
    every = cut(nodes(e))
    links = cut(e.where("src <> dst"))
    out, left, d = None, every, 0
    while True:
        waiting = links.select(F.col("dst").alias("node")).distinct()
        free = cut(left.join(waiting, "node", "left_anti").withColumn("depth", F.lit(d).cast("bigint")))
        if free.isEmpty():
            break
        out = free if out is None else out.union(free)
        left = cut(left.join(free, "node", "left_anti"))
        links = cut(links.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        d += 1
    if left.isEmpty():
        return out
    part = cut(strong_components(e))
    named = e.join(part.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(part.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    condensed = named.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    deep = longest_chain(condensed).withColumnRenamed("node", "component")
    return part.join(deep, "component").select("node", "depth")


def subgraph(e: DataFrame, seeds: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node, depth``) within ``depth`` steps of any seed in either direction, and the edges among
    them, each once."""
    both = e.union(e.select("dst", "src")).distinct()
    near = reach(both, seeds, depth)
    ids = near.select("node")
    return near, e.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def tour(e: DataFrame, entries: DataFrame, steps: int = 15, depth: int = 8) -> DataFrame:
    """``step, node, depth, fan_in``: nodes reachable from the entries, level by level, the most imported
    first."""
    lv = reach(e, entries, depth)
    fan = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    ranked = lv.join(fan, "node", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0).cast("bigint")))
    best = ranked.orderBy("depth", F.desc("fan_in"), F.desc("node")).limit(steps)
    return best.withColumn("step", F.row_number().over(Window.orderBy("depth", F.desc("fan_in"), F.desc("node"))).cast("bigint"))


def coverage_rate(e: DataFrame, is_test) -> DataFrame:
    """One row: ``covered`` production nodes, all ``production`` nodes, and their ``rate``."""
    own = nodes(e).where(~is_test(F.col("node"))).agg(F.count("*").alias("production"))
    return coverage(e, is_test).agg(F.count("*").alias("covered")).crossJoin(own).withColumn("rate", F.round(F.col("covered") / F.col("production"), 3))


def coupling(vertices: DataFrame, e: DataFrame) -> DataFrame:
    """One row over the vertices (column ``node``): ``average`` and ``most`` edges that leave one, how many are
    ``isolated``, and their number ``callables``."""
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    hit = e.select(F.col("dst").alias("node")).distinct().withColumn("hit", F.lit(True))
    v = vertices.distinct().join(out, "node", "left").join(hit, "node", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return v.agg(F.round(F.avg("n"), 4).alias("average"), F.max("n").alias("most"), F.count_if((F.col("n") == 0) & F.col("hit").isNull()).alias("isolated"), F.count("*").alias("callables"))


def around(e: DataFrame, centre: DataFrame, k: int = 10) -> DataFrame:
    """One row for the node of ``centre`` (column ``id``): its first ``callers`` and ``callees`` by name."""
    near = e.join(F.broadcast(centre.select(F.col("id").alias("dst"))), "dst", "left_semi").orderBy("src").limit(k)
    far = e.join(F.broadcast(centre.select(F.col("id").alias("src"))), "src", "left_semi").orderBy("dst").limit(k)
    text = lambda df, c, name: df.agg(F.array_join(F.sort_array(F.collect_list(c)), ",").alias(name))
    return centre.crossJoin(text(near, "src", "callers")).crossJoin(text(far, "dst", "callees"))  # one row each


def merge_relations(labelled: DataFrame) -> DataFrame:
    """One row per pair with its distinct relations in order, joined by ``+``."""
    return labelled.groupBy("src", "dst").agg(F.concat_ws("+", F.array_sort(F.collect_set("relation"))).alias("relation"))


def mermaid(e: DataFrame) -> DataFrame:
    """Diagram lines, with labels made safe."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return e.select(F.format_string("    %s --> %s", safe(F.col("src")), safe(F.col("dst"))).alias("line"))


def coverage(e: DataFrame, is_test) -> DataFrame:
    """Production nodes that a test reaches in one step, or in two through a production node."""
    first = e.where(is_test(F.col("src")) & ~is_test(F.col("dst"))).select(F.col("dst").alias("node")).distinct()
    second = e.join(first.withColumnRenamed("node", "src"), "src", "left_semi").where(~is_test(F.col("dst"))).select(F.col("dst").alias("node"))
    return first.union(second).distinct()
