"""Queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import in_repo, is_test, slashes, tour_score
from ..operators import graph as G
from ..session import cut, table
from .catalog import query

_G = "g AS (SELECT DISTINCT src, dst FROM dep_edges WHERE src IS NOT NULL AND dst IS NOT NULL)"
_V = "v AS (SELECT src AS node FROM g UNION SELECT dst FROM g)"
_SEED = "seed AS (SELECT dst AS node FROM g GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_TEST = "regexp_matches(lower({0}), 'test_|_test|spec_|_spec|tests/|test/|spec/|__tests__/|\\.test\\.|\\.spec\\.')"


def _g(spark, d):
    return G.edges(table(spark, d, "dep_edges"))


def _seed(g):
    return g.groupBy(F.col("dst").alias("node")).count().orderBy(F.desc("count"), "node").limit(1).select("node")


@query(f"WITH {_G} SELECT * FROM g")
def edges_distinct(spark, d):
    return _g(spark, d)


@query(
    f"""WITH {_G}, x AS (SELECT src AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g)
    SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o + i) AS BIGINT) AS degree FROM x GROUP BY node ORDER BY degree DESC, node LIMIT 20"""
)
def degree_topk(spark, d):
    return G.degrees(_g(spark, d)).orderBy(F.desc("degree"), "node").limit(20)


@query(f"WITH {_G}, {_V} SELECT DISTINCT path FROM source_files WHERE path NOT IN (SELECT node FROM v)")
def isolated(spark, d):
    return G.isolated(table(spark, d, "source_files").select("path").distinct(), _g(spark, d), "path")


@query(f"WITH {_G} SELECT src, dst FROM g WHERE src IN (SELECT path FROM source_files) AND dst IN (SELECT path FROM source_files)")
def edge_semi(spark, d):
    return G.within(_g(spark, d), table(spark, d, "source_files"), "path")


@query("SELECT src, dst, string_agg(relation, '+' ORDER BY relation) AS relation FROM (SELECT DISTINCT src, dst, relation FROM dep_edges) GROUP BY 1, 2")
def relation_merge(spark, d):
    return G.merge_relations(table(spark, d, "dep_edges"))


@query(f"WITH {_G}, {_V} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM g) AS edges, (SELECT node FROM seed) AS most_imported FROM (SELECT 1), seed".replace("SELECT (SELECT", f", {_SEED} SELECT (SELECT", 1).replace(" FROM (SELECT 1), seed", ""))
def graph_stats(spark, d):
    g = _g(spark, d)
    size = G.nodes(g).agg(F.count("*").alias("nodes")).crossJoin(g.agg(F.count("*").alias("edges")))
    return size.crossJoin(_seed(g).select(F.col("node").alias("most_imported")))


@query(
    f"""WITH RECURSIVE {_G}, a AS (SELECT * FROM g WHERE src <> dst), {_V}, r AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM v UNION SELECT a.dst, r.depth + 1 FROM r JOIN a ON a.src = r.node)
    SELECT (SELECT count(DISTINCT path) FROM source_files WHERE path NOT IN (SELECT node FROM v)) AS isolated, (SELECT max(depth) FROM r) AS max_depth"""
)
def graph_shape(spark, d):
    g = _g(spark, d)
    alone = G.isolated(table(spark, d, "source_files").select("path").distinct(), g, "path").agg(F.count("*").alias("isolated"))
    return alone.crossJoin(G.longest_chain(g).agg(F.max("depth").alias("max_depth")))  # one row each


@query("SELECT relation, count(*) AS n FROM (SELECT DISTINCT src, dst, relation FROM dep_edges) GROUP BY 1")
def relation_counts(spark, d):
    return table(spark, d, "dep_edges").distinct().groupBy("relation").agg(F.count("*").alias("n"))


_REACH = f"""WITH RECURSIVE {_G}, {_SEED}, r AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM seed UNION SELECT g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node WHERE r.depth < %d)"""


@query(_REACH % 3 + " SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reach_depth(spark, d):
    g = cut(_g(spark, d))
    return G.reach(g, _seed(g), 3, reverse=True)


@query(_REACH % 8 + " SELECT node, min(depth) AS distance FROM r GROUP BY node")
def shortest_dist(spark, d):
    g = cut(_g(spark, d))
    return G.reach(g, _seed(g), 8, reverse=True).withColumnRenamed("depth", "distance")


@query(f"WITH RECURSIVE {_G}, {_SEED}, r AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM seed UNION SELECT g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node WHERE r.depth < 40 AND g.src <> g.dst) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def affected_files(spark, d):
    g = cut(_g(spark, d))
    return G.reach(g, _seed(g), None, reverse=True)


@query(
    _REACH % 4 + """, b AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), far AS (SELECT node FROM b ORDER BY depth DESC, node LIMIT 1),
    p AS (SELECT node AS here, [node] AS path, 0 AS n FROM far UNION ALL SELECT g.dst, list_append(path, g.dst), n + 1 FROM p JOIN g ON g.src = p.here WHERE n < 4 AND NOT list_contains(path, g.dst))
    SELECT array_to_string(path, ' > ') AS path FROM p WHERE here IN (SELECT node FROM seed) ORDER BY n, p.path LIMIT 1"""
)
def shortest_path(spark, d):
    g = cut(_g(spark, d))
    far = G.reach(g, _seed(g), 4, reverse=True).orderBy(F.desc("depth"), "node").first()
    return G.shortest_path(g, far["node"], _seed(g).first()["node"]).select(F.array_join("path", " > ").alias("path"))


@query(
    _REACH % 4 + """, b AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), far AS (SELECT node FROM b ORDER BY depth DESC, node LIMIT 1),
    p AS (SELECT node AS here, [node] AS path, 0 AS n FROM far UNION ALL SELECT g.dst, list_append(path, g.dst), n + 1 FROM p JOIN g ON g.src = p.here WHERE n < 4 AND NOT list_contains(path, g.dst)),
    w AS (SELECT path FROM p WHERE here IN (SELECT node FROM seed) ORDER BY n, path LIMIT 1), s AS (SELECT path, unnest(range(0, len(path))) AS step FROM w)
    SELECT step, path[step + 1] AS node, CASE WHEN step = 0 THEN 'start' ELSE (SELECT min(relation) FROM dep_edges WHERE src = path[step] AND dst = path[step + 1]) END AS relation FROM s"""
)
def path_relations(spark, d):
    g = cut(_g(spark, d))
    far = G.reach(g, _seed(g), 4, reverse=True).orderBy(F.desc("depth"), "node").first()
    return G.labelled_path(table(spark, d, "dep_edges"), far["node"], _seed(g).first()["node"])


_NEAR = f"""WITH RECURSIVE {_G}, {_SEED}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM seed UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON b.src = r.node WHERE r.depth < 2),
 k AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"""


@query(_NEAR + " SELECT src, dst FROM g WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def subgraph_edges(spark, d):
    g = cut(_g(spark, d))
    return G.subgraph(g, _seed(g), 2)[1]


@query(_NEAR + " SELECT node, depth FROM k")
def subgraph_nodes(spark, d):
    g = cut(_g(spark, d))
    return G.subgraph(g, _seed(g), 2)[0]


@query(
    f"""WITH {_G}, {_SEED}, l AS (SELECT DISTINCT src, dst, relation FROM dep_edges), s AS (SELECT src AS here, dst AS node, relation FROM l UNION ALL SELECT dst, src, 'REV_' || relation FROM l),
    n1 AS (SELECT node, min(relation) AS relation FROM s WHERE here IN (SELECT node FROM seed) AND node NOT IN (SELECT node FROM seed) GROUP BY node),
    n2 AS (SELECT s.node, min(s.relation) AS relation FROM s JOIN n1 ON s.here = n1.node WHERE s.node NOT IN (SELECT node FROM n1) AND s.node NOT IN (SELECT node FROM seed) GROUP BY s.node)
    SELECT node, relation, CAST(1 AS BIGINT) AS depth FROM n1 UNION ALL SELECT node, relation, 2 FROM n2"""
)
def neighbors_k(spark, d):
    seed = _seed(_g(spark, d)).first()["node"]
    return G.neighbours(table(spark, d, "dep_edges").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), seed, 2)


_PR = f"WITH {_G}, {_V}, n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS out FROM g GROUP BY 1), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, n)" + "".join(
    f", r{i} AS MATERIALIZED (SELECT v.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s.got, 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT g.dst, sum(r.rank / o.out) AS got FROM g JOIN o USING (src) JOIN r{i - 1} r ON r.node = g.src GROUP BY 1) s ON s.dst = v.node)"
    for i in range(1, 51)
)


@query(_PR + " SELECT node, round(rank, 6) AS rank FROM r50")
def pagerank(spark, d):
    return G.page_rank(_g(spark, d)).withColumn("rank", F.round("rank", 6))


@query(
    f"WITH RECURSIVE {_G}, {_V}, b AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), c AS (SELECT node, node AS l FROM v UNION SELECT b.y, c.l FROM c JOIN b ON b.x = c.node WHERE c.l < b.y) SELECT node, min(l) AS component FROM c GROUP BY node"
)
def components(spark, d):
    return G.components(_g(spark, d))


@query(
    f"WITH RECURSIVE {_G}, a AS (SELECT * FROM g WHERE src <> dst), {_V}, r AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM v UNION SELECT a.dst, r.depth + 1 FROM r JOIN a ON a.src = r.node) SELECT node, max(depth) AS depth FROM r GROUP BY node"
)
def max_depth(spark, d):
    return G.longest_chain(_g(spark, d))


_IN = "lower(regexp_replace(replace(path, '\\', '/'), '^[^/]*/', ''))"
_ENTRIES = f"""m AS (SELECT module_id, any_value(path) AS path, any_value(external_imports) AS x FROM modules WHERE path IS NOT NULL GROUP BY module_id), sc AS (SELECT replace(path, '\\', '/') AS node,
 5 * CAST({_IN} IN ('main.py', 'app.py', 'index.py', 'manage.py', 'run.py', 'server.py', '__init__.py') AS BIGINT) + 2 * CAST(ends_with({_IN}, '/__init__.py') AND NOT regexp_matches({_IN}, '^tests?/') AS BIGINT)
 + CAST(replace(path, '\\', '/') NOT IN (SELECT dst FROM g) AND NOT regexp_matches({_IN}, '^(alembic|migrations|tests|test)/') AS BIGINT) + 3 * CAST(regexp_matches(lower(array_to_string(coalesce(x, []), ',')), 'fastapi|flask|django|express|next') AS BIGINT) AS score FROM m),
 en AS (SELECT node, max(score) AS score FROM sc GROUP BY node HAVING max(score) >= 2 ORDER BY score DESC, node LIMIT 5)"""


def _entries(spark, d, g):
    m = table(spark, d, "modules").where("path IS NOT NULL").dropDuplicates(["module_id"]).select(slashes(F.col("path")).alias("node"), "external_imports")
    hit = g.select(F.col("dst").alias("p")).distinct()
    score = tour_score(in_repo(F.col("node")), F.col("p").isNotNull(), F.col("external_imports"))
    s = m.join(hit, m.node == hit.p, "left").select("node", score.alias("score")).groupBy("node").agg(F.max("score").alias("score"))
    return s.where("score >= 2").orderBy(F.desc("score"), "node").limit(5)


@query(f"WITH {_G}, {_ENTRIES} SELECT node, score FROM en")
def tour_entries(spark, d):
    return _entries(spark, d, _g(spark, d))


@query(
    f"""WITH RECURSIVE {_G}, {_ENTRIES}, r AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM en UNION SELECT g.dst, r.depth + 1 FROM r JOIN g ON g.src = r.node WHERE r.depth < 8),
    t AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1), f AS (SELECT dst AS node, count(*) AS fan_in FROM g GROUP BY 1)
    SELECT row_number() OVER (ORDER BY depth, coalesce(fan_in, 0) DESC, node DESC) AS step, node, depth, coalesce(fan_in, 0) AS fan_in, node || ' is imported by ' || coalesce(fan_in, 0) || ' modules' AS text FROM t LEFT JOIN f USING (node) ORDER BY depth, fan_in DESC, node DESC LIMIT 15"""
)
def tour_levels(spark, d):
    g = cut(_g(spark, d))
    t = G.tour(g, _entries(spark, d, g))
    return t.withColumn("text", F.concat("node", F.lit(" is imported by "), F.col("fan_in").cast("string"), F.lit(" modules")))


@query(
    f"""WITH {_G}, p AS (SELECT DISTINCT dst AS node FROM g WHERE {_TEST.format('src')} AND NOT {_TEST.format('dst')}), q AS (SELECT DISTINCT g.dst AS node FROM g JOIN p ON g.src = p.node WHERE NOT {_TEST.format('g.dst')}), {_V},
    u AS (SELECT node FROM p UNION SELECT node FROM q) SELECT (SELECT count(*) FROM u) AS covered, count(*) AS production, round((SELECT count(*) FROM u) / count(*)::DOUBLE, 3) AS rate FROM v WHERE NOT {_TEST.format('node')}"""
)
def coverage_rate(spark, d):
    return G.coverage_rate(_g(spark, d), is_test)


@query(_REACH % 5 + ", x AS (SELECT count(DISTINCT node) - 1 AS n, max(m) AS far FROM (SELECT node, min(depth) AS m FROM r GROUP BY 1)) SELECT n, round(least(1, 0.05::DOUBLE * n + 0.15::DOUBLE * far), 2) AS risk, round(least(1, n * 0.08::DOUBLE), 2) AS served, round(least(1, n * 0.1::DOUBLE), 2) AS modules FROM x")
def impact_risk(spark, d):
    g = cut(_g(spark, d))
    hit = G.reach(g, _seed(g), 5, reverse=True).agg((F.count("*") - 1).alias("n"), F.max("depth").alias("far"))
    one = F.lit(1.0)
    return hit.select("n", F.round(F.least(one, 0.05 * F.col("n") + 0.15 * F.col("far")), 2).alias("risk"), F.round(F.least(one, F.col("n") * 0.08), 2).alias("served"), F.round(F.least(one, F.col("n") * 0.1), 2).alias("modules"))


@query(
    f"""WITH {_G}, p AS (SELECT DISTINCT dst AS node FROM g WHERE {_TEST.format('src')} AND NOT {_TEST.format('dst')}),
    q AS (SELECT DISTINCT g.dst AS node FROM g JOIN p ON g.src = p.node WHERE NOT {_TEST.format('g.dst')}) SELECT node FROM p UNION SELECT node FROM q"""
)
def coverage_2hop(spark, d):
    return G.coverage(_g(spark, d), is_test)


@query(f"WITH {_G} SELECT '    ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') AS line FROM g")
def mermaid_edges(spark, d):
    return G.mermaid(_g(spark, d))
