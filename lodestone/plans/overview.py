"""Queries that sum a code base up: layers, roles, totals, what changed and what calls what."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import resolve as R
from ..operators import windows as W
from ..session import cut, table
from .catalog import query
from .code import _CALLABLE, _CC, _CUR, _FN, _INNER, _MOD, _case, _delta, _m
from .corpus import CALLS, calls_of

_PATHS = "pm AS (SELECT DISTINCT replace(path, '\\', '/') AS path FROM modules WHERE path IS NOT NULL)"
_E = "g AS (SELECT DISTINCT src, dst FROM dep_edges WHERE src IS NOT NULL AND dst IS NOT NULL)"


def _paths(spark, d):
    return table(spark, d, "modules").where("path IS NOT NULL").select(C.slashes(F.col("path")).alias("path")).distinct()


@query(
    f"""WITH {_PATHS}, l AS (SELECT path, {_case('lower(' + _INNER + ')', C.GUIDE_LAYERS)} AS layer FROM pm), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY path) AS r, count(*) OVER (PARTITION BY layer) AS files FROM l)
    SELECT layer, any_value(files) AS files, string_agg(path, ',' ORDER BY path) AS first FROM r WHERE r <= 5 GROUP BY layer"""
)
def guide_layers(spark, d):
    """Files of each layer, and its first five."""
    p = _paths(spark, d).withColumn("layer", C.layer(C.in_repo(F.col("path"))))
    first = W.top_per_group(p, ["layer"], [F.col("path")], 5).groupBy("layer").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("first"))  # at most five
    return p.groupBy("layer").agg(F.count("*").alias("files")).join(first, "layer")


@query(f"WITH {_E}, n AS (SELECT dst AS path, count(*) AS dependents FROM g GROUP BY 1 ORDER BY dependents DESC, path LIMIT 10) SELECT path, dependents, {_case('lower(' + _INNER + ')', C.GUIDE_LAYERS)} AS layer FROM n")
def core_modules(spark, d):
    n = G.edges(table(spark, d, "dep_edges")).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))
    return n.orderBy(F.desc("dependents"), "path").limit(10).withColumn("layer", C.layer(C.in_repo(F.col("path"))))


_ROLE = "CASE " + " ".join(f"WHEN starts_with({_INNER}, '{p}') THEN '{r}'" for p, r in C.ROLES) + " ELSE 'general' END"
_SIZE = "len(list_filter(coalesce({0}, []), lambda x: x IS NOT NULL))"


@query(
    f"""WITH {_MOD}, r AS (SELECT {_ROLE} AS role, path, module_id, total_lines AS lines, CAST({_SIZE.format('classes')} + {_SIZE.format('functions')} + {_SIZE.format('interfaces')} AS BIGINT) AS entities, replace(substr(coalesce(docstring, ''), 1, 100), chr(10), ' ') AS brief FROM m)
    SELECT role, path, lines, entities, brief, row_number() OVER (PARTITION BY role ORDER BY path, module_id) AS rank FROM r QUALIFY rank <= 15"""
)
def role_overview(spark, d):
    """The first fifteen modules of each role."""
    n = lambda c: F.greatest(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))
    m = _m(spark, d).select(
        C.role(C.in_repo(F.col("path"))).alias("role"), C.slashes(F.col("path")).alias("path"), "module_id", F.col("total_lines").alias("lines"), (n("classes") + n("functions") + n("interfaces")).cast("bigint").alias("entities"),
        F.translate(F.substring(F.coalesce("docstring", F.lit("")), 1, 100), "\n", " ").alias("brief"),
    )
    return W.top_per_group(m, ["role"], [F.col("path"), F.col("module_id")], 15).drop("module_id")


@query(f"WITH {_MOD}, {_FN}, {_CC} SELECT split_part(path, '/', 1) AS repo, round(avg(complexity), 4) AS average, max(complexity) AS most, count(*) AS functions FROM cc GROUP BY 1")
def complexity_summary(spark, d):
    c = M.heuristic_complexity(M.functions_of(_m(spark, d))).groupBy(F.split("path", "/")[0].alias("repo"))
    return c.agg(F.round(F.avg("complexity"), 4).alias("average"), F.max("complexity").alias("most"), F.count("*").alias("functions"))


@query(f"WITH {_MOD}, {_FN}, {_CC} SELECT path, coalesce(owner, '') AS owner, coalesce(name, '') AS name, complexity FROM cc ORDER BY complexity DESC, path, coalesce(owner, ''), coalesce(name, '') LIMIT 10")
def complexity_top(spark, d):
    c = M.heuristic_complexity(M.functions_of(_m(spark, d))).select("path", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("name", F.lit("")).alias("name"), "complexity")
    return c.orderBy(F.desc("complexity"), "path", "owner", "name").limit(10)


@query(
    f"""WITH {_MOD}, {_FN} SELECT (SELECT count(*) FROM fn) AS functions, (SELECT round(avg(CASE WHEN length(coalesce(docstring, '')) > 0 THEN 1.0::DOUBLE ELSE 0 END), 2) FROM fn) AS docstring_coverage,
    (SELECT count(DISTINCT x) FROM (SELECT unnest(external_imports) AS x FROM m)) AS external_packages, (SELECT CAST(sum(len(imports)) AS BIGINT) FROM m) AS imports"""
)
def documentation_totals(spark, d):
    m = _m(spark, d)
    fn = M.functions_of(m).agg(F.count("*").alias("functions"), F.round(F.avg(F.when(F.length(F.coalesce("docstring", F.lit(""))) > 0, 1.0).otherwise(0.0)), 2).alias("docstring_coverage"))
    ext = m.select(F.explode("external_imports").alias("x")).agg(F.count_distinct("x").alias("external_packages"))
    return fn.crossJoin(ext).crossJoin(m.agg(F.sum(F.when(F.col("imports").isNotNull(), F.size("imports"))).alias("imports")))  # one row each


@query(
    f"""WITH {_MOD}, {_E}, t AS (SELECT count(*) AS modules, CAST(sum({_SIZE.format('classes')}) AS BIGINT) AS classes, CAST(sum({_SIZE.format('functions')}) AS BIGINT) AS functions, CAST(sum({_SIZE.format('interfaces')}) AS BIGINT) AS interfaces FROM m)
    SELECT modules, classes, functions, interfaces, classes + functions + interfaces AS entities, (SELECT count(*) FROM g) AS edges FROM t"""
)
def run_state(spark, d):
    """The totals that a run leaves behind."""
    n = lambda c: F.sum(F.greatest(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))).cast("bigint").alias(c)
    t = _m(spark, d).agg(F.count("*").alias("modules"), n("classes"), n("functions"), n("interfaces")).withColumn("entities", F.col("classes") + F.col("functions") + F.col("interfaces"))
    return t.crossJoin(G.edges(table(spark, d, "dep_edges")).agg(F.count("*").alias("edges")))


@query(
    f"""WITH {_MOD}, {_FN}, {_CALLABLE}, {_CUR}, x AS (SELECT c.path FROM cur c LEFT JOIN sto s ON c.path = s.path WHERE c.hash IS NOT NULL AND (s.path IS NULL OR c.hash IS DISTINCT FROM s.hash)) SELECT id, module FROM k WHERE module IN (SELECT path FROM x)"""
)
def changed_callables(spark, d):
    """What is defined in files that are new or have changed."""
    changed = R.delta(*_delta(spark, d)).where("change IN ('added', 'changed')").select(F.col("path").alias("module"))
    return R.callables(_m(spark, d)).join(changed, "module", "left_semi").select("id", "module")


@query(
    f"""WITH {_CUR}, x AS (SELECT CASE WHEN c.path IS NULL OR c.hash IS NULL THEN 'deleted' WHEN s.path IS NULL THEN 'added' WHEN c.hash IS DISTINCT FROM s.hash THEN 'changed' ELSE 'same' END AS change FROM cur c FULL JOIN sto s ON c.path = s.path)
    SELECT CASE WHEN count(*) FILTER (change <> 'same') = 0 THEN 'skip' ELSE 'rebuild' END AS decision, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'deleted') AS deleted FROM x"""
)
def sync_decision(spark, d):
    """Whether an index must be made again."""
    return R.sync_decision(R.delta(*_delta(spark, d)))


@query(
    f"""WITH {CALLS}, t AS (SELECT dst AS id FROM calls WHERE src <> dst GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), a AS (SELECT src AS id FROM calls WHERE dst IN (SELECT id FROM t) ORDER BY src LIMIT 10), b AS (SELECT dst AS id FROM calls WHERE src IN (SELECT id FROM t) ORDER BY dst LIMIT 10)
    SELECT (SELECT id FROM t) AS id, (SELECT string_agg(id, ',' ORDER BY id) FROM a) AS callers, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM b), '') AS callees, (SELECT count(*) FROM calls) AS edges"""
)
def icfg_summary(spark, d):
    """The callable with most callers, its first ten callers and callees, and all calls."""
    c = cut(calls_of(spark, d))
    top = c.where("src <> dst").groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select(F.col("dst").alias("id"))
    return G.around(c, top, 10).crossJoin(c.agg(F.count("*").alias("edges")))


@query(
    f"""WITH {CALLS} SELECT DISTINCT '    ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') AS line FROM calls"""
)
def call_diagram(spark, d):
    return G.mermaid(calls_of(spark, d)).distinct()


@query(
    f"""WITH {_E}, t AS (SELECT dst AS node FROM g GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), a AS (SELECT src, dst FROM g WHERE dst IN (SELECT node FROM t) AND src <> dst ORDER BY src LIMIT 3), b AS (SELECT src, dst FROM g WHERE src IN (SELECT node FROM t) AND src <> dst ORDER BY dst LIMIT 5)
    SELECT '    ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || '->>' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') || ': uses' AS line FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
)
def sequence_diagram(spark, d):
    """Messages to and from the most imported module: three callers, five callees."""
    g = G.edges(table(spark, d, "dep_edges"))
    top = g.groupBy(F.col("dst").alias("node")).count().orderBy(F.desc("count"), "node").limit(1).select("node")
    return L.sequence_diagram(g, top)


@query(
    f"""WITH {_E}, p AS (SELECT DISTINCT path FROM source_files), k AS (SELECT src, dst FROM g WHERE src IN (SELECT path FROM p) AND dst IN (SELECT path FROM p) AND src <> dst), v AS (SELECT src AS path FROM k UNION SELECT dst FROM k)
    SELECT path, {_case('lower(' + _INNER + ')', C.TOUR_LAYERS)} AS layer, (SELECT count(*) FROM k WHERE src = v.path) AS uses, (SELECT count(*) FROM k WHERE dst = v.path) AS used_by FROM v"""
)
def graph_view(spark, d):
    """Nodes of the drawn graph: files with an edge to another file, their layer and degrees."""
    k = G.within(G.edges(table(spark, d, "dep_edges")), table(spark, d, "source_files"), "path").where("src <> dst")
    n = G.degrees(k).select(F.col("node").alias("path"), F.col("fan_out").alias("uses"), F.col("fan_in").alias("used_by"))
    return n.withColumn("layer", C.layer(C.in_repo(F.col("path")), C.TOUR_LAYERS))


def _client(p):
    out = "CASE "
    for name, prefixes, part in C.CLIENT_LAYERS:
        out += "WHEN " + " OR ".join([f"starts_with({p}, '{x}')" for x in prefixes] + ([f"contains({p}, '{part}')"] if part else [])) + f" THEN '{name}' "
    return out + "ELSE '其他' END"


@query(f"WITH p AS (SELECT DISTINCT path FROM source_files) SELECT path, {_client('lower(' + _INNER + ')')} AS layer FROM p")
def client_layers(spark, d):
    return table(spark, d, "source_files").select("path").distinct().withColumn("layer", C.client_layer(C.in_repo(F.col("path"))))


@query(
    f"""WITH {_MOD}, c AS (SELECT DISTINCT path FROM m WHERE {_SIZE.format('classes')} > 0), i AS (SELECT DISTINCT path AS src, replace(x, '.', '/') AS name FROM (SELECT path, unnest(imports) AS x FROM m) WHERE x IS NOT NULL AND path IN (SELECT path FROM c)),
    s AS (SELECT path, string_split(regexp_replace(path, '\\.[^./]*$', ''), '/') AS s FROM c), n AS (SELECT path, unnest(range(1, len(s) + 1)) AS a, s FROM s), q AS (SELECT DISTINCT path AS dst, array_to_string(list_slice(s, a, b), '/') AS name FROM (SELECT path, s, a, unnest(range(a, len(s) + 1)) AS b FROM n))
    SELECT src, name, min(dst) AS dst FROM i JOIN q USING (name) WHERE src <> dst GROUP BY src, name"""
)
def class_uses(spark, d):
    """Modules with classes that import another such module by a run of its folders and its name."""
    return R.class_uses(_m(spark, d))


@query(
    "WITH p AS (SELECT DISTINCT CASE WHEN regexp_matches(path, '\\.(py|tsx?|jsx?)$') THEN regexp_replace(path, '\\.(py|tsx?|jsx?)$', '.md') ELSE path || '.md' END AS page FROM source_files) SELECT page, row_number() OVER (PARTITION BY split_part(page, '/', 1) ORDER BY page) AS position FROM p"
)
def page_list(spark, d):
    """The pages of each repository in order."""
    from ..sources.files import page_path

    p = table(spark, d, "source_files").select(page_path(F.col("path")).alias("page")).distinct().withColumn("repo", F.split("page", "/")[0])
    return W.top_per_group(p, ["repo"], [F.col("page")], 1 << 62).select("page", F.col("rank").alias("position"))


@query(f"WITH {_MOD}, {_FN} SELECT path, owner, name, 'long function' AS smell, CAST(length AS BIGINT) AS measure FROM fn WHERE length > 50 UNION ALL SELECT path, owner, name, 'many parameters', CAST(len(args) AS BIGINT) FROM fn WHERE len(args) > 5")
def smell_details(spark, d):
    return M.smell_details(M.functions_of(_m(spark, d)))


@query(
    f"""WITH {CALLS}, {_MOD}, {_FN}, {_CALLABLE}, o AS (SELECT k.id, count(c.dst) AS n FROM k LEFT JOIN calls c ON c.src = k.id GROUP BY k.id)
    SELECT round(avg(n), 4) AS average, max(n) AS most, count(*) FILTER (n = 0 AND id NOT IN (SELECT dst FROM calls)) AS isolated, count(*) AS callables FROM o"""
)
def callable_coupling(spark, d):
    """Calls that leave each callable, and callables that nothing connects."""
    return G.coupling(R.callables(_m(spark, d)).select(F.col("id").alias("node")), calls_of(spark, d))


@query(
    f"""WITH RECURSIVE {CALLS}, {_MOD}, {_FN}, {_CALLABLE}, {_CUR}, x AS (SELECT c.path FROM cur c LEFT JOIN sto s ON c.path = s.path WHERE c.hash IS NOT NULL AND (s.path IS NULL OR c.hash IS DISTINCT FROM s.hash)), seed AS (SELECT id AS node FROM k WHERE module IN (SELECT path FROM x)),
    r AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM seed UNION SELECT c.src, r.depth + 1 FROM r JOIN calls c ON c.dst = r.node WHERE r.depth < 5) SELECT node AS id, min(depth) AS distance FROM r GROUP BY node HAVING min(depth) > 0"""
)
def impact_callables(spark, d):
    """Callers of changed callables, up to five calls away, with their distance; the changed ones are not among them."""
    changed = R.delta(*_delta(spark, d)).where("change IN ('added', 'changed')").select(F.col("path").alias("module"))
    seeds = R.callables(_m(spark, d)).join(changed, "module", "left_semi").select(F.col("id").alias("node"))
    return G.reach(cut(calls_of(spark, d)), seeds, 5, reverse=True).where("depth > 0").select(F.col("node").alias("id"), F.col("depth").alias("distance"))


@query(
    f"""WITH {_MOD}, {_E}, t AS (SELECT path AS other, min(coalesce(nullif(docstring, ''), ({_SIZE.format('classes')} + {_SIZE.format('functions')} + {_SIZE.format('interfaces')}) || ' entities, ' || coalesce(total_lines, 0) || ' lines')) AS summary FROM m GROUP BY path),
    b AS (SELECT src AS path, 'depends on' AS direction, dst AS other FROM g UNION SELECT dst, 'used by', src FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY path, direction ORDER BY other) AS position FROM b) SELECT path, direction, position, other, summary FROM r JOIN t USING (other) WHERE position <= 8"""
)
def dependency_context(spark, d):
    return K.dependency_context(_m(spark, d), G.edges(table(spark, d, "dep_edges")))


@query("SELECT count(*) AS pages, count(*) FILTER (regexp_matches(text, '\\S')) AS succeeded, count(*) - count(*) FILTER (regexp_matches(text, '\\S')) AS failed, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\\[@src:'))) AS BIGINT) AS anchors, CAST(sum(length(coalesce(text, '')) // 4) AS BIGINT) AS tokens FROM documents")
def run_totals(spark, d):
    """Pages, how many came out, their source markers and an estimate of their tokens."""
    text = F.coalesce("text", F.lit(""))
    good = F.count_if(text.rlike(r"\S"))
    return table(spark, d, "documents").agg(
        F.count("*").alias("pages"), good.alias("succeeded"), (F.count("*") - good).alias("failed"), F.sum(F.regexp_count(text, F.lit(r"\[@src:"))).cast("bigint").alias("anchors"), F.sum(F.floor(F.length(text) / 4)).cast("bigint").alias("tokens")
    )
