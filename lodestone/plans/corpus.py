"""Queries of scans, trees, the knowledge graph and what is written from it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import resolve as R
from ..functions import classify as C
from ..session import checkpoint_dir, cut, table
from ..sources import files as S
from .catalog import SQL, query
from .code import _INNER, _MOD, IMPLEMENTS, INHERITS, _m

_ROLE = "CASE " + " ".join(f"WHEN starts_with({_INNER}, '{p}') THEN '{r}'" for p, r in C.ROLES) + " ELSE 'general' END"


@query(
    """WITH p AS (SELECT DISTINCT string_split(path, '/') AS s FROM source_files), r AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p),
    t AS (SELECT DISTINCT array_to_string(list_slice(s, 1, n - 1), '/') AS parent, s[n] AS name, CASE WHEN n < len(s) THEN 'dir' ELSE 'file' END AS kind, n AS depth FROM r)
    SELECT *, row_number() OVER (PARTITION BY parent ORDER BY kind = 'file', lower(name), name) AS position FROM t"""
)
def file_tree(spark, d):
    return S.tree(table(spark, d, "source_files"))


@query("SELECT DISTINCT path, CASE WHEN regexp_matches(path, '\\.(py|tsx?|jsx?)$') THEN regexp_replace(path, '\\.(py|tsx?|jsx?)$', '.md') ELSE path || '.md' END AS page FROM source_files")
def page_paths(spark, d):
    return table(spark, d, "source_files").select("path", S.page_path(F.col("path")).alias("page")).distinct()


@query(
    """WITH f AS (SELECT DISTINCT path FROM source_files), p AS (SELECT DISTINCT CASE WHEN regexp_matches(replace(path, '\\', '/'), '\\.(py|tsx?|jsx?)$') THEN regexp_replace(replace(path, '\\', '/'), '\\.(py|tsx?|jsx?)$', '.md') ELSE replace(path, '\\', '/') || '.md' END AS page FROM f),
    c AS (SELECT page, regexp_replace(page, '\\.md$', '') AS base, unnest([0, 1, 2, 3, 4]) AS i, regexp_replace(page, '\\.md$', '.') || unnest(['py', 'ts', 'tsx', 'js', 'jsx']) AS path FROM p)
    SELECT c.page, coalesce(arg_min(f.path, c.i) FILTER (f.path IS NOT NULL), any_value(base) || '.py') AS path FROM c LEFT JOIN f ON f.path = c.path GROUP BY c.page"""
)
def source_of_page(spark, d):
    f = table(spark, d, "source_files").select("path").distinct()
    return S.source_of_page(f.select(S.page_path(F.col("path")).alias("page")).distinct(), f)


#: Calls between callables, of the queries that find the callable around a place and the one that is called.
CALLS = f"""inn AS ({SQL['innermost_interval']}), res AS ({SQL['priority_resolve']}),
 calls AS (SELECT DISTINCT i.id AS src, r.callee AS dst FROM (SELECT DISTINCT module, line, name, full_name, receiver FROM call_sites) s JOIN inn i ON i.module = s.module AND i.line = s.line
   JOIN res r ON r.module = s.module AND r.name = s.name AND r.full_name = s.full_name AND r.receiver IS NOT DISTINCT FROM s.receiver WHERE r.callee IS NOT NULL)"""
_KG = f"""{_MOD}, mc AS (SELECT path AS module, unnest(classes) AS c FROM m), cl AS (SELECT module, c FROM mc WHERE c.name IS NOT NULL), mf AS (SELECT path AS module, unnest(functions) AS f FROM m), mm AS (SELECT module, c.name AS cls, unnest(c.methods) AS f FROM cl), mi AS (SELECT path AS module, unnest(interfaces) AS i FROM m),
 ev AS (SELECT path AS id, 'module' AS type, path AS name, NULL AS parent FROM m UNION ALL SELECT module || '::' || c.name, 'class', c.name, module FROM cl UNION ALL SELECT module || '::' || f.name, 'function', f.name, module FROM mf WHERE f.name IS NOT NULL
   UNION ALL SELECT module || '::' || cls || '.' || f.name, 'method', f.name, module || '::' || cls FROM mm WHERE f.name IS NOT NULL UNION ALL SELECT module || '::' || i.name, 'interface', i.name, module FROM mi WHERE i.name IS NOT NULL),
 nodes AS (SELECT id, s.t AS type, s.n AS name FROM (SELECT id, min({{'t': type, 'n': name}}) AS s FROM ev GROUP BY id))"""
_EDGES = f"""{CALLS}, inh AS ({INHERITS}), imp AS ({IMPLEMENTS}), {_KG}, bo AS (SELECT DISTINCT src, dst, 'IMPORTS' AS relation FROM dep_edges UNION SELECT src, dst, 'CALLS' FROM calls),
 edges AS (SELECT parent AS src, id AS dst, 'CONTAINS' AS relation FROM ev WHERE parent IS NOT NULL UNION SELECT child, parent, 'INHERITS' FROM inh UNION SELECT module || '::' || cls, module || '::' || interface, 'IMPLEMENTS' FROM imp
   UNION SELECT src, dst, relation FROM bo WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"""


def calls_of(spark, d):
    """``src, dst``: which callable calls which, by the place of the call and the rules of resolution."""
    m = _m(spark, d)
    known = R.callables(m)
    sites = table(spark, d, "call_sites").select("module", "line", "name", "full_name", "receiver").distinct()
    inner = R.innermost(sites.select("module", "line").distinct(), known.where("start_line IS NOT NULL"), "module", "line", "start_line", "end_line", "id")
    resolved = R.resolve_calls(sites.select("module", "name", "full_name", "receiver").distinct(), known).where("callee IS NOT NULL")
    same = sites.join(inner, ["module", "line"])
    k = ["module", "name", "full_name"]
    return same.join(resolved.withColumnRenamed("receiver", "r2"), k).where(F.col("receiver").eqNullSafe(F.col("r2"))).select(F.col("id").alias("src"), F.col("callee").alias("dst")).distinct()


def _graph(spark, d):
    narrow = cut(_m(spark, d).select("path", *[K.names_only(c) for c in ("functions", "classes", "interfaces")]))
    return K.build(narrow, G.edges(table(spark, d, "dep_edges")), calls_of(spark, d))


@query(f"WITH {_KG} SELECT id, type, name FROM nodes")
def knowledge_nodes(spark, d):
    return _graph(spark, d)[0]


@query(f"WITH {_EDGES} SELECT src, dst, relation FROM edges")
def knowledge_edges(spark, d):
    return _graph(spark, d)[1]


@query(f"WITH {_EDGES}, p AS (SELECT src, dst, string_agg(relation, '+' ORDER BY relation) AS relation FROM edges GROUP BY 1, 2) SELECT 'edge' AS kind, relation AS label, count(*) AS n FROM p GROUP BY relation UNION ALL SELECT 'node', type, count(*) FROM nodes GROUP BY type")
def knowledge_stats(spark, d):
    """Nodes by type and edges by their merged relations."""
    nodes, edges = _graph(spark, d)
    e = G.merge_relations(edges).groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("relation").alias("label"), "n")
    return e.unionByName(nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("type").alias("label"), "n"))


@query(f"WITH {CALLS}, {_KG} SELECT src, dst FROM calls WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def call_graph(spark, d):
    return _graph(spark, d)[1].where("relation = 'CALLS'").select("src", "dst")


_ONE = "SELECT path AS source, {x}.name AS symbol_name, '{kind}' AS symbol_type, {parent} AS parent_class, {x}.anchor.line AS start_line, {x}.end_line AS end_line, {doc} AS doc FROM {table}"


@query(
    f"""WITH m AS (SELECT module_id, replace(any_value(path), '\\', '/') AS path, any_value(functions) AS functions, any_value(classes) AS classes, any_value(interfaces) AS interfaces, any_value(components) AS components FROM modules GROUP BY module_id),
    a AS (SELECT path, unnest(functions) AS x FROM m), b AS (SELECT path, unnest(classes) AS x FROM m), c AS (SELECT path, x.name AS cls, unnest(x.methods) AS y FROM b), i AS (SELECT path, unnest(interfaces) AS x FROM m), o AS (SELECT path, unnest(components) AS x FROM m),
    e AS ({_ONE.format(x='x', kind='function', parent='NULL', doc='x.docstring', table='a')} UNION {_ONE.format(x='x', kind='class', parent='NULL', doc='x.docstring', table='b')} UNION {_ONE.format(x='y', kind='method', parent='cls', doc='y.docstring', table='c')}
      UNION {_ONE.format(x='x', kind='interface', parent='NULL', doc='x.docstring', table='i')} UNION {_ONE.format(x='x', kind='component', parent='NULL', doc='NULL', table='o')}),
    f AS (SELECT replace(path, '\\', '/') AS source, string_split(any_value(content), chr(10)) AS lines FROM source_files GROUP BY 1),
    g AS (SELECT e.*, f.lines, greatest(coalesce(start_line, 1), 1) AS first, greatest(coalesce(nullif(end_line, 0), greatest(coalesce(start_line, 1), 1)), greatest(coalesce(start_line, 1), 1)) AS last FROM e LEFT JOIN f USING (source) WHERE symbol_name IS NOT NULL)
    SELECT source, concat_ws(' > ', source, concat_ws('.', parent_class, symbol_name)) AS title, symbol_name, symbol_type, parent_class, first AS start_line, last AS end_line,
      concat_ws(chr(10), 'File: ' || source || chr(10) || upper(symbol_type[1]) || symbol_type[2:] || ': ' || concat_ws('.', parent_class, symbol_name), doc, array_to_string(list_slice(lines, first, last), chr(10))) AS text FROM g"""
)
def entity_chunks(spark, d):
    return K.entity_chunks(_m(spark, d), table(spark, d, "source_files"))


_NAMES = "array_to_string(list_transform(list_filter({0}, lambda x: x IS NOT NULL), lambda x: '- `' || coalesce(x.name, '?') || '` ' || coalesce(string_split(x.docstring, chr(10))[1], '')), chr(10))"


@query(
    f"""WITH m AS (SELECT module_id, replace(any_value(path), '\\', '/') AS path, any_value(docstring) AS docstring, any_value(functions) AS functions, any_value(classes) AS classes FROM modules GROUP BY module_id), g AS (SELECT DISTINCT src, dst FROM dep_edges WHERE src IS NOT NULL AND dst IS NOT NULL),
    u AS (SELECT src AS path, '- ' || array_to_string(list_slice(list(dst ORDER BY dst), 1, 8), chr(10) || '- ') AS uses FROM g GROUP BY src), b AS (SELECT dst AS path, '- ' || array_to_string(list_slice(list(src ORDER BY src), 1, 8), chr(10) || '- ') AS used_by FROM g GROUP BY dst),
    s AS (SELECT m.path, m.docstring, nullif({_NAMES.format('classes')}, '') AS cs, nullif({_NAMES.format('functions')}, '') AS fs, uses, used_by FROM m LEFT JOIN u USING (path) LEFT JOIN b USING (path))
    SELECT path, {_ROLE} AS role, substr(concat_ws(chr(10) || chr(10), '# ' || path, docstring, '## Classes' || chr(10) || cs, '## Functions' || chr(10) || fs, '## Depends on' || chr(10) || uses, '## Used by' || chr(10) || used_by), 1, 28000) AS markdown FROM s"""
)
def module_pages(spark, d):
    return K.module_pages(_m(spark, d), G.edges(table(spark, d, "dep_edges")))


@query(f"WITH {_KG} SELECT id, type, name FROM nodes")
def knowledge_saved(spark, d):
    """The nodes as they come back from where they were stored."""
    at = f"{checkpoint_dir(spark)}/knowledge-{uuid.uuid4().hex}"
    S.save(_graph(spark, d)[0], at)
    return S.load_snapshot(spark, at, "id string, type string, name string")
