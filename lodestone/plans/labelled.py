"""Queries of anchors, labels, selections and diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import graph as G
from ..operators import labels as L
from ..operators import windows as W
from ..session import table
from ..sources import files as S
from .catalog import query
from .code import _MOD, _m


_MARKED = "CASE WHEN doc_id % 3 = 0 THEN text || ' [@src:src/a' || doc_id || '.py:' || (doc_id % 90) || ']' ELSE text END"


@query(f"SELECT doc_id, regexp_extract(a, '\\[@src:([^\\]:]+):(\\d+)\\]', 1) AS path, CAST(regexp_extract(a, '\\[@src:([^\\]:]+):(\\d+)\\]', 2) AS INTEGER) AS line FROM (SELECT doc_id, unnest(regexp_extract_all({_MARKED}, '\\[@src:[^\\]:]+:\\d+\\]')) AS a FROM documents)")
def anchors(spark, d):
    """Source markers of all documents; the tables hold none, so a third of the texts gets one at its end."""
    pages = table(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("text"))
    return L.anchors(pages, "doc_id", "text")


@query("SELECT DISTINCT title, regexp_replace(translate(translate(title, '\"[]{}|', '''()()/'), '<>', '⟨⟩'), '[\\r\\n]+', ' ', 'g') AS label FROM chunks WHERE title IS NOT NULL")
def safe_labels(spark, d):
    return table(spark, d, "chunks").where("title IS NOT NULL").select("title", L.safe_label(F.col("title")).alias("label")).distinct()


@query(
    """WITH s AS (SELECT path, max(3 * CAST(contains(lower(path), 'session') AS BIGINT) + 3 * CAST(contains(lower(path), 'cache') AS BIGINT) + CAST(contains(lower(substr(coalesce(content, ''), 1, 5000)), 'session') AS BIGINT) + CAST(contains(lower(substr(coalesce(content, ''), 1, 5000)), 'cache') AS BIGINT)) AS score,
    max(length(coalesce(content, '')) > 0) AS filled FROM source_files GROUP BY path) SELECT * FROM s ORDER BY score DESC, filled DESC, path LIMIT 10"""
)
def select_files(spark, d):
    return L.select_files(table(spark, d, "source_files"), ["session", "cache"])


@query("SELECT DISTINCT src, dst FROM dep_edges WHERE contains(lower(src), 'session') OR contains(lower(dst), 'session')")
def node_search(spark, d):
    return L.matching_with_edges(G.edges(table(spark, d, "dep_edges")), "session")


@query(
    """WITH p AS (SELECT DISTINCT string_split(path, '/') AS s FROM source_files), r AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p), t AS (SELECT DISTINCT list_slice(s, 1, n) AS s, n FROM r),
    h AS (SELECT s FROM t WHERE contains(lower(s[n]), 'session')), a AS (SELECT DISTINCT array_to_string(list_slice(s, 1, k), '/') AS path FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM h))
    SELECT DISTINCT array_to_string(list_slice(t.s, 1, n - 1), '/') AS parent, t.s[n] AS name, path FROM t JOIN a ON a.path = array_to_string(t.s, '/')"""
)
def tree_search(spark, d):
    return L.matching_with_ancestors(S.tree(table(spark, d, "source_files")), "session").select("parent", "name", "path")


def _layers(column):
    inner = f"lower(regexp_replace(replace({column}, '\\', '/'), '^[^/]*/', ''))"
    return "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with({inner}, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in C.TOUR_LAYERS) + " ELSE '其他' END"


@query(f"WITH e AS (SELECT {_layers('src')} AS src_layer, {_layers('dst')} AS dst_layer FROM (SELECT DISTINCT src, dst FROM dep_edges WHERE src IS NOT NULL AND dst IS NOT NULL)) SELECT src_layer, dst_layer, count(*) AS edges FROM e WHERE src_layer <> dst_layer GROUP BY 1, 2")
def layer_diagram(spark, d):
    return L.layer_diagram(G.edges(table(spark, d, "dep_edges")), lambda c: C.layer(C.in_repo(c), C.TOUR_LAYERS))


_SAFE = "CASE WHEN regexp_matches(regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g'), '^[0-9]') THEN 'n_' ELSE '' END || regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g')"


@query(
    f"""WITH {_MOD}, g AS (SELECT DISTINCT src, dst FROM dep_edges WHERE src IS NOT NULL AND dst IS NOT NULL), b AS (SELECT src AS path, dst AS other FROM g UNION ALL SELECT dst, src FROM g), t AS (SELECT path FROM b GROUP BY path ORDER BY count(*) DESC, path LIMIT 30),
    n AS (SELECT DISTINCT other AS path FROM b WHERE path IN (SELECT path FROM t) AND other NOT IN (SELECT path FROM t) ORDER BY path LIMIT 20), v AS (SELECT path FROM t UNION SELECT path FROM n),
    c AS (SELECT module_id, path, unnest(range(1, len(classes) + 1)) AS p, unnest(classes) AS c FROM m WHERE path IN (SELECT path FROM v)), r AS (SELECT path, c, row_number() OVER (PARTITION BY path ORDER BY p) AS r FROM c WHERE c.name IS NOT NULL),
    k AS (SELECT path, c FROM r WHERE r <= 8), a AS (SELECT path, c.name AS n, unnest(c.bases) AS b FROM k)
    SELECT path, '    class ' || {_SAFE.format('c.name')} || ' {{' || chr(10) || array_to_string(list_transform(list_slice(list_filter(coalesce(c.methods, []), lambda x: x IS NOT NULL AND NOT coalesce(starts_with(x.name, '_'), false)), 1, 6), lambda x: '        +' || x.name || '()'), chr(10)) || chr(10) || '    }}' AS line FROM k
    UNION SELECT path, '    ' || {_SAFE.format('b')} || ' <|-- ' || {_SAFE.format('n')} FROM a WHERE b IS NOT NULL"""
)
def class_diagram(spark, d):
    return L.class_diagram(_m(spark, d), G.edges(table(spark, d, "dep_edges")))


@query("SELECT user_id, event_id, string_agg(event_type, '') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS so_far FROM events")
def accumulate_text(spark, d):
    return W.accumulate(table(spark, d, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "so_far")
