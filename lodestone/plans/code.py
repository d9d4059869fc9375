"""Queries over module records, calls, files and their changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import parse as P
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import resolve as R
from ..session import table
from ..sources import files as S
from .catalog import query


def _m(spark, d):
    return table(spark, d, "modules").dropDuplicates(["module_id"])


_MOD = "m AS (SELECT module_id, replace(any_value(path), '\\', '/') AS path, any_value(repo) AS repo, any_value(language) AS language, any_value(docstring) AS docstring, any_value(total_lines) AS total_lines, any_value(functions) AS functions, any_value(classes) AS classes, any_value(interfaces) AS interfaces, any_value(external_imports) AS external_imports, any_value(imports) AS imports FROM modules GROUP BY module_id)"
_FN = """cl AS (SELECT path, unnest(classes) AS c FROM m), fx AS (SELECT path, CAST(NULL AS VARCHAR) AS owner, unnest(functions) AS x FROM m UNION ALL SELECT path, c.name, unnest(c.methods) FROM cl WHERE c IS NOT NULL),
 fn AS (SELECT path, owner, x.name AS name, x.docstring AS docstring, coalesce(list_filter(x.args, lambda a: a IS NOT NULL), []) AS args,
        CASE WHEN x.end_line > 0 AND x.anchor.line IS NOT NULL THEN x.end_line - x.anchor.line END AS length, x.anchor.line AS line, x.end_line AS end_line FROM fx WHERE x IS NOT NULL)"""
_CALLABLE = """ca AS (SELECT id, max({'s': start_line, 'e': end_line, 'n': name, 'm': module}) AS s FROM (SELECT path || '::' || CASE WHEN owner IS NULL THEN '' ELSE owner || '.' END || name AS id, name, path AS module,
 line AS start_line, greatest(coalesce(end_line, 0), coalesce(line, 0)) AS end_line FROM fn WHERE name IS NOT NULL) GROUP BY id), k AS (SELECT id, s.s AS start_line, s.e AS end_line, s.n AS name, s.m AS module FROM ca)"""
_P = "replace(path, '\\', '/')"


def _case(path, layers):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with({path}, '{p}')" for p in ps) + f" THEN '{name}'" for name, ps in layers) + " ELSE '其他' END"


_INNER = "regexp_replace(replace(path, '\\', '/'), '^[^/]*/', '')"


@query(
    f"""WITH p AS (SELECT DISTINCT {_INNER} AS path FROM source_files) SELECT path, CASE WHEN starts_with(path, 'routes/') THEN 'routes' WHEN starts_with(path, 'services/') THEN 'services' WHEN starts_with(path, 'models/') THEN 'models'
    WHEN starts_with(path, 'src/') OR contains(lower(path), 'frontend') THEN 'frontend' WHEN starts_with(path, 'config') OR starts_with(path, 'main') THEN 'config' ELSE 'other' END AS graph,
    {_case('lower(path)', C.GUIDE_LAYERS)} AS guide, {_case('lower(path)', C.TOUR_LAYERS)} AS tour, CASE {' '.join(f"WHEN starts_with(path, '{p}') THEN '{r}'" for p, r in C.ROLES)} ELSE 'general' END AS role,
    regexp_matches(lower(path), 'test_|_test|spec_|_spec|tests/|test/|spec/|__tests__/|\\.test\\.|\\.spec\\.') AS test FROM p"""
)
def layer_classify(spark, d):
    p = F.col("path")
    return table(spark, d, "source_files").select(C.in_repo(p).alias("path")).distinct().select(
        "path", C.graph_layer(p).alias("graph"), C.layer(p).alias("guide"), C.layer(p, C.TOUR_LAYERS).alias("tour"), C.role(p).alias("role"), C.is_test(p).alias("test")
    )


@query(f"WITH p AS (SELECT DISTINCT path FROM source_files) SELECT count(*) AS total, CAST(sum(CASE WHEN regexp_matches({_P}, '(^|/)(__pycache__|\\.git|node_modules|\\.venv|venv|dist|build|\\.mypy_cache|\\.pytest_cache|\\.tox)/|\\.pyc$|\\.egg-info/') THEN 1 ELSE 0 END) AS BIGINT) AS excluded, total - excluded AS to_analyze FROM p")
def scan_counts(spark, d):
    return S.counts(table(spark, d, "source_files").select("path").distinct())


@query(
    f"WITH {_MOD}, i AS (SELECT DISTINCT dst FROM dep_edges), s AS (SELECT path, 3 * CAST(lower({_INNER}) IN ('main.py','app.py','index.py','manage.py','run.py','server.py') AS BIGINT) + CAST(ends_with(lower({_INNER}), '/__init__.py') OR ends_with(lower({_INNER}), '/__main__.py') AS BIGINT)"
    f" + CAST(path NOT IN (SELECT dst FROM i WHERE dst IS NOT NULL) AND NOT regexp_matches(lower({_INNER}), '^(alembic/|migrations/|tests/|test/)') AS BIGINT) + 2 * CAST(regexp_matches(lower(array_to_string(coalesce(external_imports, []), ',')), 'fastapi|flask') AS BIGINT)"
    f" + CAST(regexp_matches(lower({_INNER}), '^(backend|src)/') AND regexp_matches(lower({_INNER}), '/(__init__|main|app)\\.py$') AS BIGINT) AS score FROM m) SELECT path, max(score) AS score FROM s GROUP BY path HAVING max(score) >= 2 ORDER BY score DESC, path LIMIT 8"
)
def entry_score(spark, d):
    dst = table(spark, d, "dep_edges").select(F.col("dst").alias("p")).where("p IS NOT NULL").distinct()
    m = _m(spark, d).select(C.slashes(F.col("path")).alias("path"), "external_imports")
    s = m.join(dst, m.path == dst.p, "left").select("path", C.entry_score(C.in_repo(F.col("path")), F.col("p").isNotNull(), F.col("external_imports")).alias("score"))
    return s.groupBy("path").agg(F.max("score").alias("score")).where("score >= 2").orderBy(F.desc("score"), "path").limit(8)


@query(f"WITH {_MOD}, {_FN}, {_CALLABLE} SELECT id, name, module, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM k")
def callables(spark, d):
    return R.callables(_m(spark, d)).select("id", "name", "module", "start_line", "end_line")


@query(
    f"""WITH {_MOD}, {_FN}, {_CALLABLE}, s AS (SELECT DISTINCT module, line FROM call_sites), j AS (SELECT s.module, s.line, k.id, k.end_line - k.start_line AS w FROM s JOIN k ON k.module = s.module AND s.line BETWEEN k.start_line AND k.end_line)
    SELECT module, line, id FROM (SELECT *, row_number() OVER (PARTITION BY module, line ORDER BY w, id) AS r FROM j) WHERE r = 1"""
)
def innermost_interval(spark, d):
    sites = table(spark, d, "call_sites").select("module", "line").distinct()
    return R.innermost(sites, R.callables(_m(spark, d)).where("start_line IS NOT NULL"), "module", "line", "start_line", "end_line", "id")


_SKIP = "','".join(R.SKIPPED_CALLS)


@query(
    f"""WITH {_MOD}, {_FN}, {_CALLABLE}, s AS (SELECT DISTINCT module, name, full_name, receiver FROM call_sites),
    h AS (SELECT module, name, min(id) AS here, count(*) AS n FROM k GROUP BY 1, 2), g AS (SELECT name, min(id) AS any_id FROM k GROUP BY 1),
    n2 AS (SELECT DISTINCT s.module, s.name FROM s), o AS (SELECT n2.module, n2.name, min(k.id) AS other FROM n2 JOIN k ON k.name = n2.name AND k.module <> n2.module GROUP BY 1, 2)
    SELECT s.module, s.name, s.full_name, s.receiver, CASE WHEN coalesce(s.name IN ('{_SKIP}') OR s.full_name IN ('{_SKIP}'), false) THEN NULL WHEN s.receiver IS NULL THEN coalesce(CASE WHEN h.n = 1 THEN h.here END, o.other, g.any_id)
      WHEN s.receiver IN ('self', 'this') THEN h.here ELSE coalesce(h.here, g.any_id) END AS callee
    FROM s LEFT JOIN h ON h.module = s.module AND h.name = s.name LEFT JOIN g ON g.name = s.name LEFT JOIN o ON o.module = s.module AND o.name = s.name"""
)
def priority_resolve(spark, d):
    sites = table(spark, d, "call_sites").select("module", "name", "full_name", "receiver").distinct()
    return R.resolve_calls(sites, R.callables(_m(spark, d)))


@query()
def import_resolve(spark, d):
    i = _m(spark, d).select(F.col("path").alias("src"), F.explode("imports").alias("name"))
    return R.resolve_imports(i, table(spark, d, "source_files"))


#: Of all module records; whether any base is known there depends on the tables.
INHERITS = (
    f"WITH {_MOD}, cl AS (SELECT path, unnest(classes) AS c FROM m), n AS (SELECT c.name AS name, min(path || '::' || c.name) AS parent FROM cl WHERE c.name IS NOT NULL GROUP BY 1), b AS (SELECT path || '::' || c.name AS child, unnest(c.bases) AS base FROM cl WHERE c.name IS NOT NULL) SELECT DISTINCT child, parent FROM b JOIN n ON b.base = n.name"
)
IMPLEMENTS = (
    f"WITH {_MOD}, i AS (SELECT DISTINCT path AS module, i.name AS interface FROM (SELECT path, unnest(interfaces) AS i FROM m) WHERE i IS NOT NULL), b AS (SELECT path AS module, c.name AS cls, unnest(c.bases) AS interface FROM (SELECT path, unnest(classes) AS c FROM m) WHERE c IS NOT NULL) SELECT DISTINCT module, cls, interface FROM b JOIN i USING (module, interface)"
)


_COLUMNS = "region nation customer supplier part orders lineitem events documents embeddings repos source_files modules raw_modules chunks call_sites dep_edges file_hash eval_items".split()


@query(
    f"""WITH c AS (SELECT table_name, column_name AS "column" FROM information_schema.columns WHERE table_name IN ('{"','".join(_COLUMNS)}')), t AS (SELECT DISTINCT regexp_replace(table_name, 's$', '') AS name FROM c UNION SELECT DISTINCT table_name FROM c UNION SELECT unnest(['user', 'doc', 'vec', 'item'])),
    e AS (SELECT table_name, "column", regexp_extract("column", '^(.*)_id$', 1) AS s FROM c WHERE regexp_matches("column", '._id$')), k AS (SELECT *, unnest([s, s || 's', replace(s, '_', '')]) AS cand, unnest([0, 1, 2]) AS p FROM e)
    SELECT table_name, "column", cand AS target FROM (SELECT k.*, row_number() OVER (PARTITION BY table_name, "column" ORDER BY p) AS r FROM k JOIN t ON t.name = cand WHERE cand <> table_name) WHERE r = 1"""
)
def implicit_fk(spark, d):
    """References by name among the columns of all tables; the names that tables may be called by are given
    in the singular too."""
    rows = [(t, c) for t in _COLUMNS for c in table(spark, d, t).columns]
    cols = spark.createDataFrame(rows, "table_name string, column string")
    names = cols.select("table_name").union(cols.select(F.regexp_replace("table_name", "s$", ""))).union(spark.createDataFrame([("user",), ("doc",), ("vec",), ("item",)], "table_name string"))
    return R.implicit_keys(cols, names)


_CUR = "cur AS (SELECT path, md5(arg_max(content, scanned_at)) AS hash FROM source_files GROUP BY path), sto AS (SELECT source_path AS path, arg_max(coalesce(content_hash, ''), updated_at) AS hash FROM file_hash WHERE source_path IS NOT NULL GROUP BY 1)"


def _delta(spark, d):
    cur = table(spark, d, "source_files").groupBy("path").agg(F.md5(F.max_by("content", "scanned_at")).alias("hash"))
    sto = table(spark, d, "file_hash").where("source_path IS NOT NULL").groupBy(F.col("source_path").alias("path")).agg(F.max_by(F.coalesce("content_hash", F.lit("")), "updated_at").alias("hash"))
    return cur, sto


@query(
    f"WITH {_CUR} SELECT coalesce(c.path, s.path) AS path, CASE WHEN c.path IS NULL OR c.hash IS NULL THEN 'deleted' WHEN s.path IS NULL THEN 'added' WHEN c.hash IS DISTINCT FROM s.hash THEN 'changed' ELSE 'same' END AS change FROM cur c FULL JOIN sto s ON c.path = s.path"
)
def delta_full_outer(spark, d):
    return R.delta(*_delta(spark, d))


@query(f"WITH {_CUR} SELECT path, hash FROM cur UNION ALL SELECT path, hash FROM sto WHERE path NOT IN (SELECT path FROM cur)")
def hash_upsert(spark, d):
    cur, sto = _delta(spark, d)
    return R.upsert(sto, cur, "path")


@query("SELECT md5(text) AS hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedupe_first(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {_MOD}, {_FN} SELECT (SELECT count(*) FROM m) AS modules, (SELECT CAST(sum(total_lines) AS BIGINT) FROM m) AS lines, (SELECT count(*) FROM fn) AS functions, (SELECT count(*) FROM cl WHERE c IS NOT NULL) AS classes")
def scale_totals(spark, d):
    m = _m(spark, d)
    classes = m.select(F.explode("classes").alias("c")).where("c IS NOT NULL").agg(F.count("*").alias("classes"))
    return m.agg(F.count("*").alias("modules"), F.sum("total_lines").alias("lines")).crossJoin(M.functions_of(m).agg(F.count("*").alias("functions"))).crossJoin(classes)


_CC = "cc AS (SELECT *, CASE WHEN owner IS NULL THEN 1.0::DOUBLE + CASE WHEN len(args) > 0 AND NOT coalesce(len(args) = 1 AND args[1].name = 'self', false) THEN 0.5::DOUBLE * len(args) ELSE 0 END ELSE 2.0::DOUBLE + 0.5::DOUBLE * len(list_filter(args, lambda a: NOT coalesce(a.name IN ('self', 'cls'), false))) END + CASE WHEN length(coalesce(docstring, '')) > 0 THEN 1 ELSE 0 END AS complexity FROM fn)"


@query(f"WITH {_MOD}, {_FN}, {_CC} SELECT path, round(avg(complexity), 4) AS average, max(complexity) AS most FROM cc GROUP BY path")
def heuristic_complexity(spark, d):
    return M.heuristic_complexity(M.functions_of(_m(spark, d))).groupBy("path").agg(F.round(F.avg("complexity"), 4).alias("average"), F.max("complexity").alias("most"))


_SM = "sm AS (SELECT path, CAST(sum(lo) AS BIGINT) AS long_functions, CAST(sum(wi) AS BIGINT) AS many_parameters, count(*) FILTER (owner IS NOT NULL AND n > 10) AS god_classes FROM (SELECT path, owner, count(*) FILTER (length > 50) AS lo, count(*) FILTER (len(args) > 5) AS wi, count(*) AS n FROM fn GROUP BY path, owner) GROUP BY path)"


@query(f"WITH {_MOD}, {_FN}, {_SM} SELECT * FROM sm")
def smells(spark, d):
    return M.smells(M.functions_of(_m(spark, d)))


_FACTS = f"""{_MOD}, {_FN}, {_CC}, {_SM}, fa AS (SELECT split_part(path, '/', 1) AS repo, count(*) AS functions, avg(complexity) AS avg_cc, max(complexity) AS max_cc, avg(CASE WHEN length(coalesce(docstring, '')) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM cc GROUP BY 1),
 ed AS (SELECT split_part(src, '/', 1) AS repo, count(*)::DOUBLE / count(DISTINCT src) AS avg_coupling, max(n) AS max_coupling FROM (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM (SELECT DISTINCT src, dst FROM dep_edges)) GROUP BY 1),
 mo AS (SELECT split_part(path, '/', 1) AS repo, CAST(sum(coalesce(total_lines, 0)) AS BIGINT) AS lines, CAST(sum(len(list_filter(coalesce(classes, []), lambda c: c IS NOT NULL))) AS BIGINT) AS classes FROM m GROUP BY 1),
 sr AS (SELECT split_part(path, '/', 1) AS repo, CAST(sum(long_functions) AS BIGINT) AS long, CAST(sum(many_parameters) AS BIGINT) AS wide, CAST(sum(god_classes) AS BIGINT) AS god FROM sm GROUP BY 1),
 al AS (SELECT split_part(path, '/', 1) AS repo, count(*) AS alone FROM (SELECT DISTINCT path FROM m) WHERE path NOT IN (SELECT src FROM dep_edges WHERE src IS NOT NULL UNION SELECT dst FROM dep_edges WHERE dst IS NOT NULL) GROUP BY 1),
 ch AS (SELECT split_part(path, '/', 1) AS repo, count(*) AS churned FROM (SELECT path FROM source_files GROUP BY path HAVING count(*) > 10) GROUP BY 1),
 facts AS (SELECT mo.repo, coalesce(functions, 0) AS functions, coalesce(avg_cc, 0) AS avg_cc, coalesce(max_cc, 0) AS max_cc, coalesce(avg_coupling, 0) AS avg_coupling, coalesce(max_coupling, 0) AS max_coupling, coalesce(alone, 0) AS isolated, 0 AS dead, lines, coalesce(coverage, 0) AS coverage, coalesce(churned, 0) AS churned, coalesce(long, 0) AS long, coalesce(wide, 0) AS wide, coalesce(god, 0) AS god, classes FROM mo LEFT JOIN fa USING (repo) LEFT JOIN ed USING (repo) LEFT JOIN sr USING (repo) LEFT JOIN al USING (repo) LEFT JOIN ch USING (repo))"""
_TERMS = [
    ("avg_complexity", "-least(25.0::DOUBLE, 2 * greatest(0.0::DOUBLE, avg_cc - 3))"),
    ("max_complexity", "CASE WHEN max_cc > 10 THEN -least(15.0::DOUBLE, 0.8::DOUBLE * (max_cc - 10)) ELSE 0.0::DOUBLE END"),
    ("avg_coupling", "-least(15.0::DOUBLE, 2 * greatest(0.0::DOUBLE, avg_coupling - 3))"),
    ("max_coupling", "CASE WHEN max_coupling > 5 THEN -least(10.0::DOUBLE, max_coupling - 5.0::DOUBLE) ELSE 0.0::DOUBLE END"),
    ("isolated", "CASE WHEN isolated / greatest(functions, 1)::DOUBLE > 0.2 THEN -8.0::DOUBLE ELSE 0.0::DOUBLE END"),
    ("dead_blocks", "-0.0::DOUBLE"),
    ("size", "CASE WHEN lines > 50000 THEN -least(5.0::DOUBLE, lines / 100000.0::DOUBLE * 5) ELSE 0.0::DOUBLE END"),
    ("coverage", "least(15.0::DOUBLE, 15 * coverage)"),
    ("churn", "-least(10.0::DOUBLE, 2.0::DOUBLE * churned)"),
    ("long_functions", "-least(10.0::DOUBLE, 25.0::DOUBLE * long / greatest(functions, 1))"),
    ("many_parameters", "-least(8.0::DOUBLE, 20.0::DOUBLE * wide / greatest(functions, 1))"),
    ("god_classes", "-least(8.0::DOUBLE, 16.0::DOUBLE * god / greatest(classes, 1))"),
]


def _facts(spark, d):
    m = _m(spark, d)
    repo = F.split("path", "/")[0].alias("repo")
    fn = M.heuristic_complexity(M.functions_of(m))
    told = F.when(F.length(F.coalesce("docstring", F.lit(""))) > 0, 1.0).otherwise(0.0)
    fa = fn.groupBy(repo).agg(F.count("*").alias("functions"), F.avg("complexity").alias("avg_cc"), F.max("complexity").alias("max_cc"), F.avg(told).alias("coverage"))
    per = table(spark, d, "dep_edges").select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"))
    ed = per.groupBy(F.split("src", "/")[0].alias("repo")).agg((F.sum("n") / F.count("*")).alias("avg_coupling"), F.max("n").alias("max_coupling"))
    mp = m.select(C.slashes(F.col("path")).alias("path"), "total_lines", "classes")
    mo = mp.groupBy(repo).agg(F.sum(F.coalesce("total_lines", F.lit(0))).alias("lines"), F.sum(F.size(F.filter(F.coalesce("classes", F.array()), lambda c: c.isNotNull()))).alias("classes"))
    sr = M.smells(M.functions_of(m)).groupBy(repo).agg(F.sum("long_functions").alias("long"), F.sum("many_parameters").alias("wide"), F.sum("god_classes").alias("god"))
    files = table(spark, d, "source_files")
    al = G.isolated(mp.select("path").distinct(), G.edges(table(spark, d, "dep_edges")), "path").groupBy(repo).agg(F.count("*").alias("isolated"))
    ch = files.groupBy("path").count().where("count > 10").groupBy(repo).agg(F.count("*").alias("churned"))
    flow = P.extract(files.where(F.lower("path").endswith(".py")), "control_flow").dropDuplicates(["module", "line", "function"])
    de = flow.groupBy(F.split("module", "/")[0].alias("repo")).agg(F.sum("dead_blocks").alias("dead"))
    out = mo
    for part in (fa, ed, sr, al, ch, de):
        out = out.join(part, "repo", "left")
    return out.na.fill(0)


@query(f"WITH {_FACTS} SELECT repo, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 + {' + '.join('(' + t + ')' for _, t in _TERMS)})), 1) AS score FROM facts")
def health_score(spark, d):
    return _facts(spark, d).select("repo", M.health_score().alias("score"))


@query(
    f"WITH {_FACTS}, st AS ({' UNION ALL '.join(f'SELECT repo, CAST({i + 1} AS BIGINT) AS step, {chr(39)}{n}{chr(39)} AS factor, {t} AS e FROM facts' for i, (n, t) in enumerate(_TERMS))}) SELECT repo, step, factor, round(e, 1) + 0.0::DOUBLE AS points, round(sum(e) OVER (PARTITION BY repo ORDER BY step) + 100, 1) AS score FROM st"
)
def score_breakdown(spark, d):
    return M.score_breakdown(_facts(spark, d), ["repo"]).withColumn("points", F.col("points") + 0.0)


@query(
    f"""WITH {_MOD}, {_FN}, {_CC}, a AS (SELECT path, avg(complexity) AS avg_cc FROM cc GROUP BY 1), e AS (SELECT src AS path, count(*) AS edges FROM (SELECT DISTINCT src, dst FROM dep_edges) GROUP BY 1), h AS (SELECT path, count(*) AS churn FROM source_files GROUP BY 1),
    r AS (SELECT p.path, round(CASE WHEN avg_cc > 10 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN edges > 5 THEN least(0.4::DOUBLE, 0.05::DOUBLE * edges) ELSE 0 END + CASE WHEN churn > 5 THEN least(0.3::DOUBLE, 0.03::DOUBLE * churn) ELSE 0 END, 2) AS risk FROM (SELECT DISTINCT path FROM m) p LEFT JOIN a USING (path) LEFT JOIN e USING (path) LEFT JOIN h USING (path))
    SELECT path, risk FROM r WHERE risk > 0 ORDER BY risk DESC, path LIMIT 10"""
)
def hotspots(spark, d):
    m = _m(spark, d)
    a = M.heuristic_complexity(M.functions_of(m)).groupBy("path").agg(F.avg("complexity").alias("avg_cc"))
    e = table(spark, d, "dep_edges").select("src", "dst").distinct().groupBy(F.col("src").alias("path")).agg(F.count("*").alias("edges"))
    h = table(spark, d, "source_files").groupBy("path").agg(F.count("*").alias("churn"))
    facts = m.select(C.slashes(F.col("path")).alias("path")).distinct().join(a, "path", "left").join(e, "path", "left").join(h, "path", "left")
    return M.hotspots(facts).select("path", "risk")


@query("SELECT lower(language) AS language, count(DISTINCT module_id) AS modules FROM modules GROUP BY 1")
def language_breakdown(spark, d):
    return table(spark, d, "modules").groupBy(F.lower("language").alias("language")).agg(F.count_distinct("module_id").alias("modules"))


@query(f"WITH {_MOD} SELECT split_part({_INNER}, '/', 1) AS dir, count(*) AS files FROM m GROUP BY 1 ORDER BY files DESC, dir LIMIT 20")
def dir_rollup(spark, d):
    top = F.split(C.in_repo(F.col("path")), "/")[0].alias("dir")
    return _m(spark, d).groupBy(top).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir").limit(20)


@query(f"WITH {_MOD} SELECT repo, path || ' (' || len(coalesce(classes, [])) || 'C/' || len(coalesce(functions, [])) || 'F)' AS line, row_number() OVER (PARTITION BY repo ORDER BY path, module_id) AS position FROM m")
def index_listing(spark, d):
    """The lines of each repository's index, in order; a repository is never gathered into one row."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    m = _m(spark, d).select("repo", "module_id", C.slashes(F.col("path")).alias("path"), size("classes").alias("c"), size("functions").alias("f"))
    at = F.row_number().over(Window.partitionBy("repo").orderBy("path", "module_id")).cast("bigint")
    return m.select("repo", F.concat("path", F.lit(" ("), "c", F.lit("C/"), "f", F.lit("F)")).alias("line"), at.alias("position"))


@query(f"WITH {_MOD} SELECT x AS package, count(DISTINCT module_id) AS modules FROM (SELECT module_id, unnest(external_imports) AS x FROM m) WHERE x IS NOT NULL GROUP BY 1")
def external_packages(spark, d):
    e = _m(spark, d).select("module_id", F.explode("external_imports").alias("package")).where("package IS NOT NULL")
    return e.groupBy("package").agg(F.count_distinct("module_id").alias("modules"))


@query("SELECT module_id, json_extract_string(payload, '$.path') AS path FROM (SELECT DISTINCT module_id, payload FROM raw_modules) WHERE json_valid(payload)")
def json_field(spark, d):
    p = table(spark, d, "raw_modules").select("module_id", "payload").distinct()
    ok = F.try_parse_json("payload") if hasattr(F, "try_parse_json") else None
    return p.where(ok.isNotNull()).select("module_id", F.get_json_object("payload", "$.path").alias("path"))
