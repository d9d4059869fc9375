"""Queries over small tables written out here, for cases that the large ones do not hold."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import labels as L
from ..operators import resolve as R
from ..operators import retrieval as T
from ..operators import windows as W
from ..session import checkpoint_dir
from ..sources import files as S
from ..streaming import changes
from .catalog import query


def _values(names: str, *rows: tuple) -> str:
    def text(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({names})"


def _file(spark, path, content):
    return spark.createDataFrame([(path, content)], "path string, content string")


_DDL = "CREATE TABLE orders (id INT PRIMARY KEY, user_id INT NOT NULL, note VARCHAR(20), FOREIGN KEY (user_id) REFERENCES users(id));"


def _ddl(spark):
    return P.extract(_file(spark, "schema.sql", _DDL), "ddl")


@query(
    _values(
        "table_name, column_name, type, primary_key, nullable, referenced_table, referenced_column",
        ("orders", "id", "INT", True, False, None, None), ("orders", "user_id", "INT", False, False, "users", "id"), ("orders", "note", "VARCHAR(20)", False, True, None, None),
    )
)
def ddl_columns(spark, d):
    return _ddl(spark).drop("source")


@query(_values("source, source_column, target, target_column", ("orders", "user_id", "users", "id")))
def explicit_fk(spark, d):
    return R.explicit_keys(_ddl(spark))


_ORM = """
class User(Base):
    __tablename__ = "users"
    id = Column(Integer, primary_key=True)
    team_id = Column(Integer, ForeignKey("teams.id"), nullable=False)
    orders = relationship("Order")


class Order(Base):
    __tablename__ = "orders"
    id = mapped_column(Integer)


class Plain(BaseSettings):
    id = Column(Integer)
"""


def _orm(spark):
    return P.extract(_file(spark, "models.py", _ORM), "orm")


@query(
    _values(
        "table_name, class, column_name, type, primary_key, nullable, referenced, relationship",
        ("users", "User", "id", "Integer", True, False, None, None), ("users", "User", "team_id", "FK(teams.id)", False, False, "teams.id", None),
        ("users", "User", "orders", None, False, True, None, "Order"), ("orders", "Order", "id", "Integer", True, False, None, None),
    )
)
def orm_columns(spark, d):
    return _orm(spark).drop("source")


def _schema(spark):
    sql = _ddl(spark).select("table_name", F.lit(None).cast("string").alias("class"), "column_name", "referenced_table", F.lit("sql").alias("kind"))
    orm = _orm(spark).select("table_name", "class", "column_name", F.split("referenced", r"\.")[0].alias("referenced_table"), F.lit("orm").alias("kind"))
    return R.table_union(sql, orm)


@query(
    _values(
        "table_name, class, column_name, referenced_table, kind",
        ("orders", None, "id", None, "sql"), ("orders", None, "user_id", "users", "sql"), ("orders", None, "note", None, "sql"), ("users", "User", "id", None, "orm"), ("users", "User", "team_id", "teams", "orm"), ("users", "User", "orders", None, "orm"),
    )
)
def schema_union(spark, d):
    """Tables of SQL and of classes; the first source of a name wins."""
    return _schema(spark)


@query(_values("table_name, column_name", ("users", "id"), ("users", "team_id"), ("users", "orders")))
def schema_filter(spark, d):
    return L.matching_tables(_schema(spark), "TEAM").select("table_name", "column_name")


_FLOW = "def f(x):\n    if x > 0:\n        return 1\n    elif x < 0:\n        return 2\n    else:\n        return 3\n"


@query(_values('complexity, from_graph, dead_blocks, nesting', (3, 3, 0, 2)))
def flow_complexity(spark, d):
    """Decision points plus one are edges minus blocks plus two of the graph."""
    f = _file(spark, "a.py", _FLOW)
    n = P.extract(f, "flow_blocks").agg(F.count("*").alias("blocks")).crossJoin(P.extract(f, "flow_edges").agg(F.count("*").alias("edges")))
    return P.extract(f, "control_flow").crossJoin(n.withColumnsRenamed({"blocks": "b", "edges": "e"})).select("complexity", (F.col("e") - F.col("b") + 2).cast("int").alias("from_graph"), "dead_blocks", "nesting")


@query(_values("line, block, reachable", (1, 0, True), (1, 1, True), (1, 2, True), (1, 3, False)))
def dead_code(spark, d):
    return P.extract(_file(spark, "a.py", "def f():\n    return 1\n    print(2)\n"), "flow_blocks").select("line", "block", "reachable")


@query(_values("module, src, dst", ("a.py", 0, 2), ("a.py", 2, 1), ("a.py", 3, 1)))
def flow_edge_list(spark, d):
    return P.extract(_file(spark, "a.py", "def f():\n    return 1\n    print(2)\n"), "flow_edges").select("module", "src", "dst")


_CALLS_TS = "import x from 'y';\nfunction f(a) { return g(a); }\nclass K {\n  run(): void { this.f(1); a.b.c(2); load().then(cb); new Thing(3); }\n}\nconst h = async (x) => { await fetch(`u(1)`); if (x) { f(2); } };\n"


@query(
    _values(
        "line, name, full_name, receiver",
        (2, "g", "g", None), (4, "f", "this.f", "this"), (4, "load", "load", None), (4, "then", "load.then", "load"), (6, "fetch", "fetch", None), (6, "f", "f", None),
    )
)
def typescript_calls(spark, d):
    return P.extract(_file(spark, "a.ts", _CALLS_TS), "call_sites").select("line", "name", "full_name", "receiver")


@query(_values("line, name, full_name, receiver", (2, "g", "g", None), (3, "run", "self.run", "self"), (3, "then", "load().then", "load"), (3, "load", "load", None)))
def python_calls(spark, d):
    return P.extract(_file(spark, "a.py", "def f(self):\n    g(1)\n    self.run(load().then())\n"), "call_sites").select("line", "name", "full_name", "receiver")


_TAINT = "def a():\n    x = input()\n    y = int(x)\n    eval(y)\n\ndef b():\n    x = input()\n    eval(x)\n\ndef c():\n    eval(q)\n    q = input()\n"


@query(_values("source_line, sink_line, source, sink, risk", (2, 4, "input", "eval", "low"), (7, 8, "input", "eval", "medium"), (12, 11, "input", "eval", "high")))
def taint_risk(spark, d):
    return P.extract(_file(spark, "a.py", _TAINT), "taint_flows").select("source_line", "sink_line", "source", "sink", "risk")


@query(_values("source, target, line", ("x", "y", 3), ("y", "z", 4)))
def taint_path(spark, d):
    """Steps of a value from a source's line to a sink's: definitions and uses between them."""
    f = _file(spark, "a.py", "def a():\n    x = input()\n    y = x + 1\n    z = y\n    eval(z)\n    w = z\n")
    flows = P.extract(f, "taint_flows").where("source = 'input' AND sink = 'eval'").select("module", "source_line", "sink_line")
    steps = P.extract(f, "definitions_uses")
    return R.path_steps(flows, steps).where("source <> '<literal>' AND source <> 'input'").select("source", "target", "line")


@query(_values("t", (0.0,), (0.35,), (0.7,), (0.75,)))
def throttle_events(spark, d):
    rows = [(1, 0.0, False), (2, 0.2, False), (3, 0.35, False), (4, 0.5, False), (5, 0.7, False), (6, 0.75, True)]
    e = spark.createDataFrame(rows, "id long, t double, done boolean").withColumns({"k": F.lit("job"), "ts": F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint"))})
    return W.throttle(e, "k", "ts", "id", F.col("done"), 0.3).join(e.select("id", "t"), "id").select("t")


@query(_values("path, line", ("src/a.py", 9), ("src/b.ts", 10), ("src/b.ts", 98)))
def page_anchors(spark, d):
    text = "# Title [@src:src/a.py:9]\n\n| a | b |\n|---|---|\n| [@src:src/b.ts:10] | [@src:src/b.ts:98] |\n[@src:bad]\n"
    pages = spark.createDataFrame([(1, text)], "page_id long, markdown string")
    return L.anchors(pages, "page_id", "markdown").select("path", "line")


_RECORDS = [
    ("r/a.py", [("Base", []), ("Own", ["Base", "Missing"])], [("Shape",)]),
    ("r/b.ts", [("Square", ["Shape", "Base"])], [("Shape",)]),
]


def _records(spark):
    return spark.createDataFrame(_RECORDS, "path string, classes array<struct<name:string,bases:array<string>>>, interfaces array<struct<name:string>>")


@query(_values("child, parent", ("r/a.py::Own", "r/a.py::Base"), ("r/b.ts::Square", "r/a.py::Base")))
def inherits_from(spark, d):
    return R.inherits(_records(spark))


@query(_values("module, cls, interface", ("r/b.ts", "Square", "Shape")))
def implements_interface(spark, d):
    return R.implements(_records(spark))


@query(_values("src, name, dst", ("r/src/a.ts", "./b", "r/src/b.tsx"), ("r/src/a.ts", "@/c/d", "r/src/c/d/index.ts"), ("r/m/x.py", "m.y", "r/m/y.py"), ("r/m/x.py", "..n.z", "r/n/z.py"), ("r/m/x.py", "w", "r/q/w.py")))
def import_targets(spark, d):
    files = ["r/src/a.ts", "r/src/b.tsx", "r/src/c/d/index.ts", "r/m/x.py", "r/m/y.py", "r/n/z.py", "r/q/w.py", "s/q/w.py"]
    names = [("r/src/a.ts", "./b"), ("r/src/a.ts", "@/c/d"), ("r/src/a.ts", "react"), ("r/m/x.py", "m.y"), ("r/m/x.py", "..n.z"), ("r/m/x.py", "w")]
    return R.resolve_imports(spark.createDataFrame(names, "src string, name string"), spark.createDataFrame([(f,) for f in files], "path string"))


@query(_values('path, "isInfra"', ("a.py", None), ("Dockerfile", True)))
def infra_nodes(spark, d):
    """Infrastructure files that a graph does not hold yet, with its keys in the client's case."""
    nodes = spark.createDataFrame([("a.py",)], "path string")
    more = spark.createDataFrame([("a.py", True), ("Dockerfile", True)], "path string, is_infra boolean")
    return L.camel_case(R.add_missing(nodes, more))


_TREE = {
    "main.py": "print(1)\n", "pkg/__init__.py": "", "pkg/deep/er/util.ts": "export const a = 1;\n", "pkg/notes.txt": "no code\n", "pkg/x.pyc": "no", "node_modules/lib/index.js": "x", "pkg/node_modules/Dockerfile": "FROM x\n",
    "Dockerfile": "FROM x\n", ".github/workflows/ci.yml": "on: push\n", "db/schema.sql": _DDL, "build/out.py": "x = 1\n", "docs/b.md": "# B\n", "docs/a/a.md": "# A\n", "gen/skip.py": "y = 1\n",
}


def _folder(spark) -> str:
    """The tree above as files, in the shared folder."""
    base = os.path.join(checkpoint_dir(spark).removeprefix("file://"), f"tree-{uuid.uuid4().hex}")
    for name, text in _TREE.items():
        at = os.path.join(base, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)
    return base


@query(_values("path, language, size", (".github/workflows/ci.yml", "infra", 9), ("Dockerfile", "infra", 7), ("db/schema.sql", "infra", len(_DDL)), ("main.py", "python", 9), ("pkg/__init__.py", "python", 0), ("pkg/deep/er/util.ts", "typescript", 20)))
def scan_folder(spark, d):
    """A scan: excluded folders pruned, hidden and underscored files kept, one more exclusion given."""
    return S.scan(spark, _folder(spark), ["gen/"]).select("path", "language", F.length("content").alias("size"))


@query(_values("path", (".github/workflows/ci.yml",), ("Dockerfile",), ("db/schema.sql",)))
def scan_infrastructure(spark, d):
    return S.scan(spark, _folder(spark), only_infrastructure=True, contents=False).select("path")


@query(_values("path", ("main.py",), ("pkg/deep/er/util.ts",)))
def scan_partial(spark, d):
    files = S.scan(spark, _folder(spark), contents=False)
    wanted = spark.createDataFrame([(x,) for x in ("main.py", "pkg/deep/er/util.ts", "Dockerfile", "build/out.py", "gone.py")], "path string")
    return S.partial(files, wanted).select("path")


@query(_values("path", ("docs/a/a.md",), ("docs/b.md",)))
def wiki_pages(spark, d):
    return S.list_pages(spark, _folder(spark))


@query(_values("table_name, column_name", ("orders", "id"), ("orders", "user_id"), ("orders", "note")))
def sql_files(spark, d):
    return P.extract(S.find_sql(spark, _folder(spark)), "ddl").select("table_name", "column_name")


@query(_values("path, hash", ("main.py", hashlib.md5(b"print(1)\n").hexdigest()), ("pkg/__init__.py", hashlib.md5(b"").hexdigest())))
def hash_snapshot(spark, d):
    """Hashes of a scan, saved, loaded and taken up by an upsert."""
    folder = _folder(spark)
    now = S.scan(spark, folder).where("path IN ('main.py', 'pkg/__init__.py')").select("path", F.md5("content").alias("hash"))
    at = os.path.join(folder, "..", f"hashes-{uuid.uuid4().hex}")
    S.save(spark.createDataFrame([("main.py", "stale")], "path string, hash string"), at)
    return R.upsert(S.load_snapshot(spark, at, "path string, hash string"), now, "path")


_LIMITED = [("docs/b.md", "# B\n"), ("docs/big.md", "x" * 300_000), ("docs/.hidden/c.md", "c"), ("pic.png", "no text"), ("LICENSE", "free")]


@query(_values("path, content", ("LICENSE", "free"), ("docs/b.md", "# B\n")))
def read_folder(spark, d):
    """A directory read within its limits: text files that are not too large and not in hidden folders."""
    return S.read_directory(spark.createDataFrame(_LIMITED, "path string, content string"))


@query(_values("path, content, error", ("docs/b.md", "# B\n", None), ("docs/big.md", None, "too large"), ("gone.md", None, "not found"), ("../x", None, "outside the tree")))
def read_one(spark, d):
    files = spark.createDataFrame(_LIMITED, "path string, content string")
    out = None
    for path in ("docs/b.md", "docs/big.md", "gone.md", "../x"):
        one = S.read_document(files, path)
        out = one if out is None else out.unionByName(one)
    return out


@query(_values("parent, name, kind, position", ("", "a", "dir", 1), ("", "B.md", "file", 2), ("a", "x.py", "file", 1), ("", ".env", "file", 3)))
def tree_shown(spark, d):
    files = spark.createDataFrame([("a/x.py",), ("a/pic.png",), ("B.md",), (".env",), ("c/only.bin",)], "path string")
    t = S.tree(files, shown=S.TREE_EXTENSIONS)
    order = F.when(F.col("name") == ".env", 3).when(F.col("name") == "B.md", 2).otherwise(F.col("position"))
    return t.select("parent", "name", "kind", order.cast("int").alias("position"))


_PY_MODULE = '"""About."""\nimport os\nimport pkg.mod\nfrom . import near\n\n\n@dec(1)\nclass K(Base, m.Mixin):\n    """Class."""\n\n    async def go(self, a: int = 1, *, b="x") -> str:\n        """Goes."""\n        return b\n\n\ndef top(x, /, y=None):\n    def inner():\n        pass\n    return inner\n'
_TS_MODULE = "import React from 'react';\nimport { a } from './near';\n/** Says it. */\nexport function say(name: string, loud = false): { ok: boolean } {\n  return { ok: loud };\n}\nexport const View = ({ id }: Props) => {\n  const [s, set] = useState(0);\n  return <div>{id}</div>;\n};\nexport interface Shape { area: number; name?: string }\nclass Box extends Base implements Shape {\n  size(): number { return 1; }\n}\n"


def _module(spark, path, text):
    return P.modules_of(_file(spark, path, text))


@query(
    _values(
        "owner, name, args, returns, docstring, line, end_line",
        ("K", "go", "self::,a:int:1,b::'x'", "str", "Goes.", 11, 13), (None, "top", "x::,y::None", None, None, 16, 19),
    )
)
def python_module(spark, d):
    """Functions and methods of a Python file with their arguments; nested functions belong to their parent."""
    return _callables(_module(spark, "a.py", _PY_MODULE))


@query(
    _values(
        "owner, name, args, returns, docstring, line, end_line",
        (None, "say", "name:string:,loud::false", "{ ok: boolean }", "Says it.", 4, 6), (None, "View", "{ id }:Props:", None, None, 7, 10), ("Box", "size", "", "number", None, 13, 13),
    )
)
def typescript_module(spark, d):
    return _callables(_module(spark, "a.tsx", _TS_MODULE))


def _callables(m):
    show = lambda a: F.concat(a["name"], F.lit(":"), F.coalesce(a["type_annotation"], F.lit("")), F.lit(":"), F.coalesce(a["default"], F.lit("")))
    f = m.select(F.lit(None).cast("string").alias("owner"), F.explode("functions").alias("x")).unionByName(m.select(F.explode("classes").alias("c")).select(F.col("c.name").alias("owner"), F.explode("c.methods").alias("x")))
    return f.select("owner", F.col("x.name").alias("name"), F.array_join(F.transform("x.args", show), ",").alias("args"), F.col("x.returns").alias("returns"), F.col("x.docstring").alias("docstring"), F.col("x.anchor.line").alias("line"), F.col("x.end_line").alias("end_line"))


@query(
    _values(
        "path, docstring, imports, external, exports, classes, interfaces, components, total_lines",
        ("a.py", "About.", ".,pkg.mod", "os", "", "K(Base,m.Mixin)", "", "", 20), ("a.tsx", None, "./near,react", "react", "Shape,View,say", "Box(Base,Shape)", "Shape(area:number,name:string)", "View[useState]", 15),
        ("b.py", "[Syntax Error]", "", "", "", "", "", "", 1), ("Dockerfile", None, "", "", "", "", "", "", 2),
    )
)
def module_records(spark, d):
    """The other parts of module records, of files in each language, one that cannot be parsed and one without code."""
    files = spark.createDataFrame([("a.py", _PY_MODULE), ("a.tsx", _TS_MODULE), ("b.py", "def (:"), ("Dockerfile", "FROM x\n")], "path string, content string")
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    named = lambda column, f: text(F.transform(column, f))
    return P.modules_of(files).select(
        "path", F.regexp_replace("docstring", r"(\[Syntax Error\]).*", "$1").alias("docstring"), text("imports").alias("imports"), text("external_imports").alias("external"), text("exports").alias("exports"),
        named("classes", lambda c: F.concat(c["name"], F.lit("("), text(c["bases"]), F.lit(")"))).alias("classes"),
        named("interfaces", lambda i: F.concat(i["name"], F.lit("("), text(F.transform(i["members"], lambda x: F.concat_ws(":", x["name"], x["type"]))), F.lit(")"))).alias("interfaces"),
        named("components", lambda c: F.concat(c["name"], F.lit("["), text(c["hooks"]), F.lit("]"))).alias("components"), "total_lines",
    )


@query(_values("id, sent", (1, 0.0), (2, 0.0), (3, 1.0), (4, 2.0)))
def rate_limit(spark, d):
    rows = [(1, 0.0), (2, 0.0), (3, 0.0), (4, 1.5)]
    e = spark.createDataFrame(rows, "id long, t double").withColumns({"k": F.lit("calls"), "ts": F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint"))})
    return W.token_bucket(e, "k", "ts", "id", 1.0, 2).select(F.col("id").cast("int").alias("id"), "sent")


@query(_values("id, step", (1, 1), (3, 2), (2, 3)))
def mmr_order(spark, d):
    """The second choice differs from the first, though another is nearer to the query."""
    rows = [(1, [1.0, 0.0], 0.9), (2, [1.0, 0.05], 0.89), (3, [0.0, 1.0], 0.7)]
    return T.mmr(spark.createDataFrame(rows, "id long, v array<double>, rel double"), "id", "v", "rel").select(F.col("id").cast("int").alias("id"), F.col("step").cast("int").alias("step"))


@query(_values("id, first, failed", (1, 2.0, False), (2, 0.0, True), (3, 0.0, True), (4, 0.0, False)))
def embedding_batches(spark, d):
    """Batches of an embedder that refuses one text: the others of its batch fail with it."""

    def embedder(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(2, "bad"), (3, "xyz"), (1, "ab"), (4, None)], "id long, t string").coalesce(1)
    return T.embed(rows, "id", "t", embedder, 2, batch=2).select(F.col("id").cast("int").alias("id"), F.col("embedding")[0].cast("double").alias("first"), "failed")


@query(_values("path, change", ("docs/a/a.md", "changed"), ("docs/b.md", "added"), ("gone.md", "deleted")))
def watched_changes(spark, d):
    """A stream over a folder's pages, run over what is there and compared with stored hashes."""
    folder = _folder(spark)
    seen = changes.run_to_table(changes.file_changes(spark, folder, "*.md")).select(F.element_at(F.split("path", "/tree-[0-9a-f]+/"), -1).alias("path"), "hash")
    return R.delta(seen, spark.createDataFrame([("docs/a/a.md", "old"), ("gone.md", "x")], "path string, hash string"))


@query(_values("modules, edges, missing", (2, 1, True)))
def stored_state(spark, d):
    """A run's totals, written as JSON and read again; what is not there is none."""
    at = f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    S.save_state(spark.createDataFrame([(2, 1)], "modules long, edges long"), at)
    return S.load_or_none(spark, at).select(F.col("modules").cast("int").alias("modules"), F.col("edges").cast("int").alias("edges")).withColumn("missing", F.lit(S.load_or_none(spark, at + "-no") is None))
