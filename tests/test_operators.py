"""Fixtures with hand-worked results."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import parse as P
from lodestone.operators import graph as G
from lodestone.operators import metrics as M
from lodestone.operators import resolve as R
from lodestone.operators import retrieval as T
from lodestone.operators import windows as W
from lodestone.sources import files as S


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, T.keyword_tokens(F.lit("getUserById user_service_impl 订单模块")))
    assert got == ["getUserById", "get", "user", "by", "id", "user_service_impl", "service", "impl", "订单", "单模", "模块"]
    low = one(spark, T.keyword_tokens(F.lower(F.lit("getUserById user_service_impl 订单模块"))))
    assert low == ["getuserbyid", "user_service_impl", "user", "service", "impl", "订单", "单模", "模块"]
    assert one(spark, T.identifier_parts(F.lit("HTTPServer"))) == ["HTTP", "Server"]
    assert one(spark, T.identifier_parts(F.lit("kebab-case-x"))) == ["kebab", "case"]


def test_rank_fusion(spark):
    a = spark.createDataFrame([("d1", 1), ("d2", 2)], "k string, rank int")
    b = spark.createDataFrame([("d2", 1), ("d3", 2)], "k string, rank int")
    got = {r["k"]: round(r["score"], 4) for r in T.rrf([a, b], "k").collect()}
    assert got == {"d2": 0.0325, "d1": 0.0164, "d3": 0.0161}
    assert got == {r["k"]: round(r["score"], 4) for r in T.rrf([b, a], "k").collect()}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "b")], "src string, dst string")
    dag = e.where("src <> dst")
    seen = {r["node"]: r["depth"] for r in G.reach(dag, spark.createDataFrame([("c",)], "node string"), None, reverse=True).collect()}
    assert seen == {"c": 0, "b": 1, "a": 2}
    assert {r["node"]: r["depth"] for r in G.longest_chain(dag).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert G.shortest_path(e, "a", "d").first()["path"] == ["a", "b", "c", "d"]
    assert G.shortest_path(e, "d", "a").count() == 0
    five = dag.union(spark.createDataFrame([("x", "x2")], "src string, dst string")).where("src <> 'x'")
    rank = {r["node"]: round(r["rank"], 4) for r in G.page_rank(five, 1).collect()}
    assert rank == {"a": 0.0375, "b": 0.25, "c": 0.25, "d": 0.25}
    two = e.union(spark.createDataFrame([("y", "z"), ("z", "y")], "src string, dst string"))
    assert {r["node"]: r["component"] for r in G.components(two).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "y": "y", "z": "y"}
    assert G.components(e.where("false")).count() == 0 and G.page_rank(e.where("false")).count() == 0
    assert [r["node"] for r in G.isolated(spark.createDataFrame([("a",), ("q",)], "node string"), e, "node").collect()] == ["q"]


def test_components_of_a_long_chain(spark):
    e = spark.range(300).select(F.format_string("n%04d", F.col("id")).alias("src"), F.format_string("n%04d", F.col("id") + 1).alias("dst"))
    assert [r["component"] for r in G.components(e).select("component").distinct().collect()] == ["n0000"]


def test_delta(spark):
    old = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, hash string")
    new = spark.createDataFrame([("q", "2"), ("r", "9"), ("s", "4")], "path string, hash string")
    assert {r["path"]: r["change"] for r in R.delta(new, old).collect()} == {"p": "deleted", "q": "same", "r": "changed", "s": "added"}


def test_health_score(spark):
    facts = spark.createDataFrame([Row(avg_cc=5.0, max_cc=12.0, avg_coupling=4.0, max_coupling=7.0, functions=10, isolated=3, dead=0, lines=1000, coverage=0.4, churned=0, long=1, wide=0, god=1, classes=2)])
    assert facts.select(M.health_score().alias("s")).first()["s"] == 77.9


def test_innermost_and_calls(spark):
    spans = spark.createDataFrame([("m", 1, 20, "outer"), ("m", 5, 10, "inner")], "module string, s int, e int, id string")
    points = spark.createDataFrame([("m", 7), ("m", 15), ("m", 30)], "module string, line int")
    assert {r["line"]: r["id"] for r in R.innermost(points, spans, "module", "line", "s", "e", "id").collect()} == {7: "inner", 15: "outer"}
    known = spark.createDataFrame([("a::f", "f", "a"), ("b::f", "f", "b"), ("a::C.g", "g", "a"), ("a::D.g", "g", "a"), ("b::g", "g", "b")], "id string, name string, module string")
    sites = spark.createDataFrame([("a", "f", "f", None), ("a", "g", "g", None), ("a", "print", "print", None), ("a", "g", "self.g", "self"), ("c", "h", "h", None)], "module string, name string, full_name string, receiver string")
    got = {(r["name"], r["receiver"]): r["callee"] for r in R.resolve_calls(sites, known).collect()}
    assert got == {("f", None): "a::f", ("g", None): "b::g", ("print", None): None, ("g", "self"): "a::C.g", ("h", None): None}


def test_implicit_keys(spark):
    cols = spark.createDataFrame([("events", "user_id"), ("labels", "doc_id"), ("turns", "conv_id"), ("pages", "page_id"), ("x", "zip_id")], "table_name string, column string")
    names = spark.createDataFrame([("user",), ("docs",), ("convs",), ("pages",)], "table_name string")
    assert {r["column"]: r["target"] for r in R.implicit_keys(cols, names).collect()} == {"user_id": "user", "doc_id": "docs", "conv_id": "convs"}


def test_debounce_and_throttle(spark):
    at = lambda ms: F.timestamp_micros(F.lit(ms * 1000))
    df = spark.createDataFrame([(0, "a"), (300, "b"), (700, "a"), (2000, "c")], "ms long, path string").withColumn("ts", F.timestamp_micros(F.col("ms") * 1000)).withColumn("k", F.lit(1))
    got = sorted((r["started"].timestamp(), r["events"]) for r in W.sessions(df, ["k"], "ts", 0.5).collect())
    assert [n for _, n in got] == [3, 1]
    t = spark.createDataFrame([(0, False), (200, False), (350, False), (500, False), (700, False), (750, True)], "ms long, done boolean").withColumn("ts", F.timestamp_micros(F.col("ms") * 1000)).withColumn("k", F.lit(1))
    assert sorted(r["ms"] for r in W.throttle(t, "k", "ts", "ms", F.col("done")).collect()) == [0, 350, 700, 750]


def test_history(spark):
    t = spark.createDataFrame([(1, 3000), (2, 2000), (3, 1500), (4, 1000)], "turn_no int, n int").withColumn("k", F.lit(1))
    assert sorted(r["turn_no"] for r in W.history(t, ["k"], F.desc("turn_no"), F.col("n")).collect()) == [2, 3, 4]


def test_exclusion_and_scan(spark, tmp_path):
    p = spark.createDataFrame([("__pycache__/a.py",), ("x/node_modules/b.js",), ("c.pyc",), ("src/d.py",)], "path string")
    assert [r["e"] for r in p.select(C.excluded(F.col("path")).alias("e")).collect()] == [True, True, True, False]
    for name, text in {"src/d.py": "x = 1\n", "node_modules/e.js": "1", "Dockerfile": "FROM x", "notes.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["language"] for r in S.scan(spark, f"file:{tmp_path}").select("path", "language").collect()}
    assert got == {"src/d.py": "python", "Dockerfile": "infra"}
    assert S.load_or_none(spark, f"{tmp_path}/none.json") is None
    assert S.load_snapshot(spark, f"{tmp_path}/none", "path string, hash string").count() == 0


def test_parsers():
    cc = list(P.control_flow("m", "def f(x):\n  if x > 0:\n    return 1\n  elif x < 0:\n    return 2\n  else:\n    return 3\n"))
    assert cc[0][1] == "f" and cc[0][5] == 3
    ddl = list(P.parse_ddl("s", "CREATE TABLE orders (id INT PRIMARY KEY, user_id INT NOT NULL, price DECIMAL(10,2), FOREIGN KEY (user_id) REFERENCES users(id));"))
    assert [(r[2], r[4], r[5], r[6]) for r in ddl] == [("id", True, False, None), ("user_id", False, False, "users"), ("price", False, True, None)]
    m = P.parse_module("a/b.py", "import os\nfrom x.y import z\nasync def f(a: int, b=1, *, c): 'doc'\nclass A(B):\n  def g(self): pass\n")
    assert m["imports"] == ["x.y"] and m["external_imports"] == ["os"] and [a["name"] for a in m["functions"][0]["args"]] == ["a", "b", "c"] and m["classes"][0]["methods"][0]["name"] == "g"
    t = P.parse_module("a/b.tsx", "import x from '@s/p/q';\nexport interface P { a: string; b?: number }\nexport function View(props: P) { const [a] = useState(1); return <p>{a}</p>; }\nclass K extends L { go(a: number): void { f(); } }\n")
    assert t["external_imports"] == ["@s/p"] and t["components"][0]["hooks"] == ["useState"] and t["classes"][0]["methods"][0]["name"] == "go" and len(t["interfaces"][0]["members"]) == 2
    assert "error" in P.parse_module("x.py", "def (")
    orm = list(P.parse_orm("m", "class User(Base):\n  __tablename__ = 'users'\n  id = Column(Integer, primary_key=True)\n  team = Column(Integer, ForeignKey('teams.id'))\n  posts = relationship('Post')\n"))
    assert [(r[1], r[3], r[4]) for r in orm] == [("users", "id", "Integer"), ("users", "team", "FK(teams.id)"), ("users", "posts", None)]
    flows = list(P.taint_flows("m", "def f():\n  x = input()\n  y = html.escape(x)\n  eval(y)\n"))
    assert ("m", 2, 4, "input", "eval", "low") in flows


def test_core_stands_alone():
    """The core does not know the training-data subpackage."""
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1] / "lodestone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", p.read_text()), p


def test_labels(spark):
    from lodestone.operators import labels as L

    assert one(spark, L.safe_label(F.lit('a["x"]<b>'))) == "a('x')⟨b⟩"
    page = spark.createDataFrame([(1, "# T [@src:a/b.py:9]\n| x [@src:a/b.py:10] | [@src:c.ts:98] |")], "id int, text string")
    assert [(r["path"], r["line"]) for r in L.anchors(page, "id", "text").collect()] == [("a/b.py", 9), ("a/b.py", 10), ("c.ts", 98)]


def test_control_flow_graph():
    def graph(body):
        text = "def f(x):\n" + "".join(f"  {x}\n" for x in body.split("\n"))
        (row,) = P.control_flow("m", text)
        return row[3], row[4], row[7]

    assert graph("a = 1\nb = 2\nreturn a") == (3, 2, 0)
    assert graph("if x > 0:\n  return 1\nelif x < 0:\n  return 2\nelse:\n  return 3") == (7, 8, 0)
    assert graph("if x:\n  a = 1\nb = 2") == (5, 5, 0)
    assert graph("for i in x:\n  if i:\n    continue\n  a = i\nreturn a") == (7, 8, 0)
    assert graph("return 1\na = 2\nb = 3") == (4, 3, 1)
    assert graph("while True:\n  if x:\n    break\nreturn 1") == (6, 6, 0)
    assert [graph(b)[2] for b in (
        "while True:\n  x()\na = 1", "raise E\nif x:\n  a = 1", "if x:\n  return 1\nelse:\n  raise E\na = 1", "for i in x:\n  break\n  a = 1", "if False:\n  a = 1\nreturn x",
        "try:\n  return x()\nfinally:\n  y()\na = 1", "match x:\n  case 1:\n    return 1\n  case _:\n    return 2\na = 1",
    )] == [1, 2, 1, 1, 1, 1, 1]
    assert [graph(b)[2] for b in (
        "try:\n  return x()\nexcept E:\n  pass\na = 1", "with x:\n  return 1\na = 1", "try:\n  raise E\nexcept E:\n  a = 1\nfinally:\n  y()\nb = 1", "while x:\n  try:\n    break\n  finally:\n    y()\nelse:\n  a = 1\nb = 1",
        "match x:\n  case 1:\n    return 1\na = 1", "for i in x:\n  try:\n    continue\n  except E:\n    return 1\nb = 1", "try:\n  a = 1\nexcept E:\n  raise\nelse:\n  b = 1\nc = 1",
    )] == [0] * 7


def test_chains_on_cycles_are_those_of_the_condensation(spark):
    from lodestone.operators import graph as G

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "d"), ("x", "x"), ("d", "e"), ("a", "b")], "src string, dst string")
    assert {(r.node, r.component) for r in G.strong_components(G.edges(e)).collect()} == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "e"), ("x", "x")}
    assert {(r.node, r.depth) for r in G.longest_chain(G.edges(e)).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("x", 0)}


def test_truncation_keeps_characters_whole(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import retrieval as R

    texts = [c * k + "z" * j for c in "aéの😀" for k in (1, 3, 5) for j in (0, 1, 2, 3, 9)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (1, 4, 7, 10):
        got = [r[0] for r in df.select(R.truncate_utf8(F.col("t"), limit, "#")).collect()]
        want = [t if t is None or len(t.encode()) <= limit else t.encode()[:limit].decode("utf-8", "ignore") + "#" for t in texts]
        assert got == want


def test_recursive_split_keeps_all_text():
    from lodestone.operators import retrieval as R

    text = "\n\n".join(f"def f{i}(a):\n    return a + {i}" for i in range(400)) + "x" * 5000
    got = R.split_recursively(text, R.SEPARATORS["python"])
    assert all(0 < len(p) <= 2000 for p in got) and all(p in text for p in got) and sum(map(len, got)) >= len(text)


def test_index_is_stored_and_read(spark, tmp_path):
    from lodestone.operators import retrieval as R

    d = spark.createDataFrame([(1, "getUserById user_service_impl 订单模块"), (2, "user"), (2, "user"), (3, None), (None, "user")], "doc_id long, text string")
    index = R.build_index(d)
    assert {(r.key, r.term) for r in index.postings.collect()} == {(1, t) for t in ("getuserbyid", "user_service_impl", "user", "service", "impl", "订单", "单模", "模块")} | {(2, "user")}
    R.save_index(index, str(tmp_path / "i"))
    again = R.load_index(spark, str(tmp_path / "i"))
    want = {tuple(r) for r in R.bm25(index, ["service", "user"]).collect()}
    assert {tuple(r) for r in R.bm25(again, ["service", "user"]).collect()} == want and len(want) >= 1
